"""Language model, language, quality, leaks, joins, token counts and packing against plain versions, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracklens.llm import decontaminate, hmm, jaccard, langid, packing, quality, unigram
from tracklens.llm.common import fold, table
from tracklens.llm.components import components
from tracklens.llm.tokenizers_io import byte_bpe, default_path
from tracklens.llm.words import words_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns with names that operators use themselves.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, sig long, n long, key long, x string, predicted int, held_out string, row long, component_id long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def odd_rows():
    rng = random.Random(1)
    w = ["alpha", "beta", "gamma", "delta", "omega", "The", "été", "naïve", "日本", "x1"]
    text = " ".join(rng.choice(w) for _ in range(60))
    near = text.split()
    near[30] = "changed"
    texts = [None, "", "   \t\n", "one", "one two three four", "One two three four", text, text, text.upper(), " ".join(near), text * 300, "!!! ??? 123", "a\x0bb\x0cc d e", "  lead and\ttrail  ", "日本語の長い文" * 40, "\U0001f600 é"]
    rows = [(i, t, None if i % 5 == 4 else "en", None, None) for i, t in enumerate(texts)]
    return [*rows, (3, "one", "en", "s", 3), (None, text, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 0.5, 1, 2, 3, "x", 1, "h", 4, 5) for r in odd_rows()]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def empty(df):
    return df.filter("false")


def test_words_equal_a_regular_expression():
    texts = [r[1] for r in odd_rows()]
    seen = {}
    for w in words_of(pa.array(texts)):
        for i in range(len(w.first) - 1):
            own = words(texts[w.row0 + i])
            got = w.hashes[w.first[i] : w.first[i + 1]].tolist()
            assert len(own) == len(got)
            for a, b in zip(own, got, strict=True):
                assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def in_fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def plain_base(rows):
    counts, n = Counter(), 0
    for d, t in rows:
        if in_fold(d, 7) != 2:
            tokens = [*words(t), None]
            counts.update(tokens)
            n += len(tokens)
    v, out = len(counts), []
    for d, t in rows:
        tokens = [*words(t), None]
        out.append((d, in_fold(d, 7) == 2, len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_language_model_base(request, which):
    df = request.getfixturevalue(which)
    got = hmm.score(df, fold(df.doc_id, 7) == 2, head=300, own=50).collect()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(plain_base(rows), key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_beats_base_on_held_out_texts(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    r = hmm.score(df, fold(df.doc_id, 7) == 2).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s > r.b + 0.05 * r.n


def test_language_model_of_nothing(docs):
    assert hmm.score(empty(docs), F.lit(False)).count() == 0
    r = hmm.score(docs.limit(3), F.lit(True)).collect()
    assert len(r) == 3 and all(x.train_tokens == 0 and x.base_score == 0 and math.isfinite(x.score) for x in r)


def tiny_lexicon(classes):
    mass = np.arange(1.0, classes + 1)
    return hmm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), classes - hmm.BUCKETS, mass, 10, 5)


def test_forward_equals_summed_paths_and_is_a_distribution():
    import itertools

    lex = tiny_lexicon(hmm.BUCKETS + 3)
    m = hmm.Model.initial(lex, 3)
    tok = np.array([1, 2, 0, 7])
    want = 0.0
    for path in itertools.product(range(3), repeat=4):
        p = m.start[path[0]] * m.emit[path[0], tok[0]]
        for i in range(1, 4):
            p *= m.move[path[i - 1], path[i]] * m.emit[path[i], tok[i]]
        want += p
    assert hmm.forward(m, tok, np.array([0, 4]))[0] == pytest.approx(math.log10(want))
    every = np.array(list(itertools.product(range(len(lex.mass)), repeat=2))).ravel()
    assert (10 ** hmm.forward(m, every, np.arange(0, len(every) + 1, 2))).sum() == pytest.approx(1.0)


def test_baum_welch_counts_equal_enumeration_and_raise_likelihood():
    lex = tiny_lexicon(hmm.BUCKETS + 4)
    m = hmm.Model.initial(lex, 2)
    tok = np.array([1, 2, 0, 3, 3, 1])
    c = hmm.Counts(2, len(lex.mass))
    c.add(m, tok, np.array([0, 4, 6]))
    assert c.emit.sum() == pytest.approx(6, rel=1e-4) and c.move.sum() == pytest.approx(4, rel=1e-4) and c.start.sum() == pytest.approx(2, rel=1e-4)
    assert c.emit[:, 3].sum() == pytest.approx(2, rel=1e-4)
    assert c.log == pytest.approx(hmm.forward(m, tok, np.array([0, 4, 6])).sum(), rel=1e-4)
    logs = []
    for _ in range(6):
        c = hmm.Counts(2, len(lex.mass))
        c.add(m, tok, np.array([0, 4, 6]))
        logs.append(c.log)
        m = hmm.Model.maximised(c, lex, prior=0.0001)
    assert logs[-1] > logs[0]


@pytest.mark.parametrize("own", [50, 70_000])
def test_stored_classes_give_the_counts_of_all_texts(spark, odd, own):
    words_used = ["the", "of", "Data", "\u00e9t\u00e9"]
    plain = pa.array([r.text for r in odd.select("text").collect()])
    (w,) = words_of(pa.array([" ".join(words_used)]))
    keys = np.sort(hmm.token_keys(w)[0])
    lex = hmm.Lexicon(keys, np.full(len(keys), 9), np.arange(len(keys)), own, np.ones(own + hmm.BUCKETS), 99, len(keys))
    model, want = hmm.Model.initial(lex, 2), hmm.Counts(2, len(lex.mass))
    for w in words_of(plain):
        tokens, bounds = hmm.token_keys(w)
        want.add(model, lex.encode(tokens)[0], bounds)
    got = hmm.expected_counts(hmm.encoded(odd, lex), lex, model)
    for x in ("start", "move", "emit", "log"):
        assert getattr(got, x) == pytest.approx(getattr(want, x), rel=1e-3, abs=1e-3)


def test_language_identification(spark, odd, docs):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(df, fold(df.doc_id, 5) == 0)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    r = got.join(df.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.95
    rows = langid.identify(odd, fold(odd.doc_id, 5) == 0).collect()
    assert len(rows) == len(odd_rows())
    by = dict(enumerate(odd_rows()))
    for x in rows:
        texts = [t for d, t, *_ in by.values() if d == x.doc_id]
        if not any(any(map(str.isalpha, t or "")) for t in texts):
            assert (x.lang_pred, x.score) == ("und", 0.0)
    assert langid.identify(empty(docs), F.lit(False)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in langid.identify(none, F.lit(False)).collect()} == {"und"}


def test_network_windows_cover_whole_texts():
    net = langid.fit(["der die und das ist " * 11, "the and of that is to " * 10] * 20, ["de", "en"] * 20, epochs=6)
    tables = net.tables()
    w, first = langid.windows_of(("the and of that " * 64).encode(), b"", b"x" * 257)
    assert w.shape == (7, 256) and first.tolist() == [0, 4, 5, 7]
    rng = np.random.default_rng(4)
    w = np.vstack([w, rng.choice(np.unique(langid.SEEN), (300, 256)).astype(np.uint8)])
    for row, got in zip(w, net.features(w, tables), strict=True):
        slow, x = [], row.astype(int)
        for f, width in zip(net.filters, langid.WIDTHS, strict=True):
            slow.append(sum(f[j][x[j : j + 256 - width + 1]] for j in range(width)).max(0))
        assert np.allclose(got, np.maximum(np.hstack(slow) + net.shift, 0), atol=1e-4)
    texts = ["the and of that is", "", "der die und das ist", "12 !!", "the and of that is der " * 400]
    got = langid.told(texts, net, tables)
    assert [x[0] for x in got[:4]] == ["en", "und", "de", "und"]


def test_language_of_texts_equals_a_plain_network(spark, odd, docs):
    """The whole query against windows, sums and means written out one by one."""
    for df in (docs, odd):
        held = fold(df.doc_id, 5) == 0
        net = langid.fit(*langid.sample(df, ~held))
        want = []
        for r in df.select("doc_id", "text").collect():
            t = r.text or ""
            if not any(c.isalpha() for c in t):
                want.append((r.doc_id, "und", 0.0))
                continue
            b = bytes(langid.SEEN[c] for c in t.encode())
            z, n = np.zeros(len(net.langs)), 0
            for i in range(0, max(1, len(b)), 256):
                x = np.frombuffer(b[i : i + 256].ljust(256), np.uint8).astype(int)
                h = np.hstack([sum(f[j][x[j : 257 - width + j]] for j in range(width)).max(0) for f, width in zip(net.filters, langid.WIDTHS, strict=True)])
                letters = int((x != 32).sum())
                z += letters * (np.maximum(h + net.shift, 0) @ net.dense + net.bias)
                n += letters
            p = np.exp(z / max(1, n) - (z / max(1, n)).max())
            want.append((r.doc_id, net.langs[int(p.argmax())], float(p.max() / p.sum())))
        got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, held).collect()), key=repr)
        want.sort(key=repr)
        assert [g[:2] for g in got] == [x[:2] for x in want]
        assert np.allclose([g[2] for g in got], [x[2] for x in want], atol=1e-4)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 1100) * 9} word", f"l{i % 1100:04d}") for i in range(2200)]
    texts, langs = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(set(langs)) == 1100 and len(texts) == 2200


def test_quality(spark, odd, docs):
    df, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.assess(df, labels, fold(df.doc_id, 5) == 0)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    r = got.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert r > 0.95
    rows = quality.assess(odd, labels, fold(odd.doc_id, 5) == 0).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)
    assert {x.score for x in quality.assess(docs, empty(labels), F.lit(False)).collect()} == {0.5}
    assert quality.assess(empty(docs), labels, F.lit(False)).count() == 0


def plain_statistics(text):
    share = lambda x: math.log((min(max(x, 0), 1) + 0.002) / (1.002 - min(max(x, 0), 1)))
    raw, ws = (text or "").encode(), [x.encode() for x in WORD.findall(text or "")]
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    digit = lambda b: 48 <= b <= 57
    odd = lambda b: b in quality.SIGNS and b not in quality.PROSE_SIGNS
    n, size = max(1, len(ws)), max(1, sum(map(len, ws)))
    every = [b for x in ws for b in x]
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in ws]
    times = Counter(low)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return [
        math.log1p(len(ws)), math.log(size / n), share(sum(65 <= b <= 90 for b in every) / max(1, sum(map(letter, every)))), share(sum(map(digit, every)) / size), share(sum(map(odd, every)) / size),
        math.log((sum(b in quality.STOPS for b in every) + 0.5) / n), share(sum(not any(letter(b) or digit(b) for b in x) for x in ws) / n),
        share(sum(any(map(letter, x)) and any(digit(b) or odd(b) for b in x) for x in ws) / n), share(sum(len(x) > 18 for x in ws) / n),
        share(sum(any(a in quality.SIGNS and b in quality.SIGNS for a, b in zip(x, x[1:], strict=False)) for x in ws) / n), math.log1p(len(times)) - 0.85 * math.log1p(len(ws)),
        share(max(times.values()) / n if len(ws) > 4 else 0.05), share(sum(a == b for a, b in zip(low, low[1:], strict=False)) / n), math.log1p(len(set(raw) - {32, 9, 10, 11, 12, 13})),
        share(sum(len(x) < 20 for x in lines) / max(1, len(lines))), share(1 - len(set(lines)) / max(1, len(lines))),
    ]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_equals_a_plain_version(request, spark, which):
    """The whole query: statistics one text at a time, densities from covariances, then slope and shift."""
    df, labels = request.getfixturevalue(which), table(spark, SF, "labels")
    held = fold(df.doc_id, 5) == 0
    rows = df.select("doc_id", "text").collect()
    x = np.array([plain_statistics(r.text) for r in rows])
    model = quality.train(quality.with_statistics(df.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text"), ["doc_id", "held_out"]), labels, ~F.col("held_out"))
    got = sorted(((r.doc_id, r.score) for r in quality.assess(df, labels, held).collect()), key=repr)
    if model is None:
        assert {g[1] for g in got} == {0.5}
        return
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    logs = []
    for mean, f, o in zip(model.means, model.factors, model.offsets, strict=True):
        logs.append(o - 0.5 * np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(f @ f.T), z - mean))
    want = 1 / (1 + np.exp(-np.clip(model.slope * (logs[1] - logs[0]) + model.shift, -40, 40)))
    want = sorted(((r.doc_id, s) for r, s in zip(rows, want, strict=True)), key=repr)
    assert [g[0] for g in got] == [x[0] for x in want]
    assert np.allclose([g[1] for g in got], [x[1] for x in want], atol=1e-6)


def test_discriminant_equals_densities():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    y = np.r_[np.zeros(200, int), np.ones(300, int)]
    m = quality.fit(x, y)
    z = (x[:5] - m.centre) / m.scale
    logs = []
    for mean, f, n in zip(m.means, m.factors, (200, 300), strict=True):
        cov = f @ f.T
        logs.append([math.log(n / 500) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * (v - mean) @ np.linalg.inv(cov) @ (v - mean) for v in z])
    assert np.allclose(m.margin(x[:5]), np.array(logs[1]) - np.array(logs[0]))
    assert quality.fit(x, np.zeros(500, int)) is None


def plain_components(rows):
    sets = []
    for d, t in rows:
        w = words(t)
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.append(s)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    return sorted(((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def chained_rows():
    """Near copies in chains, groups around a hot passage, and sizes on the edge of the threshold."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(4000)]
    hot = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 9)):
            base = list(base)
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            rows.append(" ".join(base))
    for _ in range(40):
        rows.append(" ".join([*hot, *(rng.choice(vocab) for _ in range(rng.choice((2, 12, 18, 20, 24, 80))))]))
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("which", ["docs", "odd", "chains"])
def test_jaccard_join_equals_all_pairs(request, spark, which, monkeypatch):
    if which == "chains":
        df = spark.createDataFrame(chained_rows(), "doc_id long, text string")
        monkeypatch.setattr(jaccard, "BLOCK", 16)
    else:
        df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=repr)
    assert got == plain_components(rows)


def test_jaccard_join_of_nothing(docs):
    assert jaccard.join(empty(docs)).count() == 0


def test_one_of_each(spark, odd):
    rows = chained_rows()
    df = spark.createDataFrame([*rows, rows[0], (1, ""), (2, None)], "doc_id long, text string")
    got = sorted(r.doc_id for r in jaccard.one_of_each(df).collect())
    assert got == sorted({c for _, n, c in plain_components(rows) if n} | {1, 2})
    assert jaccard.one_of_each(odd).columns == odd.columns
    clash = df.selectExpr("doc_id", "text", "1 as _sig", "2 as _SIG_", "3 as sig", "4 as gone")
    assert sorted(r.doc_id for r in jaccard.one_of_each(clash).collect()) == got


def test_only_doubtful_rows_are_joined(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(40)]
    data = [*enumerate(words), (100, words[3]), (None, words[5]), (7, words[7]), (8, "other " * 9)]
    kept = jaccard.one_of_each(spark.createDataFrame(data, "doc_id long, text string"))
    plan = kept._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "LeftAnti" in plan.toString() and "LeftAnti" not in plan.children().apply(0).toString()
    want = [(i, t) for i, t in enumerate(words) if i != 5] + [(None, words[5]), (8, "other " * 9)]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("rows", ["3", "1000"])
def test_shared_keys_equal_plain_groups(spark, rows):
    """Groups that begin, end and repeat rows anywhere in batches of a few rows."""
    from tracklens.llm.common import arrow_rows

    rng = random.Random(13)
    data = [(k, s, (k * 7 + s) % 50) for k in range(120) for s in rng.choices(range(9), k=rng.choice((1, 1, 2, 3, 12)))]
    sets = defaultdict(set)
    for k, s, _ in data:
        sets[k].add(s)
    df = spark.createDataFrame(data, "key long, sig long, pos int").repartition(5)
    with arrow_rows(spark, int(rows)):
        got = sorted((r.key, r.sig, r.pos, r.hub) for r in jaccard.shared_keys(df).collect())
    assert got == sorted((k, s, (k * 7 + s) % 50, min(v)) for k, v in sets.items() if len(v) > 1 for s in v)


def test_groups_with_equal_members_are_one_before_components(spark):
    groups = {1: {(1, 4), (2, 0)}, 2: {(1, 3), (2, 5)}, 3: {(1, 9), (2, 9), (3, 9)}, 4: {(2, 1), (3, 1)}}
    df = spark.createDataFrame([(k, s, pos, min(v)[0]) for k, v in groups.items() for s, pos in v], "key long, sig long, pos int, hub long")
    got = sorted(tuple(r) for r in jaccard.unlike_groups(df).collect())
    assert got == sorted((k, s, pos) for k in (2, 3, 4) for s, pos in groups[k])


@pytest.mark.parametrize("likeliest", [True, False])
def test_vectors_travel_twice_at_most(spark, likeliest):
    """Once to their rows, and with these to their blocks, however groups are split."""
    rows = spark.createDataFrame([(1, 2, 1, 1, 0, True)], "grp long, blocks int, sig long, comp long, pos int, asks boolean")
    points = spark.createDataFrame([(1, 0, 8, b"")], "sig long, doc_id long, n long, vec binary")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        plan = jaccard.survivors(rows, points, likeliest)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange ") == 3  # rows, points, and both together


def test_frequent_shingles_equal_plain_counts(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE_PART", 1)
    sets = {frozenset(u.tolist()) for w in words_of(pa.array([r.text for r in docs.select("text").collect()])) for u in jaccard.shingles(w)}
    times = Counter(k for u in sets for k in u)
    from tracklens.llm.common import arrow_rows

    for rows in (7, 10_000):
        with arrow_rows(spark, rows):
            assert sorted(jaccard.frequent_shingles(docs.repartition(4)).tolist()) == sorted(k for k, n in times.items() if n >= 2)


def test_points_lose_nothing():
    rng = np.random.default_rng(3)
    sets = []
    for size in (30, 200, 480, 520, 700, 1000, 1100, 4000, 9000):
        for _ in range(25):
            base = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
            for gone in (0, size // 9, size // 5, size // 4):
                sets.append(np.unique(base[gone:]))
    sizes = np.array([len(u) for u in sets])
    caps = sizes - rng.integers(0, 1 + sizes // 4)
    points = jaccard.Points(sizes, caps, [jaccard.counted(u) for u in sets])
    assert len(points.kinds) > 4
    pruned = 0
    for i in range(0, len(sets), 7):
        hit, both = points.search(points.own(i), int(sizes[i]), int(caps[i]))
        bound = dict(zip(hit.tolist(), both.tolist(), strict=True))
        for j in range(len(sets)):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 7 * min(k, caps[i], caps[j]) >= 3 * (sizes[i] + sizes[j]):
                assert bound[j] >= k
        pruned += len(sets) - len(bound)
    assert pruned > 0.9 * len(sets) * len(range(0, len(sets), 7))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(1000, i) for i in range(1001, 1100)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100} | {i: 1000 for i in range(1000, 1100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaks(spark, odd):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocab[:50]) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(15, 60))) for i in range(20)] + [(50, None), (51, "..."), (52, say(200))]
    rows, want = [], set()
    for d in range(300):
        body = say(rng.randint(5, 400)).split()
        if d % 10 == 0:
            item = items[d // 10 % 20] if d % 40 else items[22]
            w = item[1].split()
            if d % 20:
                w[len(w) // 2] = "swapped"
                w.insert(3, "added")
            at = rng.randint(0, len(body))
            body[at:at] = [x.capitalize() + "," for x in w]
            want.add((d, item[0]))
        rows.append((d, " ".join(body)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    left = decontaminate.without_leaks(df, bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.find_leaks(empty(df), bench).count() == 0
    assert decontaminate.find_leaks(df, empty(bench)).count() == 0
    assert decontaminate.without_leaks(odd, bench).count() == len(odd_rows())


def test_paraphrase_needs_its_answer(spark):
    rng = random.Random(6)
    say = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    q = say(20)
    para = [x if i % 2 else f"other{i}" for i, x in enumerate(q)]
    bench = spark.createDataFrame([(1, " ".join(q), "forty two")], "item_id long, text string, answer string")
    rows = [(1, " ".join([*say(30), *para, "forty", "two", *say(30)])), (2, " ".join([*say(30), *para, *say(30)]))] + [(i, " ".join(say(200))) for i in range(3, 60)]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert [r.doc_id for r in got.collect()] == [1]


def test_paraphrases_equal_brute_force(spark):
    """Items with a part of their words kept in order, the others swapped, in texts of other words: every text against every item."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(60_000)]
    common = vocab[:60]
    say = lambda n: [rng.choice(common) if rng.random() < 0.3 else rng.choice(vocab) for _ in range(n)]
    items = [(i, say(rng.randint(20, 60))) for i in range(40)]
    rows, kept = [], {}
    for d in range(1200):
        body = say(rng.randint(30, 300))
        if d % 4 == 0:
            i, item = items[d // 4 % 40]
            share = rng.choice((0.2, 0.35, 0.55, 0.6, 0.7))
            stay = set(rng.sample(range(len(item)), math.ceil(share * len(item))))
            at = rng.randint(0, len(body))
            body[at:at] = [x if j in stay else rng.choice(vocab[60:]) for j, x in enumerate(item)]
            kept[d] = share
        rows.append((d, " ".join(body)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.find_leaks(df, bench).collect()}
    own = decontaminate.read_items(bench)
    want = {}
    (w,) = words_of(decontaminate.plain(pa.array([t for _, t in rows])))
    for r in range(len(rows)):
        ws = w.hashes[w.first[r] : w.first[r + 1]].tolist()
        for it in own:
            hits = [k for k, x in enumerate(ws) if x in it.masks]
            if len(hits) >= 0.5 * len(it.words):
                share = max(decontaminate.common_length(it.masks, len(it.words), ws[a : a + it.span]) for a in hits) / len(it.words)
                if share >= 0.5:
                    want[r, it.item_id] = share
    assert {d for d, k in kept.items() if k >= 0.5} <= {d for d, _ in want}
    assert all(want.get(k) == share for k, share in got.items())
    assert {k for k, share in want.items() if share >= 0.65} <= set(got)
    close = {k for k, share in want.items() if share < 0.65}
    assert len(close) > 50 and len(close & set(got)) >= 0.9 * len(close)


def frequent_leaks():
    """Documents of own words, a tenth of which hold one of two items, whole or with every fifth word swapped, so that all of its words are common."""
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, say(20)) for i in range(2)]
    rows, want = [], set()
    for d in range(1500):
        body = say(120)
        if d % 10 == 0:
            i, item = items[d // 10 % 2]
            body[50:50] = [f"x{d}" if d % 20 and j % 5 == 0 else x for j, x in enumerate(item)]
            want.add((d, i, 0.8 if d % 20 else 1.0))
        rows.append((d, " ".join(body)))
    return rows, [(i, " ".join(x)) for i, x in items], want


def test_frequent_leaks_are_found_in_any_partitioning(spark):
    rows, items, want = frequent_leaks()
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [{tuple(r) for r in decontaminate.find_leaks(df.repartition(k), bench).collect()} for k in (1, 7)]
    assert {r[:3] for r in got[0]} == {r[:3] for r in got[1]} == want
    assert decontaminate.without_leaks(df, bench).count() == len(rows) - len(want)
    terms = np.unique(decontaminate._hashed([items[0][1]])[0])
    one, many = (decontaminate.document_frequencies(df.union(df).repartition(k), terms) for k in (1, 7))
    assert one[1] == many[1] and (one[0] == many[0]).all()


def test_large_benchmarks_are_taken_in_slices(spark, monkeypatch):
    rows, items, want = frequent_leaks()
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SLICE", 1)
    assert {tuple(r)[:3] for r in decontaminate.find_leaks(df, bench).collect()} == want
    assert decontaminate.without_leaks(df, bench).count() == len(rows) - len(want)


def test_leaks_are_the_same_at_every_size(spark, monkeypatch):
    rows, items, want = frequent_leaks()
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    counted, got = decontaminate.document_frequencies, []
    for times in (1, 20, 100_000):

        def more(docs, terms, times=times):
            found, n = counted(docs, terms)
            return found * times, n * times

        monkeypatch.setattr(decontaminate, "document_frequencies", more)
        got.append(sorted(map(tuple, decontaminate.find_leaks(df, bench).collect())))
    assert {r[:3] for r in got[0]} == want
    for other in got[1:]:
        assert [(*r[:3], r[4]) for r in other] == [(*r[:3], r[4]) for r in got[0]]
        assert [r[3] for r in other] == pytest.approx([r[3] for r in got[0]], abs=1e-4)


def test_leaks_of_spans_equal_brute_force():
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(40)]
    for trial in range(40):
        texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice((1, 2, 5, 12, 30)))) for _ in range(4)]
        items = [decontaminate.Item(i, h, decontaminate._hashed(["v1 v2"])[0] if i == 3 else np.zeros(0, np.uint64)).prepare() for i, h in enumerate(decontaminate._hashed(texts))]
        bodies = []
        for _ in range(6):
            body = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
            at = rng.randint(0, len(body))
            body[at:at] = [x for x in texts[rng.randrange(4)].split() if rng.random() < 0.85]
            bodies.append(" ".join(body))
        terms = np.unique(np.concatenate([it.words for it in items]))
        shared = decontaminate.Shared.of(items, terms, np.array([rng.randrange(9) for _ in terms]))
        (w,) = words_of(decontaminate.plain(pa.array(bodies)))
        got = defaultdict(float)
        for r, i, block in shared.stretches(w, terms):
            ws, n = w.hashes[w.first[r] : w.first[r + 1]].tolist(), len(items[i].words)
            share = decontaminate.best_span(items[i], ws, range(block * n, min((block + 1) * n, len(ws))))[0]
            got[r, i] = max(got[r, i], share)
        for r in range(len(bodies)):
            ws = w.hashes[w.first[r] : w.first[r + 1]].tolist()
            for i, it in enumerate(items):
                want, n = 0.0, len(it.words)
                for a in range(len(ws)):
                    share = decontaminate.common_length(it.masks, n, ws[a : a + it.span]) / n
                    near = decontaminate._within(it.answer, ws[max(0, a - 64) : a + it.span + 64])
                    if share >= 0.65 or (share >= 0.45 and near):
                        want = max(want, share)
                assert got[r, i] == want, (trial, r, i)


def test_common_subsequence_equals_the_table():
    rng = random.Random(7)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 70))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        it = decontaminate.Item(0, np.array(a, np.uint64), np.zeros(0)).prepare()
        assert decontaminate.common_length(it.masks, len(a), b) == t[-1][-1]


def unigram_reference():
    from tokenizers import Tokenizer, models

    vocab = list(unigram.sentencepiece_vocabulary(default_path("piece_bpe_32k.model")))
    return Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], 0, False))


def test_token_counts(docs, odd):
    ref = unigram_reference()

    def count(t):
        return len(ref.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0

    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_tokens) for r in unigram.token_counts(df).collect()), key=repr)
        assert got == sorted(((r.doc_id, count(r.text)) for r in df.select("doc_id", "text").collect()), key=repr)
    assert unigram.token_counts(empty(docs)).count() == 0


def test_viterbi_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    rng = random.Random(8)
    for _ in range(60):
        pieces = {("▁" if rng.random() < 0.3 else "") + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        vocab = [(p, float(-rng.randint(1, 3))) for p in sorted(pieces)]
        ref, own = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], 0, False)), unigram.CountViterbi(vocab)
        for _ in range(20):
            t = "".join(rng.choice("abcz ") for _ in range(rng.randint(1, 25)))
            assert own.count(t)[0] == len(ref.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids), (t, vocab)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing_is_a_partition_of_all_tokens(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = packing.pack(df).collect()
    want = defaultdict(list)
    for d, x in rows:
        want[d].append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for d, own in want.items():
        assert sorted(r.length for r in pieces[d] for _ in [0]) and sum(r.length for r in pieces[d]) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                ids = np.array(own[0][r.start : r.start + r.length], "<u4")
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own[0]), zlib.crc32(ids.tobytes()))
                at += r.length
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    assert packing.pack(empty(df)).count() == 0


def test_byte_vocabulary_gives_the_same_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    enc, rng = byte_bpe(default_path("byte_bpe_50k.json")), random.Random(10)
    alphabet = "ab  \n\t日本é☃\U0001f600'sll12.,<|endoftext|> ́ß"
    for _ in range(2000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert enc.encode(x, allowed_special="all") == t.encode(x, add_special_tokens=False).ids


def test_differencing():
    assert [sorted(s) for s in packing.differencing([8, 7, 6, 5, 4], 2)] and sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    rng = random.Random(11)
    for _ in range(50):
        sizes = [rng.randint(1, 512) for _ in range(rng.randint(1, 300))]
        sets = packing.partition(sizes, 2048)
        assert sorted(i for s in sets for i in s) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in s) <= 2048 for s in sets)
        assert len(sets) <= -(-sum(sizes) // 2048) + 1


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    df = table(spark, sf, "documents")
    out = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    rows = {r.doc_id: r.text for r in df.collect()}
    assert kept <= set(rows)
    assert sum(r.length for r in out.collect()) == sum(len(byte_bpe(default_path("byte_bpe_50k.json")).encode(rows[d], allowed_special="all")) + 1 for d in kept)
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    good = [d for d, q in labels.items() if q == 1]
    items = {r.text for r in table(spark, sf, "benchmark").collect()}
    assert not [d for d in kept if any(i in rows[d] for i in items)]
    comps = {d: c for d, _, c in plain_components(list(rows.items()))}
    assert len({comps[d] for d in kept}) == len(kept)
    fair = {comps[d] for d in good if not any(i in rows[d] for i in items)}
    assert len(fair - {comps[d] for d in kept}) <= 0.1 * len(fair)


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_keep_columns_and_take_odd_rows(spark, odd, stage):
    got = stage[1](spark, odd, SF)
    assert got.columns == odd.columns and got.count() <= len(odd_rows())
    assert stage[1](spark, empty(odd), SF).count() == 0
