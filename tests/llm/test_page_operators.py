"""Archives, page text, and nearest neighbours against plain versions, with odd rows."""

import base64
import gzip
import hashlib
import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import assert_same
from tracklens.llm import entries, html_text, prefix_forest, warc
from tracklens.llm.common import scratch, table

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, host string, key long, file string, payload string, salt int, text string"


def odd_pages():
    t = "<p>same\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://a.example/x", t), (2, "http://a.example/y", t), (5, "http://a.example/x y\r\nz", t), (5, "http://b.example/", t), (3, None, None), (4, "nonsense", ""), (None, "http://a.example/", "<b>solo"), (None, None, t), (7, "http://www.A.example:80/p/?q#f", "é日" * 50_000), (8, "", "\x00\x01<p>x")]
    return [(*r, "h", 1, "f", "p", 2, "t") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_pages(), PAGES)


def plain_archive(rows, least=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    newest = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= least:
            newest[h or ""] = max(i, newest.get(h or "", i))
    out = []
    for i, _, h, *_ in rows:
        top = newest.get(h or "")
        again = i is not None and top is not None and i < top
        out.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 30])
def test_archive_round_trip(odd, least):
    got = warc.archive_and_index(odd, min_bytes=least).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_archive(odd_pages(), least)


def test_archive_of_pages_and_of_nothing(spark):
    pages = table(spark, SF, "pages")
    assert_same(entries.op4_warc_index(spark, SF), entries.OP4_SQL, SF)
    assert warc.archive_and_index(pages.filter("false")).count() == 0


def test_payloads_survive_and_index_points_to_them(spark, odd):
    path = scratch(spark, "warc-test")
    warc.write_archives(odd, path, file_records=3)
    index = warc.merge_runs(warc.capture_runs(spark, path)).collect()
    key = [warc.sort_key(tuple(r)) for r in index]
    assert key == sorted(key) and len({r.file for r in index}) > 1
    pages = {r[0]: r[2] or "" for r in odd_pages()}
    import glob

    for r in index:
        (f,) = glob.glob(f"{path}/{r.file}")
        with gzip.open(f) as g:
            data = g.read()
        (record,) = [x for x in warc.parse_archive(data) if x[2] == r.record_offset]
        assert record[3] == r.record_length
        if r.record_type == "response" and r.page_id is not None:
            assert record[1].partition(b"\r\n\r\n")[2].decode() == pages[r.page_id]


def test_captures_are_ordered_by_address_and_time(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    rng = random.Random(3)
    rows = [(i, f"http://{rng.choice('ab')}.example/{rng.choice(('x', 'y', 'z'))}", f"<p>{i % 50}", f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 0{rng.randint(0, 9)}:00:00" if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = warc.archive_and_index(df, captured=F.col("at").cast("timestamp"))
    assert index.rdd.getNumPartitions() > 5
    got = [(r.urlkey, r.captured, r.page_id) for r in index.collect()]
    want = sorted((warc.url_key(u), at.replace(" ", "T") + "Z" if at else warc.DATE, i) for i, u, _, at in rows)
    assert got == want and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_large_payloads_make_small_files(spark):
    import glob

    df = spark.createDataFrame([(i, "u", "x" * 1000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = scratch(spark, "warc-test")
    warc.write_archives(df, path, file_bytes=5000)
    assert len(glob.glob(f"{path}/part-*")) >= 8
    assert warc.capture_runs(spark, path).count() == 40


def test_damaged_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcX\r\n\r\n"))


def test_url_keys():
    assert warc.url_key("http://www.A.example:80/p/?q#f") == "example,a)/p/?q"
    assert warc.url_key("https://a.example/") == warc.url_key("http://a.example") == "example,a)/"
    assert warc.url_key(None) == ""


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(2)
    row = lambda: (rng.choice("abc"), rng.choice("12"), rng.choice((None, 1, 2)), None, "response", None, "d", 0, "f", rng.randrange(99), 0)
    for k in range(0, 12):
        runs = [sorted((row() for _ in range(rng.randrange(6))), key=warc.sort_key) for _ in range(k)]
        got = list(warc.LoserTree(runs))
        assert [warc.sort_key(r) for r in got] == sorted(warc.sort_key(r) for run in runs for r in run)


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header>no</header><nav><a href="a>b">no</a></nav>
<div id="cookie-notice">no</div><article><h1>One &amp; two</h1><p>a<b>b</b>c&nbsp; d<br>e<p>f<script>var t="</p>";</script><!-- no --><aside>no</aside>
<form>no<input></form><div class="ad">no</div><ul><li>g<li>h</ul><table><tr><td>i<td>j</table><section class='comments'><p>no</section>&lt;k&#8217;</article><footer>&copy; no</footer></body></html>"""


def test_roles_and_references():
    assert html_text.text_of(html_text.parse(PAGE), set()) == "One & two abc d e f g h i j <k’"


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class='content no-comments'", "div class=sidebar", "form", "div id=header"])
@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_wrappers_are_not_chrome(wrapper, tag):
    page = f"<body><nav>no</nav><{wrapper}><{tag}><div class='entry-header'><h1>One</h1></div><p>two and three and four</p><div class='share-buttons'>no</div><div class='ad'>no</div></{tag}></{wrapper.split()[0]}><div class='site-footer'>no</div></body>"
    assert html_text.text_of(html_text.parse(page), set()) == "One two and three and four"


def test_articles_in_chrome_yield_to_others():
    page = "<body><aside><article>no</article></aside><article>yes<section class=comments><article>no</article></section></article><div class='related-posts'><article>no</article></div></body>"
    assert html_text.text_of(html_text.parse(page), set()) == "yes"
    page = "<body><div class='main-menu'>no</div><p>yes</p><aside><article>no</article></aside><div class=widget><article>this</article></div></body>"
    assert html_text.text_of(html_text.parse(page), set()) == "yes this"


@pytest.mark.parametrize("text", ["", "plain", "<", "<p", "a<b", "<p>x</p", "x &am", "<!-- x", "<script>x", "</p></p>x", "<p a='>'>x", "<p a=\">x"])
def test_broken_markup_does_not_fail(text):
    assert isinstance(html_text.text_of(html_text.parse(text), set()), str)


def test_parser_is_linear():
    import time

    n = 200_000
    for page in ("<span>" * n + "</b>" * n, "<p><td>" + "<i>" * n + "<h1>" * n, "<li>" * n + "</ul>" * n, "<div><p>" * n, "<b><i></b></i>" * n):
        began = time.time()
        root = html_text.parse(page + "end")
        assert html_text.text_of(root, set()).endswith("end")
        assert time.time() - began < 10, page[:20]


def site(n):
    pages = []
    for i in range(n):
        body = f"<div><p>story {i} of the day</p></div>"
        pages.append((i, f"http://s.example/{i}", f"<html><body><div class=top><p>Welcome to our site</p></div>{body}<div><p>All rights kept</p></div></body></html>"))
    return pages


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_recurring_subtrees_go(spark, limit):
    rows = [*site(40), (100, "http://s.example/a", "<article><p>Welcome to our site</p></article>"), (101, "http://t.example/a", "<p>Welcome to our site</p>"), (0, "http://s.example/0", site(1)[0][2]), (102, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df, max_broadcast=limit).collect())
    texts = [(i, f"story {i} of the day") for i in range(40)] + [(0, "story 0 of the day"), (100, "Welcome to our site"), (101, "Welcome to our site"), (102, "")]
    assert got == sorted((i, t, len(t)) for i, t in texts)


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("tag", ["main", "article"])
def test_recurring_blocks_in_declared_articles_go(spark, tag, limit):
    notice, bar = "<div class=hint><p>Prices are shown with tax</p></div>", "<p>Send this to a friend</p>"
    page = lambda i: f"<body><{tag}><section>{notice}</section><p>story {i} of the day</p>{'<p>Good morning</p>' if i % 2 else ''}{bar}</{tag}></body>"
    copy = f"<body><{tag}><div><p>a story that one posts again</p></div></{tag}></body>"
    rows = [(i, f"http://s.example/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://s.example/c{i}", copy) for i in range(60)] + [(200, "http://t.example/", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df, max_broadcast=limit).collect()}
    want = {i: f"story {i} of the day" + (" Good morning" if i % 2 else "") for i in range(40)} | {100 + i: "a story that one posts again" for i in range(60)}
    assert got == want | {200: "Prices are shown with tax story 0 of the day Send this to a friend"}


def test_page_text(spark, odd):
    df = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for r in df.collect():
        own = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", own[1]))).split())
        assert got[r.page_id] == want
    assert html_text.extract(odd).count() == len(odd_pages())
    assert html_text.extract(df.filter("false")).count() == 0


def plain_nearest(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["given", "clusters", "lengths"])
def test_recall_order_and_scores(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "given":
        df = table(spark, "/root/testdata/sf0.1", "embeddings")
    else:
        x = rng.normal(size=(3000, 24)) * 0.3 + rng.normal(size=(30, 24)).repeat(100, 0)
        x = x * rng.lognormal(0, 0.5, (3000, 1)) if kind == "lengths" else x
        x[1500:1600] = x[1500]
        df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = plain_nearest(rows, 20), {}
    vectors = dict(rows)
    for r in prefix_forest.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        assert found[0][2] == pytest.approx(float(np.dot(vectors[q], np.array(vectors[found[0][1]], float))), abs=1e-9)
        hits += len({f[1] for f in found} & set(want[q]))
    assert hits >= 0.9 * 20 * len(want)


def test_blocks_are_reached_by_their_prefixes(spark, monkeypatch):
    """Clusters: a query visits some of many blocks; a third of all rows are equal and fill several."""
    monkeypatch.setattr(prefix_forest, "BLOCK_ROWS", 500)
    monkeypatch.setattr(prefix_forest, "BLOCK_QUERIES", 100)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(40, 16)).repeat(100, 0) + rng.normal(size=(4000, 16)) * 0.05, np.ones((2000, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    plan = prefix_forest.planned(x, len(x), 20)
    assert plan.blocks >= 12 and plan.parts.max() >= 3 and plan.reach < len(plan.parts) and plan.share <= 0.2
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = plain_nearest(rows, 20), {}
    for r in prefix_forest.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_lengths_are_spaces_and_ids_may_repeat(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [0.5, 0.25]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 0.0, 0.0])]
    got = sorted(map(tuple, prefix_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 0.25), (0, 1, 1, 0.5), (0, 2, 0, 0.0), (0, 2, 0, 0.0), (20, 1, 21, 1.0)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<float>, block int, score double")
    got = sorted(map(tuple, prefix_forest.search(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 2, -0.5), (20, 3, 0, -1.0)]
    assert prefix_forest.search(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
