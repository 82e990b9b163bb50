"""Benchmark leaks: passages near an item in a latent space (TF-IDF, a distributed randomised SVD), or with enough of its words, are held against it by common subsequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import one_blas_thread
from tracklens.llm.words import Words, mix, words_of

#: Words of a passage, and of the step to the next one.
PASSAGE, STEP = 64, 32
#: Latent dimensions, at most.
RANK = 256
#: Items of one latent space, whose vocabulary times the rank each task holds; a larger benchmark is taken in slices.
SLICE = 5000
#: Terms in more than this share of passages carry no topic; each item keeps its rarest few all the same.
COMMON, FEW = 0.003, 4
#: Share of passages that is added to each term's, and taken for a word outside of the vocabulary: weights depend on shares alone.
FLOOR = 1e-5
#: Cosine from which on a passage may be a paraphrase.
COSINE = 0.3
#: Share of an item's words that a common subsequence must hold: in any passage, in one near the item in the latent space, in one with the item's answer nearby.
SHARE, SHARE_NEAR, SHARE_WITH_ANSWER = 0.65, 0.5, 0.45
#: Share of an item's words of which a candidate must hold some that aren't the item's commonest; sets time, not results.
RARER = 0.2
_SIGNS = np.zeros(256, bool)
_SIGNS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_TABLE = bytes(32 if _SIGNS[b] else b for b in range(256))


def plain(column):
    """Texts in lower case with ASCII signs as blanks, so that words compare without case and punctuation."""
    import pyarrow as pa
    import pyarrow.compute as pc

    c = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    raw = c.buffers()[2]
    data = raw.to_pybytes()[offsets[0] : offsets[-1]].translate(_TABLE) if raw is not None else b""
    return pa.LargeStringArray.from_buffers(len(c), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data))


@dataclass
class Item:
    item_id: int
    words: np.ndarray  # hashes
    answer: np.ndarray
    masks: dict[int, int] = field(default_factory=dict)

    def prepare(self) -> Item:
        for i, h in enumerate(self.words.tolist()):
            self.masks[h] = self.masks.get(h, 0) | 1 << i
        return self

    @property
    def share(self) -> float:
        """The least share of words that can be a leak."""
        return SHARE_WITH_ANSWER if len(self.answer) else SHARE

    @property
    def span(self) -> int:
        """Words in a row that a common subsequence may spread over, so that scattered words don't add up."""
        return max(2 * len(self.words), len(self.words) + 8)


def common_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _hashed(texts: list[str]) -> list[np.ndarray]:
    import pyarrow as pa

    out: list[np.ndarray] = []
    for w in words_of(plain(pa.array(texts, pa.string()))):
        out += [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def read_items(benchmark: DataFrame) -> list[Item]:
    """The benchmark, which is small by nature; items without words can't leak.

    A column ``answer`` is used if there is one.
    """
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"), answer.alias("answer")).filter("item_id is not null and text is not null").distinct().orderBy("item_id", "text").collect()
    words, answers = _hashed([r.text for r in rows]), _hashed([r.answer or "" for r in rows])
    return [Item(r.item_id, w, a).prepare() for r, w, a in zip(rows, words, answers, strict=True) if len(w)]


@dataclass
class Shared:
    """Where a text has enough of an item's words for a leak, whatever their weight.

    A common subsequence of k words takes k of the item's places. Without the c places
    of an item's commonest words, k - c are left at least, so a stretch with fewer hits
    of the other words has no leak: this bound loses none, at any frequency of words.
    """

    first: np.ndarray  # postings of each term
    item: np.ndarray
    need: np.ndarray  # hits, by item
    step: np.ndarray  # words of a block, by item
    blocks: np.ndarray  # blocks of a stretch, which holds all spans that start in its first block

    @staticmethod
    def of(items: list[Item], terms: np.ndarray, df: np.ndarray) -> Shared:
        term: list[np.ndarray] = []
        need = np.zeros(len(items), np.int64)
        for i, it in enumerate(items):
            n = len(it.words)
            need[i] = next(k for k in range(1, n + 1) if k / n >= it.share)
            t, places = np.unique(np.searchsorted(terms, it.words), return_counts=True)
            order = np.argsort(-df[t], kind="stable")
            spare = need[i] - max(1, int(RARER * n))
            dropped = int(np.searchsorted(np.cumsum(places[order]), spare, "right"))
            need[i] -= places[order[:dropped]].sum()
            term.append(t[order[dropped:]])
        count = np.array([len(t) for t in term])
        every, item = np.concatenate(term), np.repeat(np.arange(len(items)), count)
        step = np.array([len(it.words) for it in items])
        blocks = np.array([-(-it.span // len(it.words)) + 1 for it in items])
        return Shared(np.searchsorted(np.sort(every), np.arange(len(terms) + 1)), item[np.argsort(every, kind="stable")], need, step, blocks)

    def stretches(self, w: Words, terms: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, first block) of all stretches that may hold a leak."""
        at = np.minimum(np.searchsorted(terms, w.hashes), len(terms) - 1)
        hit = np.flatnonzero((terms[at] == w.hashes) & (self.first[at + 1] > self.first[at]))
        begin, k = self.first[at[hit]], self.first[at[hit] + 1] - self.first[at[hit]]
        row = np.searchsorted(w.first, hit, "right") - 1
        item = self.item[np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        pair = np.repeat(row, k) * len(self.need) + item
        block = np.repeat(hit - w.first[row], k) // self.step[item]
        # Rows that have too few hits in all need no blocks.
        enough = np.bincount(pair)[pair] >= self.need[item]
        pair, block = pair[enough], block[enough]
        if not len(pair):
            return
        most = int(self.blocks.max())
        width = int(block.max()) + 1 + most
        code, n = np.unique(pair * width + block, return_counts=True)
        pair, block = np.divmod(code, width)
        long = self.blocks[pair % len(self.need)]
        start = np.unique(np.concatenate([code[(block >= d) & (long > d)] - d for d in range(most)]))
        upto = np.r_[0, np.cumsum(n)]
        pair, block = np.divmod(start, width)
        item = pair % len(self.need)
        held = upto[np.searchsorted(code, start + self.blocks[item])] - upto[np.searchsorted(code, start)]
        ok = held >= self.need[item]
        yield from zip((pair[ok] // len(self.need)).tolist(), item[ok].tolist(), block[ok].tolist(), strict=True)


@dataclass
class Latent:
    """The vocabulary of the benchmark with its weights, the latent basis, and the items' chunks in it."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray  # 0 for a term without topic
    basis: np.ndarray  # (terms, rank)
    chunks: np.ndarray  # (chunks, rank), of length 1
    of_item: np.ndarray  # item of each chunk
    shared: Shared
    other: float  # squared weight of a word outside of the vocabulary

    def vectors(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sparse TF-IDF of all passages of a batch: (passage, term, weight), and each passage's row, first word and squared weight of words outside."""
        n = np.diff(w.first)
        count = np.maximum(1, -(-(n - (PASSAGE - STEP)) // STEP)) * (n > 0)
        row = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = w.first[row] + nth * STEP
        first_passage = np.cumsum(count) - count
        at = np.minimum(np.searchsorted(self.terms, w.hashes), max(0, len(self.terms) - 1))
        inside = self.terms[at] == w.hashes
        hit = np.flatnonzero(inside & (self.idf[at] > 0))
        term = at[hit]
        upto = np.r_[0, np.cumsum(~inside)]
        outside = upto[np.minimum(start + PASSAGE, w.first[row + 1])] - upto[start]
        doc = np.searchsorted(w.first, hit, "right") - 1
        step = (hit - w.first[doc]) // STEP
        last = count[doc] - 1
        own = first_passage[doc] + np.minimum(step, last)
        before = np.flatnonzero((step >= 1) & (step <= last))
        passage = np.concatenate((own, first_passage[doc[before]] + step[before] - 1))
        code = passage * len(self.terms) + np.concatenate((term, term[before]))
        code, tf = np.unique(code, return_counts=True)
        p, t = np.divmod(code, max(1, len(self.terms)))
        return p, t, ((1 + np.log(tf)) * self.idf[t]).astype(np.float32), row, start, outside * self.other


def _chunks(items: list[Item]) -> list[tuple[int, np.ndarray]]:
    return [(i, it.words[a : a + PASSAGE]) for i, it in enumerate(items) for a in range(0, max(1, len(it.words) - STEP), STEP)]


def _sparse(places: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of rows of terms' places."""
    found = [np.unique(x, return_counts=True) for x in places]
    row, term, tf = np.repeat(np.arange(len(found)), [len(t) for t, _ in found]), *(np.concatenate([f[i] for f in found]) for i in (0, 1))
    return row, term, (1 + np.log(tf)) * idf[term]


def _add_rows(out: np.ndarray, to: np.ndarray, weight: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """Add ``weight`` times each row ``of`` to the row ``to``, some thousand at a time."""
    for i in range(0, len(to), 4096):
        part = slice(i, i + 4096)
        np.add.at(out, to[part], weight[part, None] * rows[of[part]])


def _project(basis: np.ndarray, p: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages that have terms, their latent vectors)."""
    some, begin = np.unique(p, return_index=True)
    out = np.empty((len(some), basis.shape[1]), np.float32)
    edges = np.r_[begin, len(p)]
    for i in range(0, len(some), 4096):
        lo, hi = edges[i], edges[min(i + 4096, len(some))]
        out[i : i + 4096] = np.add.reduceat(basis[t[lo:hi]] * x[lo:hi, None], begin[i : i + 4096] - lo)
    return some, out


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many disjoint passages each term of the vocabulary is, over all texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for w in words_of(plain(batch.column(0))):
                at = np.minimum(np.searchsorted(terms, w.hashes), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == w.hashes)
                doc = np.searchsorted(w.first, hit, "right") - 1
                count = -(-np.diff(w.first) // PASSAGE)
                passage = (np.cumsum(count) - count)[doc] + (hit - w.first[doc]) // PASSAGE
                df += np.bincount(np.unique(passage * len(terms) + at[hit]) % len(terms), minlength=len(terms))
                n += int(count.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(terms))), pa.array(np.r_[n, df])], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[got["term"].to_numpy() + 1] = got["n"].to_numpy()
    return out[1:], int(out[0])


def fit(docs: DataFrame, items: list[Item], rank: int = RANK, seed: int = 3) -> Latent:
    """Randomised SVD of the passages' TF-IDF matrix over the benchmark's vocabulary.

    The range is sketched with the items' vectors and normal noise; each task adds up
    A^T (A S) over its passages, Spark sums the tasks', and the left singular vectors
    of the sum are the basis. Its size is that of the vocabulary times the rank.
    """
    terms = np.unique(np.concatenate([it.words for it in items]))
    df, n = document_frequencies(docs, terms)
    idf = np.log((1 + FLOOR) / (df / max(1, n) + FLOOR))
    topical = df <= COMMON * n
    keep = topical.copy()
    for it in items:
        at = np.unique(np.searchsorted(terms, it.words))
        keep[at[np.argsort(df[at], kind="stable")[:FEW]]] = True
    none = np.zeros(0)
    latent = Latent(terms, np.where(keep, np.maximum(idf, 0.1), 0.0), none, none, none, Shared.of(items, terms, df), float(np.log((1 + FLOOR) / FLOOR) / 2) ** 2)
    parts = _chunks(items)
    chunk, term, weight = _sparse([np.searchsorted(terms, words) for _, words in parts], latent.idf)
    size = np.maximum(np.sqrt(np.bincount(chunk, weights=weight * weight, minlength=len(parts))), 1e-12)
    rank = min(rank, len(terms), len(parts) + 32)
    rng = np.random.default_rng(seed)
    few = len(parts) <= rank - min(32, rank // 2)
    seen = np.zeros((len(terms), len(parts) if few else rank))
    if few:
        seen[term, chunk] = weight / size[chunk]
    else:
        _add_rows(seen, term, weight / size[chunk], rng.normal(size=(len(parts), rank)), chunk)
    sketch = np.hstack([seen, rng.normal(size=(len(terms), rank)) / np.sqrt(len(terms))])[:, :rank].astype(np.float32)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        total = np.zeros(sketch.shape)
        for batch in batches:
            for w in words_of(plain(batch.column(0))):
                p, t, x, *_ = latent.vectors(w)
                some, y = _project(sketch, p, t, x)
                order = np.argsort(t, kind="stable")
                used, begin = np.unique(t[order], return_index=True)
                edges = np.r_[begin, len(order)]
                back = np.searchsorted(some, p)
                for i in range(0, len(used), 512):
                    lo, hi = edges[i], edges[min(i + 512, len(used))]
                    part = order[lo:hi]
                    total[used[i : i + 512]] += np.add.reduceat(y[back[part]] * x[part, None], begin[i : i + 512] - lo)
        rows = np.flatnonzero(total.any(1))
        for i in range(0, len(rows), 2000):
            part = rows[i : i + 2000]
            values = pa.FixedSizeListArray.from_arrays(pa.array(total[part].ravel().astype(np.float32)), sketch.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(part), values], names=["term", "row"])

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = np.asarray(batch.column(1).flatten()).reshape(len(batch), -1)
            for term, row in zip(batch.column(0).to_pylist(), values, strict=True):
                total[term] = total[term] + row if term in total else row.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["term", "row"])

    got = docs.select("text").mapInArrow(run, "term long, row array<float>").repartition("term").mapInArrow(summed, "term long, row array<double>").toArrow()
    z = np.zeros(sketch.shape)
    if got.num_rows:
        z[got["term"].to_numpy()] = np.asarray(got["row"].combine_chunks().flatten()).reshape(got.num_rows, -1)
    # The items' own vectors belong to the matrix too: a benchmark of which no text has a passage keeps its directions.
    near = np.zeros((len(parts), rank))
    _add_rows(near, chunk, weight, sketch, term)
    _add_rows(z, term, weight, near, chunk)
    latent.basis = np.linalg.svd(z, full_matrices=False)[0].astype(np.float32)
    chunks = np.zeros((len(parts), latent.basis.shape[1]))
    _add_rows(chunks, chunk, weight, latent.basis, term)
    latent.chunks = (chunks / np.maximum(np.linalg.norm(chunks, axis=1), 1e-12)[:, None]).astype(np.float32)
    latent.of_item = np.array([i for i, _ in parts])
    return latent


def _within(answer: np.ndarray, words: list[int]) -> bool:
    a = answer.tolist()
    return bool(a) and any(words[i : i + len(a)] == a for i in range(len(words) - len(a) + 1))


def best_span(it: Item, words: list[int], starts: range, least: float = SHARE) -> tuple[float, int]:
    """(share, start) of the first best leak of a span that starts in ``starts``; a share of 0 if there is none.

    ``least`` is the share that needs no answer.
    """
    n = len(it.words)
    most = common_length(it.masks, n, words[starts.start : starts.stop + it.span]) / n
    best = (0.0, 0)
    if most < min(it.share, least):
        return best
    for a in starts:
        # A span that starts between words of the item holds no more than the next one, but may be nearer to an answer.
        if best[0] == most or not (words[a] in it.masks or len(it.answer)):
            continue
        share = common_length(it.masks, n, words[a : a + it.span]) / n
        if share > best[0] and (share >= least or (share >= SHARE_WITH_ANSWER and _within(it.answer, words[max(0, a - PASSAGE) : a + it.span + PASSAGE]))):
            best = (share, a)
    return best


def near_passages(w: Words, latent: Latent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, item) of all passages whose cosine with a chunk of the item is ``COSINE`` or more.

    A projection is no longer than the vector, so passages with too small a part of
    their weight in the vocabulary need none.
    """
    p, t, x, of, start, outside = latent.vectors(w)
    inside = np.bincount(p, weights=x * x, minlength=len(of))
    length = np.sqrt(inside + outside)
    may = np.sqrt(inside) >= COSINE * length
    held = may[p] if len(p) else np.zeros(0, bool)
    some, y = _project(latent.basis, p[held], t[held], x[held])
    row, at, item = [], [], []
    for i in range(0, len(some), 1024):
        part = some[i : i + 1024]
        passage, chunk = np.nonzero(y[i : i + 1024] @ latent.chunks.T >= COSINE * length[part][:, None])
        row.append(of[part[passage]])
        at.append((start - w.first[of])[part[passage]])
        item.append(latent.of_item[chunk])
    return tuple(np.concatenate([*c, np.zeros(0, np.int64)]) for c in (row, at, item))


def leaks(w: Words, latent: Latent, items: list[Item]) -> Iterator[tuple[int, int, float, float, int]]:
    """(row, item, share of its words in common, cosine, first word of the passage): the best span of each row and item, and the passage of it that is nearest in the latent space.

    Candidates are passages near an item, which a lower share makes leaks, and stretches
    with enough of an item's words, which none of the higher share lacks.
    """
    best: dict[tuple[int, int], tuple[float, int]] = {}
    near = sorted({(r, i, a) for r, a, i in zip(*(c.tolist() for c in near_passages(w, latent)), strict=True)})
    stretches = ((r, item, block * len(items[item].words), (block + 1) * len(items[item].words), SHARE) for r, item, block in latent.shared.stretches(w, latent.terms))
    row, words = -1, []
    for r, item, lo, hi, least in [*((r, i, max(0, a - items[i].span + 1), a + PASSAGE, SHARE_NEAR) for r, i, a in near), *stretches]:
        if best.get((r, item), (0.0, 0))[0] == 1.0:
            continue
        if r != row:
            row, words = r, w.hashes[w.first[r] : w.first[r + 1]].tolist()
        found = best_span(items[item], words, range(lo, min(hi, len(words))), least)
        if found[0] > best.get((r, item), (0.0, 0))[0]:
            best[r, item] = found
    if not best:
        return
    rows = np.unique([r for r, _ in best])
    part = SimpleNamespace(hashes=np.concatenate([w.hashes[w.first[r] : w.first[r + 1]] for r in rows]), first=np.r_[0, np.cumsum((w.first[1:] - w.first[:-1])[rows])])
    p, t, x, of, start, outside = latent.vectors(part)
    length = np.sqrt(np.bincount(p, weights=x * x, minlength=len(of)) + outside)
    some, y = _project(latent.basis, p, t, x)
    at = start - part.first[of]
    for (r, item), (share, a) in sorted(best.items()):
        i = int(np.searchsorted(rows, r))
        lo, hi = np.searchsorted(of, (i, i + 1))
        near = np.arange(lo, hi)[(at[lo:hi] + PASSAGE > a) & (at[lo:hi] < a + items[item].span)]
        cosine = np.zeros(len(near))
        j = np.minimum(np.searchsorted(some, near), max(0, len(some) - 1))
        has = some[j] == near if len(some) else np.zeros(len(near), bool)
        cosine[has] = (y[j[has]] @ latent.chunks[latent.of_item == item].T).max(1) / length[near[has]]
        top = int(np.argmax(cosine))
        yield r, items[item].item_id, share, float(cosine[top]), int(at[near[top]])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and an item of which a passage, or a paraphrase near its words, is in the text.

    A leak shares 65 % of the item's words in their order, within a span of twice its
    length; 50 % if the passage is near the item in the latent space; 45 % if the item's
    answer stands nearby. Columns doc_id, item_id, share, cosine, position (first word of the passage). The
    corpus is read three times where it lies; what moves is of the benchmark's size.
    Null and empty texts, and an empty benchmark, give no pairs; repeated rows give
    their pairs each; items that share a text are found each; other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    out = "doc_id long, item_id long, share double, cosine double, position long"
    items = read_items(benchmark)
    if not items:
        return docs.sparkSession.createDataFrame([], out)
    if len(items) > SLICE:
        return reduce(DataFrame.unionByName, (_found(base, items[i : i + SLICE], out) for i in range(0, len(items), SLICE)))
    return _found(base, items, out)


def _found(base: DataFrame, items: list[Item], out: str) -> DataFrame:
    latent = fit(base, items)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [(ids[w.row0 + r], *rest) for w in words_of(plain(batch.column(1))) for r, *rest in leaks(w, latent, items)]
            if found:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "share", "cosine", "position"])

    return base.mapInArrow(run, out)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item leaks.

    Null and empty texts, null ids and repeated rows stay; so does all with an empty benchmark.
    """
    items = read_items(benchmark)
    return reduce(_clean, (items[i : i + SLICE] for i in range(0, len(items), SLICE)), docs)


def _clean(docs: DataFrame, items: list[Item]) -> DataFrame:
    latent = fit(docs.select(F.col("text").cast("string").alias("text")), items)
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for w in words_of(plain(batch.column(at))):
                for r, *_ in leaks(w, latent, items):
                    keep[w.row0 + r] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
