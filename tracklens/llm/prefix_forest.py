"""Nearest neighbours by inner product with a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.common import one_blas_thread, some_of, stored

TREES, BITS = 256, 24
#: Rows that one forest indexes, and queries that a task puts to it, about.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4096
#: The bounded sample: rows that place the hyperplanes and set how much is searched; queries among them.
SAMPLE, SAMPLE_QUERIES = 8192, 128
#: Recall that the candidates of a forest, and the blocks that are searched, must reach on the sample, above the 0.9 that is promised.
TARGET, REACHED = 0.94, 0.98
SHARES = (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.13, 0.16, 0.2, 0.23, 0.26, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8, 1.0)
#: Least candidates of a query in a block, in units of k.
LEAST = 10
#: Trees of which one deals rows to blocks.
ROUTERS = 64
#: Rows that are hashed, and queries whose ranges are held, at once; trees that ascend together at the last prefix length.
AT_ONCE, STEP = 512, 16


@dataclass
class Planes:
    """Hyperplanes of all trees in the space with one more coordinate, which makes inner products angles."""

    centre: np.ndarray
    normals: np.ndarray  # (TREES * BITS, d + 1)
    radius2: float

    def hashes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(TREES, n) hash strings, first bit highest."""
        out = np.empty((len(self.normals) // BITS, len(x)), np.uint32)
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.float32)  # exact in 24 bits
        normals = self.normals.astype(np.float32)
        for i in range(0, len(x), AT_ONCE):
            part = x[i : i + AT_ONCE]
            if query:
                z = part.astype(np.float32) @ normals[:, :-1].T
            else:
                c = part - self.centre
                rest = np.sqrt(np.maximum(self.radius2 - (c * c).sum(1), 0))
                z = np.column_stack((c, rest)).astype(np.float32) @ normals.T
            out[:, i : i + AT_ONCE] = ((z > 0).reshape(len(part), -1, BITS).astype(np.float32) @ weights).T.astype(np.uint32)
        return out


def planes(sample: np.ndarray, trees: int = TREES, seed: int = 5) -> Planes:
    """Random normals around the sample's centre, orthogonal within a tree, stretched along its principal axes."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(0)
    c = sample - centre
    values, axes = np.linalg.eigh(c.T @ c / len(c))
    stretch = axes * np.sqrt(np.maximum(values, values.max() * 1e-6))
    d = sample.shape[1]
    out = []
    for _ in range(trees):
        done = 0
        while done < BITS:
            q, _ = np.linalg.qr(rng.normal(size=(d + 1, d + 1)))
            out.append(q[:, : min(BITS - done, d + 1)].T)
            done += len(out[-1])
    normals = np.concatenate(out)
    normals[:, :-1] = normals[:, :-1] @ stretch.T
    normals[:, -1] *= np.sqrt(np.maximum(values, 0).mean())
    return Planes(centre, normals, float((c * c).sum(1).max()))


class Forest:
    """Per tree the sorted hash strings of all rows and the rows' numbers."""

    def __init__(self, p: Planes, rows: np.ndarray):
        h = p.hashes(rows, False)
        self.order = np.stack([np.argsort(t, kind="stable").astype(np.int32) for t in h])
        self.sorted = np.take_along_axis(h, self.order, 1)
        self.depth = min(BITS, 4 + int(np.ceil(np.log2(max(2, len(rows))))))
        self.n = len(rows)
        self.begin = np.arange(len(h), dtype=np.int64) * self.n

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, depth + 1, TREES) bounds of the rows that share a prefix of 0 .. depth bits with each query."""
        low = ((1 << (BITS - np.arange(self.depth + 1))) - 1).astype(np.uint32)
        first, last = q[:, :, None] & ~low, q[:, :, None] | low
        lo = np.stack([np.searchsorted(s, f) for s, f in zip(self.sorted, first, strict=True)], 2)
        hi = np.stack([np.searchsorted(s, f, "right") for s, f in zip(self.sorted, last, strict=True)], 2)
        return lo, hi

    def _mark(self, seen: np.ndarray, lo: np.ndarray, hi: np.ndarray, trees: slice) -> int:
        n = (hi - lo)[trees]
        upto = np.cumsum(n)
        at = np.repeat((lo + self.begin)[trees] - (upto - n), n) + np.arange(upto[-1])
        seen[self.order.ravel()[at]] = True
        return int(np.count_nonzero(seen))

    def candidates(self, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
        """Rows of the longest prefixes of one query: descend in all trees, then ascend in step, bit by bit, until ``most`` are found.

        ``lo`` and ``hi`` are the query's (depth + 1, TREES) ranges. Rows with one string come together.
        """
        if most >= self.n:
            return np.arange(self.n)
        sizes = (hi - lo).sum(1)
        seen = np.zeros(self.n, bool)
        # Ranges that hold fewer rows in all can't hold ``most`` different ones.
        depth = max(0, int(np.flatnonzero(sizes >= most)[-1]))
        found = self._mark(seen, lo[depth + 1], hi[depth + 1], slice(None)) if depth < self.depth else 0
        while found < most and depth >= 0:
            for t in range(0, len(self.begin), STEP):
                found = self._mark(seen, lo[depth], hi[depth], slice(t, t + STEP))
                if found >= most:
                    break
            depth -= 1
        return np.flatnonzero(seen)


def best(ids: np.ndarray, rows: np.ndarray, own: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest inner products among ``rows``, in double precision, ties to the smaller id; never a row that ``own`` marks."""
    s = (rows * query).sum(1)
    ids, s = ids[~own], s[~own]
    if len(s) > k:
        near = s >= np.partition(s, len(s) - k)[len(s) - k]
        ids, s = ids[near], s[near]
    order = np.lexsort((ids, -s))[:k]
    return ids[order], s[order]


@dataclass
class Plan:
    """How rows and queries of one vector length meet: blocks by ranges of one tree's strings, and shares to search."""

    planes: Planes
    tree: int
    cuts: np.ndarray  # least string of each range but the first
    parts: np.ndarray  # blocks of each range: one that holds many equal strings has several
    reach: int  # ranges that a query visits
    share: float  # of a block's rows that are candidates

    @property
    def blocks(self) -> int:
        return int(self.parts.sum())

    def visits(self, strings: np.ndarray) -> np.ndarray:
        """(queries, ranges): ranges by falling length of the prefix that they share with each query, nearer ones first."""
        every = 1 << BITS
        low, high = np.r_[0, self.cuts].astype(np.int64), np.r_[self.cuts.astype(np.int64) - 1, every - 1]
        s = strings.astype(np.int64)[:, None]
        nearest = np.clip(s, low, high)
        apart = np.frexp((s ^ nearest).astype(float))[1]  # bits from the first that differs on
        return np.argsort(apart * (2.0 * every) + np.abs(s - nearest), axis=1, kind="stable")


def planned(sample: np.ndarray, rows: int, k: int) -> Plan:
    """Set on the sample's own queries: the tree whose ranges need the fewest visits, how many, and the share of a block's rows that reaches the wanted recall."""
    n = len(sample)
    p = planes(sample)
    asked = np.arange(0, n, max(1, n // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    forest, ids = Forest(p, sample), np.arange(n)
    blocks = max(1, -(-rows // BLOCK_ROWS))
    strings, q = p.hashes(sample, False), p.hashes(sample[asked], True)
    truth = [best(ids, sample, ids == i, sample[i], k)[0] for i in asked]
    plan = None
    for t in range(ROUTERS if blocks > 1 else 1):
        cuts = np.unique(forest.sorted[t][np.arange(1, blocks) * n // blocks])
        cuts = cuts[cuts > forest.sorted[t][0]]
        home = np.searchsorted(cuts, strings[t], "right")
        held = np.bincount(home, minlength=len(cuts) + 1) / n
        one = Plan(p, t, cuts, np.maximum(1, np.ceil(held * blocks - 0.5)).astype(int), len(cuts) + 1, 1.0)
        place = np.argsort(one.visits(q[t]), axis=1)
        needed = np.sort(np.concatenate([place[j, home[x]] for j, x in enumerate(truth)]))
        if len(needed):
            one.reach = int(needed[min(len(needed) - 1, int(REACHED * len(needed)))]) + 1
        if plan is None or one.reach * len(plan.parts) < plan.reach * len(one.parts):
            plan = one
    lo, hi = forest.ranges(q)
    total = sum(map(len, truth))
    for share in SHARES[:-1]:
        hits = 0
        for j, i in enumerate(asked):
            c = forest.candidates(lo[j], hi[j], max(LEAST * k, int(share * n)))
            hits += len(np.intersect1d(truth[j], best(c, sample[c], c == i, sample[i], k)[0], assume_unique=True))
        if hits >= TARGET * total:
            plan.share = share
            break
    return plan


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, own) of vectors that can take part, equal rows once; ``own`` tells rows apart."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter(F.size("x") > 0).filter(F.forall("x", lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))).filter(F.exists("x", lambda v: v != 0))
    return rows.groupBy("vec_id", "x").agg(F.first(F.xxhash64("vec_id", "x")).alias("own"))


def _met(rows: DataFrame, asks: Column, d: int, n: int, k: int) -> DataFrame:
    """Each query's best rows of all blocks that it visits, of vectors of length ``d``."""
    key = F.xxhash64("vec_id")
    got = rows.filter(some_of(key, SAMPLE, n)).orderBy(key, "own").limit(SAMPLE).select("x").toArrow()
    plan = planned(np.array(got["x"].combine_chunks().flatten().to_numpy()).reshape(-1, d), n, k)
    router = replace(plan, planes=replace(plan.planes, normals=plan.planes.normals[plan.tree * BITS : (plan.tree + 1) * BITS]))
    first = np.r_[0, np.cumsum(plan.parts)]

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            own, ask = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            home = np.searchsorted(router.cuts, router.planes.hashes(x, False)[0], "right")
            block = first[home] + own % router.parts[home]
            ranges = router.visits(router.planes.hashes(x[ask], True)[0])[:, : router.reach]
            lists = iter([[b for r in row for b in range(first[r], first[r + 1])] for row in ranges.tolist()])
            visits = pa.array([next(lists) if a else None for a in ask.tolist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(block.astype(np.int32)), visits], names=["vec_id", "x", "own", "block", "visits"])

    routed = rows.select("vec_id", "x", "own", asks.alias("asks")).mapInArrow(route, "vec_id long, x array<double>, own long, block int, visits array<int>")
    routed = stored(routed, "routed", "lz4")
    asked = routed.filter("visits is not null").count()
    parts = max(1, -(-asked * min(plan.reach, len(plan.parts)) // (len(plan.parts) * BLOCK_QUERIES)))
    columns = ["block", "part", "query", "vec_id", "x", "own"]
    index = routed.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "query": F.lit(0)}).select(*columns)
    queries = routed.filter("visits is not null").select("vec_id", "x", "own", F.explode("visits").alias("block")).withColumns({"part": F.pmod("own", F.lit(parts)).cast("int"), "query": F.lit(1)}).select(*columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        now, forest, ids, data, keys, held = None, None, None, None, None, []
        for batch in batches:
            block, part, query, vec = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x, own = np.asarray(batch.column(4).flatten()).reshape(-1, d), batch.column(5).to_numpy(zero_copy_only=False)
            found: list[tuple[np.ndarray, ...]] = []
            cuts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(query) != 0)])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(vec)], strict=True):
                if (block[lo], part[lo]) != now:
                    now, forest, held = (block[lo], part[lo]), None, []
                if not query[lo]:
                    held.append((vec[lo:hi], x[lo:hi], own[lo:hi]))
                    continue
                if not held:
                    continue
                if forest is None:
                    ids, data, keys = (np.concatenate(c) for c in zip(*held, strict=True))
                    forest = Forest(plan.planes, data)
                for i in range(lo, hi, AT_ONCE):
                    end = min(hi, i + AT_ONCE)
                    a, b = forest.ranges(plan.planes.hashes(x[i:end], True))
                    for j in range(i, end):
                        c = forest.candidates(a[j - i], b[j - i], max(LEAST * k, int(plan.share * len(ids))))
                        v, s = best(ids[c], data[c], keys[c] == own[j], x[j], k)
                        found.append((np.full(len(v), own[j]), np.full(len(v), vec[j]), v, s))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["own", "query_id", "vec_id", "score"])

    dealt = index.unionByName(queries).repartition(plan.blocks * parts, "block", "part").sortWithinPartitions("block", "part", "query")
    return dealt.mapInArrow(run, "own long, query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's nearest rows.

    Rows are dealt to blocks by ranges of their hash strings in one tree; each block has
    a forest, and a query is put to the blocks with which it shares the longest
    prefixes; its best of them are its answer. How many blocks it visits, and how many
    candidates a forest must give, is set on a bounded sample, so that recall holds for
    data that hashes well and for data that doesn't (which then visits all blocks).
    Vectors of each length are a space of their own. Vectors that are null, empty, zero
    or hold a null or non-finite component take no part, nor do null ids; rows equal in
    id and vector count once, rows that share an id only are rows each, and as queries
    have their lists each; an empty table gives no rows; other columns are not read.
    """
    rows = stored(usable(vectors), "vectors", "lz4")
    # Lengths are few by nature: a table of vectors comes from one model or some.
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    met = vectors.sparkSession.createDataFrame([], "own long, query_id long, vec_id long, score double")
    for r in lengths:
        met = met.unionByName(_met(rows.filter(F.size("x") == r.d), is_query, r.d, r.n, k))
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
