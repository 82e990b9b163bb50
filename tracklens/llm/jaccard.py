"""Exact Jaccard join of word shingles: prefix keys bring texts together, a count-vector R-tree bounds their overlap, sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import arrow_rows, free_shuffles, one_blas_thread, remove, stored
from tracklens.llm.components import components
from tracklens.llm.words import Words, mix, words_of

SHINGLE = 5
#: Link when 100 * intersection >= 75 * union, which is 7 * intersection >= 3 * (size + size).
NEED_I, NEED_S = 7, 3
#: Groups of shingles whose counts are a point's coordinates: a power of two at or above an eighth of the set, within these
#: bounds. Eight shingles a group keep unrelated sets apart; above 8,000 shingles the bound weakens and common keys decide.
LEAST_GROUPS, MOST_GROUPS, A_GROUP = 64, 1024, 8
LEAF = 16
#: Rows of an R-tree, at most; larger groups are split, and every query meets every part.
BLOCK = 2048
#: Sets, and shingles in them, of a block of a star.
STAR_SETS, STAR_SHINGLES = 1024.0, 1_000_000.0
#: Shingles in two of each eighth's distinct texts are put off in the prefix order, the commonest so many at most: they steer
#: time, not results.
SAMPLE_PART, SAMPLE_LEAST, SAMPLE_SHINGLES = 8, 2, 500_000
#: Bits of the filter by which texts without a candidate are passed over, by candidate and at most.
FILTER_EACH, FILTER_BITS = 32, 1 << 29
#: Signatures that a task remembers, to drop equal sets before the shuffle.
REMEMBERED = 200_000
SALTS = 16
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(w: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; of fewer words, the sequence as one; of none, nothing."""
    h = w.hashes
    n = len(h) - size + 1
    s = mix(sum((h[i : i + n] * _FACTORS[i] for i in range(size)), np.zeros(n, np.uint64))) if n > 0 else h[:0]
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield np.unique(s[lo : hi - size + 1])
        elif hi > lo:
            part = h[lo:hi]
            yield mix(np.array([int((part * _FACTORS[: len(part)]).sum()) ^ (len(part) << 56)], np.uint64))
        else:
            yield h[:0]


def signature(u: np.ndarray) -> int:
    """Hash of a set of shingles, as a signed long."""
    total = mix(u).sum(keepdims=True, dtype=np.uint64) + np.array([len(u)], np.uint64) * _FACTORS[:1]
    return int(mix(total).view(np.int64)[0])


def prefix(u: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first shingles of a set in an order common to all sets, ``late`` ones last.

    Sets that link share 3/4 of either at least, so two prefixes of n - ceil(3n/4) + 1
    have one in common, whatever the order is.
    """
    p = len(u) - (3 * len(u) + 3) // 4 + 1
    if len(late):
        is_late = late[np.minimum(np.searchsorted(late, u), len(late) - 1)] == u
        u = np.concatenate((u[~is_late], u[is_late]))
    return u[:p]


def groups_of(n: int) -> int:
    """How many coordinates the point of a set of ``n`` shingles has."""
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << (-(-n // A_GROUP) - 1).bit_length()))


def counted(u: np.ndarray) -> bytes:
    """Shingles of each group, which their highest bits name, a byte each; 255 stands for so many or more."""
    g = groups_of(len(u))
    return np.minimum(np.bincount((u >> np.uint64(65 - g.bit_length())).astype(np.int64), minlength=g), 255).astype(np.uint8).tobytes()


def counts_of(vectors: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Coordinates of points of one length; one that is cut off counts as the whole set, so that bounds hold."""
    v = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1).astype(np.int32)
    return np.where(v == 255, sizes[:, None].astype(np.int32), v) if (v == 255).any() else v


def coarser(points: np.ndarray) -> np.ndarray:
    """The points with half as many coordinates."""
    return points.reshape(*points.shape[:-1], -1, 2).sum(-1)


def _new_sets(w: Words, seen: set[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, signature, set) of rows with words whose set isn't among the last that were seen."""
    if len(seen) > REMEMBERED:
        seen.clear()
    for i, u in enumerate(shingles(w)):
        if len(u) and (sig := signature(u)) not in seen:
            seen.add(sig)
            yield i, sig, u


def _runs(key: np.ndarray, sig: np.ndarray, now: int | None, last: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and set: which are no repeats of the row before, and which of these begin a key. ``now`` and ``last`` are those of the row before the first."""
    new = np.r_[True, (np.diff(key) != 0) | (np.diff(sig) != 0)]
    new[0] = now is None or key[0] != now or sig[0] != last
    at = np.flatnonzero(new)
    return at, np.r_[now is None or key[at[0]] != now, np.diff(key[at]) != 0] if len(at) else np.zeros(0, bool)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles in several of a hash-chosen eighth of the distinct sets. They steer the prefix order only."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        seen: set[int] = set()
        for batch in batches:
            for w in words_of(batch.column(0)):
                some = [(sig, u) for _, sig, u in _new_sets(w, seen) if sig % SAMPLE_PART == 0]
                keys = np.concatenate([*(u for _, u in some), np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.array([sig for sig, _ in some], np.int64), [len(u) for _, u in some]))], names=["key", "sig"])

    def count(batches: Iterator) -> Iterator:
        """Sets of each key, from sorted rows; the last key of a batch may go on in the next."""
        import pyarrow as pa

        now, last, n = None, None, 0
        for batch in batches:
            key, sig = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            at, begins = _runs(key, sig, now, last)
            group = np.cumsum(begins)
            times = np.bincount(group, minlength=1)
            times[0] += n
            of = np.concatenate([[0 if now is None else now], key[at][begins]])
            done = np.flatnonzero(times[:-1] >= SAMPLE_LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(of[done]), pa.array(times[done])], names=["key", "n"])
            now, last, n = key[-1], sig[-1], int(times[-1])
        if n >= SAMPLE_LEAST:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64())], names=["key", "n"])

    keys = docs.select("text").mapInArrow(run, "key long, sig long").repartition("key").sortWithinPartitions("key", "sig")
    got = keys.mapInArrow(count, "key long, n long").orderBy(F.desc("n"), "key").limit(SAMPLE_SHINGLES).toArrow()
    return np.sort(got["key"].to_numpy().view(np.uint64))


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, pos, sig, hub) of keys that two sets have, each set once a key; the hub is the key's least set.

    Keys move once and are sorted; a task reads them in order and holds a row.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        now, last, hub, held = None, None, 0, None
        for batch in batches:
            key, sig, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                key, sig, pos = np.r_[held[0], key], np.r_[held[1], sig], np.r_[held[2], pos]
            at, begins = _runs(key, sig, now, last)
            if not len(at):
                continue
            key, sig, pos = key[at], sig[at], pos[at]
            group = np.cumsum(begins)  # 0 goes on from the batch before
            size = np.bincount(group)
            hubs = np.r_[hub, sig[begins]][group]
            many = (group == 0) | (size[group] > 1)
            # The only row of the last key so far waits for the next batch.
            held = None if many[-1] else (key[-1], sig[-1], pos[-1])
            now, last, hub = (key[-1], sig[-1], hubs[-1]) if many[-1] else (None, None, 0)
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(pos[many].astype(np.int32)), pa.array(sig[many]), pa.array(hubs[many])], names=["key", "pos", "sig", "hub"])

    return keys.select("key", "sig", "pos").repartition("key").sortWithinPartitions("key", "sig").mapInArrow(run, "key long, pos int, sig long, hub long")


def describe(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """Per row its set's signature and size; with a task's first row of a set, its count vector and prefix keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        seen: set[int] = set()
        for batch in batches:
            for w in words_of(batch.column(1)):
                if len(seen) > REMEMBERED:
                    seen.clear()
                sigs, sizes, vectors, keys = [], [], [], []
                for u in shingles(w):
                    sig = signature(u) if len(u) else None
                    new = sig is not None and sig not in seen
                    sigs.append(sig)
                    sizes.append(len(u))
                    vectors.append(counted(u) if new else None)
                    keys.append(prefix(u, late).view(np.int64) if new else None)
                    if new:
                        seen.add(sig)
                ids = batch.column(0)[w.row0 : w.row0 + len(sigs)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "sig", "n", "vec", "keys"])

    return docs.mapInArrow(run, "doc_id long, sig long, n long, vec binary, keys array<long>")


class CountTree:
    """R-tree of count vectors: boxes hold coordinate maxima, the least set size and the largest cap on an overlap below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, caps: np.ndarray):
        spread = points.var(0) if len(points) > LEAF else np.zeros(points.shape[1])
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // max(LEAF, int(len(sizes) ** 0.5))
        self.order = np.lexsort((points[:, int(spread.argmax())], slab))
        self.levels = [(points[self.order], sizes[self.order], caps[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            p, s, c = self.levels[-1]
            cut = np.arange(0, len(p), LEAF)
            self.levels.append((np.maximum.reduceat(p, cut), np.minimum.reduceat(s, cut), np.maximum.reduceat(c, cut)))

    def search(self, point: np.ndarray, size: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all points whose summed coordinate minima with ``point``, and caps, allow a link; and those sums."""
        at = np.arange(len(self.levels[-1][0]))
        both = at
        for depth in range(len(self.levels) - 1, -1, -1):
            p, s, c = self.levels[depth]
            at = at[NEED_I * np.minimum(c[at], cap) >= NEED_S * (s[at] + size)]
            both = np.minimum(p[at], point).sum(1)
            ok = NEED_I * both >= NEED_S * (s[at] + size)
            at, both = at[ok], both[ok]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at], both


class Points:
    """Sets of one block: an R-tree for each number of coordinates, and for half of it, which sizes within 3/4 need."""

    def __init__(self, sizes: np.ndarray, caps: np.ndarray, vectors: list[bytes]):
        self.sizes, self.caps = sizes, caps
        length = np.fromiter(map(len, vectors), np.int64, len(vectors))
        self.kinds = {int(g): np.flatnonzero(length == g) for g in np.unique(length)}
        self.points = {g: counts_of([vectors[i] for i in at.tolist()], sizes[at]) for g, at in self.kinds.items()}
        self.place = np.empty(len(vectors), np.int64)
        for at in self.kinds.values():
            self.place[at] = np.arange(len(at))
        self.length, self.trees = length, {}

    def tree(self, kind: int, groups: int) -> CountTree:
        if (kind, groups) not in self.trees:
            at, p = self.kinds[kind], self.points[kind]
            self.trees[kind, groups] = CountTree(p if groups == kind else coarser(p), self.sizes[at], self.caps[at])
        return self.trees[kind, groups]

    def own(self, i: int) -> np.ndarray:
        return self.points[int(self.length[i])][self.place[i]]

    def search(self, point: np.ndarray, size: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all sets that may link with a set, and the bounds of their overlap."""
        g, hits, bounds = len(point), [], []
        for kind in (g // 2, g, 2 * g):
            if kind in self.kinds:
                hit, both = self.tree(kind, min(kind, g)).search(coarser(point) if kind < g else point, size, cap)
                hits.append(self.kinds[kind][hit])
                bounds.append(both)
        return (hits[0], bounds[0]) if len(hits) == 1 else (np.concatenate([*hits, np.zeros(0, np.int64)]), np.concatenate([*bounds, np.zeros(0, np.int64)]))


def blocks_of(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blocks``, in how many blocks the rows of their ``grp`` are dealt."""
    some = rows.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks")).filter("blocks > 1")
    some = some.select("grp", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("sig", F.lit(1)), F.lit(SALTS)).cast("int"))
    return salted.join(some, ["grp", "salt"], "left").drop("salt").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def survivors(rows: DataFrame, points: DataFrame, likeliest: bool = False) -> DataFrame:
    """Pairs (a, b) of different components in a group (grp) that the count vectors and caps allow, for rows that ask.

    With ``likeliest``, of each row only the pair with the largest bound in its block.

    ``rows`` has grp, blocks, sig, comp, pos and asks; sizes and vectors come from
    ``points`` last, so that they travel once. A task holds one group; groups of
    over ``BLOCK`` rows are split in blocks, and rows that ask go to the other blocks of
    their group too, but with ``likeliest``, where any partner will do. The size less
    ``pos`` bounds the overlap of a pair of which the group's key is the first common
    one: pairs that have it later in their orders are found in another group.
    A pair comes once from each block that finds it.
    """
    columns = ["grp", "block", "foreign", "sig", "comp", "pos", "asks"]
    own = rows.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("foreign", F.lit(False))
    every = own.select(*columns)
    if not likeliest:
        other = own.filter("asks and blocks > 1").drop("foreign").withColumnRenamed("block", "home")
        other = other.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("block <> home").withColumn("foreign", F.lit(True))
        every = every.unionByName(other.select(*columns))
    every = every.join(points.select("sig", "n", "vec"), "sig").select("grp", "block", "foreign", "sig", "comp", "n", (F.col("n") - F.col("pos")).alias("cap"), "asks", "vec")
    dealt = every.repartition("grp", "block").sortWithinPartitions("grp", "block", "foreign")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, held, block = None, [], None
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        group: list[np.ndarray] = []

        def found(point, n, cap, comp, sig):
            hit, both = block[0].search(point, n, cap)
            other = block[2][hit] != comp
            if not likeliest:
                other &= ~block[3][hit] | (block[1][hit] > sig)  # of two that ask, one is enough
            hit, both = hit[other], both[other]
            if likeliest and len(hit) > 1:
                hit = hit[[np.argmax(both / (block[0].sizes[hit] + n))]]
            left.append(np.full(len(hit), sig))
            right.append(block[1][hit])
            group.append(np.full(len(hit), now[0]))

        def settle():
            """Build what is held of a group, and ask its own rows."""
            nonlocal block
            sig, comp, n, cap, asks = (np.concatenate(x) for x in zip(*(h[:5] for h in held), strict=True))
            if len(sig) > 1 or held[0][6]:
                block = (Points(n, cap, [v for h in held for v in h[5]]), sig, comp, asks)
                for i in np.flatnonzero(asks).tolist():
                    found(block[0].own(i), int(n[i]), int(cap[i]), comp[i], sig[i])
            held.clear()

        def pairs():
            a, b, of = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right, group))
            for x in (left, right, group):
                x.clear()
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a, of))
            a, b, of = a[order], b[order], of[order]
            new = np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(of) != 0)][: len(a)]
            return pa.RecordBatch.from_arrays([pa.array(x[new], pa.int64()) for x in (a, b, of)], names=["a", "b", "grp"])

        for batch in batches:
            grp, blk, foreign, sig, comp, n, cap, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            vec = batch.column(8).to_pylist()
            new = np.flatnonzero(np.r_[True, (np.diff(grp) != 0) | (np.diff(blk) != 0) | np.diff(foreign)])
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(grp)], strict=True):
                if (grp[lo], blk[lo]) != now:
                    if held:
                        settle()
                    now, block = (grp[lo], blk[lo]), None
                if not foreign[lo]:
                    held.append((sig[lo:hi], comp[lo:hi], n[lo:hi], cap[lo:hi], asks[lo:hi], vec[lo:hi], False))
                    continue
                if held:
                    held[0] = (*held[0][:6], True)
                    settle()
                if block:
                    for i in range(lo, hi):
                        found(counts_of([vec[i]], n[i : i + 1])[0], int(n[i]), int(cap[i]), comp[i], sig[i])
            yield pairs()
        if held:
            settle()
            yield pairs()

    return dealt.mapInArrow(run, "a long, b long, grp long")


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.view(np.uint64))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)])


def membership_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of one long column, summed over tasks; beyond ``FILTER_BITS`` it lets more ids pass."""
    bits = min(FILTER_BITS, 1 << (FILTER_EACH * max(64, ids.count()) - 1).bit_length())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = _places(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            word, back = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    got = ids.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return out


def may_hold(members: np.ndarray, ids) -> np.ndarray:
    """Of an Arrow column of long ids, which ``members`` may hold; a null counts as 0."""
    import pyarrow.compute as pc

    at = _places(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), len(members) << 6)
    return ((members[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)


def sets_of(docs: DataFrame, members: np.ndarray) -> DataFrame:
    """(sig, hashes) of the sets of rows whose ``doc_id`` ``members`` may hold, or is null: a row each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(1).filter(pc.or_(pa.array(may_hold(members, batch.column(0))), pc.is_null(batch.column(0))))
            for w in words_of(texts):
                new = list(_new_sets(w, seen))
                yield pa.RecordBatch.from_arrays([pa.array([sig for _, sig, _ in new], pa.int64()), pa.array([u.view(np.int64) for _, _, u in new], pa.list_(pa.int64()))], names=["sig", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, hashes array<long>").dropDuplicates(["sig"])


def key_rich(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs with as many common prefix keys as a link implies.

    Of a set of size a that links with one of size b at most a - o shingles are not
    common, o being the least overlap, so that at least p - (a - o) of its p prefix
    keys are; for the one of both whose prefix ends first in the common order, these
    are keys of the other's prefix too.
    """
    side = lambda c: prefixes.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("ks").alias(f"k{c}"))
    least = F.ceil(NEED_S * (F.col("na") + F.col("nb")) / F.lit(float(NEED_I)))
    spare = lambda n: n - F.floor((3 * n + 3) / 4) + 1 - n + least
    need = F.greatest(F.lit(1), F.least(spare(F.col("na")), spare(F.col("nb"))))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(F.size(F.array_intersect("ka", "kb")) >= need).select("a", "b")


def sets_in(docs: DataFrame, points: DataFrame, sigs: DataFrame) -> DataFrame:
    """(sig, hashes) of all sets of ``sigs(sig)`` (and of a few more), from one document each; dealt by sig."""
    ids = sigs.distinct().join(points, "sig").filter("doc_id is not null").select("doc_id")
    return sets_of(docs, membership_filter(ids))


class Forest:
    """Disjoint sets of numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i


def linking_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what all links among ``sets`` connect: no pair of one component is tried again.

    The R-tree gives each set's candidates, the likeliest of every other component
    first; a component is done with at its first link.
    """
    sizes = np.array([len(u) for u in sets])
    points, forest, out = Points(sizes, sizes, [counted(u) for u in sets]), Forest(len(sets)), []
    for i in range(len(sets)):
        near, both = points.search(points.own(i), int(sizes[i]), int(sizes[i]))
        before = near < i
        near, both = near[before], both[before]
        roots = np.array([forest.find(j) for j in near.tolist()], np.int64)
        other = roots != forest.find(i)
        near, both, roots = near[other], both[other], roots[other]
        order = np.argsort(-both / (sizes[near] + sizes[i]), kind="stable")
        done: set[int] = set()
        for j, root in zip(near[order].tolist(), roots[order].tolist(), strict=True):
            if root in done:
                continue
            k = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if NEED_I * k >= NEED_S * (len(sets[i]) + len(sets[j])):
                out.append((i, j))
                done.add(root)
                forest.up[forest.find(j)] = forest.find(i)
    return out


def star_links(docs: DataFrame, points: DataFrame, stars: DataFrame, paths: list[str]) -> DataFrame:
    """Links (a, b) within the stars (grp, sig) of hubs and their sets.

    Stars of many sets, or large ones, are split in blocks, of which each has the hub
    too. Blocks are dealt before the sets are read, so that a set travels twice: to
    its rows, and with them to their blocks.
    """
    placed = stars.filter("grp <> sig").unionByName(stars.select("grp", F.col("grp").alias("sig")).distinct())
    blocks = placed.join(points.select("sig", "n"), "sig").groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / F.lit(STAR_SETS), F.sum("n") / F.lit(STAR_SHINGLES))).cast("int").alias("blocks"))
    dealt = F.when(F.col("grp") == F.col("sig"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")))
    placed = stored(placed.join(blocks, "grp").select("grp", "sig", F.explode(dealt).alias("block")), "placed", paths=paths)
    sets = sets_in(docs, points, placed.select("sig"))
    rows = placed.join(sets, "sig").select("grp", "block", "sig", "hashes").repartition("grp", "block").sortWithinPartitions("grp", "block")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, sigs, held = None, [], []

        def links():
            pairs = linking_pairs(held)
            a, b = np.array([sigs[i] for i, _ in pairs], np.int64), np.array([sigs[j] for _, j in pairs], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for grp, block, sig, hashes in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (grp, block) != now:
                    if len(held) > 1:
                        yield links()
                    now, sigs, held = (grp, block), [], []
                sigs.append(sig)
                held.append(hashes.values.to_numpy().view(np.uint64))
        if len(held) > 1:
            yield links()

    return rows.mapInArrow(run, "a long, b long").distinct()


def verified(docs: DataFrame, points: DataFrame, pairs: DataFrame, paths: list[str]) -> DataFrame:
    """The pairs whose sets do link."""
    sets = stored(sets_in(docs, points, pairs.select(F.explode(F.array("a", "b")).alias("sig"))), "sets", "lz4", paths)
    free_shuffles(docs.sparkSession)
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("hashes").alias(f"h{c}"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(NEED_I * both >= NEED_S * (F.size("ha") + F.size("hb"))).select("a", "b")


def unlike_groups(members: DataFrame) -> DataFrame:
    """(key, sig, pos) of ``members``; of groups with equal members one.

    That one is the first in the common order of keys, so that its places in the
    members' orders bound what a pair can share from there on.
    """
    alike = lambda i: F.bit_xor(F.xxhash64("sig", F.lit(i)))
    groups = members.groupBy("key").agg(F.count("*").alias("g"), alike(1).alias("h"), alike(2).alias("i"), F.min(F.struct("sig", "pos")).alias("first"))
    chosen = groups.groupBy("g", "h", "i").agg(F.min_by("key", F.col("first.pos")).alias("key"))
    return members.join(chosen.select("key"), "key", "left_semi").select("key", "sig", "pos")


def _spanning(members: DataFrame, roots: DataFrame, paths: list[str]) -> DataFrame:
    """(key, sig, pos, comp, main, blocks) of the members of groups that span components."""
    comp = members.select("key", "sig", "pos").join(roots.withColumnRenamed("id", "sig"), "sig", "left").select("key", "sig", "pos", F.coalesce("root", "sig").alias("comp"))
    comp = stored(comp, "member-components", paths=paths)
    spans = comp.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("g"), F.count("*").alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main"))
    spans = spans.filter("comps > 1").select("key", "main", F.ceil(F.col("g") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    return stored(comp.join(spans, "key").select("key", "sig", "pos", "comp", "main", "blocks"), "open-groups", paths=paths)


def classes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, sig, n) of all documents, and (sig, root) of all sets that link, as two frames.

    First each set that has a likely partner meets the one hub with which it shares the
    most prefix keys, and the others of that hub; links make components. Then groups of
    sets with a common key that still span components link their likeliest pairs, and
    last they are searched completely for pairs across components. Together no link
    that matters to a component is missed, and a group of near copies costs a number
    of pairs in proportion to its size.
    """
    spark: SparkSession = docs.sparkSession
    old: list[str] = []
    brief: list[str] = []

    def drop(paths: list[str]) -> None:
        for path in paths:
            remove(spark, path)
        paths.clear()
        free_shuffles(spark)

    late = frequent_shingles(docs)
    free_shuffles(spark)
    shingled = stored(describe(docs.select("doc_id", "text"), late), "shingled", "lz4", brief)
    rows = stored(shingled.select("doc_id", "sig", "n"), "rows")
    points = shingled.filter("vec is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("vec").alias("vec"))
    points = stored(points, "points", paths=old)
    # A key of one set can't bring sets together; most are.
    keys = shingled.filter("keys is not null").select(F.posexplode("keys").alias("pos", "key"), "sig")
    with arrow_rows(spark, 50_000):
        members = stored(shared_keys(keys), "members", paths=old)
    drop(brief)
    prefixes = stored(members.groupBy("sig").agg(F.collect_list("key").alias("ks")).join(points.select("sig", "n"), "sig"), "shared-keys", "lz4", old)
    votes = members.filter("sig <> hub").groupBy("sig", "hub").agg(F.count("*").alias("votes"))
    best = votes.groupBy("sig").agg(F.max_by("hub", F.struct("votes", "hub")).alias("grp"))
    best = stored(best, "hubs", paths=old)
    members = stored(unlike_groups(members), "unlike-groups", paths=old)
    meeting = blocks_of(best.unionByName(best.select(F.col("grp").alias("sig"), "grp").distinct()))
    meeting = meeting.select("grp", "blocks", "sig", F.col("sig").alias("comp"), F.lit(0).alias("pos"), F.lit(True).alias("asks"))
    first = survivors(meeting, points, likeliest=True)
    near = first.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    stars = best.join(near, "sig", "left_semi").select("grp", "sig")
    links = stored(star_links(docs, points, stored(stars, "stars", paths=brief), brief), "links", paths=old)
    roots = stored(components(links), "roots")

    drop(brief)
    for whole in (False, True):
        # A first round links what is likeliest, so that a large group is one component before pairs are listed.
        members = _spanning(members, roots, old)  # a group that is one component stays one
        meeting = members.select(F.col("key").alias("grp"), "blocks", "sig", "comp", "pos", (F.col("comp") != F.col("main")).alias("asks"))
        met = stored(survivors(meeting, points, likeliest=not whole), "met", paths=brief)
        if not whole:
            # A group of one block was searched in full: where no row met one of another component, none will later.
            busy = met.select(F.col("grp").alias("key")).distinct()
            members = members.filter("blocks > 1").unionByName(members.filter("blocks = 1").join(busy, "key", "left_semi"))
            members = stored(members, "busy-groups", paths=old)
        rest = stored(key_rich(met.select("a", "b").distinct(), prefixes), "pairs", paths=brief)
        if not rest.isEmpty():
            links = links.unionByName(stored(verified(docs, points, rest, brief), "links", paths=old))
            roots = stored(components(links), "roots")
        drop(brief)
    drop(old)  # all but these two has served
    return rows, roots


def join(docs: DataFrame) -> DataFrame:
    """Per document its number of shingles and the least id of its component of links.

    Null and empty texts, and texts without words, have 0 shingles and stand alone;
    equal texts link; null ids take part but never name a component unless it has no
    other; repeated rows are rows each; an empty table gives no rows; other columns
    are not read. Sets are known by 64-bit hashes of their shingles.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 500):
        rows, roots = classes(base)
    named = _by_set(rows, roots, F.min("least").alias("component_id"), ["component_id"])
    return _salted(rows).join(named, ["sig", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))


def _by_set(rows: DataFrame, roots: DataFrame, value, columns: list[str]) -> DataFrame:
    """``value`` over each component's sets, by (sig, salt), for sets with more than one row or any link.

    A set of very many rows meets them in ``SALTS`` slices.
    """
    per_set = rows.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "sig")).alias("kept"), F.count("*").alias("k")).join(roots.withColumnRenamed("id", "sig"), "sig", "left")
    per_set = stored(per_set.filter("k > 1 or root is not null").select("sig", F.coalesce("root", "sig").alias("root"), "least", "kept"), "sets-of-rows")
    return per_set.select("sig", "root").join(per_set.groupBy("root").agg(value), "root").select("sig", *columns, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each component: its least ``doc_id`` stays (a null one first).

    Texts without words stay. Of equal rows of one id one stays. Rows whose ids a filter
    clears stay where they are; only the others, copies nearly all, are joined.
    """
    at, columns = docs.columns.index("text"), docs.columns
    own = "_sig"
    while own.lower() in (c.lower() for c in columns):
        own += "_"
    keyed = docs.withColumn(own, F.col("doc_id").cast("long"))
    rows, roots = classes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")))
    kept = _by_set(rows, roots, F.min("kept").alias("kept"), ["kept"])
    gone = _salted(rows).join(kept, ["sig", "salt"]).filter(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("sig") == F.col("kept.sig")))).select("doc_id", "sig").distinct()
    gone = stored(gone, "gone")
    repeated = stored(rows.filter("sig is not null").groupBy("doc_id", "sig").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"), "repeated")
    members = membership_filter(gone.select("doc_id").unionByName(repeated).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id")))

    def run(batches: Iterator, doubtful: bool) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            part = batch.filter(pa.array(may_hold(members, batch.column(len(columns))) == doubtful))
            if doubtful:
                sigs = [signature(u) if len(u) else None for w in words_of(part.column(at)) for u in shingles(w)]
                part = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sigs, pa.int64())], names=[*columns, own])
            yield part

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {own} long"
    clear = keyed.mapInArrow(lambda batches: run(batches, False), schema)
    signed, gone = keyed.mapInArrow(lambda batches: run(batches, True), schema).alias("signed"), gone.alias("gone")
    same = F.col("signed.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id")) & (F.col(f"signed.{own}") == F.col("gone.sig"))
    left = signed.join(gone, same, "left_anti")
    if not repeated.isEmpty():
        left = left.filter(f"{own} is null").unionByName(left.filter(f"{own} is not null").dropDuplicates(["doc_id", own]))
    return clear.unionByName(left).select(*(f"`{c}`" for c in columns))
