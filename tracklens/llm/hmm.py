"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import one_blas_thread, remove, stored
from tracklens.llm.words import Words, words_of

STATES = 8
#: Passes of Baum-Welch over all training texts.
PASSES = 4
#: Weight of staying in a state at first, against some 0.4 of moving to each other one: states that last find topics and languages in few passes.
STAY = 100.0
#: Words whose counts are sent to all tasks, at most (16 bytes each); rarer ones are joined.
HEAD = 100_000
#: Words with emission parameters of their own, at most, and the least count of one.
OWN, OWN_COUNT = 16_000, 5
#: Other words share emissions by the last two letters; words of a class are told apart by their counts.
BUCKETS = 256
#: Tokens whose states a task holds at once, and tokens that it gathers before it runs over them.
CELLS, GATHERED = 1 << 20, 1 << 22
#: Weight, in tokens, of the unigram prior of each state's emissions.
PRIOR = 500.0
END = np.uint64(0x9E3779B97F4A7C00)
_LOW = np.uint64(BUCKETS - 1)


def token_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, an end after each row's words, and the bounds of rows.

    A key is a word's hash with its emission bucket in the low bits.
    """
    last = w.data[w.ends - 1].astype(np.uint64) if len(w.ends) else np.zeros(0, np.uint64)
    before = w.data[np.maximum(w.ends - 2, w.starts)].astype(np.uint64) if len(w.ends) else last
    fold = lambda b: np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
    bucket = (fold(last) * np.uint64(31) + fold(before) * np.uint64(7)) & _LOW
    keys = (w.hashes & ~_LOW) | bucket
    bounds = w.first + np.arange(len(w.first))
    out = np.empty(len(keys) + len(w.first) - 1, np.uint64)
    ends = bounds[1:] - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = keys, END
    return out, bounds


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of all tokens of ``docs(text)``; summed by batch, by task, then by key."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        for batch in batches:
            for w in words_of(batch.column(0)):
                keys, n = np.unique(token_keys(w)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Counts of frequent words, the classes of all words, and corpus totals."""

    keys: np.ndarray  # sorted
    counts: np.ndarray
    cls: np.ndarray  # of each key
    own: int  # classes 0 .. own - 1 are words, the next BUCKETS are buckets
    mass: np.ndarray  # of each class: sum of count + 1, buckets with one more for an unseen word
    tokens: int
    types: int

    def encode(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its place among the frequent words (-1: not one of them)."""
        if not len(self.keys):
            return (self.own + (keys & _LOW)).astype(np.int32), np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.cls[at], self.own + (keys & _LOW).astype(np.int64)).astype(np.int32), np.where(found, at, -1)


def lexicon(counts: DataFrame, head: int = HEAD, own: int = OWN, own_count: int = OWN_COUNT) -> Lexicon:
    """Frequent words by count thresholds, which a histogram of at most some hundred classes gives."""
    level = F.floor(F.log2("n") * 8).cast("int")
    hist = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    tokens, types = sum(r.tokens for r in hist), sum(r.words for r in hist)

    def least(most: int) -> int:
        """The lowest level from which on there are at most ``most`` words."""
        total, low = 0, 10**6
        for r in sorted(hist, key=lambda r: -r.level):
            if (total := total + r.words) > most:
                break
            low = r.level
        return low

    top, mine = counts.withColumn("level", level), least(own)
    is_end = F.col("key") == int(_signed(np.array([END]))[0])
    is_own = is_end | ((F.col("level") >= mine) & (F.col("n") >= own_count))
    rows = top.filter((F.col("level") >= least(head)) | is_end).select("key", "n", is_own.alias("own")).toArrow()
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    mine_mask = rows["own"].to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(keys)
    keys, n, mine_mask = keys[order], n[order], mine_mask[order]
    m = int(mine_mask.sum())
    cls = m + (keys & _LOW).astype(np.int64)
    cls[mine_mask] = np.arange(m)
    mass = np.ones(m + BUCKETS)
    mass[:m] = n[mine_mask] + 1
    rest = top.filter(~is_own).groupBy(F.col("key").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum(F.col("n") + 1).alias("mass")).collect()
    for r in rest:
        mass[m + r.bucket] += r.mass
    return Lexicon(keys, n, cls, m, mass, tokens, types)


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (K, classes)

    @staticmethod
    def initial(lex: Lexicon, states: int, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        base = lex.mass / lex.mass.sum()
        emit = base * (rng.gamma(1.0, 1.0, (states, len(base))) + 0.001)
        move = np.eye(states) * STAY + rng.random((states, states)) * 0.2 + 0.3
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def maximised(counts: Counts, lex: Lexicon, prior: float = PRIOR) -> Model:
        base = lex.mass / lex.mass.sum()
        start, move = counts.start + 0.1, counts.move + 0.1
        emit = counts.emit + prior * base
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


class Counts:
    """Expected starts, moves and emissions."""

    def __init__(self, states: int, classes: int):
        self.start, self.move, self.emit, self.log = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)), 0.0

    def add(self, model: Model, tok: np.ndarray, bounds: np.ndarray) -> None:
        """Forward-backward over whole texts, those of like length side by side."""
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")[: int((n > 0).sum())]
        i = 0
        while i < len(order):
            part = order[i : i + max(1, CELLS // int(n[order[i]]))]
            self._texts(model, tok, bounds[part], n[part])
            i += len(part)

    def _texts(self, model: Model, tok: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        """Texts by falling length. One of more than ``CELLS`` tokens is run in parts: states at their starts first, then backwards, part by part."""
        size = max(1, CELLS // len(at))
        cuts = [*range(0, int(length[0]), size), int(length[0])]
        entry: list[np.ndarray | None] = [None]
        for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
            entry.append(self._forward(model, tok, at, length, lo, hi, entry[-1])[1][:, -1])
        beta = np.ones((len(model.move), len(at)), np.float32)
        for lo, hi, a in reversed(list(zip(cuts[:-1], cuts[1:], entry, strict=True))):
            beta = self._part(model, tok, at, length, lo, hi, a, beta)

    @staticmethod
    def _forward(model: Model, tok: np.ndarray, at: np.ndarray, length: np.ndarray, lo: int, hi: int, a: np.ndarray | None) -> tuple:
        """(emissions, scaled states, scales, classes, number of texts longer than t) of the tokens lo .. hi."""
        steps, n = hi - lo, len(at)
        active = np.searchsorted(-length, -np.arange(lo, hi), "left")
        t_of = np.arange(lo, hi)[:, None]
        seq = np.where(t_of < length, tok[np.minimum(at + t_of, len(tok) - 1)], 0)
        move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
        e = np.maximum(emit[:, seq], np.float32(1e-30))  # (K, steps, n)
        alpha = np.zeros((len(move), steps, n), np.float32)
        scale = np.ones((steps, n), np.float32)
        for t in range(steps):
            m = active[t]
            a = model.start.astype(np.float32)[:, None] * e[:, 0] if a is None else (move.T @ a[:, :m]) * e[:, t, :m]
            scale[t, :m] = a.sum(0)
            a = a / scale[t, :m]
            alpha[:, t, :m] = a
        return e, alpha, scale, seq, active

    def _part(self, model: Model, tok: np.ndarray, at: np.ndarray, length: np.ndarray, lo: int, hi: int, entry: np.ndarray | None, beta: np.ndarray) -> np.ndarray:
        """Add the counts of the tokens lo .. hi, and of the moves into them; ``beta`` is that of the last, the one before lo is returned."""
        e, alpha, scale, seq, active = self._forward(model, tok, at, length, lo, hi, entry)
        move = model.move.astype(np.float32)
        self.log += float(np.log10(scale.astype(np.float64)).sum())
        for t in range(hi - lo - 1, -1, -1):
            m = active[t]
            b = e[:, t, :m] * beta[:, :m] / scale[t, :m]
            alpha[:, t, :m] *= beta[:, :m]
            before = alpha[:, t - 1, :m] if t else entry
            if before is not None:
                self.move += (before[:, :m] @ b.T).astype(np.float64) * model.move
                beta[:, :m] = move @ b
        if lo == 0:
            self.start += alpha[:, 0].sum(1, dtype=np.float64)
        flat = seq.ravel()
        for s in range(len(move)):
            self.emit[s] += np.bincount(flat, weights=alpha[s].ravel(), minlength=self.emit.shape[1])
        return beta

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(row number, values by state): classes with counts, then start, moves and the likelihood from -1 on down."""
        k = len(self.move)
        used = np.flatnonzero(self.emit.any(0))
        extra = np.vstack([self.start, self.move, np.full((1, k), self.log / k)])
        return np.concatenate([used, -1 - np.arange(len(extra))]), np.vstack([self.emit[:, used].T, extra])

    @staticmethod
    def gathered(numbers: np.ndarray, values: np.ndarray, states: int, classes: int) -> Counts:
        out = Counts(states, classes)
        for r, v in zip(numbers.tolist(), values, strict=True):
            if r >= 0:
                out.emit[:, r] = v
            elif r == -1:
                out.start = v
            elif r >= -1 - states:
                out.move[-2 - r] = v
            else:
                out.log = float(v.sum())
        return out


def encoded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(tok) of each text of ``docs(text)``: the classes of its tokens, two bytes each, or four where there are too many classes."""
    kind = _kind(lex)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        for batch in batches:
            for w in words_of(batch.column(0)):
                keys, bounds = token_keys(w)
                tok = lex.encode(keys)[0].astype(kind)
                column = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * kind.itemsize).astype(np.int64)), pa.py_buffer(tok)])
                yield pa.RecordBatch.from_arrays([column.cast(pa.binary())], names=["tok"])

    return docs.select("text").mapInArrow(run, "tok binary")


def _kind(lex: Lexicon) -> np.dtype:
    return np.dtype("<u2" if len(lex.mass) <= 1 << 16 else "<i4")


def expected_counts(coded: DataFrame, lex: Lexicon, model: Model) -> Counts:
    """Baum-Welch counts of all texts, given as classes: each task sums its own, Spark sums the tasks'."""
    (k, classes), kind = model.emit.shape, _kind(lex)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        total, held, n = Counts(k, classes), [], 0

        def add():
            tok = np.concatenate([t for t, _ in held])
            begin = np.cumsum([0] + [len(t) for t, _ in held])
            total.add(model, tok, np.concatenate([*(b[:-1] + o for (_, b), o in zip(held, begin, strict=False)), begin[-1:]]))
            held.clear()

        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            if not len(column):
                continue
            tok = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind)
            held.append((tok, (at - at[0]) // kind.itemsize))
            n += len(tok)
            if n >= GATHERED:
                add()
                n = 0
        if held:
            add()
        numbers, values = total.rows()
        yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), *(pa.array(values[:, i]) for i in range(k))], names=["row", *(f"s{i}" for i in range(k))])

    summed = coded.mapInArrow(run, "row long, " + ", ".join(f"s{i} double" for i in range(k)))
    got = summed.groupBy("row").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k))).toArrow()
    return Counts.gathered(got["row"].to_numpy(), np.stack([got[f"s{i}"].to_numpy() for i in range(k)], 1), k, classes)


def forward(model: Model, tok: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 likelihood of each text's class sequence: the scaled forward recursion over whole texts."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    at, length = bounds[order], n[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")
    out = np.zeros(len(n))
    a = np.zeros((len(model.move), len(n)))
    back = np.ascontiguousarray(model.move.T)
    for t in range(steps):
        m = active[t]
        e = model.emit[:, tok[at[:m] + t]]
        a = (back @ a[:, :m]) * e if t else model.start[:, None] * e
        s = a.sum(0)
        a /= s
        out[:m] += np.log10(s)
    result = np.empty(len(n))
    result[order] = out
    return result


def train(docs: DataFrame, lex: Lexicon, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch: every pass runs over all training texts, whole ones, whose classes are stored once."""
    model = Model.initial(lex, states)
    if not lex.tokens or not passes:
        return model
    paths: list[str] = []
    coded = stored(encoded(docs, lex), "lm-classes", "lz4", paths)
    for _ in range(passes):
        model = Model.maximised(expected_counts(coded, lex, model), lex)
    remove(docs.sparkSession, paths[0])
    return model


def score(docs: DataFrame, held_out: Column, *, states: int = STATES, passes: int = PASSES, head: int = HEAD, own: int = OWN) -> DataFrame:
    """log10 probabilities of all texts of ``docs(doc_id, text)`` under a model of those not held out.

    Tokens are words, A-Z in lower case, and an end. The base is the add-one unigram
    model; ``score`` is the hidden Markov model's: forward likelihood of the texts'
    emission classes, times each word's share of its class by add-one counts. Counts
    of frequent words are sent to the tasks (a bounded table); all others are joined
    by key, and only words seen in training need a partner. Null text counts as
    empty, of which the end remains; a null ``doc_id`` folds as an empty one; repeated
    rows are scored, and learned from, each; an empty table gives no rows; other
    columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    training = base.filter(~F.col("held_out")).select("text")
    counts = stored(word_counts(training), "word-counts")
    lex = lexicon(counts, head, own)
    model = train(training, lex, states, passes)
    log_mass = np.log10(lex.mass)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        one_blas_thread()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for w in words_of(batch.column(1)):
                keys, bounds = token_keys(w)
                rows = len(bounds) - 1
                cls, place = lex.encode(keys)
                likely = forward(model, cls, bounds)
                seen = place >= 0
                log_n = np.zeros(len(keys))
                log_n[seen] = np.log10(lex.counts[place[seen]] + 1.0)
                shared = cls >= lex.own
                doc = np.repeat(np.arange(rows), np.diff(bounds))
                by_doc = lambda x: np.bincount(doc, weights=x, minlength=rows)
                known, base_log = by_doc(seen), by_doc(log_n)
                in_class = by_doc(np.where(shared, log_n - log_mass[cls], 0.0))
                rare = np.flatnonzero(~seen)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, bounds).astype(np.int32)), pa.array(_signed(keys[rare])))
                span = slice(w.row0, w.row0 + rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + rows)), batch.column(0)[span], batch.column(2)[span], pa.array(np.diff(bounds)), pa.array(known.astype(np.int64)), pa.array(base_log), pa.array(likely + in_class), lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base_log", "model_log", "rare"],
                )
                row += rows

    first = stored(base.select("doc_id", "text", "held_out").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base_log double, model_log double, rare array<long>"), "lm-rows")
    rare = first.select("row", F.explode("rare").alias("key")).join(counts, "key").groupBy("row").agg(F.count("*").alias("known_rare"), F.sum(F.log10(F.col("n") + 1.0)).alias("log_rare"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    log_total = float(np.log10(lex.tokens + lex.types + 1))
    return first.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("known_rare")).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + zero("log_rare") - F.col("n_tokens") * log_total).alias("base_score"), (F.col("model_log") + zero("log_rare")).alias("score"),
    )
