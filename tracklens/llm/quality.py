"""Text quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import one_blas_thread, some_of, stored
from tracklens.llm.words import Words, words_of

#: Labelled rows that the classes are fitted to, at most.
SAMPLE = 20_000
#: Share of the pooled, and of the spherical, covariance in each class's own.
POOLED, SPHERE = 0.10, 0.05
THRESHOLD = 0.3
NAMES = ("log_words", "word_length", "upper", "digits", "signs", "stops", "bare_words", "mixed_words", "long_words", "sign_runs", "distinct", "top_word", "repeats", "spread", "short_lines", "line_repeats")
#: ASCII signs, and those that prose uses between words.
SIGNS, PROSE_SIGNS, STOPS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"!\"'(),-.:;?", b".!?"


def _set(members: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_UPPER, _LOWER, _DIGIT, _SIGN, _PROSE, _STOP = map(_set, (range(65, 91), range(97, 123), range(48, 58), SIGNS, PROSE_SIGNS, STOPS))
_INK = ~_set(b" \t\n\x0b\f\r")
_LETTER = _UPPER | _LOWER | _set(range(128, 256))


def _share(x: np.ndarray) -> np.ndarray:
    """Shares in [0, 1], stretched at both ends."""
    x = np.clip(x, 0.0, 1.0)
    return np.log((x + 0.002) / (1.002 - x))


def word_statistics(w: Words) -> np.ndarray:
    """Transformed statistics of each row's words: their number, make-up and repetition. An empty row has those of zero counts."""
    rows, m = len(w.first) - 1, len(w.starts)
    row = np.repeat(np.arange(rows), np.diff(w.first))
    by_row = lambda x: np.bincount(row, weights=x, minlength=rows)

    def in_words(mask: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=upto[1:])
        return upto[w.ends] - upto[w.starts]

    data, length = w.data, w.ends - w.starts
    letters, digits, upper = in_words(_LETTER[data]), in_words(_DIGIT[data]), in_words(_UPPER[data])
    sign = _SIGN[data]
    signs, odd = in_words(sign), in_words(sign & ~_PROSE[data])
    run = np.zeros(len(data), bool)
    run[1:] = sign[1:] & sign[:-1]
    runs = in_words(run) - run[w.starts]  # a run is of one word
    words = np.diff(w.first)
    n, size = np.maximum(1, words), np.maximum(1, by_row(length))
    again = np.zeros(m, bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((w.hashes, row))
    h, r = w.hashes[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])][:m])
    times = np.diff(np.r_[new, m])
    distinct = np.bincount(r[new], minlength=rows)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, r[new], times)
    held = (letters > 0) & ((digits > 0) | (odd > 0))
    edges = zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)
    spread = np.array([np.count_nonzero(np.bincount(data[w.starts[a] : w.ends[b - 1]], minlength=256)[_INK]) if b > a else 0 for a, b in edges])
    return np.column_stack([
        np.log1p(words), np.log(size / n), _share(by_row(upper) / np.maximum(1, by_row(letters))), _share(by_row(digits) / size), _share(by_row(odd) / size),
        np.log((by_row(in_words(_STOP[data])) + 0.5) / n), _share(by_row(letters + digits == 0) / n), _share(by_row(held) / n), _share(by_row(length > 18) / n), _share(by_row(runs > 0) / n),
        np.log1p(distinct) - 0.85 * np.log1p(words), _share(np.where(words > 4, top / n, 0.05)), _share(by_row(again) / n), np.log1p(spread),
    ])


def _line_statistics(text: str) -> tuple[float, float]:
    """Shares of short lines and of lines that another repeats."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(lines))
    return sum(len(x) < 20 for x in lines) / n, 1 - len(set(lines)) / n


def statistics(column) -> np.ndarray:
    """(rows, statistics) of whole texts of an Arrow column; a null is an empty text."""
    parts = [word_statistics(w) for w in words_of(column)]
    lines = np.array([_line_statistics(t.as_py() or "") for t in column], float).reshape(-1, 2)
    return np.hstack([np.concatenate([*parts, np.zeros((0, len(NAMES) - 2))]), _share(lines)])


@dataclass
class Discriminant:
    """Class means and Cholesky factors of their covariances, computed and inverted once."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: np.ndarray  # log prior minus half the log determinant
    slope: float
    shift: float
    inverses: list[np.ndarray] = field(init=False)  # of the factors, triangular too

    def __post_init__(self):
        self.inverses = [np.tril(np.linalg.inv(f)) for f in self.factors]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density difference, class 1 minus class 0, by Mahalanobis distances."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        logs = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.inverses, self.offsets, strict=True)]
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, sphere: float = SPHERE) -> Discriminant | None:
    """None unless both classes have two rows at least."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    parts = [z[y == c] for c in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    common = sum(len(p) * c for p, c in zip(parts, covs, strict=True)) / len(z)
    d = x.shape[1]
    covs = [(1 - pooled - sphere) * c + pooled * common + sphere * np.trace(common) / d * np.eye(d) + 1e-3 * np.eye(d) for c in covs]
    factors = [np.linalg.cholesky(c) for c in covs]
    offsets = np.array([np.log(len(p) / len(z)) - np.log(np.diag(f)).sum() for p, f in zip(parts, factors, strict=True)])
    model = Discriminant(centre, scale, [p.mean(0) for p in parts], factors, offsets, 1.0, 0.0)
    # Statistics are correlated and not normal, so that margins overstate: fit slope and shift to the labels.
    m, a, b = model.margin(x) / 10, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g = np.array([((p - y) * m).sum() + 0.01 * a, (p - y).sum()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * m * m).sum() + 0.01, (w * m).sum()], [(w * m).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
    if a > 0:
        model.slope, model.shift = float(a) / 10, float(b)
    return model


def with_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns and the array ``x``; texts are read once, without a shuffle."""
    kept = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", x array<double>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        for batch in batches:
            got = statistics(batch.column(len(carry)))
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, len(NAMES), dtype=np.int32)), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], x], names=[*carry, "x"])

    return kept.mapInArrow(run, schema)


def train(stats: DataFrame, labels: DataFrame, training: Column) -> Discriminant | None:
    """Fit to a bounded, hash-ordered sample of labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(some_of(F.xxhash64("doc_id"), SAMPLE, labels.count()))
    rows = stats.filter(training).select("doc_id", "x").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    if not rows:
        return None
    return fit(np.array([r.x for r in rows]), np.array([r.quality for r in rows]))


def apply(stats: DataFrame, model: Discriminant | None, carry: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.select(*carry).schema.fields) + ", score double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        for batch in batches:
            x = np.asarray(batch.column(len(carry)).flatten()).reshape(-1, len(NAMES))
            s = model.scores(x) if model is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(s, pa.float64())], names=[*carry, "score"])

    return stats.select(*carry, "x").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def assess(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Quality scores of all texts.

    Statistics are written once to the shared folder and serve both the fit and the
    scores. A null text is an empty one; a document with several labels counts as the
    better; without labels of both classes every score is 0.5. Repeated rows are
    scored each; an empty table gives no rows; columns other than ``doc_id``, ``text``
    and the labels' ``doc_id``, ``quality`` are not read.
    """
    base = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text")
    stats = stored(with_statistics(base, ["doc_id", "held_out"]), "statistics")
    return apply(stats, train(stats, labels, ~F.col("held_out")), ["doc_id", "held_out"])


def accepted(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold.

    Null ids and repeated rows are judged by their texts alike; without labels of both
    classes every row stays; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text")
    model = train(stored(with_statistics(base, ["doc_id", "held_out"]), "statistics"), labels, ~F.col("held_out"))
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        for batch in batches:
            x = statistics(batch.column(at))
            keep = model.scores(x) >= THRESHOLD if model is not None and len(x) else np.ones(len(x), bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
