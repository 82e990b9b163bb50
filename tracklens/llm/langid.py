"""Language of texts by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import one_blas_thread

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: The training sample: windows a language and in all, at most; characters of a window; epochs.
SAMPLE_EACH, SAMPLE_ALL, SAMPLE_CHARS, EPOCHS = 2000, 12_000, 220, 14
#: Windows that are convolved at once, and bytes of texts that are windowed at once.
BLOCK, AT_ONCE = 256, 1 << 20
UNDETERMINED = "und"
#: Probability below which a prediction is a guess.
KEPT_SCORE = 0.4
#: Bytes as the network sees them: A-Z as a-z; ASCII signs, digits and white space as a blank.
SEEN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class Network:
    """Filters of several widths over one-hot bytes, the maximum over a window, then a softmax layer."""

    langs: list[str]
    filters: list[np.ndarray]  # of each width: (width, 256, FILTERS)
    shift: np.ndarray  # (filters,)
    dense: np.ndarray  # (filters, languages)
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter sums of byte pairs: those at a position, and what the two bytes after it add."""
        pair = lambda f, i: (f[i][:, None, :] + f[i + 1][None, :, :]).reshape(65536, -1)
        two, three, four = self.filters
        third = np.repeat(three[2][:, None, :], 256, 1).reshape(65536, -1)
        return np.hstack([pair(two, 0), pair(three, 0), pair(four, 0)]), np.hstack([third, pair(four, 2)])

    def features(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rectified maximum of each filter over all its positions in each window of (n, WINDOW) bytes."""
        out = np.empty((len(windows), len(self.shift)), np.float32)
        head, tail = tables
        for i in range(0, len(windows), BLOCK):
            # A byte more, so that each place has a pair after it; sums of wider filters that reach over the end don't count.
            w = np.pad(windows[i : i + BLOCK].astype(np.int32), ((0, 0), (0, 1)))
            pairs = w[:, :-1] * 256 + w[:, 1:]
            g = head[pairs[:, : WINDOW - 1]]
            g[:, : WINDOW - 2, FILTERS:] += tail[pairs[:, 2:]]
            for k, width in enumerate(WIDTHS):
                g[:, WINDOW - width + 1 :, k * FILTERS : (k + 1) * FILTERS] = -np.inf
            out[i : i + BLOCK] = g.max(1)
        return np.maximum(out + self.shift, 0)

    def logits(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.features(windows, tables) @ self.dense + self.bias


def windows_of(*texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Whole texts in consecutive windows, the last of each filled with blanks; and the bounds of each text's windows."""
    first = np.cumsum([0] + [max(1, -(-len(t) // WINDOW)) for t in texts])
    out = np.full(first[-1] * WINDOW, 32, np.uint8)
    for t, at in zip(texts, first.tolist(), strict=False):
        out[at * WINDOW : at * WINDOW + len(t)] = SEEN[np.frombuffer(t, np.uint8)]
    return out.reshape(-1, WINDOW), first


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Adam on cross entropy; a filter's gradient reaches the bytes of its best position only."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    n_filters = FILTERS * len(WIDTHS)
    net = Network(names, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n_filters, np.float32), rng.normal(0, 0.3, (n_filters, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    if not names:
        return net
    x = windows_of(*(t.encode()[:WINDOW] for t in texts))[0]
    y = np.searchsorted(names, langs)
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y].astype(np.float32)
    params = [*net.filters, net.shift, net.dense, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(x))
        for i in range(0, len(order), 128):
            part = order[i : i + 128]
            w = x[part].astype(np.int64)
            best, tops = [], []
            for f, width in zip(net.filters, WIDTHS, strict=True):
                span = WINDOW - width + 1
                s = sum(f[j][w[:, j : j + span]] for j in range(width))
                at = s.argmax(1)
                best.append(at)
                tops.append(np.take_along_axis(s, at[:, None, :], 1)[:, 0])
            h = np.maximum(np.hstack(tops) + net.shift, 0)
            z = h @ net.dense + net.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            d = p * weight[part, None] / len(part)
            dh = (d @ net.dense.T) * (h > 0)
            grads = []
            for k, (f, width) in enumerate(zip(net.filters, WIDTHS, strict=True)):
                g, dk = np.zeros_like(f), dh[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    np.add.at(g[j], (np.take_along_axis(w, best[k] + j, 1), np.arange(FILTERS)[None, :]), dk)
                grads.append(g)
            grads += [dh.sum(0), h.T @ d + 1e-4 * net.dense, d.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, training: Column) -> tuple[list[str], list[str]]:
    """Windows of labelled training texts: a bounded, hash-ordered sample, even over languages."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("k"), training.alias("training"))
    rows = rows.filter(F.col("training") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Labels are few by nature, a row each.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not sizes:
        return [], []
    least = F.map_from_arrays(F.array(*(F.lit(r.lang) for r in sizes)), F.array(*(F.lit(int(min(1.0, SAMPLE_EACH / r.n) * (2**31 - 1))) for r in sizes)))
    rows = rows.filter(F.pmod("k", F.lit(2**31 - 1)) <= F.element_at(least, F.col("lang")))
    at = F.pmod(F.xxhash64("k"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    got = rows.select("k", "lang", F.substring(F.col("text"), at, F.lit(SAMPLE_CHARS)).alias("text")).orderBy("k", "lang", "text").limit(SAMPLE_ALL).collect()
    return [r.text for r in got], [r.lang for r in got]


def told(texts: Iterable[str], net: Network, tables: tuple[np.ndarray, np.ndarray]) -> list[tuple[str, float]]:
    """(language, probability) of whole texts. A text's logits are the mean of its windows', weighted by their letters."""
    out: list[tuple[str, float]] = []
    held: list[tuple[int, bytes]] = []

    def tell() -> None:
        w, first = windows_of(*(raw for _, raw in held))
        letters = (w != 32).sum(1)
        z = np.add.reduceat(net.logits(w, tables) * letters[:, None], first[:-1])
        z /= np.maximum(1, np.add.reduceat(letters, first[:-1]))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for (i, _), k, best in zip(held, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            out[i] = net.langs[k], best
        held.clear()

    size = 0
    for t in texts:
        if net.langs and any(map(str.isalpha, t)):
            held.append((len(out), t.encode()))
            size += len(held[-1][1])
        out.append((UNDETERMINED, 0.0))
        if size >= AT_ONCE:
            tell()
            size = 0
    if held:
        tell()
    return out


def predict(docs: DataFrame, net: Network, carry: list[str]) -> DataFrame:
    """``carry`` columns with ``lang_pred`` and ``score``, from all windows of each text."""
    kept = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + (", " if carry else "") + "lang_pred string, score double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        tables = net.tables()
        for batch in batches:
            got = told((t.as_py() or "" for t in batch.column(len(carry))), net, tables)
            langs, scores = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*carry, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, held_out: Column, carry: list[str] | None = None) -> DataFrame:
    """Train on labelled rows that are not held out, predict every row.

    ``lang_pred`` is a language of the training rows; null texts and texts without a
    letter are ``und`` with score 0, and so is everything if no row is labelled.
    Repeated rows are predicted each; an empty table gives no rows; columns other than
    ``doc_id``, ``text`` and ``lang`` are not read.
    """
    net = fit(*sample(docs, ~held_out))
    base = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text") if carry is None else docs
    return predict(base, net, carry or ["doc_id", "held_out"])


def with_language(docs: DataFrame, held_out: Column, least: float = KEPT_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with a probability of ``least``.

    Null texts and texts without a letter go. If no row is labelled nothing can be
    told, and only those go. Null ids and repeated rows are judged by their texts alike;
    an empty table gives no rows.
    """
    net = fit(*sample(docs, ~held_out))
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_blas_thread()
        tables = net.tables()
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(at))
            keep = [score >= least for _, score in told(texts, net, tables)] if net.langs else [any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
