"""Token counts under a unigram vocabulary: best-score segmentation, of which only the count is kept."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.tokenizers_io import default_path

SPACE = "▁"
#: What an unknown character costs below the least score, as unigram tokenizers have it.
UNKNOWN_PENALTY = 10.0
#: Segmentations that a worker remembers.
CACHE = 400_000
SCHEMA = "doc_id long, n_tokens long, n_unknown long, score double"


class CountViterbi:
    """Piece count and score of the best segmentation, without its pieces.

    An Aho-Corasick automaton gives all vocabulary matches by their ends. For each
    position the best score and its piece count are kept. Of equal scores the longest
    last piece wins: a candidate from an earlier start is met first and only a
    strictly better one replaces it. A character that no single-character piece
    covers may be unknown; runs of unknown characters are one piece.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        # Text may be cut before a space mark if no piece has one after another character.
        self.separable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.cache: dict[str, tuple[int, int, float]] = {}

    def segment(self, text: str) -> tuple[int, int, float]:
        """(pieces, unknown pieces, score) of one stretch of text."""
        n = len(text)
        if self.single.issuperset(text):  # no character can be unknown; matches of an end come longest first
            top, number = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for end, (length, piece_score) in self.automaton.iter(text):
                end += 1
                s = top[end - length] + piece_score
                if s > top[end]:
                    top[end] = s
                    number[end] = number[end - length] + 1
            return number[n], 0, top[n]
        best: list[float | None] = [None] * (n + 1)
        count, bad, open_bad = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for end in range(n):
            top, at, unk = None, 0, False
            for length, score in sorted(ends[end], reverse=True):
                start = end + 1 - length
                if top is None or best[start] + score > top:
                    top, at, unk = best[start] + score, start, False
            if text[end] not in self.single and (top is None or best[end] + self.unknown > top):
                top, at, unk = best[end] + self.unknown, end, True
            best[end + 1], open_bad[end + 1] = top, unk
            fused = unk and open_bad[at]
            count[end + 1] = count[at] + (not fused)
            bad[end + 1] = bad[at] + (unk and not fused)
        return count[n], bad[n], best[n]

    def _cached(self, part: str) -> tuple[int, int, float]:
        got = self.cache.get(part)
        if got is None:
            got = self.segment(part)
            if len(part) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[part] = got
        return got

    def count(self, text: str) -> tuple[int, int, float]:
        """Spaces become marks, with one before the text; empty text has no pieces."""
        if not text:
            return 0, 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.separable:
            return self.segment(marked)
        n = bad = 0
        score = 0.0
        before = False
        for part in re.findall(f"{SPACE}+[^{SPACE}]*", marked):
            c, b, s = self._cached(part)
            # An unknown run can't span parts: each begins with a mark, which is a piece or itself unknown.
            n, bad, score = n + c, bad + b, score + s
            before = before or b > 0
        if before and SPACE not in self.single:
            return self.segment(marked)  # without a piece for the mark, runs may fuse across parts
        return n, bad, score


@functools.lru_cache(maxsize=2)
def sentencepiece_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a model file; control, unknown and byte pieces can't match text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> CountViterbi:
    return CountViterbi(list(sentencepiece_vocabulary(path)))


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: number of pieces, unknown ones among them, and the segmentation's score.

    Whole texts are counted where they are read, without a shuffle. Null or empty
    text has 0 pieces; repeated rows are counted each; an empty table gives no rows;
    other columns are not read.
    """
    path = model or default_path("piece_bpe_32k.model")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocab = counter(path)
        for batch in batches:
            got = [vocab.count(t.as_py() or "") for t in batch.column(1)]
            n, bad, score = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(bad, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "n_unknown", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
