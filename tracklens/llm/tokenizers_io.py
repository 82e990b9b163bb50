"""Readers of public tokenizer files; each is loaded once in a worker process."""

from __future__ import annotations

import functools
import json

#: The pre-tokenization pattern of the byte-level vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str):
    """A tiktoken encoding with the vocabulary of a ``tokenizers`` byte-level BPE file.

    Ids rank the merges in such files, so that both libraries give the same ids, where
    the text of an added token stands too (``allowed_special="all"``); tests hold them
    against each other.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    of = _byte_of_char()
    ranks = {bytes(of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)
