"""Byte-level BPE from a tokenizers file, encoded by tiktoken's merge loop over the same vocabulary.

The ids equal those of the ``tokenizers`` library for the file (tested); the vocabulary
file's path is a parameter and the file stays where it is.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: The pre-token pattern that byte-level BPE files with ``use_regex`` stand for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Printable bytes stand for themselves; the others take the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(4)
def encoding(path: str):
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        raise ValueError(f"{path} isn't a plain byte-level BPE")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    back = _byte_of_char()
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: White space of the pattern above in a run that the pattern's engine would have to back out of step by step.
_LONG_BLANK = re.compile(r"[^\S\x1c-\x1f]{5000,}")


def long_blanks(text: str, special: tuple[str, ...] = ()) -> list[tuple[int, int]]:
    """Long runs of white space that are one pre-token: all of a run that ends the text or stands before a special token, else all but its last character, which may belong to what follows."""
    found = [m.span() for m in _LONG_BLANK.finditer(text)]
    return [(a, b if b == len(text) or (special and text.startswith(special, b)) else b - 1) for a, b in found]


def _pieces(text: str, path: str, special: bool) -> list[int]:
    enc = encoding(path)

    def plain(part: str) -> list[int]:
        return enc.encode(part, allowed_special="all", disallowed_special=()) if special else enc.encode_ordinary(part)

    ids: list[int] = []
    at = 0
    for a, b in long_blanks(text, tuple(enc.special_tokens_set) if special else ()):
        ids += plain(text[at:a])
        ids += enc._encode_single_piece(text[a:b])
        at = b
    return ids + plain(text[at:]) if at else plain(text)


def encode(text: str, path: str) -> np.ndarray:
    return np.asarray(_pieces(text, path, True), np.uint32)


def count_plain(text: str, path: str) -> int:
    """How many tokens a text has whose special tokens' strings are ordinary text."""
    return len(_pieces(text, path, False))
