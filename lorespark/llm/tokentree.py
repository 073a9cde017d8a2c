"""Edit-aware token counts.

A document's pre-tokens are kept in leaves of about ``LEAF`` pre-tokens under a segment
tree of characters and tokens.  An edit re-reads its leaves and one of context before
them, and goes on to the right only until a pre-token ends where a leaf of the old text
began: from there on, the old leaves hold.  Only the new leaves are encoded, and only the
sums above them change.  ``grow`` makes the trees of a corpus as rows that may be written
and read back; ``edit`` applies a batch of edits to such rows and gives such rows, so that
version after version only what an edit touches is encoded again.

Defined results: a null text counts as empty (no token); special tokens' strings are
ordinary text; edits apply one after another, each to the text that the one before left;
an edit's place and length are clipped to the text; a null list of edits is none.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import ship

LEAF = 64
EDITS = "array<struct<at:long,remove:long,insert:string>>"


@functools.lru_cache(1)
def _pattern():
    import regex

    return regex.compile(tokens.PATTERN)


def leaf_ends(text: str, start: int, stop: int) -> list[int]:
    """Ends of leaves from ``start``, a pre-token's beginning; the last is where the text or ``stop`` ends.

    A leaf never ends in white space, whose pre-tokens depend on what follows, unless the text ends there.
    """
    ends, n, last = [], 0, start
    for m in _pattern().finditer(text, start):
        if m.end() > stop:
            break
        n += 1
        last = m.end()
        if n >= LEAF and not text[last - 1].isspace():
            ends.append(last)
            n = 0
    if n and last == len(text):
        ends.append(last)
    return ends


class TokenTree:
    def __init__(self, text: str, path: str, leaves: list[tuple[int, int]] | None = None):
        """A tree of the text; of ``leaves`` (characters, tokens) that it had before, if given."""
        self.count_text = lambda part: tokens.count_plain(part, path)
        self.text, self.encoded = text, 0
        if leaves is None:
            self._build()
        else:
            self._lay(leaves)

    def leaves(self) -> list[tuple[int, int]]:
        some = slice(self.size, self.size + self.n)
        return [(c, t) for c, t in zip(self.chars[some].tolist(), self.toks[some].tolist(), strict=True) if c]

    def _build(self) -> None:
        ends = leaf_ends(self.text, 0, len(self.text))
        leaves = [(b - a, self._count(a, b)) for a, b in zip([0, *ends], ends, strict=False)]
        self._lay(leaves)

    def _lay(self, leaves: list[tuple[int, int]]) -> None:
        self.n = len(leaves)
        self.size = 1 << max(0, self.n - 1).bit_length()
        self.chars, self.toks = (np.zeros(2 * self.size, np.int64) for _ in range(2))
        if leaves:
            self.chars[self.size : self.size + self.n], self.toks[self.size : self.size + self.n] = np.array(leaves).T
        k = self.size
        while k > 1:
            for a in (self.chars, self.toks):
                a[k // 2 : k] = a[k : 2 * k].reshape(-1, 2).sum(1)
            k //= 2

    def _count(self, a: int, b: int) -> int:
        self.encoded += b - a
        return self.count_text(self.text[a:b])

    @property
    def total(self) -> int:
        return int(self.toks[1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if place >= before + self.chars[k] and k + 1 < 2 * self.size and self.chars[k + 1] > 0:
                before += int(self.chars[k])
                k += 1
        return k - self.size, before

    def edit(self, at: int, remove: int, insert: str) -> None:
        at = min(max(at, 0), len(self.text))
        remove = min(max(remove, 0), len(self.text) - at)
        self.text = self.text[:at] + insert + self.text[at + remove :]
        if not self.n:
            self._build()
            return
        shift = len(insert) - remove
        lo, start = self.find(max(0, at - 1))
        while lo > 0:  # one leaf of context: what a pre-token ends with depends on what follows it
            lo -= 1
            start -= int(self.chars[self.size + lo])
            if self.chars[self.size + lo]:
                break
        hi, hi_start = self.find(min(at + remove, len(self.text) - shift - 1) if len(self.text) > shift else 0)
        # Old leaves that begin after the edit may hold; read on until a new pre-token ends where one begins.
        begins = hi_start + int(self.chars[self.size + hi])
        hi += 1
        while hi < self.n and begins + shift <= at + len(insert):
            begins += int(self.chars[self.size + hi])
            hi += 1
        end = None
        k, b = hi, begins
        ends: list[int] = []
        n, pos = 0, start
        for m in _pattern().finditer(self.text, start):
            pos = m.end()
            n += 1
            while k < self.n and b + shift < pos:
                b += int(self.chars[self.size + k])
                k += 1
            if k < self.n and b + shift == pos and pos > at + len(insert) and not self.text[pos - 1].isspace():
                end = k
                ends.append(pos)
                break
            if n >= LEAF and not self.text[pos - 1].isspace():
                ends.append(pos)
                n = 0
        if end is None:
            end = self.n
            if not ends or ends[-1] < len(self.text):
                ends.append(len(self.text))
        leaves = [(q - p, self._count(p, q)) for p, q in zip([start, *ends], ends, strict=False) if q > p]
        slots = end - lo
        if len(leaves) > slots:
            kept = [(int(self.chars[self.size + i]), int(self.toks[self.size + i])) for i in range(self.n)]
            self._lay(kept[:lo] + leaves + kept[end:])
            return
        leaves += [(0, 0)] * (slots - len(leaves))
        for i, (c, t) in enumerate(leaves):
            k = self.size + lo + i
            dc, dt = c - int(self.chars[k]), t - int(self.toks[k])
            while k and (dc or dt):
                self.chars[k] += dc
                self.toks[k] += dt
                k //= 2


_TREE = "text string, leaf_chars array<long>, leaf_tokens array<long>, n_leaves long, n_tokens long, n_chars long, n_edits long, encoded long"


def _rows(first: pa.Array, trees: list[TokenTree], edits: list[int], names: list[str]) -> pa.RecordBatch:
    leaves = [t.leaves() for t in trees]
    lists = [pa.array([[x[k] for x in own] for own in leaves], pa.list_(pa.int64())) for k in (0, 1)]
    numbers = [[len(own) for own in leaves], [t.total for t in trees], [len(t.text) for t in trees], edits, [t.encoded for t in trees]]
    return pa.RecordBatch.from_arrays([first, pa.array([t.text for t in trees], pa.string()), *lists, *[pa.array(n, pa.int64()) for n in numbers]], names)


def _schema(docs: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([docs.schema[id_col], *T._parse_datatype_string(_TREE).fields])


#: Trees held at once in a task.
HELD = 500


def grow(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The tree of each document: id_col, text, its leaves' characters and tokens, and their sums; ``encoded`` characters are the whole text."""
    ship(docs.sparkSession)
    schema = _schema(docs, id_col)

    def run(batches):
        path = tokenizer or tokens.default_path()
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                some = batch.slice(at, HELD)
                trees = [TokenTree(text.as_py() or "", path) for text in some.column(1)]
                yield _rows(some.column(0), trees, [0] * len(trees), schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def edit(trees: DataFrame, *, id_col: str = "doc_id", edits_col: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """Rows of ``grow`` (or of ``edit``) with a column of edits, after these: rows of the same kind; ``encoded`` are the characters encoded again."""
    ship(trees.sparkSession)
    schema = _schema(trees, id_col)

    def run(batches):
        path = tokenizer or tokens.default_path()
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                some = batch.slice(at, HELD)
                after, n = [], []
                for text, chars, toks, edits in zip(*(some.column(k) for k in range(1, 5)), strict=True):
                    tree = TokenTree(text.as_py() or "", path, list(zip(chars.as_py(), toks.as_py(), strict=True)))
                    edits = edits.as_py() or []
                    for e in edits:
                        tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                    after.append(tree)
                    n.append(len(edits))
                yield _rows(some.column(0), after, n, schema.names)

    return trees.select(id_col, "text", "leaf_chars", "leaf_tokens", F.col(edits_col).cast(EDITS).alias("edits")).mapInArrow(run, schema)


def count_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """(id_col, n_leaves, n_tokens, n_edits, n_tokens_edited, n_chars_edited, encoded_again) of each document: its tree grown, edited and given up."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), F.col(edits_col).cast(EDITS).alias("__edits"))
    names = ["n_leaves", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "encoded_again"]
    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches):
        path = tokenizer or tokens.default_path()
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = TokenTree(text.as_py() or "", path)
                leaves, before, first = tree.n, tree.total, tree.encoded
                edits = edits.as_py() or []
                for e in edits:
                    tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                out.append((leaves, before, len(edits), tree.total, len(tree.text), tree.encoded - first))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], pa.int64()) for k in range(6)]], schema.names)

    return rows.mapInArrow(run, schema)
