"""Column expressions that several operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(text: Column, terms: Iterable[str]) -> Column:
    """How many of the terms the text contains."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def any_of(text: Column, terms: Iterable[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a plain term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def literals(pattern: str) -> list[str] | None:
    """Plain strings of which any match of a pattern holds one: what each alternative begins with; None where one begins with none.

    For patterns of alternatives at the top, or in one unnamed group between word boundaries.
    """
    bare = pattern.removeprefix(r"\b")
    if m := re.fullmatch(r"\(\?:([^()]*)\)(\\b)?", bare):
        bare = m[1]
    if "(" in bare:
        return None
    out = []
    for part in bare.split("|"):
        head = re.match(r"[^\\\[\].^$*+?{}()|]*", part.removeprefix(r"\b"))[0]
        if part.removeprefix(r"\b")[len(head) : len(head) + 1] in ("?", "*", "{"):
            head = head[:-1]
        if not head:
            return None
        out.append(head)
    return list(dict.fromkeys(x for x in out if not any(y != x and y in x for y in out)))


def guarded_matches(text: Column, pattern: str) -> Column:
    """``matches``, by search for plain strings where the pattern's are not there; 0 for a null."""
    plain = literals(pattern)
    counted = matches(text, pattern)
    return F.when(any_of(text, plain), counted).otherwise(0) if plain else F.coalesce(counted, F.lit(0))


def guarded_like(text: Column, pattern: str) -> Column:
    """Whether a pattern is in the text, by search for plain strings where the pattern's are not there."""
    plain, like = literals(pattern), F.regexp_like(text, F.lit(pattern))
    return F.when(any_of(text, plain), like).otherwise(False) if plain else like


def guarded_occurrences(text: Column, term: str) -> Column:
    """``occurrences``, without a copy of the text where the term is not there; 0 for a null."""
    return F.when(F.contains(text, F.lit(term)), occurrences(text, term)).otherwise(0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# The same expressions as DuckDB SQL, for the oracles.
def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_present(text: str, terms: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {quote(t)})::INT" for t in terms) + ")"


def sql_any(text: str, terms: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(t)})" for t in terms) + ")"


def sql_occurrences(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {quote(term)}, ''))) // {len(term)})"


def sql_matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quote(pattern)}))"
