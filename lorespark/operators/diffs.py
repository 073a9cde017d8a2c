"""Line differences of two texts, as hunks that can be applied.

Lines become numbers, equal ends and lines that only one side has go first, and what is left is compared by Myers' O(ND)
search: the fewest lines removed and added.  Where that takes more than ``STEPS`` differences, the texts are split at
lines that each has exactly once, along their longest common order, and the parts are compared; a part
without such a line is replaced as a whole.  So a difference is the smallest up to ``STEPS``, and valid always.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship
from ..sources.tables import spread, table

#: Differences up to which the smallest difference is looked for.
STEPS = 1500
HUNK = "struct<old_start:int,removed:array<string>,new_start:int,added:array<string>>"


def _walk(a: list[int], b: list[int], most: int) -> list[tuple[int, int]] | None:
    """Pairs of places of a longest common subsequence, by Myers' greedy search; None beyond ``most`` differences."""
    n, m = len(a), len(b)
    reach, trail = {1: 0}, []
    for d in range(min(n + m, most) + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                out = []
                for step in range(d, -1, -1):
                    last = trail[step]
                    k = x - y
                    up = k == -step or (k != step and last[k - 1] < last[k + 1])
                    px = last[k + 1] if up else last[k - 1]
                    py = px - (k + 1 if up else k - 1)
                    sx = px if up else px + 1
                    while step and x > sx or not step and x > 0:
                        x, y = x - 1, y - 1
                        out.append((x, y))
                    x, y = px, py
                return out[::-1]
        reach = {k: v for k, v in reach.items() if abs(k) <= d}
        reach.setdefault(d + 2, -1), reach.setdefault(-d - 2, -1)
    return None


def _unique_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of lines that each side has once, in their longest common order."""
    once_a, once_b = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    pairs = [(i, where[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in where]
    ends, best, before = [], [], [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        ends[k : k + 1] = [j]
        best[k : k + 1] = [i]
        before[i] = best[k - 1] if k else -1
    out, i = [], best[-1] if best else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def common(a: list[int], b: list[int], most: int = STEPS) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, both rising."""
    out: list[tuple[int, int]] = []
    left = [(0, len(a), 0, len(b))]
    while left:
        a0, a1, b0, b1 = left.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        both = set(a[a0:a1]) & set(b[b0:b1])
        at_a = [i for i in range(a0, a1) if a[i] in both]
        at_b = [j for j in range(b0, b1) if b[j] in both]
        if not both:
            continue
        own_a, own_b = [a[i] for i in at_a], [b[j] for j in at_b]
        found = _walk(own_a, own_b, most)
        if found is not None:
            out += [(at_a[i], at_b[j]) for i, j in found]
            continue
        split = [(at_a[i], at_b[j]) for i, j in _unique_pairs(own_a, own_b)]
        out += split
        if split:
            starts, stops = [(a0 - 1, b0 - 1), *split], [*split, (a1, b1)]
            left += [(i + 1, x, j + 1, y) for (i, j), (x, y) in zip(starts, stops, strict=True)]
    return sorted(out)


def hunks_of(old: list[str], new: list[str], most: int = STEPS) -> list[tuple[int, list[str], int, list[str]]]:
    """(first old line, removed, first new line, added), counted from 0, in order."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in side] for side in (old, new))
    out, i, j = [], 0, 0
    for x, y in [*common(a, b, most), (len(a), len(b))]:
        if x > i or y > j:
            out.append((i, old[i:x], j, new[j:y]))
        i, j = x + 1, y + 1
    return out


def unified(old: list[str], hunks: list, around: int = 1) -> str:
    """The hunks with lines around them, in unified form; hunks whose surroundings meet are one."""
    groups: list[list] = []
    for h in hunks:
        if groups and h[0] - (groups[-1][-1][0] + len(groups[-1][-1][1])) <= 2 * around:
            groups[-1].append(h)
        else:
            groups.append([h])
    lines = ["---", "+++"] if groups else []
    for group in groups:
        first, last = group[0], group[-1]
        lo, hi = max(0, first[0] - around), min(len(old), last[0] + len(last[1]) + around)
        n_new = hi - lo + sum(len(h[3]) - len(h[1]) for h in group)
        new_lo = first[2] - (first[0] - lo)
        span = lambda at, n: f"{at + (n > 0)}" + (f",{n}" if n != 1 else "")
        lines.append(f"@@ -{span(lo, hi - lo)} +{span(new_lo, n_new)} @@")
        at = lo
        for i, removed, _, added in group:
            lines += [f" {x}" for x in old[at:i]] + [f"-{x}" for x in removed] + [f"+{x}" for x in added]
            at = i + len(removed)
        lines += [f" {x}" for x in old[at:hi]]
    return "\n".join(lines)


def hunks(old_new: DataFrame, around: int = 1) -> DataFrame:
    """(id, hunks, diff) of rows (id, old, new); lines end at line feeds, a null text is empty."""
    ship(old_new.sparkSession)
    kind = pa.list_(pa.struct([("old_start", pa.int32()), ("removed", pa.list_(pa.string())), ("new_start", pa.int32()), ("added", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            found, text = [], []
            for a, b in zip(batch.column(1), batch.column(2), strict=True):
                old, new = (a.as_py() or "").split("\n"), (b.as_py() or "").split("\n")
                got = hunks_of(old, new)
                found.append([dict(zip(("old_start", "removed", "new_start", "added"), h, strict=True)) for h in got])
                text.append(unified(old, got, around))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(text, pa.string())], ["id", "hunks", "diff"])

    return old_new.select("id", "old", "new").mapInArrow(run, f"id {old_new.schema['id'].dataType.simpleString()}, hunks array<{HUNK}>, diff string")


def applied(old: Column, hunks_col: Column) -> Column:
    """The new text: the old one's lines with the hunks put in."""
    lines = F.split(F.coalesce(old, F.lit("")), "\n", -1)
    n = F.size(hunks_col)
    end = lambda k: F.when(k > 0, F.get(hunks_col, k - 1)["old_start"] + F.size(F.get(hunks_col, k - 1)["removed"])).otherwise(0)
    piece = lambda k: F.concat(F.slice(lines, end(k) + 1, F.when(k < n, F.get(hunks_col, k)["old_start"]).otherwise(F.size(lines)) - end(k)), F.coalesce(F.get(hunks_col, k)["added"], F.array().cast("array<string>")))
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), piece)), "\n")


def edited(docs: DataFrame) -> DataFrame:
    """(id, old, new): texts, and the same with some lines left out, some twice and some changed, as the lines' own digests say."""
    digit = lambda x: F.substring(F.md5(x), 1, 1)
    kept_lines = F.filter(F.split("text", "\n", -1), lambda x: digit(x) >= "3")
    new = F.flatten(F.transform(kept_lines, lambda x: F.when(digit(x) >= "e", F.array(x, x)).when(digit(x) >= "c", F.array(F.concat(x, F.lit(" changed")))).otherwise(F.array(x))))
    return docs.where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("old"), F.array_join(new, "\n").alias("new"))


def rebuilt(docs: DataFrame) -> DataFrame:
    """(id, lines, text_sha256): how many lines the edits of each document add on balance, and the text that its hunks make of the old one."""
    pairs = edited(docs)
    got = hunks(pairs).select(F.col("id").alias("h_id"), "hunks")
    each = F.aggregate("hunks", F.lit(0), lambda n, h: n + F.size(h["added"]) - F.size(h["removed"]))
    met = pairs.select("id", "old").join(got, F.col("id") == F.col("h_id"))
    return met.select("id", each.alias("lines"), F.sha2(applied(F.col("old"), F.col("hunks")), 256).alias("text_sha256"))


QUERIES = {"ve_rebuilt": lambda s, d: rebuilt(spread(table(s, d, "documents")))}
_LINES = "list_filter(string_split(text, chr(10)), lambda x: substr(md5(x), 1, 1) >= '3')"
_NEW = f"flatten(list_transform({_LINES}, lambda x: CASE WHEN substr(md5(x), 1, 1) >= 'e' THEN [x, x] WHEN substr(md5(x), 1, 1) >= 'c' THEN [x || ' changed'] ELSE [x] END))"
ORACLE = {"ve_rebuilt": f"SELECT id, (greatest(len(new), 1) - len(string_split(old, chr(10))))::INT AS lines, sha256(array_to_string(new, chr(10))) AS text_sha256 FROM (SELECT doc_id AS id, text AS old, {_NEW} AS new FROM documents WHERE text IS NOT NULL)"}
