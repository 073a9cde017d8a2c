"""Bin completion on a histogram of sizes: branch and bound with best-fit incumbents.

Only how many items of each size there are matters, so the search works on at most
``capacity`` distinct sizes however many items there are.  At a node the largest size
left opens a bin; the undominated fillings of the rest are tried, those that waste least
first, each first as often as the counts allow and then once.  A node is cut off when
the waste so far and the least waste to come leave no better solution than the
incumbent; every node's rest is packed by best-fit decreasing, and what beats the
incumbent replaces it.  At first a node enumerates only so many fillings; a search that
left some out and ends above the bound is run again with four times as many, until one
left none out, which proves its packing best.  The search ends when the bound is met,
when nothing is left to try, or after ``work`` steps, a node counting as many as it has
sizes; which of these is told with the packing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A filling: sizes, largest first.  A packing: fillings with how many bins each fills.
Packing = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: items over half a bin, and what must go beside them, for every size taken as the least that counts."""
    if not counts:
        return 0
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    number = np.concatenate([[0], np.cumsum(n)])  # of items of a size below the index
    amount = np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    half = capacity // 2
    k = np.arange(half + 1)
    large = number[-1] - number[capacity - k + 1]
    middle = number[capacity - k + 1] - number[half + 1]
    room = middle * capacity - (amount[capacity - k + 1] - amount[half + 1])
    small = amount[half + 1] - amount[k]
    return int((large + middle + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing, many equal bins at a time."""
    open_bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    full: Packing = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        room = size
        while left and room < capacity:
            here = open_bins[room]
            if not here:
                room += 1
                continue
            filling, bins = here.popitem()
            use = min(bins, left)
            if use < bins:
                here[filling] = bins - use
            to = open_bins[room - size]
            to[(*filling, size)] = to.get((*filling, size), 0) + use
            left -= use
            # Room that a placed item leaves may be the best fit for the next of its size.
            room = max(size, room - size) if room - size >= size else room
        if left:
            each = capacity // size
            whole, rest = divmod(left, each)
            if whole:
                to = open_bins[capacity - each * size]
                to[(size,) * each] = to.get((size,) * each, 0) + whole
            if rest:
                to = open_bins[capacity - rest * size]
                to[(size,) * rest] = to.get((size,) * rest, 0) + 1
    for bins in open_bins:
        full += list(bins.items())
    return full


def bins_of(packing: Packing) -> int:
    return sum(n for _, n in packing)


def _dominated(filling: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether ``filling``'s items fit into pieces no larger than ``other``'s items, one after another."""
    if len(other) > len(filling):
        return False
    rooms = sorted(other)

    def place(k: int) -> bool:
        if k == len(filling):
            return True
        tried = set()
        for i, room in enumerate(rooms):
            if room >= filling[k] and room not in tried:
                tried.add(room)
                rooms[i] -= filling[k]
                if place(k + 1):
                    rooms[i] += filling[k]
                    return True
                rooms[i] += filling[k]
        return False

    return place(0)


def fillings(counts: dict[int, int], largest: int, capacity: int, most: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated ways to fill the bin around ``largest``, least waste first; and whether these are all.

    Sizes are tried largest first; up to ``most`` maximal fillings are compared, and an exact fill by one item ends the search: it dominates all others.
    """
    room = capacity - largest
    if room == 0:
        return [(largest,)], True
    left = dict(counts)
    left[largest] -= 1
    if left.get(room, 0) > 0:
        return [(largest, room)], True
    sizes = [s for s in sorted(left, reverse=True) if s <= room and left[s] > 0]
    if not sizes:
        return [(largest,)], True
    smallest = sizes[-1]
    found: list[tuple[int, ...]] = []
    steps = [0]

    def grow(start: int, room: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        steps[0] += 1
        if room < smallest or steps[0] > 40 * most:
            yield taken
            return
        any_fits = False
        if start < len(sizes) and sizes[start] > room:
            lo, hi = start, len(sizes)
            while lo < hi:
                mid = (lo + hi) // 2
                if sizes[mid] > room:
                    lo = mid + 1
                else:
                    hi = mid
            start = lo
        for i in range(start, len(sizes)):
            s = sizes[i]
            if s > room or left[s] <= taken.count(s):
                continue
            any_fits = True
            yield from grow(i, room - s, (*taken, s))
        if not any_fits:
            yield taken

    whole = True
    for filling in grow(0, room, ()):
        found.append(filling)
        if len(found) >= most or steps[0] > 40 * most:
            whole = False
            break
    found = sorted(set(found), key=lambda f: (-sum(f), len(f), [-s for s in f]))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if not any(_dominated(f, k) for k in kept):
            kept.append(f)
    return [(largest, *f) for f in kept], whole


def _times(filling: tuple[int, ...], counts: dict[int, int]) -> int:
    return min(counts[s] // filling.count(s) for s in set(filling))


def pack(counts: dict[int, int], capacity: int, work: int = 250_000, most: int = 24) -> tuple[Packing, int, bool]:
    """A packing of ``counts`` items of each size into bins of ``capacity``, the lower bound, and whether none is better.

    ``most`` is how many fillings a node compares in the first search.
    """
    counts = {s: c for s, c in counts.items() if c > 0}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes go from 1 to the capacity")
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    total = sum(s * c for s, c in counts.items())
    spent, whole = 0, False
    while bins_of(best) > bound and spent < work and not whole:
        whole = True
        # Nodes: counts left, fillings so far, waste so far.  Depth first, the most promising child on top.
        stack: list[tuple[dict[int, int], Packing, int]] = [(counts, [], 0)]
        while stack and spent < work and bins_of(best) > bound:
            left, done, waste = stack.pop()
            spent += max(10, len(left))
            if not left:
                if bins_of(done) < bins_of(best):
                    best = done
                continue
            if bins_of(done) + lower_bound(left, capacity) >= bins_of(best) or total + waste > (bins_of(best) - 1) * capacity:
                continue
            rest = best_fit(left, capacity)
            if bins_of(done) + bins_of(rest) < bins_of(best):
                best = done + rest
            largest = max(left)
            children = []
            found, complete = fillings(left, largest, capacity, most)
            whole &= complete
            for filling in found:
                times = _times(filling, left)
                for n in dict.fromkeys((times, 1)):
                    now = dict(left)
                    for s in filling:
                        now[s] -= n
                    children.append(({s: c for s, c in now.items() if c}, [*done, (filling, n)], waste + n * (capacity - sum(filling))))
            stack += reversed(children)
        whole &= not stack
        most *= 4
    return best, bound, whole or bins_of(best) == bound
