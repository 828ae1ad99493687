"""Bin completion on a table of lengths: which lengths go together into bins.

The search state is the number of items left per length, a table no longer than a bin.  A node
takes the largest length left, enumerates fillings of the space beside it that no other filling
dominates (each item of a dominated one fits into an item of the other, so the other can never
be worse), and branches on the fullest first.  As many equal bins as the counts allow are closed
at once, so the depth follows the number of distinct lengths and not of items.  The incumbent is
the best-fit packing; a branch is cut when the waste of its bins exceeds what the incumbent's
number of bins leaves.
"""

from __future__ import annotations

from bisect import bisect_right, insort


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on counts: ``(bins, lengths in a bin)``.

    Bins of one kind (the same content) are filled alike, as many at once as the counts allow.
    """
    kinds: dict[tuple[int, ...], int] = {}
    by_space: dict[int, set[tuple[int, ...]]] = {}

    def put(kind, n):
        if n:
            kinds[kind] = kinds.get(kind, 0) + n
            by_space.setdefault(size - sum(kind), set()).add(kind)

    def take(kind, n):
        kinds[kind] -= n
        if not kinds[kind]:
            del kinds[kind]
            by_space[size - sum(kind)].discard(kind)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = next((s for s in range(length, size) if by_space.get(s)), None)
            if space is None:
                fit = size // length
                put((length,) * fit, left // fit)
                put((length,) * (left % fit), 1 if left % fit else 0)
                left = 0
            else:
                kind = min(by_space[space])
                more = min(space // length, left)
                n = min(kinds[kind], max(1, left // more))
                take(kind, n)
                put((*kind, *(length,) * more), n)
                left -= n * more
    return sorted(((n, kind) for kind, n in kinds.items()), key=lambda x: x[1], reverse=True)


def fillings(counts: dict[int, int], lengths: list[int], space: int, most: int, nodes: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``space``, fullest first, with at most ``most`` kept.

    ``lengths`` are those left, ascending.  A filling is maximal: nothing left fits beside it.
    """
    found: list[tuple[int, ...]] = []
    budget = [nodes]

    def extend(chosen: tuple[int, ...], left: int, upto: int):
        if budget[0] <= 0 or (found and len(found) >= 8 * most):
            return
        budget[0] -= 1
        at = bisect_right(lengths, min(left, upto)) - 1
        any_fits = False
        while at >= 0 and budget[0] > 0:
            x = lengths[at]
            if counts[x] > chosen.count(x):
                any_fits = True
                extend((*chosen, x), left - x, x)
                if found and sum(found[-1]) == space and len(found) >= most:
                    return
            at -= 1
        if not any_fits:
            smallest = next((x for x in lengths if counts[x] > chosen.count(x)), None)
            if smallest is None or smallest > left:
                found.append(chosen)

    extend((), space, space)
    found = sorted(set(found), key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
            if len(kept) == most:
                break
    return kept


def dominates(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` can be put into the items of ``big`` taken as bins (first fit)."""
    room = sorted(big)
    for x in sorted(small, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= x), None)
        if at is None:
            return False
        room[at] -= x
        room.sort()
    return True


def complete_bins(
    counts: dict[int, int], size: int, most: int = 3, nodes: int = 2_000, steps: int = 3_000
) -> list[tuple[int, tuple[int, ...]]]:
    """``(bins, lengths in a bin)`` for all items; at most ``steps`` search nodes are opened."""
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    total = sum(k * n for k, n in counts.items())
    bound = -(-total // size)
    best = best_fit(counts, size)
    best_bins = sum(n for n, _ in best)
    left = [steps]
    lengths = sorted(counts)  # changed in place and restored, as the counts are
    closed: list[tuple[int, tuple[int, ...]]] = []

    def change(uses, n):
        for x, k in uses.items():
            if not counts.get(x):
                insort(lengths, x)
            counts[x] = counts.get(x, 0) - n * k
            if not counts[x]:
                del counts[x]
                lengths.remove(x)

    def search(bins, waste):
        nonlocal best, best_bins
        if not counts:
            if bins < best_bins:
                best, best_bins = list(closed), bins
            return
        if left[0] <= 0 or best_bins == bound:
            return
        left[0] -= 1
        largest = lengths[-1]
        counts[largest] -= 1
        beside = fillings(counts, lengths, size - largest, most, nodes) or [()]
        counts[largest] += 1
        for filling in beside:
            content = (largest, *filling)
            uses = {x: content.count(x) for x in content}
            n = min(counts[x] // k for x, k in uses.items())
            spare = (best_bins - 1) * size - total - waste  # what an improvement may still waste
            lost = size - sum(content)
            if lost > spare:
                continue
            if lost:
                n = min(n, spare // lost)
            change(uses, n)
            closed.append((n, content))
            search(bins + n, waste + n * lost)
            closed.pop()
            change(uses, -n)
            if best_bins == bound or left[0] <= 0:
                return

    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        search(0, 0)
    finally:
        sys.setrecursionlimit(limit)
    return best
