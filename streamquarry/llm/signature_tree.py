"""Trees of set signatures: nodes hold OR-combined bitmaps and size ranges.

A set's bitmap has one bit per value of the top bits of its tokens, about as many bits as it has
tokens.  Two sets share at most as many tokens as bits of both, plus the tokens that fell onto
bits already taken in one of them; for nodes the same holds with the combined bitmaps and the
largest such excess.  A dual traversal follows only node pairs whose sizes and bound allow the
wanted similarity and that are not already known to be one component.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 16, 8


def signature(tokens: np.ndarray) -> bytes:
    width = max(6, int(len(tokens) - 1).bit_length())
    bits = np.zeros(1 << width, dtype=np.uint8)
    bits[(tokens >> np.uint64(64 - width)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _at_width(signatures: list[bytes], size: int) -> np.ndarray:
    """All bitmaps folded to ``size`` bytes: neighbouring bits joined until they fit."""
    out = np.empty((len(signatures), size), dtype=np.uint8)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(signatures):
        by_length.setdefault(len(s), []).append(i)
    for length, rows in by_length.items():
        bits = np.frombuffer(b"".join(signatures[i] for i in rows), np.uint8).reshape(len(rows), length)
        while bits.shape[1] > size:
            halves = np.unpackbits(bits, axis=1)
            bits = np.packbits(halves[:, ::2] | halves[:, 1::2], axis=1)
        out[rows] = bits
    return out


class _Level:
    def __init__(self, bits, low, high, excess, one, children):
        self.bits, self.low, self.high, self.excess, self.one, self.children = bits, low, high, excess, one, children


def _members(bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> _Level:
    excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    return _Level(bits, sizes, sizes, excess, labels, None)


def _tree(bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> list[_Level]:
    """Levels from the leaves' members up; members are in the order of their sizes."""
    levels = [_members(bits, sizes, labels)]
    fan = LEAF
    while len(levels[-1].low) > 1:
        b = levels[-1]
        at = np.arange(0, len(b.low), fan)
        one = np.minimum.reduceat(b.one, at)
        levels.append(_Level(
            np.bitwise_or.reduceat(b.bits, at, axis=0), np.minimum.reduceat(b.low, at), np.maximum.reduceat(b.high, at),
            np.maximum.reduceat(b.excess, at), np.where(one == np.maximum.reduceat(b.one, at), one, -1 << 62),
            [np.arange(s, min(s + fan, len(b.low))) for s in at],
        ))
        fan = FAN
    return levels


def _possible(a: _Level, i, b: _Level, j, num: int, den: int) -> np.ndarray:
    """Which node pairs may hold sets ``x, y`` with ``den * |x & y| >= num * |x | y|``."""
    sizes = (den * a.high[i] >= num * b.low[j]) & (den * b.high[j] >= num * a.low[i])
    apart = (a.one[i] != b.one[j]) | (a.one[i] == -1 << 62)
    keep = np.flatnonzero(sizes & apart)
    out = np.zeros(len(i), dtype=bool)
    for s in range(0, len(keep), 1 << 14):
        k = keep[s : s + (1 << 14)]
        x, y = i[k], j[k]
        shared = np.bitwise_count(a.bits[x] & b.bits[y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(shared + np.minimum(a.excess[x], b.excess[y]), np.minimum(a.high[x], b.high[y]))
        out[k] = (num + den) * most >= num * (a.low[x] + b.low[y])
    return out


def _traverse(left: list[_Level], right: list[_Level], same: bool, num: int, den: int):
    """Member pairs that the bounds allow; with ``same`` each pair once."""
    depth = max(len(left), len(right)) - 1
    at = lambda tree, d: tree[min(d, len(tree) - 1)]
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        a, b = at(left, depth), at(right, depth)
        ok = _possible(a, i, b, j, num, den)
        if same and depth == 0:
            ok &= i < j
        i, j = i[ok], j[ok]
        if depth == 0 or not len(i):
            return i, j
        down_a, down_b = depth < len(left), depth < len(right)
        pairs = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p = a.children[x] if down_a else np.array([x])
            q = b.children[y] if down_b else np.array([y])
            p, q = np.repeat(p, len(q)), np.tile(q, len(p))
            if same:
                p, q = p[p <= q], q[p <= q]
            pairs.append((p, q))
        i, j = (np.concatenate(z) for z in zip(*pairs, strict=True))
        depth -= 1


def candidate_pairs(signatures, sizes, labels, sides=None, num: int = 75, den: int = 100):
    """Pairs of positions that may be similar and have different labels, each once.

    With ``sides`` only pairs of one member of side 0 and one of side 1.  Members are dealt into
    bands of sizes a factor of ``den / num`` wide, so a pair lies in one band or in neighbours.
    """
    sizes, labels = np.asarray(sizes, np.int64), np.asarray(labels, np.int64)
    order = np.argsort(sizes, kind="stable")
    band = np.floor(np.log(sizes[order]) / np.log(den / num) + 1e-9).astype(np.int64)
    found_i, found_j = [], []
    for k in np.unique(band):
        low, mid, high = np.searchsorted(band, [k, k + 1, k + 2])
        own, near = order[low:mid], order[mid:high]
        width = min(len(signatures[p]) for p in own)
        groups = [(own, own, True)] if sides is None else [(own[sides[own] == 0], own[sides[own] == 1], False)]
        if len(near):
            groups += [(own, near, False)] if sides is None else [
                (own[sides[own] == 0], near[sides[near] == 1], False), (own[sides[own] == 1], near[sides[near] == 0], False)]
        for left, right, same in groups:
            if not len(left) or not len(right) or (same and len(left) < 2):
                continue
            trees = [_tree(_at_width([signatures[p] for p in m], width), sizes[m], labels[m]) for m in ([left] if same else [left, right])]
            i, j = _traverse(trees[0], trees[-1], same, num, den)
            found_i.append(left[i])
            found_j.append(right[j])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def leaf_bound(signatures, sizes, i: np.ndarray, j: np.ndarray, num: int = 75, den: int = 100) -> np.ndarray:
    """Which pairs of positions the bound on shared tokens allows, as at the leaves of a tree."""
    lengths = np.array([len(s) for s in signatures], dtype=np.int64)
    width = np.minimum(lengths[i], lengths[j])
    out = np.zeros(len(i), dtype=bool)
    for size in np.unique(width):
        pairs = np.flatnonzero(width == size)
        members, place = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        bits = _at_width([signatures[m] for m in members], int(size))
        level = _members(bits, sizes[members], np.arange(len(members)))
        out[pairs] = _possible(level, place[: len(pairs)], level, place[len(pairs) :], num, den)
    return out
