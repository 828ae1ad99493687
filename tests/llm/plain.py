"""The contracts in plain Python, to compare with."""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


def crc(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode())


def shingles(text, n=5):
    w = lower_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def similar(texts, num=75, den=100):
    sets = [shingles(t) for t in texts]
    order = sorted((i for i in range(len(sets)) if sets[i]), key=lambda i: len(sets[i]))
    links = []
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if num * len(sets[j]) > den * len(sets[i]):
                break
            both = len(sets[i] & sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    return sets, roots(len(texts), links)


def measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def gapless(pieces):
    """Whether ``(start, length)`` pieces follow each other from 0."""
    pieces = sorted(pieces)
    return pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(pieces))
