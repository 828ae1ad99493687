"""The definitions applied directly to tiny databases, for comparison with the Spark operators."""

from __future__ import annotations

import itertools
import math

ANY = None


def is_var(s):
    return isinstance(s, int)


def matches(query, stream):
    """All (positions, binding) of a query (tuples of None / str / int variable) in a stream."""
    found = []

    def go(t, start, pos, bind):
        if t == len(query):
            found.append((tuple(pos), dict(bind)))
            return
        for p in range(start, len(stream)):
            new = dict(bind)
            ok = True
            for a, s in enumerate(query[t]):
                v = stream[p][a]
                if s is ANY:
                    continue
                if v is None:
                    ok = False
                elif is_var(s):
                    ok = new.setdefault(s, v) == v
                else:
                    ok = s == v
                if not ok:
                    break
            if ok:
                go(t + 1, p + 1, [*pos, p], new)

    go(0, 0, [], {})
    return found


def does_match(query, stream):
    return bool(matches(query, stream))


def normal(query):
    count = {}
    for t in query:
        for s in t:
            if is_var(s):
                count[s] = count.get(s, 0) + 1
    names, out = {}, []
    for t in query:
        term = []
        for s in t:
            if is_var(s):
                s = names.setdefault(s, len(names)) if count[s] > 1 else ANY
            term.append(s)
        if any(s is not ANY for s in term):
            out.append(tuple(term))
    return tuple(out)


def _partitions(items):
    """All ways to give each item None, or to put it into a block (restricted growth)."""
    def go(i, n, acc):
        if i == len(items):
            yield tuple(acc)
            return
        for b in range(n + 1):
            yield from go(i + 1, max(n, b + 1), [*acc, b])

    yield from go(0, 0, [])


def event_queries(stream, max_terms):
    """All queries in normal form that match the stream."""
    n_attrs = len(stream[0]) if stream else 0
    found = set()
    for k in range(1, max_terms + 1):
        for positions in itertools.combinations(range(len(stream)), k):
            cells = [(t, a) for t in range(k) for a in range(n_attrs)
                     if stream[positions[t]][a] is not None]
            for mask in itertools.product("_vx", repeat=len(cells)):
                by_value = {}
                base = [[ANY] * n_attrs for _ in range(k)]
                for (t, a), m in zip(cells, mask, strict=True):
                    v = stream[positions[t]][a]
                    if m == "v":
                        base[t][a] = v
                    elif m == "x":
                        by_value.setdefault((a, v), []).append((t, a))
                groups = [list(_partitions(g)) for g in by_value.values()]
                for choice in itertools.product(*groups):
                    q = [list(t) for t in base]
                    n = 0
                    for g, blocks in zip(by_value.values(), choice, strict=True):
                        for (t, a), b in zip(g, blocks, strict=True):
                            q[t][a] = n + b
                        n += max(blocks) + 1
                    q = normal(q)
                    if len(q) == k:
                        found.add(q)
    return found


def discover(db, supp, max_terms):
    """{query: number of streams}, by definition."""
    needed = max(1, math.ceil(round(len(db) * supp, 9)))
    counts = {}
    for stream in db.values():
        for q in event_queries(stream, max_terms):
            counts[q] = counts.get(q, 0) + 1
    return {q: n for q, n in counts.items() if n >= needed}


def reached_length(db, supp):
    needed = max(1, math.ceil(round(len(db) * supp, 9)))
    return sorted((len(s) for s in db.values()), reverse=True)[needed - 1]


def weaker(q1, q2):
    """Is q1 weaker than q2: does q1 match q2 read as a stream?"""
    if q1 == q2:
        return False
    tag = lambda s: s if s is ANY else (f"x={s}" if is_var(s) else f"v={s}")
    stream = [tuple(tag(s) for s in t) for t in q2]
    query = tuple(tuple(s if s is ANY or is_var(s) else f"v={s}" for s in t) for t in q1)
    return does_match(query, stream)


def descriptive(queries):
    return {q for q in queries if not any(weaker(q, o) for o in queries)}


def text(query):
    show = lambda s: "" if s is ANY else (f"$x{s}" if is_var(s) else s)
    return " ".join("".join(show(s) + ";" for s in t) for t in query)
