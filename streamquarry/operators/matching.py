"""Matching tables of queries against all streams at once.

Queries advance term by term.  The driving condition of a term is its first
fixed value or already bound variable, so a step is one equi join on
``(stream_id, chunk, attribute, value)`` with a position range; all other
conditions are checked on the joined event.  Queries form a trie: those that
begin alike share the state of what they have in common, held under the smallest
of their ids, and all queries, of whatever length, share the one join per term
number.  Without windows only the earliest end per binding is kept, which is
enough because every later continuation of a later end also continues it.  With
windows the events within reach of the ends so far are kept as intervals, of which
an event lies in one (of each chunk), so state does not grow with pairs of events.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamquarry.functions import notation as nt
from streamquarry.functions.columns import attributes, threshold
from streamquarry.operators.profiling import count_streams
from streamquarry.operators.queries import (
    _merged_gaps, drop_empty_terms, full_gaps, normal_terms,
)
from streamquarry.plans.chunks import CHUNK, chosen_streams, chunk_of
from streamquarry.plans.workspace import BROADCAST_ROWS, broadcast_if_small, materialize, shuffled_if_large

# Terms joined in one plan before the matches so far are written.
TERMS_PER_PLAN = 6
# Numbers of matches, which are binomial in the length of a stream.
COUNT = "decimal(38,0)"
# Parts a query table too large to broadcast is repeated in, against hot values.
SALTS = 16


@dataclass
class _Options:
    every: bool = False  # every match, not one per end
    all_ends: bool = False  # a match per end, also without windows
    positions: bool = False
    gaps: bool = False
    forbidden: bool = False
    span: bool = False
    counting: bool = False  # the number of matches per end, not the matches

    @property
    def windows(self) -> bool:
        """With windows a later end can go on where the earliest cannot."""
        return self.gaps or self.forbidden or self.span or self.all_ends or self.counting


def _options_of(
    qs: DataFrame, positions: bool = False, every: bool = False, all_ends: bool = False
) -> _Options:
    """Options with the conditions that the query table brings."""
    return _Options(
        every=every, positions=positions, all_ends=all_ends, gaps="gaps" in qs.columns,
        forbidden="gap_forbidden" in qs.columns, span="span" in qs.columns,
    )


def _prepare(qs: DataFrame, options: _Options, share: bool = True) -> DataFrame:
    """Queries in normal form; windows move along with dropped terms.

    Next to forbidden values an empty term stays, as one event of any kind, since
    the sets belong to the gaps on both of its sides.
    ``n_before`` counts, per term, the variables met in earlier terms.  ``nodes`` holds, per
    term, the smallest id of the queries that are alike up to there, windows included: the
    nodes of the trie (with ``share=False`` each query has its own).  The table is written, so
    that later steps read plain columns.
    """
    terms = normal_terms(F.col("terms"))
    extra = []
    if options.gaps:
        gaps = full_gaps(F.col("gaps"), F.size("terms"))
        extra.append((gaps if options.forbidden else _merged_gaps(gaps, terms)).alias("_gaps"))
    if options.forbidden:
        extra.append("gap_forbidden")
    if options.span:
        extra.append(F.expr("IF(span >= 0, span, NULL)").alias("span"))
    kept = terms if options.forbidden else drop_empty_terms(terms)
    # names of their own: an alias `terms` would hide the column from the other expressions
    named = qs.select("query_id", kept.alias("_terms"), *extra).withColumnsRenamed(
        {"_terms": "terms", "_gaps": "gaps"}
    )
    prepared = named.selectExpr(
        "*", "size(terms) AS n_terms",
        """transform(terms, (t, i) -> size(array_distinct(filter(
               flatten(slice(terms, 1, i)), s -> s.kind = 'var')))) AS n_before""",
    )
    if not share:
        return materialize(prepared.selectExpr("*", "array_repeat(query_id, n_terms) AS nodes"), "queries")
    return materialize(_with_nodes(prepared, options), "queries")


def _with_nodes(prepared: DataFrame, options: _Options) -> DataFrame:
    alike = ["slice(terms, 1, i + 1) AS t"]
    alike += ["slice(gaps, 1, i + 1) AS g"] if options.gaps else []
    alike += ["slice(gap_forbidden, 1, i) AS f"] if options.forbidden else []
    alike += ["span AS s"] if options.span else []
    beginnings = prepared.selectExpr(
        "query_id", f"posexplode(transform(terms, (x, i) -> sha2(to_json(struct({', '.join(alike)})), 256))) AS (_t, _begin)"
    )
    least = beginnings.groupBy("_t", "_begin").agg(F.min("query_id").alias("_node"))
    nodes = beginnings.join(least, ["_t", "_begin"]).groupBy("query_id").agg(
        F.expr("transform(array_sort(collect_set(struct(_t, _node))), x -> x._node)").alias("nodes"))
    return prepared.join(nodes, "query_id", "left")


ANY_EVENT = "named_struct('d_attr', -1, 'd_key', '#')"


def _events_by_value(sdb: DataFrame, size: int | None, any_event: bool = False) -> DataFrame:
    """Events once per set attribute, keyed by value (``v...``) and by ``*`` for new variables."""
    attrs = attributes(sdb)
    keys = ", ".join([
        f"IF({a} IS NOT NULL, named_struct('d_attr', {i}, 'd_key', {key}), NULL)"
        for i, a in enumerate(attrs)
        for key in (f"concat('v', {a})", "'*'")
    ] + ([ANY_EVENT] if any_event else []))
    keyed = sdb.selectExpr(
        "stream_id", "pos", *attrs, f"explode(array({keys})) AS _d"
    ).filter("_d IS NOT NULL").selectExpr("stream_id", "pos", *attrs, "_d.*")
    return keyed if size is None else keyed.withColumn("chunk", chunk_of(F.col("pos"), size))


def _asked(qs: DataFrame, t: int, n_attrs: int, options: _Options) -> DataFrame:
    """Conditions of term t per node of the trie, and the node of the term before (``_parent``).

    Per attribute there is a value ``v``, a known variable ``x`` or a new one.
    """
    columns = [f"{f'nodes[{t - 1}]' if t else 'query_id'} AS _parent"]
    for a in range(n_attrs):
        s = f"terms[{t}][{a}]"
        var, before = f"CAST({s}.val AS INT)", f"n_before[{t}]"
        columns += [
            f"IF({s}.kind = 'val', {s}.val, NULL) AS v{a}",
            f"CASE WHEN {s}.kind = 'var' THEN IF({var} < {before}, {var}, NULL) END AS x{a}",
            f"CASE WHEN {s}.kind = 'var' THEN {var} >= {before} ELSE false END AS new{a}",
        ]
    if options.gaps:
        columns += [f"gaps[{t}].lo AS lo", f"gaps[{t}].hi AS hi"]
    if options.forbidden and t:
        columns.append(f"get(gap_forbidden, {t - 1}) AS forbidden")
    if options.span:
        columns.append("span")
    return qs.filter(f"n_terms > {t} AND nodes[{t}] = query_id").selectExpr("query_id", *columns)


def _with_driver(df: DataFrame, n_attrs: int, bound: bool) -> DataFrame:
    """Resolve conditions to values ``w`` and choose the driving one."""
    resolved = df.selectExpr("*", *[
        f"coalesce(v{a}, get(b, x{a})) AS w{a}" if bound else f"v{a} AS w{a}" for a in range(n_attrs)
    ])
    choices = [
        f"WHEN w{a} IS NOT NULL THEN named_struct('d_attr', {a}, 'd_key', concat('v', w{a}))"
        for a in range(n_attrs)
    ] + [f"WHEN new{a} THEN named_struct('d_attr', {a}, 'd_key', '*')" for a in range(n_attrs)]
    return resolved.selectExpr("*", f"CASE {' '.join(choices)} ELSE {ANY_EVENT} END AS _d").selectExpr("*", "_d.*").drop("_d")


def _holds(attrs: list[str]) -> str:
    return " AND ".join(
        f"(w{i} IS NULL OR w{i} = {a}) AND (NOT new{i} OR {a} IS NOT NULL)" for i, a in enumerate(attrs)
    )


def _new_bindings(attrs: list[str]) -> str:
    new = ", ".join(f"IF(new{i}, {a}, NULL)" for i, a in enumerate(attrs))
    return f"array_compact(array({new}))"


def _reduce(df: DataFrame, options: _Options) -> DataFrame:
    """One row per state: the earliest end, or every end if windows ask for it.

    Of the starts that a span reaches back to the latest serves every continuation.
    """
    keys = ["query_id", "stream_id", "b"]
    if options.every:
        return df
    if options.counting:
        return df.groupBy(*keys, "p", *(["p_first"] if options.span else [])).agg(
            F.sum("n").cast(COUNT).alias("n"))
    ends = ["p", *(["p_first"] if options.span else [])]
    if options.positions and options.windows:
        return df.groupBy(*keys, *ends).agg(F.min("positions").alias("positions"))
    if options.positions:
        best = F.min(F.struct("p", "positions")).alias("_m")
        return df.groupBy(*keys).agg(best).select(*keys, "_m.p", "_m.positions")
    if options.span:
        return df.groupBy(*keys, "p").agg(F.max("p_first").alias("p_first"))
    if options.windows:
        return df.select(*keys, "p").distinct()
    return df.groupBy(*keys).agg(F.min("p").alias("p"))


def _state_columns(options: _Options) -> list[str]:
    return (
        ["query_id", "stream_id", "b", "p"]
        + (["positions"] if options.positions else [])
        + (["p_first"] if options.span else [])
        + (["n"] if options.counting else [])
    )


def _first_term(events, qs, n_queries, attrs, options) -> DataFrame:
    terms = _with_driver(_asked(qs, 0, len(attrs), options), len(attrs), bound=False)
    on = ["d_attr", "d_key"]
    if n_queries > BROADCAST_ROWS:
        # a frequent value would otherwise be one join key for its events and queries
        events = events.selectExpr("*", f"CAST(pmod(xxhash64(stream_id, pos), {SALTS}) AS INT) AS _salt")
        terms = terms.selectExpr("*", f"explode(sequence(0, {SALTS - 1})) AS _salt")
        on = [*on, "_salt"]
    hits = events.join(broadcast_if_small(terms, n_queries), on).filter(_holds(attrs))
    if options.gaps:
        hits = hits.filter("pos >= lo AND (hi IS NULL OR pos <= hi)")
    hits = hits.selectExpr(
        "query_id", "stream_id", f"{_new_bindings(attrs)} AS b", "pos AS p",
        *(["array(pos) AS positions"] if options.positions else []),
        *(["pos AS p_first"] if options.span else []),
        *([f"CAST(1 AS {COUNT}) AS n"] if options.counting else []),
    )
    return _reduce(hits, options)


def _next_term(state, events, ends, qs, n_queries, t, attrs, options, size) -> DataFrame:
    terms = _asked(qs, t, len(attrs), options)
    state = state.withColumnRenamed("query_id", "_parent").join(
        broadcast_if_small(terms, n_queries), "_parent").drop("_parent")
    if options.windows and not options.every and not options.counting:
        state = _earliest_if_open(state, terms.columns, options)
    asked = _with_driver(state, len(attrs), bound=True)
    upper = (["p + 1 + hi"] if options.gaps else []) + (["p_first + span - 1"] if options.span else [])
    upper = f"least({', '.join(upper)})" if len(upper) > 1 else (upper or ["CAST(NULL AS INT)"])[0]
    asked = asked.selectExpr(
        "*", f"p + 1{' + lo' if options.gaps else ''} AS _from", f"{upper} AS _to"
    )
    if options.forbidden and t:
        asked = _before_forbidden(asked, terms, events, ends, size)
    if options.windows and not options.every and not options.positions:
        asked = _reach(asked, options, size)
    on = ["stream_id", "d_attr", "d_key"]
    if ends is not None:
        # long streams exist: ask every chunk that may hold the next term
        asked = asked.join(ends, "stream_id").withColumn("_to", F.least("_to", "last_pos")).filter(
            "_from <= _to"
        )
        chunks = F.sequence(chunk_of(F.col("_from"), size), chunk_of(F.col("_to"), size))
        asked = asked.withColumn("chunk", F.explode(chunks))
        on = [*on, "chunk"]
    hits = asked.join(events, on).filter(
        f"pos >= _from AND (_to IS NULL OR pos <= _to) AND {_holds(attrs)}"
    ).selectExpr(
        "query_id", "stream_id", f"concat(b, {_new_bindings(attrs)}) AS b", "pos AS p",
        *(["concat(positions, array(pos)) AS positions"] if options.positions else []),
        *(["p_first"] if options.span else []),
        *(["n"] if options.counting else []),
    )
    return _reduce(hits, options)


def _reach(asked: DataFrame, options: _Options, size: int) -> DataFrame:
    """The ends of a state and binding as few intervals ``_from`` to ``_to`` of what may follow.

    Bounded gaps: overlapping intervals become one.  A span over open gaps: an interval ends before
    the next one begins, which takes the latest start so far.  Counts over open gaps: likewise, and
    the next one takes the sum so far.  Each chunk of positions has its own intervals, so a hot
    stream is many groups.  Spans over bounded gaps, and counts under any window, stay as they are.
    """
    any_bound = (["hi IS NOT NULL"] if options.gaps else []) + (
        ["coalesce(size(forbidden), 0) > 0"] if "forbidden" in asked.columns else [])
    bounded = f"({' OR '.join(any_bound)})" if any_bound else "false"
    spanned = "span IS NOT NULL" if options.span else "false"
    if options.counting:
        style = f"CASE WHEN {bounded} OR {spanned} THEN 'own' ELSE 'next' END"
    else:
        style = f"CASE WHEN NOT ({spanned}) THEN 'merged' WHEN {bounded} THEN 'own' ELSE 'next' END"
    asked = asked.withColumn("_style", F.expr(style))
    keys = ["query_id", "stream_id", "b", "_style", "_block"]
    blocks = asked.filter("_style <> 'own'").withColumn("_block", chunk_of(F.col("_from"), size))
    own = [c for c in asked.columns if c not in (*keys, "p", "_from", "_to", "p_first", "n")]
    in_order = Window.partitionBy(*keys).orderBy("_from")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)

    follows = F.lead("_from").over(in_order) - 1
    nexts = blocks.filter("_style = 'next'")
    if options.span and not options.counting:
        nexts = nexts.withColumn("p_first", F.max("p_first").over(so_far)).withColumn("_follows", follows)
        nexts = nexts.withColumn("_to", F.least(F.expr("p_first + span - 1"), "_follows"))
    elif options.counting:
        nexts = nexts.withColumn("n", F.sum("n").over(so_far).cast(COUNT)).withColumn("_to", follows)
    columns = [*keys[:3], *own, "_from", "_to", *(["p_first"] if options.span else []),
               *(["n"] if options.counting else [])]
    parts = [asked.filter("_style = 'own'").select(*columns), nexts.select(*columns)]
    if not options.counting:
        open_end = F.coalesce("_to", F.lit(2**31 - 1))
        fresh = F.col("_from") - 1 > F.max("_to").over(before)
        merged = (
            blocks.filter("_style = 'merged'").withColumn("_to", open_end)
            .withColumn("_fresh", F.coalesce(fresh, F.lit(False)).cast("int"))
            .withColumn("_part", F.sum("_fresh").over(so_far))
            .groupBy(*keys, "_part").agg(
                F.min("_from").alias("_from"), F.max("_to").alias("_to"),
                *[F.first(c).alias(c) for c in [*own, *(["p_first"] if options.span else [])]])
        )
        parts.append(merged.select(*columns))
    return reduce(DataFrame.unionByName, parts if options.span or options.counting else parts[2:])


def _earliest_if_open(state: DataFrame, asked: list[str], options: _Options) -> DataFrame:
    """Keep only the earliest end where nothing bounds the next term from above.

    What can follow a later end can then follow the earliest one too, so a stream in which the
    first term occurs often makes one row here and not one per occurrence.
    """
    bounds = (["hi IS NOT NULL"] if options.gaps else []) + (["span IS NOT NULL"] if options.span else []) + (
        ["coalesce(size(forbidden), 0) > 0"] if options.forbidden else [])
    own = f"IF({' OR '.join(bounds)}, p, -1)" if bounds else "-1"
    keys = ["query_id", "stream_id", "b"]
    kept = ["p", *(["positions"] if options.positions else []), *(["p_first"] if options.span else [])]
    more = (["p_first"] if options.span else [])
    rest = [c for c in asked if c not in ("query_id", "_parent")]
    state = state.selectExpr(*keys, *kept, *rest, f"{own} AS _own", *(
        [f"IF({own} = -1, -1, p_first) AS _own_first"] if more else []))
    grouped = state.groupBy(*keys, "_own", *(["_own_first"] if more else [])).agg(
        F.min(F.struct(*kept)).alias("_m"), *[F.first(c).alias(c) for c in rest])
    return grouped.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in kept], *rest)


def _before_forbidden(asked, terms, events, ends, size) -> DataFrame:
    """Bound ``_to`` by the next event after ``p`` that holds a forbidden value.

    Ends and events with forbidden values are put in one descending order per stream, value and
    chunk, and each end takes the last event met; if there is none, the first of the next chunk that
    has one.  So no end is paired with the events behind it.
    """
    probes = asked.filter("size(forbidden) > 0").selectExpr(
        "query_id", "stream_id", "p", "explode(forbidden) AS _f"
    ).selectExpr("query_id", "stream_id", "p AS pos", "concat('v', _f) AS d_key").distinct()
    on = ["stream_id", "d_key"]
    if ends is not None:
        probes = probes.withColumn("chunk", chunk_of(F.col("pos"), size))
        on = [*on, "chunk"]
    values = terms.selectExpr("explode(forbidden) AS _f").selectExpr("concat('v', _f) AS d_key").distinct()
    marks = events.join(values, "d_key", "left_semi").selectExpr(*on, "pos", "true AS _event").unionByName(
        probes.selectExpr(*on, "pos", "false AS _event").distinct())
    event_pos = F.expr("IF(_event, pos, NULL)")
    downwards = Window.partitionBy(*on).orderBy(F.desc("pos"), "_event").rowsBetween(Window.unboundedPreceding, 0)
    stops = marks.withColumn("_stop", F.min(event_pos).over(downwards)).filter("NOT _event").drop("_event")
    if ends is not None:
        chunks = Window.partitionBy("stream_id", "d_key").orderBy(F.desc("chunk")).rowsBetween(
            Window.unboundedPreceding, -1)
        later = marks.groupBy(*on).agg(F.min(event_pos).alias("_least")).select(
            *on, F.min("_least").over(chunks).alias("_later"))
        stops = stops.join(later, on).select(*on, "pos", F.coalesce("_stop", "_later").alias("_stop"))
    nearest = (
        probes.join(stops, [*on, "pos"])
        .groupBy("query_id", "stream_id", F.col("pos").alias("p")).agg(F.min("_stop").alias("_stop"))
    )
    return asked.join(nearest, ["query_id", "stream_id", "p"], "left").withColumn(
        "_to", F.least("_to", "_stop")
    ).drop("_stop")


def _match(
    sdb: DataFrame, qs: DataFrame, options: _Options, max_pos: int | None, size: int = CHUNK,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """States of all matches; of ``pairs(query_id, stream_id)`` only, if given (without windows)."""
    attrs = attributes(sdb)
    prepared = _prepare(qs, options, share=pairs is None)
    # one row per query length
    lengths = {r[0]: r[1] for r in prepared.groupBy("n_terms").count().collect()}
    if max_pos is None:
        seen = sdb.agg(F.max("pos"), F.count(F.lit(1))).first()
        max_pos, sdb = seen[0] or 0, shuffled_if_large(sdb, seen[1])
    ends = None
    if max_pos >= size:
        ends = sdb.groupBy("stream_id").agg(F.max("pos").alias("last_pos"))
    events = _events_by_value(sdb, None if ends is None else size, options.forbidden)
    columns = _state_columns(options)
    results = []
    if 0 in lengths:
        empty = _empty_matches(sdb, prepared.filter("n_terms = 0"), lengths.pop(0), options).select(*columns)
        results.append(empty if pairs is None else empty.join(pairs, ["query_id", "stream_id"], "left_semi"))
    longest = max(lengths, default=0)
    state = None if pairs is None else pairs.selectExpr(
        "query_id", "stream_id", "CAST(array() AS ARRAY<STRING>) AS b", "-1 AS p")
    unwritten = 0
    for t in range(longest):
        n_queries = sum(n for n_terms, n in lengths.items() if n_terms > t)
        if state is None:
            state = _first_term(events, prepared, n_queries, attrs, options)
        else:
            state = _next_term(state, events, ends, prepared, n_queries, t, attrs, options, size)
        unwritten += 1
        ending = lengths.get(t + 1, 0)
        # read by the queries that end here and by those that go on
        if t + 1 < longest and (ending or unwritten == TERMS_PER_PLAN):
            state, unwritten = materialize(state, "matches"), 0
        if ending:
            results.append(_ended(sdb, state, prepared, t + 1, ending, options).select(*columns))
    if not results:
        schema = "query_id bigint, stream_id bigint, b array<string>, p int"
        schema += ", positions array<int>" if options.positions else ""
        schema += ", p_first int" if options.span else ""
        schema += f", n {COUNT}" if options.counting else ""
        return sdb.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, results)


def _ended(sdb, state, qs, n_terms, n_queries, options) -> DataFrame:
    """The matches of the queries with ``n_terms`` terms, out of the states of their last nodes."""
    own = qs.filter(F.col("n_terms") == n_terms).selectExpr(
        "query_id", f"nodes[{n_terms - 1}] AS _node",
        *([f"gaps[{n_terms}].lo AS _lo", f"gaps[{n_terms}].hi AS _hi"] if options.gaps else []))
    found = state.withColumnRenamed("query_id", "_node").join(broadcast_if_small(own, n_queries), "_node")
    if not options.gaps:
        return found
    lasts = sdb.groupBy("stream_id").agg(F.max("pos").alias("_last"))
    return found.join(lasts, "stream_id").filter("_last - p >= _lo AND (_hi IS NULL OR _last - p <= _hi)")


def _empty_matches(sdb: DataFrame, qs: DataFrame, n_queries: int, options: _Options) -> DataFrame:
    """A query without conditions matches every stream, before its first event (``p`` is -1).

    Its only gap bounds the number of events.  The result has a row per query and stream.
    """
    lasts = sdb.groupBy("stream_id").agg(F.max("pos").alias("_last"))
    asked = qs.selectExpr("query_id", *(["gaps[0].lo AS _lo", "gaps[0].hi AS _hi"] if options.gaps else []))
    pairs = lasts.join(broadcast_if_small(asked, n_queries), how="cross")
    if options.gaps:
        pairs = pairs.filter("_last + 1 >= _lo AND (_hi IS NULL OR _last + 1 <= _hi)")
    return pairs.selectExpr(
        "query_id", "stream_id", "CAST(array() AS ARRAY<STRING>) AS b", "-1 AS p",
        "CAST(array() AS ARRAY<INT>) AS positions", "-1 AS p_first", f"CAST(1 AS {COUNT}) AS n")


def match_types(sdb: DataFrame, qs: DataFrame, max_pos: int | None = None) -> DataFrame:
    """Type queries: ``query_id, stream_id, p``, the end of the earliest match."""
    types = qs.filter(nt.query_kind(F.col("terms")) == "type")
    return _match(sdb, types, _options_of(qs), max_pos).groupBy("query_id", "stream_id").agg(F.min("p").alias("p"))


def match(
    sdb: DataFrame, qs: DataFrame, max_pos: int | None = None, max_terms: int | None = None
) -> DataFrame:
    """``query_id, stream_id, b, p``: per binding of the variables the earliest end of a match.

    Columns of ``qs`` add conditions: ``gaps`` (bounds on the number of events
    between two terms, before the first and after the last), ``gap_forbidden``
    (values that no event between two terms may hold) and ``span`` (most events
    from the first to the last matched one).  Queries with more than
    ``max_terms`` terms match nothing.  ``max_pos`` is the last position of the
    longest stream, if known; otherwise it is looked up.
    """
    if max_terms is not None:
        qs = qs.filter(F.size(drop_empty_terms(normal_terms(F.col("terms")))) <= max_terms)
    options = _options_of(qs)
    found = _match(sdb, qs, options, max_pos)
    if not options.windows:
        return found
    return found.groupBy("query_id", "stream_id", "b").agg(F.min("p").alias("p"))


def match_ends(sdb: DataFrame, qs: DataFrame, max_pos: int | None = None) -> DataFrame:
    """``query_id, stream_id, p``: every position at which a match of the query ends."""
    found = _match(sdb, qs, _options_of(qs, all_ends=True), max_pos)
    return found.select("query_id", "stream_id", "p").filter("p >= 0").distinct()


def streams_before_query(
    sdb: DataFrame, qs: DataFrame, n_before: int, max_pos: int | None = None
) -> DataFrame:
    """One stream per match end of the seed queries ``qs``: the ``n_before`` events before it.

    The stream id is the text ``query:stream:p``; ends without any event before them give none.
    Every end lists the positions it needs, so events are joined by ``(stream_id, pos)``.
    """
    start = F.greatest(F.col("p") - n_before, F.lit(0))
    wanted = match_ends(sdb, qs, max_pos).filter("p > 0").select(
        "stream_id", F.concat_ws(":", "query_id", "stream_id", "p").alias("_id"), start.alias("_start"),
        F.explode(F.sequence(start, F.col("p") - 1)).alias("pos"),
    )
    return wanted.join(sdb, ["stream_id", "pos"]).select(
        F.col("_id").alias("stream_id"), (F.col("pos") - F.col("_start")).cast("int").alias("pos"), *attributes(sdb))


def support_of(matches: DataFrame, qs: DataFrame, n_streams: int) -> DataFrame:
    """``query_id, n_streams, support`` for every query of ``qs``."""
    counts = (
        matches.select("query_id", "stream_id").distinct()
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    )
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return qs.select("query_id").join(counts, "query_id", "left").select(
        "query_id", n.alias("n_streams"), (n / n_streams).alias("support")
    )


def support(
    sdb: DataFrame,
    qs: DataFrame,
    max_pos: int | None = None,
    n_streams: int | None = None,
    max_terms: int | None = None,
) -> DataFrame:
    """Number and share of the streams that match each query; always complete.

    Queries that are equal in normal form are matched and counted once.
    """
    total = count_streams(sdb) if n_streams is None else n_streams
    named = _prepare(qs, _options_of(qs), share=False)
    conditions = [c for c in ("terms", "gaps", "gap_forbidden", "span") if c in named.columns]
    keyed = named.select("query_id", F.sha2(F.to_json(F.struct(*conditions)), 256).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("query_id").alias("_same"))
    same = materialize(keyed.join(first, "_key").select("query_id", "_same"), "same")
    asked = materialize(qs.join(
        same.select(F.col("_same").alias("query_id")).distinct(), "query_id", "left_semi"), "asked")
    counts = support_of(match(sdb, asked, max_pos, max_terms), asked, total)
    return same.join(counts.withColumnRenamed("query_id", "_same"), "_same").select(
        "query_id", "n_streams", "support")


def supported(
    sdb: DataFrame,
    qs: DataFrame,
    supp: float = 1.0,
    max_pos: int | None = None,
    max_terms: int | None = None,
) -> DataFrame:
    """Queries that ``ceil(n_streams * supp)`` streams match."""
    total = count_streams(sdb)
    found = support(sdb, qs, max_pos, total, max_terms)
    return found.filter(F.col("n_streams") >= threshold(total, supp))


def reached_length(sdb: DataFrame, supp: float = 1.0) -> int:
    """The longest length that ``ceil(n_streams * supp)`` streams reach: the default term bound."""
    needed = threshold(count_streams(sdb), supp)
    reached = sdb.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= needed)
    last = reached.agg(F.max("pos")).first()[0]
    return 0 if last is None else last + 1


def matched_streams(sdb: DataFrame, qs: DataFrame, max_pos: int | None = None) -> DataFrame:
    """``query_id, stream_id``: the pairs that match.

    All other pairs do not match; ``support`` counts the streams of each query.
    """
    return match(sdb, qs, max_pos).select("query_id", "stream_id").distinct()


def witness(sdb: DataFrame, qs: DataFrame, max_pos: int | None = None) -> DataFrame:
    """The first match of each query and stream: end ``p``, positions of all terms, bindings."""
    found = _match(sdb, qs, _options_of(qs, positions=True), max_pos)
    first = F.min(F.struct("p", "positions", "b")).alias("_m")
    return found.groupBy("query_id", "stream_id").agg(first).select(
        "query_id", "stream_id", "_m.p", "_m.positions", "_m.b"
    )


def instances(
    sdb: DataFrame, qs: DataFrame, streams: DataFrame | None = None, max_pos: int | None = None
) -> DataFrame:
    """All matches as ``query_id, stream_id, positions, b``, optionally of chosen streams only."""
    if streams is not None:
        sdb = chosen_streams(sdb, streams)
    options = _options_of(qs, positions=True, every=True)
    return _match(sdb, qs, options, max_pos).select("query_id", "stream_id", "positions", "b")


def count_instances(sdb: DataFrame, qs: DataFrame, max_pos: int | None = None) -> DataFrame:
    """``query_id, stream_id, n_instances``: how many matches ``instances`` would list.

    Matches are counted per end and added up term by term, never listed.  A number beyond 38 digits is an error.
    """
    options = _options_of(qs)
    options.counting = True
    return _match(sdb, qs, options, max_pos).groupBy("query_id", "stream_id").agg(
        F.sum("n").cast(COUNT).alias("n_instances"))


def update_matches(
    state: DataFrame,
    qs: DataFrame,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    max_pos: int | None = None,
) -> DataFrame:
    """Matches after streams were removed or added; only added streams are matched."""
    if removed is not None:
        gone = removed.select("stream_id").distinct()
        state = state.join(gone, "stream_id", "left_anti")
    if added is not None:
        state = state.unionByName(match(added, qs, max_pos))
    return state


def update_support(
    state: DataFrame,
    qs: DataFrame,
    n_streams: int,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    max_pos: int | None = None,
) -> DataFrame:
    """Support after an update; ``n_streams`` counts the streams after it."""
    return support_of(update_matches(state, qs, added, removed, max_pos), qs, n_streams)


def classify_queries(
    sdb: DataFrame,
    qs: DataFrame,
    reference_qs: DataFrame,
    supp: float = 1.0,
    max_pos: int | None = None,
) -> DataFrame:
    """Label queries ``descriptive`` (in the reference set), ``supported`` or ``not_supported``."""
    total = count_streams(sdb)
    known = reference_qs.select(
        nt.format_terms(drop_empty_terms(normal_terms(F.col("terms")))).alias("_key")
    ).distinct().withColumn("_known", F.lit(True))
    keyed = qs.select(
        "query_id", nt.format_terms(drop_empty_terms(normal_terms(F.col("terms")))).alias("_key")
    )
    counts = support(sdb, qs, max_pos, total)
    return (
        counts.join(keyed, "query_id").join(known, "_key", "left")
        .select(
            "query_id", "n_streams",
            F.when(F.col("n_streams") < threshold(total, supp), "not_supported")
            .when(F.col("_known"), "descriptive").otherwise("supported").alias("label"),
        )
    )


def canonical_streams(qs: DataFrame, n_attrs: int) -> DataFrame:
    """Each query as a stream: one event per term, open places unset, symbols tagged by kind."""
    return qs.select(
        F.col("query_id").alias("stream_id"), F.posexplode("terms").alias("pos", "_t")
    ).select(
        "stream_id", "pos",
        *[
            F.when(F.get("_t", F.lit(a))["kind"] != "any", F.concat_ws(
                "=", F.get("_t", F.lit(a))["kind"], F.get("_t", F.lit(a))["val"]
            )).alias(f"a{a}")
            for a in range(n_attrs)
        ],
    )
