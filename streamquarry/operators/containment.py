"""Which queries of a table are weaker than others, without comparing all pairs.

A query is weaker than another exactly when it matches the stream that the other forms.  Two
indexes choose the pairs for which that is tried:

* *Neighbours.*  The symbols of a query, counted per attribute, are its parts: a value with the number
  of its occurrences, a variable with the number of its.  A step that weakens a query takes one
  occurrence of a part away, turns occurrences of a value into a variable, or splits a variable
  in two; what parts that leaves does not depend on places.  So each query is looked up under the
  sums of the hashes of what its steps leave, one per part and count, and meets the queries that
  have just these parts.
* *Containment.*  A query can only be weaker than one that has all its parts, at least as often.
  Each query is listed under its parts, and another looks into the shortest of the lists under
  which it would have to be found itself; numbers of terms and symbols and all other parts are
  compared before anything is matched.

In a table that holds every generalisation of its queries, a query is weaker than another one
exactly if it is weaker than a neighbour.  In other tables the queries without one are looked up
by containment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamquarry.functions import notation as nt
from streamquarry.operators.matching import _match, _Options, canonical_streams
from streamquarry.plans.workspace import materialize


def parts(qs: DataFrame) -> DataFrame:
    """``query_id, attr, kind, val, c``: the symbols of each query with their numbers of occurrences."""
    return (
        qs.select("query_id", F.explode("terms").alias("_t"))
        .select("query_id", F.posexplode("_t").alias("attr", "_s"))
        .select("query_id", "attr", "_s.*").filter("kind <> 'any'")
        .groupBy("query_id", "attr", "kind", "val").agg(F.count(F.lit(1)).cast("int").alias("c"))
    )


def _hash(kind: str, c: str) -> str:
    """Hash of a part that has ``c`` occurrences; variables have no names, none are left of 0."""
    val = "val" if kind == "val" else "''"
    return f"IF({c} > 0, CAST(xxhash64(attr, '{kind}', {val}, CAST({c} AS INT)) AS DECIMAL(38, 0)), 0)"


def _keyed(found: DataFrame, qs: DataFrame) -> DataFrame:
    """``query_id, key``: the sum of the hashes of all parts."""
    own = f"IF(kind = 'val', {_hash('val', 'c')}, {_hash('var', 'c')})"
    keys = found.groupBy("query_id").agg(F.sum(F.expr(own)).alias("key"))
    return qs.select("query_id", F.size("terms").alias("n_terms")).join(keys, "query_id", "left").withColumn(
        "key", F.coalesce("key", F.lit(0).cast("decimal(38,0)")))


def neighbour_candidates(qs: DataFrame) -> DataFrame:
    """Pairs ``query_id`` and ``stream_id``: a query may be one step weaker than the other."""
    found = materialize(parts(qs), "parts")
    keys = materialize(_keyed(found, qs), "part-keys")
    values = f"""transform(sequence(1, c), k -> {_hash('val', 'c - k')} - {_hash('val', 'c')}
        + IF(k = 1, 0, {_hash('var', 'k')}))"""
    more = f"""transform(sequence(1, greatest(1, c div 2)), k -> IF(k = 1, {_hash('var', 'IF(c > 2, c - 1, 0)')},
        {_hash('var', 'k')} + {_hash('var', 'c - k')}) - {_hash('var', 'c')})"""
    # the step k = 1 takes one occurrence away, a larger one moves k of them to a new variable
    one_less = f"array({_hash('val', 'c - 1')} - {_hash('val', 'c')})"
    steps = found.selectExpr(
        "query_id", f"explode(IF(kind = 'val', IF(c = 1, {one_less}, {values}), {more})) AS step")
    weaker = steps.join(keys, "query_id").select(
        F.col("query_id").alias("stream_id"), (F.col("key") + F.col("step")).cast("decimal(38,0)").alias("key"),
        F.col("n_terms").alias("_terms")).distinct()
    return weaker.join(keys, "key").filter("n_terms <= _terms AND query_id <> stream_id").select("query_id", "stream_id")


def _items(found: DataFrame, qs: DataFrame, wanted: bool) -> DataFrame:
    """``query_id, n_terms, n_symbols, items`` : what a query is listed under, or must be listed under.

    A part with c occurrences is listed under 1 to c of them, as itself and as any symbol of its attribute.
    """
    name = lambda kind, k: f"concat_ws('|', attr, {kind}, CAST({k} AS STRING))"
    value, either = "concat('=', val)", "'*'"
    if wanted:
        listed = f"array(IF(kind = 'val', {name(value, 'c')}, {name(either, 'c')}))"
    else:
        listed = f"""concat(IF(kind = 'val', transform(sequence(1, c), k -> {name(value, 'k')}), array()),
            transform(sequence(1, c), k -> {name(either, 'k')}))"""
    own = found.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_list(F.expr(listed)))).alias("items"), F.sum("c").alias("n_symbols"))
    everywhere = F.array(F.lit("any"))  # under which the query without symbols looks
    return qs.select("query_id", F.size("terms").alias("n_terms")).join(own, "query_id", "left").select(
        "query_id", "n_terms", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"),
        F.concat(everywhere, F.coalesce("items", F.array().cast("array<string>"))).alias("items"))


def containment_candidates(qs1: DataFrame, qs2: DataFrame) -> DataFrame:
    """Pairs ``query_id`` (of qs1) and ``stream_id`` (of qs2): the second has all parts of the first."""
    held = materialize(_items(parts(qs2), qs2, wanted=False), "items")
    lists = held.select(F.col("query_id").alias("stream_id"), F.explode("items").alias("item"), F.col("n_terms").alias("_terms"),
                        F.col("n_symbols").alias("_symbols"), F.col("items").alias("_items"))
    sizes = lists.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    asked = materialize(_items(parts(qs1), qs1, wanted=True), "wanted")
    # a query that asks for an item nobody is listed under is weaker than none: the inner list is empty
    shortest = (
        asked.select("query_id", F.explode("items").alias("item")).join(sizes, "item", "left")
        .groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item")).alias("_m"))
        .select("query_id", "_m.item")
    )
    return asked.join(shortest, "query_id").join(lists, "item").filter(
        "n_terms <= _terms AND n_symbols <= _symbols AND size(array_except(items, _items)) = 0"
    ).select("query_id", "stream_id")


def _tagged(qs: DataFrame) -> DataFrame:
    """Values named as ``canonical_streams`` names them."""
    return qs.select("query_id", F.transform(
        "terms", lambda t: F.transform(t, lambda s: F.when(
            s["kind"] == "val", nt.symbol("val", F.concat(F.lit("val="), s["val"]))
        ).otherwise(s))
    ).cast(nt.TERMS_TYPE).alias("terms"))


def verified(candidates: DataFrame, qs1: DataFrame, qs2: DataFrame) -> DataFrame:
    """Of the pairs those whose first query is weaker than the second: it matches it and differs from it."""
    size = qs2.agg(F.max(F.size(F.get("terms", F.lit(0)))), F.max(F.size("terms"))).first()
    # without any query in qs2 there is still one (empty) attribute to match
    n_attrs, max_terms = max(size[0] or 0, 1), size[1] or 0
    pairs = materialize(candidates, "candidates")
    # the query without terms matches every stream, also one without events
    matched = _match(canonical_streams(qs2, n_attrs), _tagged(qs1), _Options(), max_terms, pairs=pairs)
    found = matched.select("query_id", "stream_id").distinct()
    left = qs1.select("query_id", nt.format_terms(F.col("terms")).alias("_w"))
    right = qs2.select(F.col("query_id").alias("stream_id"), nt.format_terms(F.col("terms")).alias("_s"))
    return found.join(left, "query_id").join(right, "stream_id").filter("_w <> _s").select("query_id", "stream_id")


def weaker_than(qs1: DataFrame, qs2: DataFrame) -> DataFrame:
    """Pairs ``weaker_id`` (of qs1), ``stricter_id`` (of qs2) of different queries in normal form."""
    return verified(containment_candidates(qs1, qs2), qs1, qs2).withColumnsRenamed(
        {"query_id": "weaker_id", "stream_id": "stricter_id"})


def weaker_queries(qs: DataFrame, complete: bool = False) -> DataFrame:
    """``query_id`` of the queries that another one of the table is stricter than.

    ``complete`` states that the table holds every generalisation of its queries.
    """
    qs = materialize(qs.select("query_id", "terms"), "queries")
    near = materialize(verified(neighbour_candidates(qs), qs, qs).select("query_id").distinct(), "weaker")
    if complete:
        return near
    rest = materialize(qs.join(near, "query_id", "left_anti"), "unmet")
    n_rest = rest.count()
    far = verified(containment_candidates(rest, qs), rest, qs).select("query_id").distinct() if n_rest else near.limit(0)
    return near.unionByName(far)
