"""Tables of queries: notation, normal form, description, checks, generalisation.

All of these work on one row at a time with array functions; only removing
duplicates shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamquarry.functions import notation as nt

GAPS_TYPE = "array<struct<lo:int,hi:int>>"


def queries_from_strings(df: DataFrame) -> DataFrame:
    """``query_id, qstr`` (and other columns) to a query table with ``terms``."""
    return df.withColumn("terms", nt.parse_terms(F.col("qstr")))


def to_strings(qs: DataFrame) -> DataFrame:
    """Set ``qstr`` to the text form of ``terms``."""
    return qs.withColumn("qstr", nt.format_terms(F.col("terms")))


def _unbounded(gap: Column) -> Column:
    return gap["hi"].isNull() | (gap["hi"] < 0)


def full_gaps(gaps: Column, n_terms: Column) -> Column:
    """Gaps with an entry before the first and after the last term; open bounds as (0, NULL)."""
    open_gap = F.struct(F.lit(0).alias("lo"), F.lit(None).cast("int").alias("hi"))
    padded = F.when(F.size(gaps) == n_terms - 1, F.concat(F.array(open_gap), gaps, F.array(open_gap)))
    padded = padded.when(F.size(gaps) == n_terms + 1, gaps).otherwise(
        F.array_repeat(open_gap, (n_terms + 1).cast("int"))
    )
    return F.transform(
        padded,
        lambda g: F.struct(
            F.greatest(F.coalesce(g["lo"], F.lit(0)), F.lit(0)).alias("lo"),
            F.when(_unbounded(g), F.lit(None)).otherwise(g["hi"]).cast("int").alias("hi"),
        ),
    ).cast(GAPS_TYPE)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas of ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_variables(terms: Column) -> Column:
    """Variables that occur twice or more, in order of first appearance; by sorting, not by counting each."""

    def of(used: Column) -> Column:
        again = _once(F.array_sort(used), lambda v: F.filter(v, lambda x, i: (i > 0) & (x == F.get(v, i - 1))))
        return F.array_intersect(used, again)

    return _once(nt.variables(terms), of)


def normal_terms(terms: Column) -> Column:
    """Blank variables that occur once; name variables 0, 1, ... by first appearance."""

    def renamed(repeated: Column) -> Column:
        def rename(s: Column) -> Column:
            place = F.array_position(repeated, s["val"])
            return (
                F.when(s["kind"] != "var", s)
                .when(place > 0, nt.symbol("var", place - 1))
                .otherwise(nt.any_symbol())
            )

        return F.transform(terms, lambda t: F.transform(t, rename))

    return _once(repeated_variables(terms), renamed).cast(nt.TERMS_TYPE)


def _not_empty(term: Column) -> Column:
    return F.exists(term, lambda s: s["kind"] != "any")


def drop_empty_terms(terms: Column) -> Column:
    return F.filter(terms, _not_empty)


def _merged_gaps(gaps: Column, terms: Column) -> Column:
    """Gaps around dropped terms, added up plus one event for the term itself."""
    first = F.slice(gaps, F.lit(1), F.lit(1))
    steps = F.transform(
        terms, lambda t, i: F.struct(_not_empty(t).alias("keep"), F.get(gaps, i + 1).alias("g"))
    )

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        merged = F.struct(
            (last["lo"] + s["g"]["lo"] + 1).alias("lo"),
            (last["hi"] + s["g"]["hi"] + 1).alias("hi"),  # NULL (open) stays NULL
        )
        shorter = F.slice(done, F.lit(1), F.size(done) - 1)
        return F.when(s["keep"], F.concat(done, F.array(s["g"]))).otherwise(
            F.concat(shorter, F.array(merged))
        ).cast(GAPS_TYPE)

    return F.aggregate(steps, first.cast(GAPS_TYPE), step)


def normal_form(qs: DataFrame, keep_windows: bool = False) -> DataFrame:
    """Queries without single variables and empty terms, variables renamed in order.

    With ``keep_windows`` the ``gaps`` around a dropped term are merged (sum of
    bounds plus one); otherwise a ``gaps`` column is dropped.
    """
    named = qs.withColumn("_terms", normal_terms(F.col("terms")))
    if keep_windows and "gaps" in qs.columns:
        named = named.withColumn("gaps", full_gaps(F.col("gaps"), F.size("terms"))).withColumn(
            "gaps", _merged_gaps(F.col("gaps"), F.col("_terms"))
        )
    elif "gaps" in qs.columns:
        named = named.drop("gaps")
    named = named.withColumn("terms", drop_empty_terms(F.col("_terms"))).drop("_terms")
    return to_strings(named)


def describe_queries(qs: DataFrame) -> DataFrame:
    """Number of terms, values, variables and repeated variables, and the class of each query."""
    terms = F.col("terms")
    used = nt.variables(terms)
    distinct = F.array_distinct(used)
    repeated = F.filter(distinct, lambda v: F.size(F.filter(used, lambda u: u == v)) >= 2)
    return qs.select(
        "query_id",
        F.size(terms).alias("n_terms"),
        F.coalesce(F.size(F.get(terms, F.lit(0))), F.lit(0)).alias("n_attrs"),
        F.size(nt.values(terms)).alias("n_values"),
        F.size(F.array_distinct(nt.values(terms))).alias("n_distinct_values"),
        F.size(distinct).alias("n_variables"),
        F.size(repeated).alias("n_repeated_variables"),
        nt.query_kind(terms).alias("kind"),
    )


def is_normal(terms: Column) -> Column:
    """Is the query in normal form, apart from the names of its variables?"""
    used = nt.variables(terms)
    single = F.exists(used, lambda v: F.size(F.filter(used, lambda u: u == v)) < 2)
    return ~single & ~F.exists(terms, lambda t: ~_not_empty(t))


def validate_queries(qs: DataFrame) -> DataFrame:
    """Add ``errors``, the names of all broken rules; an empty array is a valid query."""
    terms = F.col("terms")
    n_terms = F.size(terms)
    n_attrs = F.coalesce(F.size(F.get(terms, F.lit(0))), F.lit(0))
    symbols = F.flatten(
        F.transform(terms, lambda t: F.transform(
            t, lambda s, j: F.struct(s["kind"].alias("kind"), s["val"].alias("val"), j.alias("attr"))
        ))
    )
    in_two_attributes = F.exists(
        symbols, lambda s: (s["kind"] == "var") & F.exists(
            symbols, lambda o: (o["kind"] == "var") & (o["val"] == s["val"]) & (o["attr"] != s["attr"])
        ),
    )
    rules: list[tuple[str, Column]] = [
        ("no_terms", n_terms == 0),
        ("term_width", F.exists(terms, lambda t: F.size(t) != n_attrs)),
        ("empty_value", F.exists(symbols, lambda s: (s["kind"] == "val") & (s["val"] == ""))),
        ("variable_in_two_attributes", in_two_attributes),
    ]
    if "gaps" in qs.columns:
        gaps = F.col("gaps")
        rules += [
            ("gaps_length", gaps.isNotNull() & ~F.size(gaps).isin(0)
             & (F.size(gaps) != n_terms - 1) & (F.size(gaps) != n_terms + 1)),
            ("gap_bounds", F.exists(gaps, lambda g: (g["hi"] >= 0) & (g["lo"] > g["hi"]))),
            ("gap_lower_bound_needs_normal_form",
             F.exists(gaps, lambda g: g["lo"] > 0) & ~is_normal(terms)),
        ]
    if "gap_forbidden" in qs.columns:
        sets = F.col("gap_forbidden")
        rules += [
            ("gap_sets_length", sets.isNotNull() & ~F.size(sets).isin(0)
             & (F.size(sets) != n_terms - 1)),
            ("gap_sets_and_normal_form", (F.size(sets) > 0) & ~is_normal(terms)),
        ]
    if "span" in qs.columns:
        span = F.col("span")
        rules += [
            ("span_shorter_than_query", (span >= 0) & (span < n_terms)),
            ("span_and_normal_form", (span >= 0) & ~is_normal(terms)),
        ]
    found = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(n)) for n, broken in rules])
    return qs.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def query_key(qs: DataFrame) -> Column:
    """Text that is equal exactly for syntactically equal queries."""
    parts = [nt.format_terms(F.col("terms"))]
    if "gaps" in qs.columns:
        gaps = full_gaps(F.col("gaps"), F.size("terms"))
        parts.append(F.array_join(
            F.transform(gaps, lambda g: F.concat_ws("-", g["lo"], F.coalesce(g["hi"].cast("string"), F.lit("")))),
            ",",
        ))
    if "gap_forbidden" in qs.columns:
        parts.append(F.to_json(F.transform(
            F.coalesce(F.col("gap_forbidden"), F.array().cast("array<array<string>>")),
            lambda s: F.array_sort(F.array_distinct(s)),
        )))
    if "span" in qs.columns:
        span = F.col("span")
        parts.append(F.coalesce(F.when(span >= 0, span).cast("string"), F.lit("")))
    return F.concat_ws("|", *parts)


def dedupe_queries(qs: DataFrame) -> DataFrame:
    """One query, that with the smallest id, of each set of syntactically equal ones."""
    rest = [c for c in qs.columns if c != "query_id"]
    first = F.min_by(F.struct("query_id", *rest), "query_id")
    # an aggregate, so that equal queries meet before the shuffle already
    return (
        qs.withColumn("_key", query_key(qs)).groupBy("_key").agg(first.alias("q")).select("q.*")
        .select(qs.columns)
    )


# Subsets of equal symbols are made as rows, so many bits at a time.
MASK_BITS = 12


def generalisations(qs: DataFrame) -> DataFrame:
    """All one-step weaker queries of each query in normal form, without repetition.

    Steps: blank one symbol; replace two or more equal values of an attribute by
    a new variable; give 2..m-2 of m occurrences of a variable a new name.
    Their number is exponential in the equal symbols of a query by definition; they are made
    row by row.
    """
    base = qs.select("query_id", normal_terms(F.col("terms")).alias("terms")).withColumn(
        "terms", drop_empty_terms(F.col("terms"))
    )
    cells = F.flatten(F.transform(
        F.col("terms"),
        lambda t, i: F.transform(t, lambda s, j: F.struct(
            i.alias("t"), j.alias("a"), s["kind"].alias("kind"), s["val"].alias("val")
        )),
    ))
    placed = base.withColumn("_cells", F.filter(cells, lambda c: c["kind"] != "any"))
    groups = placed.withColumn("_g", F.explode(F.array_distinct(F.transform(
        "_cells", lambda c: F.struct(c["a"].alias("a"), c["kind"].alias("kind"), c["val"].alias("val"))
    ))))
    members = F.transform(
        F.filter("_cells", lambda c: (c["a"] == F.col("_g.a")) & (c["kind"] == F.col("_g.kind"))
                 & (c["val"] == F.col("_g.val"))),
        lambda c: c["t"],
    )
    groups = groups.select(
        "query_id", "terms", "_g", members.alias("_at"),
        F.size(F.array_distinct(nt.variables(F.col("terms")))).alias("_n_vars"),
    ).withColumn("_m", F.size("_at"))
    one = groups.select("*", F.explode("_at").alias("_t")).select(
        "*", F.array("_t").alias("_chosen"), nt.any_symbol().alias("_new")
    ).drop("_t")
    n_bits = F.bit_count(F.col("_mask"))
    upper = F.when(F.col("_g.kind") == "val", F.col("_m")).otherwise(F.col("_m") - 2)
    masks = groups.filter(F.col("_m") >= F.when(F.col("_g.kind") == "val", 2).otherwise(4)).withColumn(
        "_mask", F.lit(0).cast("bigint"))
    for shift in range(0, 63, MASK_BITS):
        bits = F.expr(f"greatest(0, least({min(MASK_BITS, 63 - shift)}, _m - {shift}))")
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1))
        masks = masks.withColumn("_part", part).withColumn(
            "_mask", F.col("_mask") + F.shiftleft("_part", shift)).drop("_part")
    many = (
        masks.filter((n_bits >= 2) & (n_bits <= upper))
        .withColumn("_chosen", F.filter(
            "_at", lambda t, i: F.call_function("getbit", F.col("_mask"), i) == 1
        ))
        .withColumn("_new", nt.symbol("var", F.col("_n_vars")))
        .drop("_mask")
    )
    rewritten = one.unionByName(many.select(one.columns)).select(
        "query_id",
        F.transform(
            "terms",
            lambda t, i: F.transform(t, lambda s, j: F.when(
                (j == F.col("_g.a")) & F.array_contains("_chosen", i), F.col("_new")
            ).otherwise(s)),
        ).alias("terms"),
    )
    weaker = normal_form(rewritten).filter(F.size("terms") > 0)
    return weaker.dropDuplicates(["query_id", "qstr"]).select("query_id", "qstr", "terms")
