"""Discovery of the queries that a share of all streams supports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamquarry.functions import notation as nt
from streamquarry.functions.columns import attributes
from streamquarry.operators.containment import neighbour_candidates, verified, weaker_queries
from streamquarry.operators.queries import generalisations
from streamquarry.operators.templates import TemplateMining, without_open_terms
from streamquarry.plans.growth import Growth, Run, run_together
from streamquarry.plans.workspace import materialize

STRATEGIES = ("unified", "separated", "by_attribute")
RESULT = ["query_id", "qstr", "terms", "n_terms", "kind", "n_streams", "support"]


def _closed(growth: Growth, runs: list[Run]) -> DataFrame:
    """Supported queries of all runs: those without a variable that occurs once."""
    metas = [level.meta for run in runs for level in run.levels if level.n_queries]
    if not metas:
        return growth.sdb.sparkSession.createDataFrame(
            [], f"query_id bigint, qstr string, terms {nt.TERMS_TYPE}, n_terms int, kind string, "
            "n_streams bigint, support double",
        )
    found = reduce(DataFrame.unionByName, metas).filter(
        ~F.exists("var_count", lambda c: c < 2)
    )
    terms = F.col("terms")
    return found.select(
        F.col("qid").alias("query_id"), nt.format_terms(terms).alias("qstr"), "terms",
        F.col("k").alias("n_terms"), nt.query_kind(terms).alias("kind"), "n_streams",
        (F.col("n_streams") / growth.n_streams).alias("support"),
    )


def _grow(growth: Growth, strategy: str, inner: str) -> list[Run]:
    if strategy == "unified":
        return [growth.run()]
    if strategy == "separated":
        return _separated(growth)
    if strategy != "by_attribute":
        raise ValueError(f"strategy is one of {STRATEGIES}")
    attrs = range(growth.n_attrs)
    if inner == "unified":
        parts = [[run] for run in run_together([lambda a=a: growth.run(attr=a) for a in attrs])]
    else:
        pure = run_together([
            lambda a=a, kind=kind: growth.run(**kind, attr=a) for a in attrs for kind in KINDS
        ])
        pairs = [pure[2 * a: 2 * a + 2] for a in attrs]
        merged = run_together([
            lambda a=a: growth.merge([[run] for run in pairs[a]], attr=a) for a in attrs
        ])
        parts = [[*pair, mix] for pair, mix in zip(pairs, merged, strict=True)]
    found = [run for runs in parts for run in runs]
    return found + ([growth.merge(parts)] if growth.n_attrs > 1 else [])


# What a run of type queries and one of pattern queries leave out.
KINDS = ({"use_variables": False}, {"use_values": False})


def _separated(growth: Growth) -> list[Run]:
    pure = run_together([lambda kind=kind: growth.run(**kind) for kind in KINDS])
    return [*pure, growth.merge([[run] for run in pure])]


def discover(
    sdb: DataFrame,
    supp: float = 1.0,
    max_terms: int | None = None,
    strategy: str = "unified",
    inner: str = "unified",
    descriptive_only: bool = True,
    max_variables: int | None = None,
) -> DataFrame:
    """Queries supported by ``ceil(n_streams * supp)`` streams, strictest ones only by default.

    Strategies give the same result.  ``unified`` grows values and variables of
    all attributes together.  ``separated`` finds type and pattern queries on
    their own and merges them; ``by_attribute`` (with ``inner`` one of the other
    two) finds the queries of each attribute on their own and merges those.
    Without ``max_terms`` the bound is the longest length that enough streams
    reach.  With ``descriptive_only=False`` all supported queries are returned,
    with a flag ``descriptive``.
    """
    found = supported_queries(sdb, supp, max_terms, strategy, inner, max_variables)
    # a step may need one variable more than both of the queries it lies between
    flagged = flag_descriptive(found, complete=max_variables is None)
    return flagged.filter("descriptive") if descriptive_only else flagged


def supported_queries(
    sdb: DataFrame,
    supp: float = 1.0,
    max_terms: int | None = None,
    strategy: str = "unified",
    inner: str = "unified",
    max_variables: int | None = None,
) -> DataFrame:
    """All supported queries, without asking which of them are descriptive."""
    with Growth(sdb, supp, max_terms, max_variables) as growth:
        return materialize(_closed(growth, _grow(growth, strategy, inner)), "supported")


def discover_types(
    sdb: DataFrame, supp: float = 1.0, max_terms: int | None = None, max_items: int | None = None
) -> DataFrame:
    """All supported type queries.

    ``max_items`` bounds the values of a query; it has no more terms than values.
    """
    with TemplateMining(sdb, supp, max_terms, max_items) as mining:
        return _mined(mining, [mining.sequences()], "types")


def _mined(mining: TemplateMining, parts: list[DataFrame], label: str) -> DataFrame:
    """What template-first mining has found, as a discovery result."""
    found = reduce(DataFrame.unionByName, [p.select("terms", "n_streams") for p in parts])
    terms = F.col("terms")
    return materialize(without_open_terms(found).select(
        F.monotonically_increasing_id().alias("query_id"), nt.format_terms(terms).alias("qstr"), "terms",
        F.size("terms").alias("n_terms"), nt.query_kind(terms).alias("kind"), "n_streams",
        (F.col("n_streams") / mining.n_streams).alias("support"),
    ), label)


def discover_patterns(
    sdb: DataFrame,
    supp: float = 1.0,
    max_terms: int | None = None,
    max_variables: int | None = None,
) -> DataFrame:
    """All supported pattern queries."""
    with Growth(sdb, supp, max_terms, max_variables, use_values=False) as growth:
        return materialize(_closed(growth, [growth.run(use_values=False)]), "patterns")


def flag_descriptive(qs: DataFrame, complete: bool = False) -> DataFrame:
    """Add ``descriptive``: no other query of the table is stricter.

    ``complete`` states that the table holds every generalisation of its queries, as a table of all
    supported queries does; then only queries one step apart are compared.
    """
    weaker = weaker_queries(qs, complete).withColumn("_weaker", F.lit(True))
    return qs.join(weaker, "query_id", "left").withColumn(
        "descriptive", F.col("_weaker").isNull()
    ).drop("_weaker")


def descriptive(qs: DataFrame, method: str = "containment") -> DataFrame:
    """The strictest queries of a table of supported queries.

    ``containment`` compares by matching every query against the others;
    ``generalisations`` drops every query that is a one-step generalisation of
    another, which is enough if the table holds all supported queries.
    """
    if method == "containment":
        return flag_descriptive(qs).filter("descriptive").drop("descriptive")
    if method != "generalisations":
        raise ValueError("method is 'containment' or 'generalisations'")
    weaker = generalisations(qs).select("qstr").distinct()
    return qs.join(weaker, "qstr", "left_anti").select(qs.columns)


def query_lattice(qs: DataFrame, frequent_only: bool = False) -> DataFrame:
    """Edges from each query to its one-step generalisations.

    ``child`` is the stricter query; ``parent_n_streams`` is NULL for a
    generalisation outside the table, ``child_descriptive`` tells whether no
    query of the table is a child of the child.

    ``frequent_only`` leaves out generalisations outside the table.  They are then not formed at all,
    which takes 2^m of them for m equal symbols: queries meet under what a step leaves of their parts.
    """
    if frequent_only:
        names = materialize(qs.select("query_id", "terms", "qstr"), "queries")
        edges = verified(neighbour_candidates(names), names, names).join(
            names.select("query_id", F.col("qstr").alias("parent")), "query_id"
        ).select(F.col("stream_id").alias("query_id"), "parent")
    else:
        edges = generalisations(qs).select("query_id", F.col("qstr").alias("parent"))
    known = qs.select(F.col("qstr").alias("parent"), F.col("n_streams").alias("parent_n_streams"))
    has_child = edges.select(F.col("parent").alias("child")).distinct().withColumn(
        "_has", F.lit(True)
    )
    return (
        qs.select("query_id", F.col("qstr").alias("child"), F.col("n_streams").alias("child_n_streams"))
        .join(edges, "query_id")
        .join(known, "parent", "left")
        .join(has_child, "child", "left")
        .select(
            "child", "parent", "child_n_streams", "parent_n_streams",
            F.col("_has").isNull().alias("child_descriptive"),
        )
    )


def discover_by_templates(
    sdb: DataFrame,
    max_terms: int | None = None,
    lossy: bool = False,
    supp: float = 1.0,
    descriptive_only: bool = True,
) -> DataFrame:
    """Queries by template-first mining; the same as ``discover`` finds unless ``lossy``.

    Sequences of event templates come first, then equality constraints between their open places
    (``operators.templates``).  ``lossy`` wants at least one value in every term, which is faster
    and misses queries with terms of variables only.
    """
    with TemplateMining(sdb, supp, max_terms, open_terms=not lossy) as mining:
        sequences = mining.sequences()
        found = _mined(mining, [sequences, *mining.constrained(sequences)], "supported")
    flagged = flag_descriptive(found, complete=not lossy)
    return flagged.filter("descriptive") if descriptive_only else flagged


def compare_query_sets(found: DataFrame, expected: DataFrame) -> DataFrame:
    """True and false positives, misses, precision, recall and F-score by ``qstr``."""
    f = found.select("qstr").distinct().withColumn("f", F.lit(1))
    e = expected.select("qstr").distinct().withColumn("e", F.lit(1))
    joined = f.join(e, "qstr", "full_outer")
    both, only_f, only_e = (
        F.col("f").isNotNull() & F.col("e").isNotNull(), F.col("e").isNull(), F.col("f").isNull()
    )

    def n(cond):
        return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))

    counts = joined.agg(
        n(both).alias("true_positives"), n(only_f).alias("false_positives"), n(only_e).alias("misses")
    )
    tp = F.col("true_positives")
    return counts.select(
        "*",
        F.try_divide(tp, tp + F.col("false_positives")).alias("precision"),
        F.try_divide(tp, tp + F.col("misses")).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + F.col("false_positives") + F.col("misses")).alias("f_score"),
    )
