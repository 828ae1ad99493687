"""Template-first mining: what events have in common, sequences of that, equal values in between.

1. An *event template* keeps some attribute values of an event and leaves the others open.
   Templates that enough streams hold are counted over the subsets of supported values.
2. *Template sequences* grow by one template at their right end.  The state of a sequence is one row
   per stream, the earliest end of a match.  A stream supports the longer sequence exactly if the
   last place of the next template lies behind that end, so candidates need one join with one row
   per stream and template; the next end is looked up for survivors only, and not at all on the
   last level.
3. *Constraints* want equal values at open places of one attribute.  Pairs of places are tried
   first; larger sets of constraints are made of supported pairs only, each set from exactly one
   smaller one, and all sets of a size are matched against the streams in one run.

Type queries are the template sequences without open terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamquarry.functions.columns import attributes, cells, threshold
from streamquarry.functions.notation import TERMS_TYPE
from streamquarry.operators.matching import support
from streamquarry.plans.chunks import CHUNK, chunk_of
from streamquarry.plans.workspace import broadcast_if_small, delete_steps, write_step

SEQUENCES = ["seq", "terms", "n_items", "n_streams"]


class TemplateMining:
    """Sequences of event templates that ``ceil(n_streams * supp)`` streams hold, and their constraints.

    ``open_terms`` also admits the template without any value, which every event has;
    ``max_items`` bounds the values of a sequence.
    """

    def __init__(
        self,
        sdb: DataFrame,
        supp: float = 1.0,
        max_terms: int | None = None,
        max_items: int | None = None,
        open_terms: bool = False,
        chunk: int = CHUNK,
    ):
        self._paths: list[str] = []
        self.attrs = attributes(sdb)
        self.max_terms, self.max_items = max_terms, max_items
        self.sdb = self._write(sdb.select("stream_id", "pos", *self.attrs), "streams")
        size = self.sdb.agg(F.sum((F.col("pos") == 0).cast("int")), F.max("pos")).first()
        self.n_streams, self.max_pos = size[0] or 0, size[1] or 0
        self.needed = threshold(self.n_streams, supp)
        self._find_templates(open_terms, chunk)

    def __enter__(self) -> TemplateMining:
        return self

    def __exit__(self, *_) -> None:
        delete_steps(self.sdb.sparkSession, self._paths)
        self._paths = []

    def _write(self, df: DataFrame, label: str) -> DataFrame:
        written, path = write_step(df, label)
        self._paths.append(path)
        return written

    # -- event templates ----------------------------------------------------

    def _with_supported_values(self) -> DataFrame:
        """The events; values that too few streams hold are unset."""
        known = self._write(
            cells(self.sdb).select("stream_id", "attr", "val").distinct().groupBy("attr", "val")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= self.needed), "values")
        n_known = known.count()
        events = self.sdb
        for i, a in enumerate(self.attrs):
            own = known.filter(F.col("attr") == i).select(F.col("val").alias(a), F.lit(True).alias("_known"))
            events = events.join(broadcast_if_small(own, n_known), a, "left").withColumn(
                a, F.when(F.col("_known"), F.col(a))).drop("_known")
        return events

    def _find_templates(self, open_terms: bool, chunk: int) -> None:
        """``templates``, and where they lie: per chunk of a stream (``places``), per stream (``bounds``)."""
        subsets = [
            [a if mask >> i & 1 else None for i, a in enumerate(self.attrs)]
            for mask in range(0 if open_terms else 1, 1 << len(self.attrs))
        ]
        unset = F.lit(None).cast("string")
        items = F.filter(F.array(*[
            F.struct(
                F.array(*[F.col(a) if a else unset for a in chosen]).alias("items"),
                F.lit(sum(a is not None for a in chosen)).alias("n_items"),
                F.concat(F.lit(""), *[F.col(a) for a in chosen if a]).isNotNull().alias("held"),
            ) for chosen in subsets
        ]), lambda s: s["held"])
        held = self._write(
            self._with_supported_values().select("stream_id", "pos", F.inline(items))
            .groupBy("stream_id", "items", "n_items", chunk_of(F.col("pos"), chunk).alias("chunk"))
            .agg(F.sort_array(F.collect_list("pos")).alias("positions")), "held")
        # a chunk has at most its size of positions; a stream with several has one row for each
        ordered = Window.partitionBy("stream_id", "items").orderBy("chunk")
        last = F.element_at("positions", -1)
        held = held.withColumn("last", last).withColumn("before", F.lag("last").over(ordered))
        counted = held.filter("before IS NULL").groupBy("items", "n_items").agg(
            F.count(F.lit(1)).alias("n_streams")).filter(F.col("n_streams") >= self.needed)
        term = F.transform("items", lambda v: F.struct(
            F.when(v.isNull(), "any").otherwise("val").alias("kind"), v.alias("val")))
        self.templates = self._write(counted.select(
            F.monotonically_increasing_id().alias("template"), "items", "n_items", "n_streams",
            term.alias("term")), "templates")
        self.n_templates = self.templates.count()
        names = broadcast_if_small(self.templates.select("template", "items"), self.n_templates)
        self.places = self._write(held.join(names, "items").select(
            "stream_id", "template", "positions", F.coalesce("before", F.lit(-1)).alias("before"), "last"), "places")
        self.bounds = self._write(self.places.groupBy("stream_id", "template").agg(
            F.min(F.get("positions", F.lit(0))).alias("first"), F.max("last").alias("last")), "bounds")

    # -- sequences ------------------------------------------------------------

    def sequences(self) -> DataFrame:
        """All supported sequences: ``seq, terms, n_items, n_streams``."""
        level = self._write(self.templates.filter(self._within("n_items")).select(
            F.col("template").alias("seq"), F.array("term").cast(TERMS_TYPE).alias("terms"), "n_items", "n_streams"),
            "sequences")
        found, k = level, 1
        state = self.bounds.withColumnsRenamed({"template": "seq", "first": "end"}).select("seq", "stream_id", "end")
        while k != self.max_terms:
            longer = self._longer(level, state)
            n_longer = longer.count()
            if not n_longer:
                break
            k += 1
            level = longer.select(*SEQUENCES)
            found = found.unionByName(level)
            if k != self.max_terms:
                state = self._write(self._ends(state, longer, n_longer), "ends")
        return self._write(found.withColumn("seq", F.monotonically_increasing_id()), "all-sequences")

    def _within(self, n_items: str):
        return F.lit(True) if self.max_items is None else F.expr(f"{n_items} <= {self.max_items}")

    def _longer(self, level: DataFrame, state: DataFrame) -> DataFrame:
        """Supported sequences of one template more, with the sequence (``head``) and ``template`` they are made of."""
        counted = (
            state.join(self.bounds.select("stream_id", "template", "last"), "stream_id").filter("last > end")
            .groupBy("seq", "template").agg(F.count(F.lit(1)).alias("n_streams"))
            .filter(F.col("n_streams") >= self.needed)
        )
        templates = broadcast_if_small(
            self.templates.select("template", "term", F.col("n_items").alias("_more")), self.n_templates)
        made = counted.join(templates, "template").join(level.select("seq", "terms", "n_items"), "seq")
        return self._write(made.filter(self._within("n_items + _more")).select(
            F.monotonically_increasing_id().alias("seq"), F.col("seq").alias("head"), "template",
            F.concat("terms", F.array("term")).cast(TERMS_TYPE).alias("terms"),
            (F.col("n_items") + F.col("_more")).alias("n_items"), "n_streams"), "sequences")

    def _ends(self, state: DataFrame, longer: DataFrame, n_longer: int) -> DataFrame:
        """Earliest ends of the longer sequences: the next place lies in exactly one chunk."""
        steps = broadcast_if_small(longer.select("head", "template", F.col("seq").alias("_seq")), n_longer)
        return (
            state.join(steps, F.col("seq") == F.col("head"))
            .join(self.places, ["stream_id", "template"]).filter("before <= end AND last > end")
            .select(F.col("_seq").alias("seq"), "stream_id",
                    F.expr("get(filter(positions, p -> p > end), 0)").alias("end"))
        )

    # -- constraints ----------------------------------------------------------

    def _supported(self, candidates: DataFrame) -> tuple[DataFrame, int]:
        """Candidates that enough streams match, with ``n_streams``, and their number."""
        asked = self._write(candidates.withColumn("query_id", F.monotonically_increasing_id()), "constraints")
        counts = support(self.sdb, asked.select("query_id", "terms"), self.max_pos, self.n_streams)
        kept = counts.filter(F.col("n_streams") >= self.needed).select("query_id", "n_streams")
        found = self._write(asked.join(kept, "query_id").drop("query_id"), "constrained")
        return found, found.count()

    def _one_more(self, level: DataFrame) -> DataFrame:
        """Every query with one constraint more that ``level`` leads to; places are numbered term by term.

        A constraint joins a place to the last variable, behind its last place, or starts a variable
        behind the first place of the last one.  So each set of constraints is reached once.
        """
        n = len(self.attrs)
        free = f"filter(sequence(0, size(terms) * {n} - 1), s -> terms[s div {n}][s % {n}].kind = 'any')"
        pairs = f"""concat(
            transform(filter(free, s -> n_vars > 0 AND s > last AND s % {n} = last % {n}),
                s -> named_struct('s1', first, 's2', s, 'fresh', false)),
            flatten(transform(filter(free, s -> s > first), s -> transform(
                filter(free, t -> t > s AND t % {n} = s % {n}),
                t -> named_struct('s1', s, 's2', t, 'fresh', true)))))"""
        var = "named_struct('kind', 'var', 'val', CAST(n_vars - IF(fresh, 0, 1) AS STRING))"
        joined = f"""transform(terms, (t, i) -> transform(t, (s, a) ->
            IF(i * {n} + a = s2 OR (fresh AND i * {n} + a = s1), {var}, s)))"""
        return (
            level.withColumn("free", F.expr(free)).select("*", F.expr(f"inline({pairs})"))
            .select("seq", F.expr(joined).cast(TERMS_TYPE).alias("terms"),
                    (F.col("n_vars") + F.col("fresh").cast("int")).alias("n_vars"),
                    F.col("s1").alias("first"), F.col("s2").alias("last"))
        )

    def constrained(self, sequences: DataFrame) -> list[DataFrame]:
        """Per number of constraints the supported queries: ``terms, n_streams``."""
        n = len(self.attrs)
        # later places lie behind the first one of the last variable: an open term before it stays open
        lost = f"exists(slice(terms, 1, first div {n}), t -> forall(t, s -> s.kind = 'any'))"
        roots = sequences.select(
            "seq", "terms", F.lit(0).alias("n_vars"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        found, n_found = self._supported(self._one_more(roots))
        pairs = found.select("seq", "first", "last")
        levels = []
        while n_found:
            level = found.filter(f"NOT {lost}")
            levels.append(level.select("terms", "n_streams"))
            more = self._one_more(level).filter(f"NOT {lost}").join(pairs, ["seq", "first", "last"], "left_semi")
            found, n_found = self._supported(more)
        return levels


def without_open_terms(found: DataFrame) -> DataFrame:
    return found.filter("forall(terms, t -> exists(t, s -> s.kind <> 'any'))")
