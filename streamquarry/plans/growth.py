"""Level-wise growth of event queries over an occurrence index.

A query under construction only ever grows at its end: by a new term with one
symbol, or by one more symbol of a later attribute in its last term.  A symbol
is a supported value, a new variable, or a variable met before.  A variable may
occur once while the query is *open*.  Every query in normal form has exactly
one such build order and its support never rises along it, so pruning by
support loses nothing, and candidates are read off the data instead of being
enumerated.

``state``: qid, stream_id, b, p0, pre, p.  For a query, a stream and a binding
``b`` of its variables (an array of codes), ``p`` is the end of the earliest
match, ``p0`` the end of that match without the last term, and ``pre`` the item
set the last term stands for.

``meta``: one row per query under construction.  A symbol is the integer
``(arg * 3 + kind) * 2 + mode``; kind 0 is a value (arg its id), 1 a new
variable (arg its attribute), 2 a known variable (arg its number); mode 0
starts a term, 1 continues the last one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamquarry.functions.columns import attributes, threshold
from streamquarry.functions.notation import TERMS_TYPE
from streamquarry.plans.chunks import chunk_of, nodes_of
from streamquarry.plans.occurrences import INDEX_CHUNK, OccurrenceIndex, build_index
from streamquarry.plans.workspace import broadcast_if_small, delete_steps, write_step

VALUE, NEW, KNOWN = 0, 1, 2
META = ["qid", "parent", "sym", "n_streams", "k", "last_attr", "terms", "var_attr", "var_count"]
STATE = ["qid", "stream_id", "b", "p0", "pre", "p"]


@dataclass
class Level:
    meta: DataFrame
    n_queries: int
    n_known: int  # most variables of a query
    state: DataFrame | None


@dataclass
class Run:
    """Levels of one growth; level i holds queries of i + 1 symbols."""

    levels: list[Level] = field(default_factory=list)

    def meta(self) -> list[DataFrame]:
        return [level.meta for level in self.levels]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _code(arg: int | str, kind: int | str, mode: str) -> str:
    return f"((CAST({arg} AS BIGINT) * 3 + {kind}) * 2 + {mode})"


def _join_small(left: DataFrame, right: DataFrame, on, n_rows: int, how: str = "inner") -> DataFrame:
    return left.join(broadcast_if_small(right, n_rows), on, how)


def run_together(tasks: list[Callable[[], Run]]) -> list[Run]:
    """Independent runs side by side: their jobs share the cluster instead of waiting in line."""
    results: list[Run | BaseException | None] = [None] * len(tasks)

    def call(i: int, task: Callable[[], Run]) -> None:
        try:
            results[i] = task()
        except BaseException as e:  # noqa: BLE001
            results[i] = e

    threads = [InheritableThread(target=call, args=(i, t)) for i, t in enumerate(tasks)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for r in results:
        if isinstance(r, BaseException):
            raise r
    return results


class Growth:
    """Queries supported by ``ceil(n_streams * supp)`` streams, grown level by level."""

    def __init__(
        self,
        sdb: DataFrame,
        supp: float = 1.0,
        max_terms: int | None = None,
        max_variables: int | None = None,
        use_values: bool = True,
        use_variables: bool = True,
    ):
        self._used, self._lock, self._paths = 1, Lock(), []
        self.index: OccurrenceIndex | None = None
        self.n_attrs = len(attributes(sdb))
        self.sdb = self._write(sdb.select("stream_id", "pos", *attributes(sdb)), "streams")
        size = self.sdb.agg(
            F.sum((F.col("pos") == 0).cast("int")), F.max("pos")
        ).first()
        self.n_streams, self.max_pos = size[0] or 0, size[1] or 0
        self.needed = threshold(self.n_streams, supp)
        self.max_terms = max_terms or self._reached_length()
        self.max_variables = max_variables
        self.index = build_index(
            self.sdb, self.needed, self.max_pos, use_values, use_variables, self._write
        )
        self.use_values, self.use_variables = use_values, use_variables

    def _write(self, df: DataFrame, label: str) -> DataFrame:
        written, path = write_step(df, label)
        with self._lock:
            self._paths.append(path)
        return written

    def _carried(self, emitted: DataFrame) -> tuple[DataFrame, str]:
        """What a level's only join has found, written: it is counted, then read again for the survivors.

        The folder goes when the level ends, or with all others if it does not.
        """
        written, path = write_step(emitted, "emitted")
        with self._lock:
            self._paths.append(path)
        return written, path

    def __enter__(self) -> Growth:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Forget the index and delete what the levels have written."""
        if self.index is not None:
            self.index.rows.unpersist()
        delete_steps(self.sdb.sparkSession, self._paths)
        self._paths = []

    def _reached_length(self) -> int:
        """The longest length that enough streams reach.

        A stream reaches length m exactly when it has an event at position m - 1.
        """
        reached = self.sdb.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).filter(
            F.col("n") >= self.needed
        )
        return (reached.agg(F.max("pos")).first()[0] or 0) + 1

    # -- one level ---------------------------------------------------------

    def _root(self) -> tuple[DataFrame, DataFrame]:
        state = self.sdb.filter("pos = 0").selectExpr(
            "0L AS qid", "stream_id", "CAST(array() AS ARRAY<BIGINT>) AS b", "-1 AS p0",
            f"{self.index.empty_item_set} AS pre", "-1 AS p",
        )
        meta = self.sdb.sparkSession.range(0, 1, 1, 1).selectExpr(
            "id AS qid", "-1L AS parent", "-1L AS sym", f"{self.n_streams}L AS n_streams", "0 AS k",
            f"{self.n_attrs} AS last_attr", f"CAST(array() AS {TERMS_TYPE}) AS terms",
            "CAST(array() AS ARRAY<INT>) AS var_attr", "CAST(array() AS ARRAY<INT>) AS var_count",
        )
        return state, meta

    def _flags(self, meta: DataFrame, within_terms: bool = True) -> DataFrame:
        """What may still be added to each query."""
        limit = self.max_terms
        room = str(self.use_variables).lower()
        if self.max_variables is not None:
            room = f"({room} AND size(var_attr) < {self.max_variables})"
        can_s = f"k < {limit}"
        can_i = f"k > 0 AND last_attr < {self.n_attrs - 1} AND {str(within_terms).lower()}"
        return meta.selectExpr(
            "qid", f"({can_s}) AS can_s", f"({can_i}) AS can_i",
            f"(k + 1 < {limit} AND {room}) AS new_s", f"(k < {limit} AND {room}) AS new_i",
        )

    def _emit(
        self, state: DataFrame, flags: DataFrame, n_queries: int, n_known: int, rows: DataFrame,
        use_values: bool = True, use_variables: bool = True,
    ) -> DataFrame:
        """All symbols that continue a match, with the earliest end they lead to."""
        empty, grown = self.index.empty_item_set, self.index.with_value
        probe = (
            _join_small(state, flags, "qid", n_queries)
            .filter("can_s OR can_i")
            .selectExpr("qid", "stream_id", "b", f"""explode(array(
                IF(can_s, named_struct('p0', p, 'pre', {empty}, 'mode', 0, 'new', new_s), NULL),
                IF(can_i, named_struct('p0', p0, 'pre', pre, 'mode', 1, 'new', new_i), NULL)
            )) AS _at""")
            .filter("_at IS NOT NULL")
            .selectExpr("qid", "stream_id", "b", "_at.*")
        )
        if "chunk" in self.index.join_keys:
            probe = probe.withColumn("chunk", F.explode(
                nodes_of(chunk_of(F.col("p0"), INDEX_CHUNK), self.index.levels)))
        # matches and index both grow with the streams: neither may be broadcast, also where a union
        # of written states has lost their hints
        joined = probe.hint("merge").join(rows, self.index.join_keys).filter("p0 >= lo AND p0 < pos")
        symbols = []
        if use_values:
            symbols.append(_code("vid", VALUE, "mode"))
        if use_variables:
            # a variable must be met again later, so its value must occur later
            new = _code(f"bc % {self.n_attrs}", NEW, "mode")
            symbols.append(f"IF(new AND last > pos, {new}, NULL)")
            symbols += [
                f"IF(size(b) > {x} AND get(b, {x}) = bc, {_code(x, KNOWN, 'mode')}, NULL)"
                for x in range(n_known)
            ]
        return joined.selectExpr(
            "qid", "stream_id", "b", "bc", "p0", f"{grown('pre', 'key')} AS pre", "pos",
            f"explode(array({', '.join(symbols)})) AS sym",
        ).filter("sym IS NOT NULL")

    def _candidates(self, emitted: DataFrame) -> DataFrame:
        return (
            emitted.select("qid", "sym", "stream_id").distinct()
            .groupBy("qid", "sym").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= self.needed)
        )

    def _describe(self, candidates: DataFrame, meta: DataFrame, n_meta: int) -> DataFrame:
        """Meta rows of the grown queries; queries that can never be closed are left out."""
        known = candidates.withColumnsRenamed({"qid": "_parent", "sym": "_sym"})
        old = meta.drop("n_streams", "sym", "parent").withColumnRenamed("qid", "_parent")
        values = self.index.values.selectExpr("vid", "attr AS _vattr", "val")
        grown = _join_small(known, old, "_parent", n_meta).selectExpr(
            "*", "_sym % 2 AS _mode", "(_sym div 2) % 3 AS _kind", "_sym div 6 AS _arg",
            f"IF((_sym div 2) % 3 = {VALUE}, _sym div 6, NULL) AS vid",
        )
        grown = _join_small(grown, values, "vid", self.index.n_values, "left").selectExpr(
            "*",
            f"""CAST(CASE _kind WHEN {VALUE} THEN _vattr WHEN {NEW} THEN _arg
                ELSE get(var_attr, CAST(_arg AS INT)) END AS INT) AS _attr""",
            f"""CASE _kind WHEN {VALUE} THEN named_struct('kind', 'val', 'val', val)
                WHEN {NEW} THEN named_struct('kind', 'var', 'val', CAST(size(var_attr) AS STRING))
                ELSE named_struct('kind', 'var', 'val', CAST(_arg AS STRING)) END AS _s""",
        )
        blank = f"array_repeat(named_struct('kind', 'any', 'val', CAST(NULL AS STRING)), {self.n_attrs})"
        changed = {
            "terms": f"""CAST(concat(
                slice(terms, 1, CAST(k - _mode AS INT)),
                array(transform(IF(_mode = 0, {blank}, get(terms, k - 1)),
                                (s, j) -> IF(j = _attr, _s, s)))
            ) AS {TERMS_TYPE})""",
            "var_count": f"""IF(_kind = {NEW}, concat(var_count, array(1)), transform(
                var_count, (c, i) -> IF(_kind = {KNOWN} AND i = _arg, c + 1, c)))""",
            "var_attr": f"IF(_kind = {NEW}, concat(var_attr, array(_attr)), var_attr)",
            "k": "CAST(k + 1 - _mode AS INT)",
            "last_attr": "_attr",
        }
        rest = [c for c in grown.columns if c not in changed and c != "n"]
        grown = grown.selectExpr(*rest, "n AS n_streams", *[f"{e} AS {c}" for c, e in changed.items()])
        closable = [
            f"""size(filter(arrays_zip(var_attr, var_count), v -> v.var_attr = {a} AND v.var_count = 1))
                <= {self.max_terms} - k + IF({a} > last_attr, 1, 0)"""
            for a in range(self.n_attrs)
        ]
        return grown.filter(" AND ".join(closable)).selectExpr(
            "*", "spark_partition_id() AS _part", "monotonically_increasing_id() AS _place"
        ).withColumnsRenamed({"_parent": "parent", "_sym": "sym"})

    def _numbered(self, described: DataFrame, columns: list[str], label: str) -> DataFrame:
        """Write the queries of a level with dense ids, following those of all levels before.

        Partitions are counted once they are written, so ids fit whatever their number is.
        """
        rest = [c for c in columns if c != "qid"]
        written = self._write(described.select(*rest, "_part", "_place"), f"{label}-found")
        first = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        parts = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_least"))
        n_queries = written.count()
        with self._lock:
            base, self._used = self._used, self._used + n_queries
        # a row per partition
        before = parts.select("_part", "_least", (F.coalesce(first, F.lit(0)) + base).alias("_first"))
        return self._write(
            written.join(F.broadcast(before), "_part")
            .withColumn("qid", F.expr("_first + _place - _least")).select(columns),
            f"{label}-queries",
        )

    def _finish(
        self, emitted: DataFrame, described: DataFrame, columns: list[str], label: str
    ) -> Level:
        """Write the queries of a level and, if any can grow, their matches."""
        meta = self._numbered(described, columns, label)
        flags = self._flags(meta)
        size = meta.join(flags, "qid").agg(
            F.count(F.lit(1)), F.max(F.size("var_attr")),
            F.sum((F.col("can_s") | F.col("can_i")).cast("int")),
        ).first()
        n_queries, n_known = size[0], size[1] or 0
        if not size[2]:
            return Level(meta, n_queries, n_known, None)
        alive = flags.filter("can_s OR can_i").join(
            meta.selectExpr("qid", "parent AS _parent", "sym"), "qid"
        ).selectExpr("_parent", "sym", "qid AS _new")
        grown = _join_small(
            emitted.withColumnRenamed("qid", "_parent"), alive, ["_parent", "sym"], n_queries
        ).selectExpr(
            "_new AS qid", "stream_id",
            f"IF((sym div 2) % 3 = {NEW}, concat(b, array(bc)), b) AS b", "p0", "pre", "pos AS p",
        )
        return Level(meta, n_queries, n_known, self._write(grown, f"{label}-state"))

    # -- runs --------------------------------------------------------------

    def _rows(self, attr: int | None) -> DataFrame:
        if attr is None:
            return self.index.rows
        return self.index.rows.filter(
            f"pre = {self.index.empty_item_set} AND bc % {self.n_attrs} = {attr}"
        )

    def run(
        self, use_values: bool = True, use_variables: bool = True, attr: int | None = None,
    ) -> Run:
        """Grow from the empty query, optionally with one kind of symbols or one attribute."""
        rows = self._rows(attr)
        if not use_variables:
            rows = rows.filter(F.col("vid").isNotNull())
        state, meta = self._root()
        n_queries, n_known = 1, 0
        run = Run()
        limit = self.max_terms * (1 if attr is not None else self.n_attrs)
        while state is not None and n_queries and len(run.levels) < limit:
            flags = self._flags(meta, within_terms=attr is None)
            emitted, path = self._carried(self._emit(
                state, flags, n_queries, n_known, rows,
                use_values and self.use_values, use_variables and self.use_variables,
            ))
            described = self._describe(self._candidates(emitted), meta, n_queries)
            level = self._finish(emitted, described, META, f"level{len(run.levels) + 1}")
            delete_steps(self.sdb.sparkSession, [path])
            run.levels.append(level)
            state, meta = level.state, level.meta
            n_queries, n_known = level.n_queries, level.n_known
        return run

    def merge(self, parts: list[list[Run]], attr: int | None = None) -> Run:
        """Grow the queries that mix several classes of symbols.

        ``parts[c]`` are the runs whose queries use class c only: values and
        variables, or the single attributes.  A mixed query grows out of the
        longest pure query it starts with.  A symbol of class c is
        only tried if the part of the query that belongs to class c, grown by
        that symbol, is itself supported: that is looked up in the queries of
        ``parts[c]``, so pure parts are never matched again.
        """
        n_classes = len(parts)
        extra = ["own", "nodes", "in_last", "var_class"]
        trees, pures = [], []
        for c, runs in enumerate(parts):
            all_meta = [m for r in runs for m in r.meta()]
            trees.append(_union(all_meta).select(
                F.lit(c).alias("c"), F.col("parent").alias("node"), F.col("sym").alias("tsym"),
                F.col("qid").alias("child"), F.col("last_attr").alias("tattr"),
            ))
            pures.append(max(len(r.levels) for r in runs))
        tree = _union(trees)
        n_tree = sum(level.n_queries for runs in parts for r in runs for level in r.levels)
        empty = Level(self._root()[1].limit(0), 0, 0, None)
        run, mixed = Run([empty]), None
        rows = self._rows(attr)
        for depth in range(1, self.max_terms * (self.n_attrs if attr is None else 1)):
            metas, states, n_meta, n_known = [], [], 0, 0
            for c, runs in enumerate(parts):
                for r in runs:
                    if depth <= len(r.levels) and r.levels[depth - 1].state is not None:
                        level = r.levels[depth - 1]
                        nodes = ", ".join("qid" if i == c else "0L" for i in range(n_classes))
                        in_last = ", ".join(str(i == c).lower() for i in range(n_classes))
                        metas.append(level.meta.selectExpr(
                            *META, f"{c} AS own", f"array({nodes}) AS nodes",
                            f"array({in_last}) AS in_last",
                            f"array_repeat({c}, size(var_attr)) AS var_class",
                        ))
                        states.append(level.state)
                        n_meta += level.n_queries
                        n_known = max(n_known, level.n_known)
            if mixed is not None and mixed.state is not None:
                metas.append(mixed.meta.select(*META, *extra))
                states.append(mixed.state)
                n_meta += mixed.n_queries
                n_known = max(n_known, mixed.n_known)
            if not metas:
                # nothing of this size can grow; larger pure queries may still exist
                mixed = None
                if depth >= max(pures):
                    break
                run.levels.append(empty)
                continue
            meta, state = _union(metas), _union(states).select(*STATE)
            allowed = self._write(self._allowed(meta, tree, n_tree), "allowed")
            n_allowed = allowed.count()
            emitted, path = self._carried(_join_small(
                self._emit(state, self._flags(meta, attr is None), n_meta, n_known, rows),
                allowed.select("qid", "sym"), ["qid", "sym"], n_allowed, "left_semi",
            ))
            candidates = _join_small(self._candidates(emitted), allowed, ["qid", "sym"], n_allowed)
            described = self._describe(candidates, meta, n_meta)
            described = described.withColumns({
                "nodes": F.expr("transform(nodes, (v, i) -> IF(i = c, child, v))"),
                "in_last": F.expr("transform(in_last, (v, i) -> i = c OR (sym % 2 = 1 AND v))"),
                "var_class": F.expr(
                    f"IF((sym div 2) % 3 = {NEW}, concat(var_class, array(c)), var_class)"
                ),
                "own": F.lit(-1),
            })
            mixed = self._finish(emitted, described, META + extra, f"mixed{depth + 1}")
            delete_steps(self.sdb.sparkSession, [path])
            run.levels.append(mixed)
        return Run([
            Level(v.meta.select(*META), v.n_queries, v.n_known, v.state) for v in run.levels
        ])

    def _allowed(self, meta: DataFrame, tree: DataFrame, n_tree: int) -> DataFrame:
        """``qid, sym, c, child``: symbols whose class part is a known supported query."""
        nodes = meta.selectExpr(
            "qid", "last_attr", "own", "in_last", "var_class", "posexplode(nodes) AS (c, node)"
        ).filter("c <> own")
        found = _join_small(nodes, tree, ["c", "node"], n_tree).selectExpr(
            "qid", "c", "child", "tattr", "last_attr", "get(in_last, c) AS has",
            "tsym % 2 AS tmode", "(tsym div 2) % 3 AS kind", "tsym div 6 AS targ",
            # places of the variables of class c among all variables
            "filter(transform(var_class, (v, i) -> IF(v = c, i, -1)), i -> i >= 0) AS own_vars",
        )
        # in the pure part a term begins here if the last term had nothing of its class
        return found.selectExpr(
            "qid", "c", "child", "kind",
            f"IF(kind = {KNOWN}, get(own_vars, CAST(targ AS INT)), targ) AS arg",
            """explode(array(
                IF(tmode = 0, 0, NULL),
                IF((tmode = 1) = has AND tattr > last_attr, 1, NULL)
            )) AS mode""",
        ).filter("mode IS NOT NULL").selectExpr(
            "qid", f"{_code('arg', 'kind', 'mode')} AS sym", "c", "child"
        )
