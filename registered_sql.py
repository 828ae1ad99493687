"""The same results as ``registered_queries``, as DuckDB SQL over the same tables."""

from __future__ import annotations

from itertools import combinations, product

BUCKET = "CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR)"

EV = f"""ev_all AS (
  SELECT user_id AS stream_id, event_type AS a0, {BUCKET} AS a1, value, ts, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS plc
  FROM events),
ev AS (SELECT stream_id, CAST(plc AS INT) AS pos, a0, a1, value FROM ev_all)"""

# the conversations under the name of the streams, for the discovery of longer queries
TALKS = """ev AS (
  SELECT conv_id AS stream_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos,
         role AS a0, CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END AS a1
  FROM conversations)"""

ORD = """ord AS (
  SELECT o_custkey AS stream_id, o_orderstatus AS a0, o_orderpriority AS a1,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS pos
  FROM orders)"""


def cells(name: str) -> str:
    return f"""cells AS (
  SELECT stream_id, pos, 0 AS attr, a0 AS val FROM {name} WHERE a0 IS NOT NULL
  UNION ALL SELECT stream_id, pos, 1, a1 FROM {name} WHERE a1 IS NOT NULL)"""


def ev(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([EV, *ctes]) + "\n" + sql


def with_talks(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([TALKS, *ctes]) + "\n" + sql


def od(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([ORD, *ctes]) + "\n" + sql


def needed(supp: float, name: str = "ev") -> str:
    return f"(SELECT ceil(round(count(DISTINCT stream_id) * {supp}, 9)) FROM {name})"


# -- queries derived from the streams ---------------------------------------

DERIVED = """dt AS (
  SELECT stream_id AS query_id, pos AS term, CAST(ascii(a0) % 7 + 20 AS VARCHAR) AS var,
         CASE WHEN pos % 2 = 0 THEN a1 ELSE '' END AS val
  FROM ev),
dv AS (SELECT *, count(*) OVER (PARTITION BY query_id, var) AS n_var FROM dt)"""

PAIRS = """pq AS (
  SELECT stream_id AS query_id, arg_min(a0, pos) AS a, arg_max(a0, pos) AS b
  FROM ev GROUP BY stream_id)"""

# All priorities of a customer as a query, values numbered, and the same with the first priority as variable x,
# which goes if it occurs once. Streams as text, so that a query without variables is a LIKE pattern.
WHOLE = """vals AS (
  SELECT a1 AS val, CAST(row_number() OVER (ORDER BY a1) AS VARCHAR) AS c
  FROM (SELECT DISTINCT a1 FROM ord WHERE a1 IS NOT NULL)),
coded AS (
  SELECT stream_id, pos, c, CASE WHEN a1 = first_value(a1) OVER (PARTITION BY stream_id ORDER BY pos) THEN 'x' ELSE c END AS x
  FROM ord LEFT JOIN vals ON a1 = val),
whole AS (
  SELECT stream_id, coalesce(list(c ORDER BY pos) FILTER (WHERE c IS NOT NULL), []) AS c,
         coalesce(list(x ORDER BY pos) FILTER (WHERE x IS NOT NULL), []) AS x
  FROM coded GROUP BY stream_id),
given AS (
  SELECT 2 * stream_id AS query_id, c AS q FROM whole
  UNION ALL
  SELECT 2 * stream_id + 1, CASE WHEN len(list_filter(x, lambda s: s = 'x')) = 1 THEN list_filter(x, lambda s: s <> 'x') ELSE x END
  FROM whole),
texts AS (SELECT coalesce('|' || array_to_string(c, '||') || '|', '') AS t, count(*) AS n FROM whole GROUP BY ALL)"""


def counted(name: str, queries: str) -> str:
    """CTE ``name``: q, n_streams of each of ``queries``: streams that match it under some values of x and y."""
    return f"""{name} AS (
  SELECT q, CAST(sum(n) AS BIGINT) AS n_streams FROM (
    SELECT DISTINCT q, t, n FROM (
      SELECT DISTINCT q, '%' || array_to_string(list_transform(q, lambda s:
        '|' || CASE s WHEN 'x' THEN v.c WHEN 'y' THEN w.c ELSE s END || '|'), '%') || '%' AS p
      FROM (SELECT DISTINCT q FROM ({queries})), vals v, vals w) JOIN texts ON t LIKE p)
  GROUP BY q)"""


# What is one step stricter than a supported query of WHOLE, of whatever length: a variable gets a value; a term is
# added, of a value or the variable; two terms of a new variable are. A query below any stricter supported one is
# below such a step, which is supported too, so the strictest queries are those without a supported step.
STEPS = """steps AS (
  SELECT q, list_transform(q, lambda s: CASE s WHEN 'x' THEN vals.c ELSE s END) AS m FROM supp, vals WHERE list_contains(q, 'x')
  UNION ALL
  SELECT q, q[1:i] || [s] || q[i + 1:] FROM supp, unnest(range(0, len(q) + 1)) g(i), (SELECT c FROM vals UNION ALL SELECT 'x') o(s)
  WHERE s <> 'x' OR list_contains(q, 'x')
  UNION ALL
  SELECT q, q[1:i] || ['y'] || q[i + 1:j] || ['y'] || q[j + 1:]
  FROM supp, unnest(range(0, len(q) + 1)) g(i), unnest(range(0, len(q) + 1)) h(j) WHERE i <= j)"""

# -- matching ---------------------------------------------------------------

TYPE_MATCHES = """
  SELECT 1 AS query_id, stream_id, '' AS b, pos AS p FROM ev WHERE a0 = 'click'
  UNION ALL
  SELECT 2, a.stream_id, '', b.pos FROM ev a JOIN ev b ON a.stream_id = b.stream_id AND a.pos < b.pos
  WHERE a.a0 = 'click' AND b.a0 = 'error'
  UNION ALL
  SELECT 3, a.stream_id, '', b.pos FROM ev a JOIN ev b ON a.stream_id = b.stream_id AND a.pos < b.pos
  WHERE a.a0 = 'click' AND a.a1 = '0' AND b.a0 = 'view'"""

THREE = """ev a JOIN ev b ON a.stream_id = b.stream_id AND a.pos < b.pos
  JOIN ev c ON b.stream_id = c.stream_id AND b.pos < c.pos"""
TWO = "ev a JOIN ev b ON a.stream_id = b.stream_id AND a.pos < b.pos"


def mixed_matches(first: int = 1) -> str:
    return f"""
  SELECT {first} AS query_id, a.stream_id, a.a0 AS b, c.pos AS p, a.pos AS p1, b.pos AS p2, c.pos AS p3
  FROM {THREE} WHERE a.a0 = b.a0 AND b.a0 = c.a0
  UNION ALL
  SELECT {first + 1}, a.stream_id, b.a0, c.pos, a.pos, b.pos, c.pos
  FROM {THREE} WHERE a.a0 = 'click' AND b.a0 = c.a0
  UNION ALL
  SELECT {first + 2}, a.stream_id, a.a1, c.pos, a.pos, b.pos, c.pos
  FROM {THREE} WHERE a.a1 = c.a1 AND b.a0 = 'error'
  UNION ALL
  SELECT {first + 3}, a.stream_id, a.a0 || ',' || a.a1, b.pos, a.pos, b.pos, NULL
  FROM {TWO} WHERE a.a0 = b.a0 AND a.a1 = b.a1"""


LAST_EVENTS = "l AS (SELECT stream_id, max(pos) AS last FROM ev GROUP BY stream_id)"
FIRST_OF_TWO = """SELECT query_id, stream_id, p, p1 || ',' || p AS positions, b FROM m
  QUALIFY row_number() OVER (PARTITION BY query_id, stream_id ORDER BY p, p1, b) = 1"""
EARLIEST = "SELECT query_id, stream_id, b, min(p) AS p FROM m GROUP BY query_id, stream_id, b"


def before_end(n: int) -> str:
    return f"""SELECT m.query_id || ':' || m.stream_id || ':' || m.p AS stream_id,
      CAST(e.pos - greatest(m.p - {n}, 0) AS INT) AS pos, e.a0, e.a1
      FROM m JOIN ev e ON e.stream_id = m.stream_id AND e.pos >= m.p - {n} AND e.pos < m.p"""


def support(n_queries: int) -> str:
    return f"""
  SELECT CAST(q.query_id AS BIGINT) AS query_id, count(DISTINCT m.stream_id) AS n_streams,
         count(DISTINCT m.stream_id) / (SELECT count(DISTINCT stream_id) FROM s)::DOUBLE AS support
  FROM range(1, {n_queries + 1}) q(query_id) LEFT JOIN m ON m.query_id = q.query_id
  GROUP BY q.query_id"""


ALL_MATCHES = f"""m AS (
  SELECT query_id, stream_id FROM ({TYPE_MATCHES})
  UNION ALL SELECT query_id, stream_id FROM ({mixed_matches(4)})),
s AS (SELECT stream_id FROM ev)"""

# -- discovery: every query shape of up to three terms ----------------------


def shapes(k: int) -> list[str]:
    """Per attribute and term: open (_), value (v), or the one variable (x, plc least twice)."""
    return [
        "".join(s) for s in product("_vx", repeat=k) if s.count("x") != 1
    ]


def found(n_attrs: int, max_terms: int, supp: float, where: str = "true") -> str:
    """CTE ``found``: qstr, symbols t<term>a<attr>, n_terms, kind, n_streams of supported queries."""
    parts = []
    columns = [f"t{t}a{a}" for t in range(max_terms) for a in range(n_attrs)]
    for k in range(1, max_terms + 1):
        joins = "ev e0" + "".join(
            f" JOIN ev e{t} ON e{t}.stream_id = e0.stream_id AND e{t}.pos > e{t - 1}.pos"
            for t in range(1, k)
        )
        options = "".join(
            f" JOIN (VALUES {', '.join(f'({chr(39)}{s}{chr(39)})' for s in shapes(k))}) o{a}(s) ON true"
            for a in range(n_attrs)
        )
        same = " AND ".join(
            f"(substr(o{a}.s, {i + 1}, 1) <> 'x' OR substr(o{a}.s, {j + 1}, 1) <> 'x' "
            f"OR e{i}.a{a} = e{j}.a{a})"
            for a in range(n_attrs) for i, j in combinations(range(k), 2)
        ) or "true"
        filled = " AND ".join(
            "(" + " OR ".join(f"substr(o{a}.s, {t + 1}, 1) <> '_'" for a in range(n_attrs)) + ")"
            for t in range(k)
        )

        def number(a: int) -> str:
            if a == 0 or n_attrs == 1:
                other = "1" if n_attrs > 1 else None
                if other is None:
                    return "'$x0'"
                return ("CASE WHEN instr(o1.s, 'x') > 0 AND instr(o1.s, 'x') < instr(o0.s, 'x') "
                        "THEN '$x1' ELSE '$x0' END")
            return ("CASE WHEN instr(o0.s, 'x') > 0 AND instr(o0.s, 'x') <= instr(o1.s, 'x') "
                    "THEN '$x1' ELSE '$x0' END")

        symbols = []
        for t in range(max_terms):
            for a in range(n_attrs):
                if t >= k:
                    symbols.append(f"NULL AS t{t}a{a}")
                else:
                    symbols.append(
                        f"CASE substr(o{a}.s, {t + 1}, 1) WHEN 'v' THEN e{t}.a{a} "
                        f"WHEN 'x' THEN {number(a)} ELSE '' END AS t{t}a{a}")
        any_v = " OR ".join(f"instr(o{a}.s, 'v') > 0" for a in range(n_attrs))
        any_x = " OR ".join(f"instr(o{a}.s, 'x') > 0" for a in range(n_attrs))
        parts.append(f"""
    SELECT e0.stream_id, {k} AS n_terms, {', '.join(symbols)},
           CASE WHEN ({any_v}) AND ({any_x}) THEN 'mixed' WHEN {any_v} THEN 'type' ELSE 'pattern' END AS kind
    FROM {joins}{options} WHERE {same} AND {filled}""")
    text = " || ".join(
        f"coalesce({'' if t == 0 else chr(39) + ' ' + chr(39) + ' || '}"
        + " || ".join(f"t{t}a{a} || ';'" for a in range(n_attrs)) + ", '')"
        for t in range(max_terms)
    )
    names = ", ".join(columns)
    return f"""raw AS ({' UNION ALL '.join(parts)}),
found AS (
  SELECT {text} AS qstr, {names}, n_terms, kind, count(DISTINCT stream_id) AS n_streams
  FROM raw WHERE {where} GROUP BY {names}, n_terms, kind
  HAVING count(DISTINCT stream_id) >= {needed(supp)})"""


def weaker(n_attrs: int, max_terms: int = 2) -> str:
    """Is w weaker than q: can its terms be placed, in order, on terms of q?"""
    ways = []
    for kw in range(1, max_terms + 1):
        for kq in range(kw, max_terms + 1):
            for place in combinations(range(kq), kw):
                holds = [f"w.n_terms = {kw}", f"q.n_terms = {kq}"]
                for a in range(n_attrs):
                    for t, f in enumerate(place):
                        mine, other = f"w.t{t}a{a}", f"q.t{f}a{a}"
                        holds.append(f"({mine} = '' OR ({mine} LIKE '$%' AND {other} <> '') "
                                     f"OR ({mine} NOT LIKE '$%' AND {mine} = {other}))")
                    # an attribute has one variable at most
                    holds += [
                        f"(w.t{t}a{a} NOT LIKE '$%' OR w.t{u}a{a} NOT LIKE '$%' "
                        f"OR q.t{place[t]}a{a} = q.t{place[u]}a{a})"
                        for t, u in combinations(range(kw), 2)
                    ]
                ways.append("(" + " AND ".join(holds) + ")")
    return f"(w.qstr <> q.qstr AND ({' OR '.join(ways)}))"


def discovered(n_attrs: int, flags: bool = True, only: bool = False, supp: float = 0.5,
               where: str = "true", max_terms: int = 2, streams: str = EV) -> str:
    strict = f"NOT EXISTS (SELECT 1 FROM found q WHERE {weaker(n_attrs, max_terms)})"
    more = (f", n_streams / (SELECT count(DISTINCT stream_id) FROM ev)::DOUBLE AS support, "
            f"{strict} AS descriptive") if flags else ""
    chosen = f"SELECT qstr, n_terms, kind, n_streams{more} FROM found w" + (f" WHERE {strict}" if only else "")
    return f"WITH {streams},\n{found(n_attrs, max_terms, supp, where)}\n{chosen}"


HAS_VALUE = " AND ".join(
    f"(t{t}a0 IS NULL OR t{t}a0 NOT IN ('', '$x0', '$x1') OR t{t}a1 NOT IN ('', '$x0', '$x1'))"
    for t in range(2)
)

EDGES = """edges AS (
  SELECT DISTINCT * FROM (
    SELECT qstr AS child, n_streams AS child_n_streams, unnest([t0a0 || ';', t1a0 || ';']) AS parent
    FROM found WHERE n_terms = 2 AND kind = 'type'
    UNION ALL
    SELECT qstr, n_streams, '$x0; $x0;' FROM found WHERE n_terms = 2 AND kind = 'type' AND t0a0 = t1a0))"""


def share(counts: str, n: str, by: str = "") -> str:
    return f"{n} / (sum({n}) OVER ({by}))::DOUBLE AS share FROM ({counts})"


def oracle_sql() -> dict[str, str]:
    disjoint = """sup AS (
  SELECT attr, val FROM cells GROUP BY attr, val
  HAVING count(DISTINCT stream_id) >= """ + needed(0.75) + """),
f AS (
  SELECT c.stream_id, c.pos * 2 + c.attr AS plc, s.val IS NOT NULL AS t,
         count(*) OVER (PARTITION BY c.stream_id, c.attr, c.val) >= 2 AS p
  FROM cells c LEFT JOIN sup s ON c.attr = s.attr AND c.val = s.val),
r AS (
  SELECT *, min(plc) FILTER (WHERE t) OVER w AS tf, max(plc) FILTER (WHERE t) OVER w AS tl,
         min(plc) FILTER (WHERE p) OVER w AS pf, max(plc) FILTER (WHERE p) OVER w AS pl
  FROM f WINDOW w AS (PARTITION BY stream_id)),
k AS (
  SELECT stream_id,
         count(*) FILTER (WHERE t AND plc < pf) AS t_before,
         count(*) FILTER (WHERE t AND plc BETWEEN pf AND pl) AS t_in,
         count(*) FILTER (WHERE t AND plc > pl) AS t_behind,
         count(*) FILTER (WHERE p AND plc < tf) AS p_before,
         count(*) FILTER (WHERE p AND plc BETWEEN tf AND tl) AS p_in,
         count(*) FILTER (WHERE p AND plc > tl) AS p_behind,
         count(*) FILTER (WHERE t) AS nt, count(*) FILTER (WHERE p) AS np
  FROM r GROUP BY stream_id),
d AS (
  SELECT stream_id, t_before, t_in, t_behind, p_before, p_in, p_behind,
         CASE WHEN np = 0 THEN 1.0::DOUBLE WHEN nt = 0 THEN -1.0::DOUBLE ELSE
           abs(t_in - nt / 2.0::DOUBLE) / (nt / 2.0::DOUBLE) * (abs(p_in - np / 2.0::DOUBLE) / (np / 2.0::DOUBLE))
           * ((t_before - t_behind) / nt::DOUBLE - (p_before - p_behind) / np::DOUBLE) / 2 END AS disjointness
  FROM k)"""
    grams = """g AS (
  SELECT CASE WHEN lead(a0) OVER w IS NOT NULL THEN
    a0 || ';' || replace(a1, ' ', '%20') || '; ' || lead(a0) OVER w || ';' || replace(lead(a1) OVER w, ' ', '%20') || ';'
    END AS gram
  FROM ord WINDOW w AS (PARTITION BY stream_id ORDER BY pos))"""
    one = found(1, 2, 0.5)
    ids = "SELECT DISTINCT stream_id FROM ord"
    before = """SELECT m.{id} AS stream_id, CAST(e.plc - greatest(m.plc - {n}, 0) AS INT) AS pos, {cols}
      FROM m JOIN ev_all e ON e.stream_id = m.stream_id AND e.plc >= m.plc - {n} AND e.plc < m.plc"""
    gap_matches = f"""m AS (
  SELECT 1 AS query_id, a.stream_id, '' AS b, b.pos AS p, a.pos AS p1 FROM {TWO}
  WHERE a.a0 = 'click' AND b.a0 = 'error' AND b.pos - a.pos - 1 BETWEEN 1 AND 3
  UNION ALL
  SELECT 2, a.stream_id, a.a0, b.pos, a.pos FROM {TWO} JOIN l ON l.stream_id = a.stream_id
  WHERE a.a0 = b.a0 AND a.pos BETWEEN 0 AND 9 AND b.pos - a.pos - 1 BETWEEN 0 AND 4
    AND l.last - b.pos BETWEEN 1 AND 30
  UNION ALL
  SELECT 3, a.stream_id, '', b.pos, a.pos FROM {TWO}
  WHERE a.a1 = '0' AND b.a1 = '1' AND b.pos - a.pos - 1 BETWEEN 0 AND 1)"""

    def clear(values: str) -> str:
        return (f"NOT EXISTS (SELECT 1 FROM ev x WHERE x.stream_id = a.stream_id AND x.pos > a.pos "
                f"AND x.pos < b.pos AND (x.a0 IN ({values}) OR x.a1 IN ({values})))")

    lengths = "SELECT stream_id, count(*) AS n_events FROM ord GROUP BY stream_id"
    at_least = f"n_streams >= {needed(0.5, 'ord')}"
    classify = f"""SELECT CAST(query_id AS BIGINT) AS query_id, n_streams,
      CASE WHEN NOT {at_least} THEN 'not_supported'
           WHEN len(q) > 0 AND q NOT IN (SELECT s.q FROM steps s JOIN stricter w ON w.q = s.m WHERE {at_least}) THEN 'descriptive'
           ELSE 'supported' END AS label
      FROM given JOIN counts USING (q)"""
    sql = {
        "read_traces": ev("SELECT pos, a0, a1, count(*) AS n, count(DISTINCT stream_id) AS n_streams FROM ev GROUP BY pos, a0, a1"),
        "write_read_streams": od("SELECT stream_id, pos, a0, a1 FROM ord"),
        "streams_from_table": od("SELECT stream_id, pos, a0, a1 FROM ord"),
        "streams_before_match": ev(
            before.format(id="id", n=5, cols="e.a0, e.a1"),
            "m AS (SELECT *, stream_id || ':' || plc AS id FROM ev_all WHERE a0 = 'error' AND value > 40 AND plc > 0)"),
        "streams_before_first_matches": ev(
            before.format(id="id", n=4, cols="e.a0"),
            """m AS (SELECT *, row_number() OVER (ORDER BY ts, event_id, stream_id) - 1 AS id FROM ev_all
              WHERE a0 = 'error' AND plc > 0 QUALIFY id < 200)"""),
        "streams_before_every_match": ev(
            before.format(id="id", n=3, cols="e.a0"),
            "m AS (SELECT *, stream_id || ':' || plc AS id FROM ev_all WHERE a0 = 'purchase' AND plc > 0)"),
        "streams_before_query_pair": ev(before_end(4), f"""m AS (
            SELECT DISTINCT 1 AS query_id, a.stream_id, b.pos AS p FROM {TWO}
            WHERE a.a0 = 'error' AND b.a0 = 'error' AND b.pos - a.pos - 1 BETWEEN 0 AND 2
            UNION SELECT 2, a.stream_id, c.pos FROM {THREE}
            WHERE a.a0 = c.a0 AND b.a0 = 'signup' AND b.pos - a.pos - 1 <= 1 AND c.pos - b.pos - 1 <= 1)"""),
        "streams_before_query_span": ev(before_end(3), f"""m AS (
            SELECT DISTINCT 1 AS query_id, a.stream_id, c.pos AS p FROM {THREE}
            WHERE a.a0 = 'click' AND b.a0 = 'error' AND c.a0 = 'view' AND c.pos - a.pos + 1 <= 5)"""),
        "keep_last": od("""SELECT stream_id, CAST(pos - greatest(n - 4, 0) AS INT) AS pos, a0, a1 FROM (
            SELECT *, count(*) OVER (PARTITION BY stream_id) AS n FROM ord) WHERE pos >= n - 4"""),
        "drop_longer_than": od("""SELECT stream_id, pos, a0, a1 FROM ord
            QUALIFY count(*) OVER (PARTITION BY stream_id) <= 9"""),
        "require_values": od("""SELECT stream_id, pos, a0, a1 FROM ord QUALIFY
            bool_or(a0 = 'F') OVER (PARTITION BY stream_id) AND bool_or(a1 = '1-URGENT') OVER (PARTITION BY stream_id)
            AND bool_or(a1 = '5-LOW') OVER (PARTITION BY stream_id)"""),
        "limit_streams": od(f"SELECT stream_id, pos, a0, a1 FROM ord WHERE stream_id IN ({ids} ORDER BY stream_id LIMIT 50)"),
        "project": od("SELECT stream_id, pos, a1 AS a0 FROM ord"),
        "split_attributes": ev("SELECT stream_id, pos, attr, val FROM cells", cells("ev")),
        "uniquify_frequent": od(
            """SELECT o.stream_id, o.pos, coalesce(f0.val || ',' || f0.i, a0) AS a0, coalesce(f1.val || ',' || f1.i, a1) AS a1
            FROM ord o LEFT JOIN f f0 ON f0.attr = 0 AND f0.stream_id = o.stream_id AND f0.pos = o.pos
            LEFT JOIN f f1 ON f1.attr = 1 AND f1.stream_id = o.stream_id AND f1.pos = o.pos""",
            cells("ord"),
            "n AS (SELECT attr, val, count(*) AS n FROM cells GROUP BY attr, val)",
            "h AS (SELECT attr, val FROM n QUALIFY n > avg(n) OVER (PARTITION BY attr) + stddev_pop(n) OVER (PARTITION BY attr))",
            """f AS (SELECT c.*, row_number() OVER (PARTITION BY c.attr, c.val ORDER BY stream_id, pos) - 1 AS i
              FROM cells c JOIN h ON h.attr = c.attr AND h.val = c.val)"""),
        "uniquify_by_position": ev(
            """SELECT stream_id, pos, a0, CASE WHEN a1 IN (SELECT val FROM n WHERE n > (SELECT avg(n) + stddev_pop(n) FROM n))
               THEN a1 || ',' || stream_id || ':' || pos ELSE a1 END AS a1 FROM ev""",
            "n AS (SELECT a1 AS val, count(*) AS n FROM ev GROUP BY a1)"),
        "mask_values": od("SELECT stream_id, pos, a0, CASE WHEN a1 NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN a1 END AS a1 FROM ord"),
        "mask_top_values": od("""SELECT stream_id, pos, a0, CASE WHEN a1 NOT IN (
            SELECT a1 FROM ord GROUP BY a1 ORDER BY count(*) DESC, a1 LIMIT 2) THEN a1 END AS a1 FROM ord"""),
        "bin_values": ev("""SELECT stream_id, pos, a0, CAST((value > c[1])::INT + (value > c[2])::INT + (value > c[3])::INT AS VARCHAR) AS a1
            FROM ev, (SELECT quantile_disc(value, [0.25, 0.5, 0.75]) AS c FROM ev)"""),
        "bin_values_exact": ev("SELECT stream_id, pos, a0, CAST(ntile(10) OVER (ORDER BY value, stream_id, pos) - 1 AS VARCHAR) AS a1 FROM ev"),
        "map_values": od("""SELECT stream_id, pos, a0, CASE a1 WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high'
            WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE a1 END AS a1 FROM ord"""),
        "explode_attribute": od("""SELECT stream_id, pos, CASE WHEN a0 = 'F' THEN a0 END AS a0, CASE WHEN a0 = 'O' THEN a0 END AS a1,
            CASE WHEN a0 = 'P' THEN a0 END AS a2, a1 AS a3 FROM ord"""),
        "stream_lengths": od("""SELECT count(*) AS n_streams, CAST(sum(n_events) AS BIGINT) AS n_events, min(n_events) AS min_length,
            arg_min(stream_id, (n_events, stream_id)) AS min_stream, max(n_events) AS max_length,
            arg_min(stream_id, (-n_events, stream_id)) AS max_stream, avg(n_events) AS mean_length FROM l""", f"l AS ({lengths})"),
        "length_distribution": od("SELECT n_events, n_streams, " + share(
            "SELECT n_events, count(*) AS n_streams FROM l GROUP BY n_events", "n_streams"), f"l AS ({lengths})"),
        "alphabet": od("SELECT DISTINCT attr, val FROM cells", cells("ord")),
        "alphabet_global": ev("SELECT DISTINCT val FROM cells", cells("ev")),
        "supported_alphabet": ev(f"""SELECT attr, val, count(DISTINCT stream_id) AS n_streams FROM cells GROUP BY attr, val
            HAVING count(DISTINCT stream_id) >= {needed(0.5)}""", cells("ev")),
        "vertical_index": ev("""SELECT stream_id, attr, val, 0 AS block, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions
            FROM cells GROUP BY stream_id, attr, val""", cells("ev")),
        "value_distribution": od("SELECT attr, val, n, " + share(
            "SELECT attr, val, count(*) AS n FROM cells GROUP BY attr, val", "n", "PARTITION BY attr"), cells("ord")),
        "ngrams_of_events": od("SELECT gram, n, " + share(
            "SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram", "n"), grams),
        "ngrams_of_values": ev("SELECT gram, n, " + share(
            "SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram", "n"), cells("ev"),
            """g AS (SELECT val || '; ' || lead(val) OVER w || '; ' || lead(val, 2) OVER w || ';' AS gram FROM cells
              WINDOW w AS (PARTITION BY stream_id ORDER BY pos, attr))"""),
        "repeated_values": ev("SELECT stream_id, attr, val, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) >= 2", cells("ev")),
        "database_profile": ev(
            """SELECT *, CASE WHEN rho_r > 2 * rho_s THEN 'by_attribute' WHEN n_supported > 20 THEN 'separated' ELSE 'unified' END AS strategy
            FROM (SELECT count(*) AS n_streams, 2 AS n_attrs, (SELECT count(*) FROM sup) AS n_supported,
                    CAST(max(s) AS BIGINT) AS rho_s, CAST(min(r) AS BIGINT) AS rho_r FROM p)""",
            cells("ev"),
            f"sup AS (SELECT attr, val FROM cells GROUP BY attr, val HAVING count(DISTINCT stream_id) >= {needed(0.5)})",
            """v AS (SELECT stream_id, attr, val, count(*) AS n FROM cells GROUP BY ALL)""",
            """p AS (SELECT stream_id, sum(CASE WHEN s.val IS NULL THEN 0 ELSE n END) AS s, sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS r
              FROM v LEFT JOIN sup s ON s.attr = v.attr AND s.val = v.val GROUP BY stream_id)"""),
        "type_pattern_disjointness": ev("SELECT * FROM d", cells("ev"), disjoint),
        "disjointness_score": ev("SELECT (max(disjointness) - min(disjointness)) / 2 AS score FROM d", cells("ev"), disjoint),
        "value_presence": od("""SELECT attr, val, count(*) AS n_streams, CAST(sum(n) AS BIGINT) AS n, max(n) AS max_in_stream,
            count(*) = (SELECT count(DISTINCT stream_id) FROM ord) AS in_all
            FROM (SELECT stream_id, attr, val, count(*) AS n FROM cells GROUP BY ALL) GROUP BY attr, val""", cells("ord")),
        "profile_report": od(
            f"""SELECT 'lengths' AS metric, key, value FROM (
              SELECT unnest(['n_streams', 'n_events', 'min_length', 'max_length', 'mean_length']) AS key,
                     unnest([count(*)::DOUBLE, sum(n_events)::DOUBLE, min(n_events)::DOUBLE, max(n_events)::DOUBLE, avg(n_events)]) AS value FROM l)
            UNION ALL SELECT 'length_distribution', n_events::VARCHAR, c / sum(c) OVER ()::DOUBLE FROM (SELECT n_events, count(*) AS c FROM l GROUP BY 1)
            UNION ALL SELECT 'alphabet_size', attr::VARCHAR, count(DISTINCT val)::DOUBLE FROM cells GROUP BY attr
            UNION ALL SELECT 'supported_value', attr || '=' || val, count(DISTINCT stream_id)::DOUBLE FROM cells GROUP BY attr, val
              HAVING count(DISTINCT stream_id) >= {needed(0.8, 'ord')}
            UNION ALL SELECT 'value_distribution', attr || '=' || val, c / sum(c) OVER (PARTITION BY attr)::DOUBLE
              FROM (SELECT attr, val, count(*) AS c FROM cells GROUP BY ALL)
            UNION ALL SELECT 'repeated_values', attr::VARCHAR, count(*)::DOUBLE
              FROM (SELECT stream_id, attr, val FROM cells GROUP BY ALL HAVING count(*) >= 2) GROUP BY attr
            UNION ALL SELECT 'ngram_2', gram, c / sum(c) OVER ()::DOUBLE FROM (SELECT gram, count(*) AS c FROM g WHERE gram IS NOT NULL GROUP BY 1)""",
            cells("ord"), f"l AS ({lengths})", grams),
        "queries_from_strings": ev("""SELECT query_id, term, 0 AS attr, 'var' AS kind, var AS val FROM dt
            UNION ALL SELECT query_id, term, 1, CASE WHEN val = '' THEN 'any' ELSE 'val' END, val FROM dt""", DERIVED),
        "to_strings": ev("SELECT query_id, string_agg('$x' || var || ';' || val || ';', ' ' ORDER BY term) AS qstr FROM dt GROUP BY query_id", DERIVED),
        "normal_form": ev(
            """SELECT query_id, coalesce(string_agg(CASE WHEN t <> ';;' THEN t END, ' ' ORDER BY term), '') AS qstr FROM (
              SELECT query_id, term, coalesce('$x' || i, '') || ';' || val || ';' AS t FROM x) GROUP BY query_id""",
            DERIVED,
            "fst AS (SELECT *, CASE WHEN n_var > 1 THEN min(term) OVER (PARTITION BY query_id, var) END AS first FROM dv)",
            "x AS (SELECT *, CASE WHEN first IS NOT NULL THEN dense_rank() OVER (PARTITION BY query_id ORDER BY first NULLS LAST) - 1 END AS i FROM fst)"),
        "describe_queries": ev("""SELECT query_id, CAST(count(*) AS INT) AS n_terms, 2 AS n_attrs, count(*) FILTER (WHERE val <> '') AS n_values,
            count(DISTINCT val) FILTER (WHERE val <> '') AS n_distinct_values, count(DISTINCT var) AS n_variables,
            count(DISTINCT var) FILTER (WHERE n_var > 1) AS n_repeated_variables, 'mixed' AS kind FROM dv GROUP BY query_id""", DERIVED),
        "validate_queries": ev("""SELECT query_id, concat_ws(',', CASE WHEN query_id % 3 > query_id % 5 THEN 'gap_bounds' END,
            CASE WHEN query_id % 3 > 0 AND min(n_var) < 2 THEN 'gap_lower_bound_needs_normal_form' END,
            CASE WHEN query_id % 97 < count(*) THEN 'span_shorter_than_query' END,
            CASE WHEN min(n_var) < 2 THEN 'span_and_normal_form' END) AS errors FROM dv GROUP BY query_id""", DERIVED),
        "dedupe_queries": ev("SELECT min(query_id) AS query_id, a || '; ' || b || ';' AS qstr FROM pq GROUP BY a, b", PAIRS),
        "generalisations": ev("""SELECT DISTINCT query_id, unnest([a || ';', b || ';'] || CASE WHEN a = b THEN ['$x0; $x0;'] ELSE [] END) AS qstr FROM pq""", PAIRS),
        "weaker_than": ev(f"SELECT w.qstr AS weaker, q.qstr AS stricter FROM found w JOIN found q ON {weaker(1)}", one),
        "match_types": ev("SELECT query_id, stream_id, min(p) AS p FROM m GROUP BY query_id, stream_id", f"m AS ({TYPE_MATCHES})"),
        "match": ev(EARLIEST, f"m AS ({mixed_matches()})"),
        "support": ev(support(7), ALL_MATCHES),
        "supported": ev(f"SELECT * FROM ({support(7)}) WHERE n_streams >= {needed(0.5)}", ALL_MATCHES),
        "matched_streams": ev("SELECT DISTINCT query_id, stream_id FROM m", f"m AS ({mixed_matches()})"),
        "match_with_gaps": ev(EARLIEST, LAST_EVENTS, gap_matches),
        "match_with_forbidden_values": ev(EARLIEST, f"""m AS (
            SELECT 1 AS query_id, a.stream_id, '' AS b, b.pos AS p FROM {TWO}
            WHERE a.a0 = 'click' AND b.a0 = 'error' AND {clear("'view', 'signup'")}
            UNION ALL SELECT 2, a.stream_id, a.a0, b.pos FROM {TWO} WHERE a.a0 = b.a0 AND {clear("'error'")})"""),
        "match_with_span": ev(EARLIEST, f"""m AS (
            SELECT 1 AS query_id, a.stream_id, '' AS b, b.pos AS p FROM {TWO}
            WHERE a.a0 = 'click' AND b.a0 = 'error' AND b.pos - a.pos + 1 <= 3
            UNION ALL SELECT 2, a.stream_id, a.a0, c.pos FROM {THREE}
            WHERE a.a0 = c.a0 AND b.a0 = 'view' AND c.pos - a.pos + 1 <= 5)"""),
        "witness": ev("""SELECT query_id, stream_id, p, p1 || ',' || p2 || ',' || p3 AS positions, b FROM m WHERE query_id < 4
            QUALIFY row_number() OVER (PARTITION BY query_id, stream_id ORDER BY p, p1, p2, p3, b) = 1""", f"m AS ({mixed_matches()})"),
        "instances": ev("SELECT query_id, stream_id, p1 || ',' || p2 || ',' || p3 AS positions, b FROM m WHERE query_id < 4", f"m AS ({mixed_matches()})"),
        "count_instances": ev("SELECT query_id, stream_id, count(*) AS n_instances FROM m WHERE query_id < 4 GROUP BY ALL", f"m AS ({mixed_matches()})"),
        "witness_with_gaps": ev(FIRST_OF_TWO, LAST_EVENTS, gap_matches),
        "match_types_with_gaps": ev(
            "SELECT CASE query_id WHEN 3 THEN 2 ELSE 1 END AS query_id, stream_id, min(p) AS p FROM m WHERE query_id <> 2 GROUP BY ALL",
            LAST_EVENTS, gap_matches),
        "witness_with_forbidden_values": ev(FIRST_OF_TWO, f"""m AS (
            SELECT 1 AS query_id, a.stream_id, '' AS b, b.pos AS p, a.pos AS p1 FROM {TWO}
            WHERE a.a0 = 'click' AND b.a0 = 'error' AND {clear("'view', 'signup'")}
            UNION ALL SELECT 2, a.stream_id, a.a0, b.pos, a.pos FROM {TWO} WHERE a.a0 = b.a0 AND {clear("'error'")})"""),
        "instances_with_span": ev(f"""SELECT 1 AS query_id, a.stream_id, '' AS b, a.pos || ',' || b.pos AS positions FROM {TWO}
            WHERE a.a0 = 'click' AND b.a0 = 'error' AND b.pos - a.pos + 1 <= 3
            UNION ALL SELECT 2, a.stream_id, a.a0, a.pos || ',' || b.pos || ',' || c.pos FROM {THREE}
            WHERE a.a0 = c.a0 AND b.a0 = 'view' AND c.pos - a.pos + 1 <= 5"""),
        "support_of_empty_query": ev(support(3), f"""m AS (
            SELECT q.query_id, stream_id FROM ev, (VALUES (1), (2)) q(query_id)
            UNION ALL SELECT 3, a.stream_id FROM {TWO} WHERE a.a0 = 'click' AND b.a0 = 'error'),
            s AS (SELECT stream_id FROM ev)"""),
        "update_support": ev(support(4), f"m AS (SELECT * FROM ({mixed_matches()}) WHERE stream_id % 3 <> 1)",
                             "s AS (SELECT stream_id FROM ev WHERE stream_id % 3 <> 1)"),
        "supported_with_term_bound": ev(f"SELECT * FROM ({support(7)}) WHERE n_streams >= {needed(0.2)} AND query_id NOT IN (4, 5, 6)", ALL_MATCHES),
        "classify_queries": od(
            classify, WHOLE, counted("counts", "SELECT q FROM given"),
            f"supp AS (SELECT q FROM counts WHERE {at_least})", STEPS, counted("stricter", "SELECT m AS q FROM steps")),
        "discover_types": ev("SELECT qstr, n_terms, kind, n_streams FROM found", found(2, 2, 0.5, "kind = 'type'")),
        "discover_types_prefix_span": ev("SELECT qstr, n_terms, kind, n_streams FROM found", found(1, 2, 0.5, "kind = 'type'")),
        "discover_patterns": ev("SELECT qstr, n_terms, kind, n_streams FROM found", found(2, 2, 0.2, "kind = 'pattern'")),
        "discover_one_attribute": discovered(1),
        "supported_queries": discovered(1, flags=False),
        "descriptive": discovered(1, flags=False, only=True),
        "descriptive_by_generalisation": discovered(1, flags=False, only=True),
        "discover_three_terms": discovered(2, flags=False, only=True, supp=0.75, max_terms=3, streams=TALKS),
        "discover_three_terms_supported": with_talks("SELECT qstr, n_terms, kind, n_streams FROM found", found(2, 3, 0.75)),
        "query_lattice": ev("""SELECT e.child, e.parent, e.child_n_streams, f.n_streams AS parent_n_streams,
            NOT EXISTS (SELECT 1 FROM edges o WHERE o.parent = e.child) AS child_descriptive
            FROM edges e LEFT JOIN found f ON f.qstr = e.parent""", one, EDGES),
        "query_lattice_frequent": ev("""SELECT e.child, e.parent, e.child_n_streams, f.n_streams AS parent_n_streams,
            NOT EXISTS (SELECT 1 FROM edges o WHERE o.parent = e.child) AS child_descriptive
            FROM edges e JOIN found f ON f.qstr = e.parent""", one, EDGES),
        "discover_by_templates": discovered(2, flags=False, only=True),
        "discover_by_templates_three_terms": discovered(2, flags=False, only=True, supp=0.75, max_terms=3, streams=TALKS),
        "discover_by_templates_lossy": discovered(2, flags=False, only=True, where=HAS_VALUE),
        "compare_query_sets": ev("""SELECT tp AS true_positives, fp AS false_positives, mi AS misses,
            CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + mi > 0 THEN tp / (tp + mi)::DOUBLE END AS recall,
            CASE WHEN 2 * tp + fp + mi > 0 THEN 2 * tp / (2 * tp + fp + mi)::DOUBLE END AS f_score FROM (
            SELECT count(*) FILTER (WHERE n_streams >= """ + needed(0.6) + """) AS tp, 0::BIGINT AS fp,
                   count(*) FILTER (WHERE n_streams < """ + needed(0.6) + """) AS mi FROM found)""", found(1, 2, 0.4)),
    }
    for name in ("discover_unified", "discover_separated", "discover_by_attribute",
                 "discover_by_attribute_separated"):
        sql[name] = discovered(2)
    return sql
