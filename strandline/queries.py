"""Queries over the property graph derived from the tables of one folder, and their SQL.

Each query runs an operator over the whole graph. Numbers are rounded and lists joined, so that results compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import cycles, derive, impact, output
from strandline.operators import relational as rel
from strandline.operators import traversal as walk
from strandline.plans.tables import graph, oracle
from strandline.session import EDGE_KINDS, NODE_KINDS, GraphSession

ALL = None
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(name: str, build: Callable[[GraphSession], DataFrame], sql: str | None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: build(graph(spark, sf_dir))
    if sql is not None:
        _SQL[name] = oracle(sql)


def _in(kinds) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


CALL_KINDS = _in(walk.edge_kind_policy())
CALLABLE = "('method', 'constructor')"
TYPES = "('class', 'interface', 'enum', 'annotation_type', 'aspect')"


def _closure(start: str, depth: int, steps: str, name: str = "walk") -> str:
    """CTEs steps(src, dst, kind, line), walk(id, depth), best: the least depth of each node but the start."""
    return f""", steps AS MATERIALIZED ({steps}),
{name} AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT s.dst, w.depth + 1 FROM {name} w JOIN steps s ON s.src = w.id WHERE w.depth < {depth}),
every AS (SELECT id, min(depth) AS depth FROM {name} GROUP BY id), best AS (SELECT * FROM every WHERE id <> '{start}'),
via AS (SELECT b.id, b.depth, s.kind, s.src AS via, s.line, row_number() OVER (PARTITION BY b.id ORDER BY s.kind, s.src) AS rn FROM best b JOIN steps s ON s.dst = b.id JOIN every p ON p.id = s.src AND p.depth = b.depth - 1)"""


def _steps(kinds: str, direction: str) -> str:
    out, back = "SELECT source AS src, target AS dst, kind, line FROM edges WHERE kind IN " + kinds, "SELECT target AS src, source AS dst, kind, line FROM edges WHERE kind IN " + kinds
    return {"out": out, "in": back}.get(direction) or f"{out} UNION ALL {back}"


# -- lookups
_register("get_node", lambda g: rel.get_node(g, "geo.NATION_7"), "SELECT id, kind, qualified_name, name, file_path, start_line + 1 AS start_line, end_line + 1 AS end_line FROM nodes WHERE id = 'geo.NATION_7' OR qualified_name = 'geo.NATION_7' ORDER BY id = 'geo.NATION_7' DESC, kind, id LIMIT 1")
_register("file_nodes", lambda g: rel.file_nodes(g, "/src/cust7.java"), "SELECT id, kind, qualified_name, name FROM nodes WHERE file_path = '/src/cust7.java'")
_register("find_entry_points", lambda g: rel.find_entry_points(g, None, ALL), "SELECT id, qualified_name, coalesce(entry_point_kind, 'unknown') AS entry_kind, file_path FROM nodes WHERE entry_point")
_register("index_status", rel.index_status, "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file_path) FROM nodes) AS files, CAST(NULL AS BIGINT) AS last_crawl")
_register("get_schema", rel.get_schema, "SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{k}')" for e, ks in (("node", NODE_KINDS), ("edge", EDGE_KINDS)) for k in ks) + ") v(element, kind)")
_register("graph_violations", lambda g: g.violations(), "SELECT 'dangling ' || side AS rule, id AS key FROM (SELECT 'source' AS side, source AS id FROM edges UNION ALL SELECT 'target', target FROM edges) e WHERE id NOT IN (SELECT id FROM nodes)")

# -- search
_RANK = "CASE WHEN lower(qualified_name) = '{q}' THEN 0 WHEN lower(id) = '{q}' THEN 1 WHEN lower(name) = '{q}' THEN 2 WHEN starts_with(lower(qualified_name), '{q}') THEN 3 WHEN starts_with(lower(id), '{q}') THEN 4 ELSE 5 END"
_TOKENS = "list_filter(string_split_regex(lower(concat_ws(' ', id, qualified_name, name)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_register("search_symbols", lambda g: rel.search_full_text(g, "customer order1", None, ALL).select("id", "rank"), f"SELECT id, {_RANK.format(q='customer order1')} AS rank FROM nodes WHERE len(list_filter({_TOKENS}, lambda t: starts_with(t, 'customer'))) > 0 AND len(list_filter({_TOKENS}, lambda t: starts_with(t, 'order1'))) > 0")
_register("search_symbols_substring", lambda g: rel.search_substring(g, "ier1", None, ALL).select("id", "rank"), f"SELECT id, {_RANK.format(q='ier1')} AS rank FROM nodes WHERE contains(lower(id), 'ier1') OR contains(lower(qualified_name), 'ier1')")
_register("suggest_symbols", lambda g: rel.suggest_symbols(g, "geo.customers#order12", None).select("id", "rank"), f"SELECT id, {_RANK.format(q='order12')} AS rank FROM nodes WHERE len(list_filter({_TOKENS}, lambda t: starts_with(t, 'order12'))) > 0")

# -- annotations, wiring
_register("find_annotated", lambda g: rel.find_annotated(g, "@BUILDING", None, ALL), "SELECT s.id, s.kind, s.qualified_name, e.target AS annotation, e.line, CAST(NULL AS VARCHAR) AS arguments FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes a ON a.id = e.target WHERE e.kind = 'ANNOTATED_WITH' AND a.kind = 'annotation' AND (a.id = '@BUILDING' OR a.qualified_name = 'BUILDING' OR suffix(a.qualified_name, '.BUILDING') OR lower(a.name) = 'building')")
_register("get_decorators", lambda g: rel.get_decorators(g, "customer:7", True), "SELECT source AS member, target AS annotation, line, CAST(NULL AS VARCHAR) AS arguments, CAST(NULL AS BOOLEAN) AS decorator FROM edges WHERE kind = 'ANNOTATED_WITH' AND (source = 'customer:7' OR source IN (SELECT target FROM edges JOIN nodes ON id = target WHERE edges.kind = 'CONTAINS' AND source = 'customer:7' AND nodes.kind IN ('method', 'constructor', 'field')))")
_WIRING = "SELECT e.source, s.qualified_name AS source_name, e.target, t.qualified_name AS target_name, e.line, e.confidence, e.channel, e.http_method, e.path FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind = '{}'"
for _name, _kind in (("find_injections", "INJECTS"), ("find_reflections", "REFLECTS"), ("find_routes", "ROUTES"), ("find_event_flows", "EMITS")):
    _register(_name, lambda g, k=_kind: rel.wiring_edges(g, k, None, ALL), _WIRING.format(_kind))
_register("wiring_edges", lambda g: rel.wiring_edges(g, "INJECTS", "ext:supplier3", ALL), _WIRING.format("INJECTS") + " AND (e.source = 'ext:supplier3' OR e.target = 'ext:supplier3')")
_register(
    "find_aspects",
    lambda g: rel.find_aspects(g, ALL),
    "SELECT a.id AS aspect, m.id AS advice, m.advice_kind, CAST(coalesce(x.n, 0) AS INT) AS n_targets, coalesce(x.t, '') AS targets FROM nodes a JOIN edges c ON c.source = a.id AND c.kind = 'CONTAINS' JOIN nodes m ON m.id = c.target "
    "LEFT JOIN (SELECT source, count(DISTINCT target) AS n, string_agg(DISTINCT target, ',' ORDER BY target) AS t FROM edges WHERE kind = 'ADVISES' GROUP BY source) x ON x.source = m.id WHERE a.kind = 'aspect' AND m.kind IN " + CALLABLE + " AND (m.advice_kind IS NOT NULL OR x.n IS NOT NULL)",
)

# -- traversal
_REF = "JOIN nodes n ON n.id = {} "
_register("get_callers_direct", lambda g: walk.get_callers_direct(g, "part:1", ALL), f"SELECT n.id, n.kind AS node_kind, n.qualified_name, e.kind AS edge_kind, e.line, e.resolved, e.confidence FROM edges e {_REF.format('e.source')} WHERE e.target = 'part:1' AND e.kind IN {CALL_KINDS}")
_register("get_callees_direct", lambda g: walk.get_callees_direct(g, "part:1", ALL), f"SELECT n.id, n.kind AS node_kind, n.qualified_name, e.kind AS edge_kind, e.line, e.resolved, e.confidence FROM edges e {_REF.format('e.target')} WHERE e.source = 'part:1' AND e.kind IN {CALL_KINDS}")
_VIA = "SELECT v.id, n.qualified_name, v.depth, v.kind AS edge_kind, v.via FROM via v JOIN nodes n ON n.id = v.id WHERE rn = 1"
_pick = lambda df: df.select("id", "qualified_name", "depth", "edge_kind", "via")
_register("get_callers", lambda g: _pick(walk.get_callers(g, "part:1", 2, ALL)), _closure("part:1", 2, _steps(CALL_KINDS, "in")) + _VIA)
_register("get_callees", lambda g: _pick(walk.get_callees(g, "part:1", 2, ALL)), _closure("part:1", 2, _steps(CALL_KINDS, "out")) + _VIA)
_register("get_callees_chain", lambda g: _pick(walk.get_callees(g, "order:10", 40, ALL)), _closure("order:10", 40, _steps(CALL_KINDS, "out")) + _VIA)
_register("trace_execution", lambda g: walk.trace_execution(g, "part:2", 2, ALL), _closure("part:2", 2, _steps("('CALLS', 'DYNAMIC_DISPATCH')", "out") + " UNION ALL SELECT target, source, 'INTERCEPT', line FROM edges WHERE kind = 'ADVISES'") + _VIA)
_SUB = _closure("customer:7", 2, _steps(_in(walk.SUBGRAPH_KINDS), "both"))
_register("get_subgraph", lambda g: walk.get_subgraph(g, "customer:7", 2, limit=ALL)[0], _SUB + "SELECT n.id, n.kind AS node_kind, n.qualified_name, n.file_path, e.depth FROM every e JOIN nodes n ON n.id = e.id")
_register("get_subgraph_edges", lambda g: walk.get_subgraph(g, "customer:7", 2, limit=ALL)[1], _SUB + f"SELECT source, target, kind, line FROM edges WHERE kind IN {_in(walk.SUBGRAPH_KINDS)} AND source IN (SELECT id FROM every) AND target IN (SELECT id FROM every)")
_register("find_implementations", lambda g: walk.find_implementations(g, "region:1", 10, ALL), _closure("region:1", 10, _steps("('EXTENDS', 'IMPLEMENTS')", "in")) + f"SELECT v.id, n.kind AS node_kind, n.qualified_name, v.depth, v.kind AS relation FROM via v JOIN nodes n ON n.id = v.id WHERE rn = 1 AND n.kind IN {TYPES}")
_register("enclosing_chain", walk.ancestors, ", up AS (SELECT source AS type, target AS ancestor, 1 AS depth FROM edges WHERE kind IN ('EXTENDS', 'IMPLEMENTS') UNION SELECT u.type, e.target, u.depth + 1 FROM up u JOIN edges e ON e.source = u.ancestor AND e.kind IN ('EXTENDS', 'IMPLEMENTS') WHERE u.depth < 10) SELECT type, ancestor, min(depth) AS depth FROM up GROUP BY type, ancestor")
_register("subtypes_of", lambda g: walk.subtypes_of(g, "region:2"), _closure("region:2", 10, _steps("('EXTENDS', 'IMPLEMENTS')", "in")) + "SELECT id AS type, depth FROM best")
_register(
    "find_inherited",
    lambda g: walk.find_inherited(g, "customer:7", "NATION_17"),
    _closure("customer:7", 10, _steps("('EXTENDS', 'IMPLEMENTS')", "out")) + "SELECT m.id AS member, b.id AS owner, b.depth FROM best b JOIN edges c ON c.source = b.id AND c.kind = 'CONTAINS' JOIN nodes m ON m.id = c.target WHERE m.name = 'NATION_17' QUALIFY rank() OVER (ORDER BY b.depth, b.id) = 1 ORDER BY b.depth, b.id, m.id",
)
_register(
    "trace_path",
    lambda g: walk.trace_path(g, "event:signup", "event:purchase", 3, 10).select("path_no", "depth", F.array_join("path", ">").alias("path")),
    f""", steps AS MATERIALIZED (SELECT DISTINCT source AS src, target AS dst FROM edges WHERE kind IN {CALL_KINDS}),
two AS MATERIALIZED (SELECT src FROM steps WHERE dst = 'event:purchase'),
paths AS (SELECT ['event:signup', 'event:purchase'] AS p FROM steps WHERE src = 'event:signup' AND dst = 'event:purchase'
UNION ALL SELECT ['event:signup', a.dst, 'event:purchase'] FROM steps a JOIN two ON two.src = a.dst WHERE a.src = 'event:signup' AND a.dst NOT IN ('event:signup', 'event:purchase')
UNION ALL SELECT ['event:signup', a.dst, b.dst, 'event:purchase'] FROM steps a JOIN steps b ON b.src = a.dst JOIN two ON two.src = b.dst WHERE a.src = 'event:signup' AND a.dst NOT IN ('event:signup', 'event:purchase') AND b.dst NOT IN ('event:signup', 'event:purchase') AND b.dst <> a.dst),
top AS (SELECT p, row_number() OVER (ORDER BY len(p), p) AS rn FROM paths)
SELECT CAST(rn AS INT) AS path_no, CAST(len(p) - 1 AS INT) AS depth, array_to_string(p, '>') AS path FROM top WHERE rn <= 10""",
)

# -- aggregates
_FAN = f""", calls AS (SELECT DISTINCT source, target FROM edges WHERE kind IN {CALL_KINDS}), i AS (SELECT target, count(*) AS n FROM calls GROUP BY target), o AS (SELECT source, count(*) AS n FROM calls GROUP BY source),
a AS (SELECT target, count(*) AS n FROM edges WHERE kind = 'ADVISES' GROUP BY target)
SELECT n.id, n.qualified_name, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(a.n, 0) AS advised FROM nodes n LEFT JOIN i ON i.target = n.id LEFT JOIN o ON o.source = n.id LEFT JOIN a ON a.target = n.id WHERE n.kind IN {CALLABLE}"""
_register("hotspots", lambda g: rel.hotspots(g), _FAN + " ORDER BY fan_in DESC, fan_out DESC, n.qualified_name, n.id LIMIT 50")
_register("hotspots_all", lambda g: rel.hotspots(g, ALL), _FAN)
_register("external_dependencies", lambda g: rel.external_dependencies(g, ALL), "SELECT regexp_replace(t.id, '^ext:', '') AS package, count(*) AS references, count(DISTINCT s.file_path) AS files, string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) AS kinds FROM edges e JOIN nodes t ON t.id = e.target JOIN nodes s ON s.id = e.source WHERE t.kind = 'external_symbol' GROUP BY t.id")
_register("unresolved_by_reason", rel.unresolved_by_reason, "SELECT coalesce(reason, 'unresolved') AS reason, count(*) AS n FROM edges WHERE kind = 'CALLS' AND NOT resolved GROUP BY 1")
_register("edge_counts_by_kind", rel.edge_counts_by_kind, "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
_register("confidence_histogram", rel.confidence_histogram, "SELECT kind, coalesce(printf('%.2f', confidence), 'none') AS confidence, count(*) AS n FROM edges GROUP BY 1, 2")


def _cases(g: GraphSession) -> DataFrame:
    """Labels for edges: those of the graph, every seventh declared absent, and some that are not there declared present."""
    e = g.edges.select("source", "target", "kind", (F.length(F.concat("source", "target")) % 7 != 0).alias("expected"))
    return e.union(g.edges.filter("kind = 'CONTAINS'").select(F.col("target"), F.col("source"), F.lit("CALLS"), (F.length("target") % 3 == 0).alias("expected")))


_register(
    "precision_recall",
    lambda g: rel.precision_recall(g, _cases(g)),
    ", c AS (SELECT source, target, kind, length(source || target) % 7 <> 0 AS expected, true AS there FROM edges UNION ALL SELECT target, source, 'CALLS', length(target) % 3 = 0, false FROM edges WHERE kind = 'CONTAINS'), "
    "t AS (SELECT kind, count(*) FILTER (expected AND there) AS tp, count(*) FILTER (NOT expected AND there) AS fp, count(*) FILTER (expected AND NOT there) AS fn, count(*) FILTER (NOT expected AND NOT there) AS tn FROM c GROUP BY kind) "
    "SELECT kind, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END, 4) AS recall FROM t",
)
_register("latency_percentiles", lambda g: rel.latency_percentiles(g.edges.filter("line IS NOT NULL"), "kind", "line"), "SELECT kind, quantile_disc(line, 0.5) AS p50, quantile_disc(line, 0.95) AS p95 FROM edges WHERE line IS NOT NULL GROUP BY kind")

# -- reports
_DEAD = f"SELECT n.id, n.kind, n.qualified_name, n.file_path FROM nodes n WHERE n.kind = 'method' AND coalesce(n.name, '') <> 'main' AND NOT coalesce(n.entry_point, false) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target = n.id AND (e.kind IN {CALL_KINDS} OR e.kind = 'ADVISES'))"
_LIKE = "".join(f" AND replace(n.file_path, chr(92), '/') NOT ILIKE '{p}'" for p in rel.TEST_DIRS) + "".join(f" AND n.file_path NOT ILIKE '{p}' ESCAPE chr(92)".replace("ESCAPE chr(92)", "ESCAPE '\\'") for p in rel.TEST_FILES) + "".join(f" AND n.qualified_name NOT ILIKE '{p}'" for p in rel.TEST_NAMES)
_register("dead_code", lambda g: rel.dead_code(g, ALL), _DEAD + _LIKE)
_register("dead_code_with_tests", lambda g: rel.dead_code(g, ALL, include_tests=True), _DEAD)
_register("find_unresolved", lambda g: rel.find_unresolved(g, "F", None, ALL), ", u AS (SELECT e.source, n.qualified_name AS caller, e.target, e.line, coalesce(e.reason, 'unresolved') AS reason FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'CALLS' AND NOT e.resolved AND contains(lower(coalesce(e.reason, 'unresolved')), 'f')) SELECT *, (SELECT count(*) FROM u) AS total, false AS truncated FROM u")
_register("unresolved_for_node", lambda g: rel.unresolved_for_node(g, "__unknown__:RF"), "SELECT CASE WHEN source = '__unknown__:RF' THEN 'outgoing' ELSE 'incoming' END AS direction, source, target, line, coalesce(reason, 'unresolved') AS reason FROM edges WHERE kind = 'CALLS' AND NOT resolved AND (source = '__unknown__:RF' OR target = '__unknown__:RF')")
_register("proxy_call_info", rel.proxy_call_info, "SELECT e.source, e.target, t.proxy, split_part(s.qualified_name, '#', 1) = split_part(t.qualified_name, '#', 1) AS inert FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind = 'CALLS' AND t.proxy IS NOT NULL")


_IMPACT = f""", t AS MATERIALIZED (SELECT 'customer:7' AS id UNION SELECT e.target FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'customer:7' AND e.kind = 'CONTAINS' AND n.kind IN {CALLABLE}),
w AS (SELECT id, 0 AS depth FROM t UNION SELECT e.source, w.depth + 1 FROM w JOIN edges e ON e.target = w.id AND e.kind IN {CALL_KINDS} WHERE w.depth < 40),
c AS MATERIALIZED (SELECT id, min(depth) AS depth FROM w WHERE id NOT IN (SELECT id FROM t) GROUP BY id),
i AS MATERIALIZED (SELECT n.id FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'customer:7' AND e.kind IN ('EXTENDS', 'IMPLEMENTS') AND n.kind IN {TYPES})
"""
_register(
    "impact_analysis",
    lambda g: impact.impact_analysis(g, "customer:7", 40, True, ALL),
    _IMPACT + """SELECT 'customer:7' AS root, (SELECT count(*) FROM c) AS callers, (SELECT count(*) FROM c WHERE depth = 1) AS direct_callers,
(SELECT count(*) FROM nodes WHERE entry_point AND (id IN (SELECT id FROM t) OR id IN (SELECT id FROM c))) AS entry_points,
(SELECT count(*) FROM edges WHERE kind = 'ROUTES' AND (source IN (SELECT id FROM t) OR target IN (SELECT id FROM t))) AS routes,
(SELECT count(*) FROM edges WHERE kind = 'EMITS' AND (source IN (SELECT id FROM t) OR target IN (SELECT id FROM t))) AS event_flows,
(SELECT count(*) FROM i) AS implementations,
(SELECT count(DISTINCT file_path) FROM nodes WHERE id = 'customer:7' OR id IN (SELECT id FROM c) OR id IN (SELECT id FROM i)) AS files,
CASE WHEN (SELECT count(*) FROM nodes WHERE entry_point AND (id IN (SELECT id FROM t) OR id IN (SELECT id FROM c))) > 0 THEN 'high' WHEN (SELECT count(*) FROM c WHERE depth = 1) > 0 THEN 'medium' ELSE 'low' END AS risk""",
)
_register(
    "impact_details",
    lambda g: impact.impact_details(g, "customer:7", 40, True, ALL),
    _IMPACT
    + """SELECT 'caller' AS section, id, CAST(depth AS VARCHAR) AS detail FROM c UNION ALL SELECT 'entry point', id, entry_point_kind FROM nodes WHERE entry_point AND (id IN (SELECT id FROM t) OR id IN (SELECT id FROM c))
UNION ALL SELECT CASE kind WHEN 'ROUTES' THEN 'route' ELSE 'event flow' END, source, target FROM edges WHERE kind IN ('ROUTES', 'EMITS') AND (source IN (SELECT id FROM t) OR target IN (SELECT id FROM t))
UNION ALL SELECT 'implementation', id, NULL FROM i UNION ALL SELECT DISTINCT 'file', file_path, CAST(NULL AS VARCHAR) FROM nodes WHERE file_path IS NOT NULL AND (id = 'customer:7' OR id IN (SELECT id FROM c) OR id IN (SELECT id FROM i))""",
)
_ex = lambda side, label: f"SELECT '{label}' AS section, {'target' if side == 'source' else 'source'} AS id, kind AS detail FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY kind) AS rn FROM edges WHERE kind IN {CALL_KINDS} AND {side} = 'order:10' AND source <> target) x WHERE rn = 1"
_register(
    "explain_symbol",
    lambda g: impact.explain_symbol(g, "order:10", 1, True, ALL),
    ", sections AS (SELECT 'decorator' AS section, source AS id, string_agg(DISTINCT target, ',' ORDER BY target) AS detail FROM edges WHERE kind = 'ANNOTATED_WITH' AND source = 'order:10' GROUP BY source UNION ALL "
    "SELECT 'member decorator', a.source, a.target FROM edges a JOIN edges h ON h.target = a.source AND h.kind = 'CONTAINS' AND h.source = 'order:10' JOIN nodes n ON n.id = a.source WHERE a.kind = 'ANNOTATED_WITH' AND n.kind IN ('method', 'constructor', 'field') UNION ALL "
    "SELECT 'member', e.target, n.kind FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'CONTAINS' AND e.source = 'order:10' UNION ALL "
    + _ex("target", "caller") + " UNION ALL " + _ex("source", "callee")
    + "".join(f" UNION ALL SELECT '{s}', CASE WHEN source = 'order:10' THEN target ELSE source END, CASE WHEN source = 'order:10' THEN 'out' ELSE 'in' END FROM edges WHERE kind = '{k}' AND (source = 'order:10' OR target = 'order:10')" for s, k in (("route", "ROUTES"), ("injection", "INJECTS"), ("reflection", "REFLECTS")))
    + ") SELECT * FROM sections UNION ALL SELECT 'count', section, CAST(count(*) AS VARCHAR) FROM sections GROUP BY section",
)
_DIFF = "".join(f"--- a/src/cust{c}.java\n+++ b/src/cust{c}.java\n@@ -5,3 +5,120 @@\n x\n@@ -300,2 +330,0 @@\n" for c in (7, 10, 13))


def _hunks(g: GraphSession) -> DataFrame:
    return g.spark.createDataFrame([(h.file, h.start, h.end) for h in impact.parse_unified_diff(_DIFF)], "file string, start int, end int")


_HUNK_SQL = "(VALUES " + ", ".join(f"('{h.file}', {h.start}, {h.end})" for h in impact.parse_unified_diff(_DIFF)) + ") h(file, a, b)"
_DECL = f""", d AS MATERIALIZED (SELECT id, kind, file_path, start_line + 1 AS first, greatest(coalesce(end_line, start_line), start_line) + 1 AS last FROM nodes WHERE start_line IS NOT NULL AND kind IN ('method', 'constructor', 'class', 'interface', 'enum', 'annotation_type', 'aspect')),
x AS MATERIALIZED (SELECT DISTINCT d.* FROM {_HUNK_SQL} JOIN d ON (d.file_path = h.file OR suffix(d.file_path, '/' || h.file) OR suffix(h.file, '/' || d.file_path)) AND d.first <= h.b AND d.last >= h.a),
r AS MATERIALIZED (SELECT id FROM x WHERE kind IN {CALLABLE} UNION SELECT o.id FROM x o WHERE o.kind IN {TYPES} AND NOT EXISTS (SELECT 1 FROM x m JOIN edges c ON c.source = o.id AND c.target = m.id AND c.kind = 'CONTAINS' WHERE m.kind IN {CALLABLE} AND o.first <= m.first AND o.last >= m.last AND o.last - o.first > m.last - m.first))"""
_register("diff_declarations", lambda g: impact.diff_declarations(g, _hunks(g)), _DECL + " SELECT id FROM r")
_register(
    "parse_unified_diff",
    lambda g: impact.parse_diffs(g.spark.createDataFrame([(1, _DIFF)], "diff_id int, diff string")),
    " SELECT 1 AS diff_id, file, a AS start, b AS " + '"end"' + f" FROM {_HUNK_SQL}",
)
_register("file_declarations", lambda g: impact.file_declarations(g, g.spark.createDataFrame([("src/cust7.java",), ("cust13.java",)], "file string")), f"SELECT id FROM nodes WHERE kind IN {TYPES} AND start_line IS NOT NULL AND file_path IN ('/src/cust7.java', '/src/cust13.java')")
_register(
    "change_impact",
    lambda g: impact.change_impact(g, diff=_DIFF, max_depth=40, limit=ALL, max_symbols=ALL).select("root", "callers", "direct_callers", "entry_points", "injections", "advice", "routes", "event_flows", "risk", "score"),
    _DECL + f""", w AS (SELECT id AS root, id, 0 AS depth FROM r UNION SELECT w.root, e.source, w.depth + 1 FROM w JOIN edges e ON e.target = w.id AND e.kind IN {CALL_KINDS} WHERE w.depth < 40),
c AS MATERIALIZED (SELECT root, id, min(depth) AS depth FROM w GROUP BY root, id),
s AS (SELECT r.id AS root, (SELECT count(*) FROM c WHERE c.root = r.id AND c.id <> r.id) AS callers, (SELECT count(*) FROM c WHERE c.root = r.id AND c.depth = 1) AS direct_callers,
(SELECT count(*) FROM c JOIN nodes n ON n.id = c.id WHERE c.root = r.id AND n.entry_point) AS entry_points,
(SELECT count(*) FROM edges e WHERE e.kind = 'INJECTS' AND (e.source = r.id OR e.target = r.id)) AS injections, (SELECT count(*) FROM edges e WHERE e.kind = 'ADVISES' AND e.target = r.id) AS advice,
(SELECT count(*) FROM edges e JOIN c ON c.id = e.target AND c.root = r.id WHERE e.kind = 'ROUTES') AS routes, (SELECT count(*) FROM edges e JOIN c ON c.id = e.source AND c.root = r.id WHERE e.kind = 'EMITS') AS event_flows FROM r),
k AS (SELECT *, CASE WHEN entry_points > 0 THEN 'high' WHEN direct_callers > 0 THEN 'medium' ELSE 'low' END AS risk FROM s)
SELECT *, CAST(CASE risk WHEN 'high' THEN 1000 WHEN 'medium' THEN 100 ELSE 0 END + 20 * routes + 20 * entry_points + 10 * injections + 10 * advice + 5 * event_flows + callers AS BIGINT) AS score FROM k""",
)
_register(
    "find_cycles",
    lambda g: cycles.find_cycles(g, limit=ALL),
    f""", c AS (SELECT id FROM nodes WHERE kind IN {CALLABLE}),
e AS MATERIALIZED (SELECT DISTINCT source, target FROM edges WHERE kind = 'CALLS' AND source <> target AND source IN (SELECT id FROM c) AND target IN (SELECT id FROM c)),
ids AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT source AS id FROM e INTERSECT SELECT target FROM e)),
s AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM e JOIN ids a ON a.id = source JOIN ids b ON b.id = target),
w AS (SELECT a, b FROM s UNION SELECT w.a, s.b FROM w JOIN s ON s.a = w.b),
m AS (SELECT x.a, min(x.b) AS c FROM w x JOIN w y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
SELECT k.id AS component, count(*) AS size, string_agg(i.id, ',' ORDER BY i.id) AS members FROM m JOIN ids i ON i.n = m.a JOIN ids k ON k.n = m.c GROUP BY k.id HAVING count(*) >= 2""",
)
_register("self_calls", cycles.self_calls, f"SELECT DISTINCT source AS id FROM edges JOIN nodes n ON n.id = source WHERE edges.kind = 'CALLS' AND source = target AND n.kind IN {CALLABLE}")

# -- output
_register("estimate_tokens", lambda g: (lambda n: n.select("id", output.estimate_tokens(n).alias("tokens")))(g.nodes.select("id", "kind")), "SELECT id, CAST(ceil(length(to_json({'id': id, 'kind': kind})) / 4) AS BIGINT) AS tokens FROM nodes")
_register(
    "apply_budget",
    lambda g: output.apply_budget(rel.edge_counts_by_kind(g), ["kind"], 40, 2).select("kind", "n", "tokens", F.col("position").cast("long"), "total", "used", F.col("next_cursor").cast("long")),
    ", k AS (SELECT kind, count(*) AS n FROM edges GROUP BY kind), p AS (SELECT kind, n, CAST(ceil(length(to_json({'kind': kind, 'n': n})) / 4) AS BIGINT) AS tokens, row_number() OVER (ORDER BY kind) - 1 AS position, count(*) OVER () AS total FROM k), "
    "u AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY position) AS BIGINT) AS used FROM p WHERE position >= 2), v AS (SELECT * FROM u WHERE used <= 40 OR position = 2) SELECT *, CASE WHEN (SELECT max(position) FROM v) + 1 < total THEN (SELECT max(position) FROM v) + 1 END AS next_cursor FROM v",
)
_register(
    "compactify",
    lambda g: output.compactify(g.nodes.select(F.struct("id", F.col("qualified_name").alias("qualifiedName"), "kind").alias("symbol"), F.lit(1).alias("n"))),
    "SELECT qualified_name AS symbol, 1 AS n FROM nodes",
)
_register(
    "export_graph",
    lambda g: output.export_graph(g, "nation:3", 1, ("EXTENDS", "CONTAINS"), limit=ALL),
    _closure("nation:3", 1, _steps("('EXTENDS', 'CONTAINS')", "both"))
    + ", m AS (SELECT n.id, n.qualified_name || CASE WHEN n.start_line IS NULL THEN '' ELSE ':' || (n.start_line + 1) END AS label, row_number() OVER (ORDER BY n.qualified_name, n.id) - 1 AS i FROM every e JOIN nodes n ON n.id = e.id), "
    "l AS (SELECT 0 AS part, 0 AS x, 0 AS y, '' AS k, 'graph LR' AS line UNION ALL SELECT 1, i, 0, '', '  n' || i || '[\"' || label || '\"]' FROM m UNION ALL SELECT 2, a.i, b.i, e.kind, '  n' || a.i || ' -->|' || e.kind || '| n' || b.i FROM edges e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target WHERE e.kind IN ('EXTENDS', 'CONTAINS')) "
    "SELECT row_number() OVER (ORDER BY part, x, y, k) AS line_no, line FROM l",
)

# -- derived edges
def _channels(g: GraphSession) -> tuple[DataFrame, DataFrame]:
    """Hierarchy edges as publishers and listeners: whoever points at a type publishes, what it points at listens."""
    e = g.edges_of("EXTENDS", "IMPLEMENTS")
    pub = e.select(F.col("source").alias("owner"), F.col("target").alias("type_name"), F.lit("topic").alias("channel_kind"), F.when(F.length("source") % 2 == 0, F.col("target")).alias("qualified"))
    lis = e.select(F.col("target").alias("owner"), F.col("source").alias("type_name"), F.lit("topic").alias("channel_kind"), F.when(F.length("target") % 2 == 0, F.col("source")).alias("qualified"))
    name = lambda d: d.select("owner", "channel_kind", F.col("type_name").alias("channel"), "qualified", F.lit(None).cast("string").alias("phase"))
    return name(pub), name(lis)


_register("build_channel_edges", lambda g: derive.channel_edges(*_channels(g)).select("source", "target", "channel_kind", "channel", F.round("confidence", 2).alias("confidence")), "SELECT p.source, l.target, 'topic' AS channel_kind, p.target AS channel, CASE WHEN length(p.source) % 2 = 0 AND length(l.target) % 2 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence FROM edges p JOIN edges l ON p.target = l.source AND l.kind IN ('EXTENDS', 'IMPLEMENTS') WHERE p.kind IN ('EXTENDS', 'IMPLEMENTS') AND p.source <> l.target")
_register(
    "build_dispatch_edges",
    lambda g: derive.dispatch_edges(*_hierarchy(g)).select("source", "target"),
    ", up AS (SELECT source AS type, target AS ancestor, 1 AS depth FROM edges WHERE kind IN ('EXTENDS', 'IMPLEMENTS') UNION SELECT u.type, e.target, u.depth + 1 FROM up u JOIN edges e ON e.source = u.ancestor AND e.kind IN ('EXTENDS', 'IMPLEMENTS') WHERE u.depth < 10) SELECT DISTINCT ancestor || '#m' AS source, type || '#m' AS target FROM up",
)


def _hierarchy(g: GraphSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One method m on every type of the hierarchy, each called."""
    types = g.edges_of("EXTENDS", "IMPLEMENTS").select(F.explode(F.array("source", "target")).alias("type_id")).distinct()
    methods = types.select(F.concat("type_id", F.lit("#m")).alias("id"), "type_id", F.lit("m").alias("name"), F.lit(0).alias("arity"), F.lit(0).alias("ordinal"), F.array().cast("array<string>").alias("modifiers"))
    calls = methods.select(F.col("id").alias("target"), F.lit(True).alias("resolved"))
    return calls, methods, walk.ancestors(g)


_register(
    "build_advice_edges",
    lambda g: derive.advice_edges(g.spark.createDataFrame([("advice:x", "Before", "execution(* geo.customer1*.order*(..))"), ("advice:y", "After", "within(geo.customer2*) && !execution(* *.order1*(..))")], "advice string, advice_kind string, pointcut string"), _methods(g)).select("source", "target", F.round("confidence", 2).alias("confidence")),
    "SELECT 'advice:x' AS source, id AS target, CAST(0.9 AS DOUBLE) AS confidence FROM nodes WHERE starts_with(id, 'order:') AND starts_with(qualified_name, 'geo.customer1') UNION ALL SELECT 'advice:y', id, CAST(0 AS DOUBLE) FROM nodes WHERE starts_with(id, 'order:') AND starts_with(qualified_name, 'geo.customer2') AND NOT starts_with(name, 'order1')",
)


def _methods(g: GraphSession) -> DataFrame:
    none = F.array().cast("array<string>")
    return g.nodes.filter(f"kind IN {CALLABLE}").select("id", F.substring_index("qualified_name", "#", 1).alias("type_id"), "name", F.lit("void").alias("return_type"), F.lit(0).alias("arity"), none.alias("annotations"), none.alias("type_annotations"))


_register("external_package_of", lambda g: g.nodes.filter("kind = 'external_symbol'").select("id", derive.external_package_of(F.col("qualified_name")).alias("package")), "SELECT id, split_part(split_part(qualified_name, '/', 1), '.', 1) AS package FROM nodes WHERE kind = 'external_symbol'")
_register("edge_kind_policy", lambda g: g.edges_of(*walk.edge_kind_policy(False, True, True)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM edges WHERE kind IN ('CALLS', 'ADVISES', 'EMITS') GROUP BY kind")
_register("stale_files", lambda g: derive.stale_files(g.nodes.select(F.col("file_path").alias("path")), g.nodes.filter("kind = 'class'").select(F.col("file_path").alias("path"))), "SELECT DISTINCT file_path AS path FROM nodes WHERE file_path IS NOT NULL EXCEPT SELECT file_path FROM nodes WHERE kind = 'class'")
_register("keep_first", lambda g: rel.keep_first(g.edges.select("source", "kind", "target"), ["source", "kind"], ["target"]), "SELECT source, kind, min(target) AS target FROM edges GROUP BY source, kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
