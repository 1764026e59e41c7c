"""Operators on literal graphs: call tree, unresolved calls, impact, cycles, paging, diffs, pointcuts, channels."""

import pytest

from strandline.operators import cycles, derive, impact, output
from strandline.operators import relational as rel
from strandline.operators import traversal as walk
from strandline.session import GraphSession


def make(spark, edges, nodes=(), entry=()):
    """edges: (source, target, kind, extra columns); other nodes default to methods."""
    kinds = dict(nodes)
    ids = sorted({e[0] for e in edges} | {e[1] for e in edges} | set(kinds))
    n = spark.createDataFrame([(i, kinds.get(i, "method"), i, i.split("#")[-1], f"/src/{i.split('#')[0]}.java", 0, 9, i in entry, "cli" if i in entry else None) for i in ids], "id string, kind string, qualified_name string, name string, file_path string, start_line int, end_line int, entry_point boolean, entry_point_kind string")
    rows = [(e[0], e[1], e[2], *(e[3:] + (None,) * 3)[:3]) for e in edges]
    e = spark.createDataFrame(rows, "source string, target string, kind string, line int, resolved boolean, reason string").fillna(True, ["resolved"])
    return GraphSession(n, e)


@pytest.fixture(scope="module")
def tree(spark):
    c = lambda a, b: (a, b, "CALLS")
    return make(spark, [c("Main#main", "OrderService#place"), c("Main#main", "CustomerService#find"), c("Main#main", "ShippingService#ship"), c("OrderService#place", "OrderRepository#create"), c("ShippingService#ship", "Tracking#dispatch")])


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_callers_and_callees(tree):
    assert pairs(walk.get_callers(tree, "OrderRepository#create"), "id", "depth") == [("OrderService#place", 1), ("Main#main", 2)]
    assert {("OrderRepository#create", 2), ("Tracking#dispatch", 2)} <= set(pairs(walk.get_callees(tree, "Main#main"), "id", "depth"))
    assert walk.get_callers(tree, "nobody").count() == 0


def test_paths(tree):
    assert pairs(walk.trace_path(tree, "Main#main", "Tracking#dispatch"), "path") == [(["Main#main", "ShippingService#ship", "Tracking#dispatch"],)]
    assert walk.trace_path(tree, "CustomerService#find", "Main#main").count() == 0
    assert walk.trace_path(tree, "nobody", "Main#main").count() == 0


def test_a_closure_on_a_cycle_ends_and_leaves_the_start_out(spark):
    g = make(spark, [("a", "b", "CALLS"), ("b", "a", "CALLS"), ("a", "a", "CALLS")])
    assert pairs(walk.get_callees(g, "a"), "id", "depth") == [("b", 1)]
    assert sorted(pairs(walk.get_callees_direct(g, "a"), "id")) == [("a",), ("b",)]


def test_inherited_overloads_all_come_from_the_nearest_ancestor(spark):
    """Near holds two overloads; Next, as near, and Far, above both, hold more of that name."""
    e = [("Leaf", "Next", "IMPLEMENTS"), ("Leaf", "Near", "EXTENDS"), ("Near", "Far", "EXTENDS"), ("Leaf", "Empty", "IMPLEMENTS")]
    e += [(t, f"{t}{n}#run", "CONTAINS") for t in ("Far", "Next", "Near") for n in (1, 2)] + [("Near", "Near#stop", "CONTAINS"), ("Empty", "Empty#stop", "CONTAINS")]
    g = make(spark, e, [(t, "class") for t in ("Leaf", "Near", "Next", "Far", "Empty")])
    assert sorted(pairs(walk.find_inherited(g, "Leaf", "run"), "member", "owner", "depth")) == [("Near1#run", "Near", 1), ("Near2#run", "Near", 1)]
    assert sorted(pairs(walk.find_inherited(g, "Near", "run"), "member", "owner", "depth")) == [("Far1#run", "Far", 1), ("Far2#run", "Far", 1)]
    assert walk.find_inherited(g, "Leaf", "walk").count() == 0 and walk.find_inherited(g, "nobody", "run").count() == 0


def test_dispatch_and_advice_trace(spark):
    e = [("Checkout#checkout", "Payment#pay", "CALLS"), ("Payment#pay", "CardPayment#pay", "DYNAMIC_DISPATCH"), ("Payment#pay", "UpiPayment#pay", "DYNAMIC_DISPATCH"), ("AuditAspect#beforeCheckout", "Checkout#checkout", "ADVISES"), ("AuditAspect#auditPayment", "Payment#pay", "ADVISES")]
    g = make(spark, e)
    assert set(pairs(walk.trace_execution(g, "Checkout#checkout"), "id", "edge_kind")) == {("AuditAspect#beforeCheckout", "INTERCEPT"), ("Payment#pay", "CALLS"), ("AuditAspect#auditPayment", "INTERCEPT"), ("CardPayment#pay", "DYNAMIC_DISPATCH"), ("UpiPayment#pay", "DYNAMIC_DISPATCH")}
    assert "INTERCEPT" not in {k for (k,) in pairs(walk.trace_execution(g, "Checkout#checkout", include_advice=False), "edge_kind")}


def test_unresolved(spark):
    g = make(spark, [("a", "__unknown__:x", "CALLS", 4, False, "DYNAMIC receiver"), ("a", "__unknown__:y", "CALLS", 9, False, "no such type"), ("a", "b", "CALLS", 1, True)], [("__unknown__:x", "unknown_symbol"), ("__unknown__:y", "unknown_symbol")])
    assert pairs(rel.unresolved_by_reason(g), "n") == [(1,), (1,)]
    assert rel.find_unresolved(g, "dynamic").count() == 1
    assert rel.find_unresolved(g, caller_kind="file").count() == 0
    assert rel.find_unresolved(g, limit=1).first().truncated


def test_impact(spark):
    e = [("main", "place", "CALLS"), ("place", "Repository#save", "CALLS"), ("Repository", "Repository#save", "CONTAINS"), ("JdbcRepository", "Repository", "IMPLEMENTS"), ("place", "Repository#save", "ROUTES"), ("x", "y", "CALLS")]
    g = make(spark, e, [("Repository", "interface"), ("JdbcRepository", "class")], entry=("main",))
    r = impact.impact_analysis(g, "Repository#save").first()
    assert (r.direct_callers, r.callers, r.entry_points, r.routes, r.implementations, r.risk) == (1, 2, 1, 1, 1, "high")
    assert impact.impact_analysis(g, "y").first().risk == "medium" and impact.impact_analysis(g, "x").first().risk == "low"
    assert impact.impact_analysis(g, "nobody").count() == 0


def test_cycles(spark):
    c = lambda a, b: (f"Tangle#{a}", f"Tangle#{b}", "CALLS")
    g = make(spark, [c("alpha", "beta"), c("beta", "gamma"), c("gamma", "alpha"), c("loop", "loop"), c("entry", "alpha"), c("entry", "loop"), c("alpha", "tail")])
    assert pairs(cycles.find_cycles(g), "size", "members") == [(3, "Tangle#alpha,Tangle#beta,Tangle#gamma")]
    assert pairs(cycles.self_calls(g), "id") == [("Tangle#loop",)]
    assert cycles.find_cycles(g, min_size=4).count() == 0
    found = cycles.components(g.edges_of("CALLS"), g.nodes)
    assert cycles.cycle_sample(g, found) == ["Tangle#alpha", "Tangle#beta", "Tangle#gamma", "Tangle#alpha"]


def test_two_components_of_one_colour(spark):
    c = lambda a, b: (a, b, "CALLS")
    g = make(spark, [c("a", "b"), c("b", "a"), c("b", "c"), c("c", "d"), c("d", "c"), c("d", "e"), c("e", "f"), c("f", "e")])
    assert sorted(pairs(cycles.find_cycles(g), "members")) == [("a,b",), ("c,d",), ("e,f",)]


def test_search_ranks_exact_names_first(spark):
    g = make(spark, [("T#target", f"T#target{i}", "CALLS") for i in range(20)])
    assert rel.search_symbols(g, "target", limit=10).first().id == "T#target"
    assert rel.search_symbols(g, "startLine").count() == 0
    assert rel.search_symbols(g, "arget1").count() > 0  # the substring arm
    assert rel.suggest_symbols(g, "no.such#target3").first().id == "T#target3"


def test_phrase_terms(spark):
    g = make(spark, [("m#load_user_list", "m#user_load", "CALLS")])
    assert pairs(rel.search_full_text(g, "load_us"), "id") == [("m#load_user_list",)]


def test_paging(spark):
    df = spark.createDataFrame([(i, "x" * 40) for i in range(10)], "i int, pad string")
    page = output.apply_budget(df, ["i"], 60)
    rows = page.orderBy("position").collect()
    assert rows[0].next_cursor == len(rows) < 10
    assert output.apply_budget(df, ["i"], 1).count() == 1
    seen, cursor = [], 0
    while cursor is not None:
        rows = output.apply_budget(df, ["i"], 60, cursor).orderBy("position").collect()
        seen += [r.i for r in rows]
        cursor = rows[0].next_cursor
    assert seen == list(range(10))
    assert output.apply_budget(df, ["i"], None).count() == 10


def test_unified_diff():
    text = "\r\n".join(["--- a/x.py", "+++ b/x.py", "@@ -1,2 +1,3 @@", "@@ -9 +12 @@", "--- a/gone.py", "+++ /dev/null", "@@ -1,3 +0,0 @@", "--- a/old.py", "+++ b/new.py", "@@ -5,2 +6,0 @@", ""])
    assert [(h.file, h.start, h.end) for h in impact.parse_unified_diff(text)] == [("x.py", 1, 3), ("x.py", 12, 12), ("new.py", 6, 6)]
    assert impact.parse_unified_diff("") == []


def test_a_touched_member_stands_for_its_type(spark):
    n = spark.createDataFrame([("C", "class", "/r/src/C.java", 0, 30), ("C#a", "method", "/r/src/C.java", 2, 8), ("C#b", "method", "/r/src/C.java", 10, 19)], "id string, kind string, file_path string, start_line int, end_line int")
    e = spark.createDataFrame([("C", "C#a", "CONTAINS"), ("C", "C#b", "CONTAINS")], "source string, target string, kind string")
    g = GraphSession(n, e)
    hunk = lambda a, b: spark.createDataFrame([("src/C.java", a, b)], "file string, start int, end int")
    assert pairs(impact.diff_declarations(g, hunk(12, 14)), "id") == [("C#b",)]
    assert pairs(impact.diff_declarations(g, hunk(25, 25)), "id") == [("C",)]
    assert impact.diff_declarations(g, hunk(90, 91)).count() == 0


@pytest.mark.parametrize(
    "pointcut, expected",
    [
        ("execution(* com.acme.*Service.find*(..))", {"com.acme.OrderService#findAll": 0.9}),
        ("execution(* *.save(*))", {"com.acme.db.Repo#save": 0.9}),
        ("within(com.acme..*)", {"com.acme.OrderService#findAll": 0.85, "com.acme.db.Repo#save": 0.85}),
        ("within(com.acme.*)", {"com.acme.OrderService#findAll": 0.85}),
        ("@annotation(Audited)", {"com.acme.db.Repo#save": 0.85}),
        ("execution(* *(..)) && !within(com.acme.db.*)", {"com.acme.OrderService#findAll": 0.0}),
        ("target(com.acme.db.Repo) || args()", {"com.acme.db.Repo#save": 0.55, "com.acme.OrderService#findAll": 0.6}),
        ("", {"com.acme.OrderService#findAll": 0.3, "com.acme.db.Repo#save": 0.3}),
        ("cflow(x)", {}),
    ],
)
def test_pointcuts(spark, pointcut, expected):
    m = spark.createDataFrame([("com.acme.OrderService#findAll", "com.acme.OrderService", "findAll", 0, [], []), ("com.acme.db.Repo#save", "com.acme.db.Repo", "save", 1, ["Audited"], [])], "id string, type_id string, name string, arity int, annotations array<string>, type_annotations array<string>")
    a = spark.createDataFrame([("A#advice", "Before", pointcut)], "advice string, advice_kind string, pointcut string")
    assert {r.target: r.confidence for r in derive.advice_edges(a, m).collect()} == pytest.approx(expected)


def test_named_pointcuts():
    named = {"ops": "execution(* a.B.*(..)) || other()", "other": "within(c.D)", "self": "self()"}
    out = derive.expand_pointcuts([("A#x", "Before", "ops()"), ("A#y", "After", "P.self()")], named)
    assert out[0][2] == "execution(* a.B.*(..)) || within(c.D)" and "self()" in out[1][2]


def test_dispatch(spark):
    m = spark.createDataFrame([("P#pay", "P", "pay", 1, 0, []), ("C#pay", "C", "pay", 2, 0, []), ("C#pay(int)", "C", "pay", 1, 1, []), ("P#priv", "P", "priv", 0, 1, ["private"]), ("C#priv", "C", "priv", 0, 2, [])], "id string, type_id string, name string, arity int, ordinal int, modifiers array<string>")
    calls = spark.createDataFrame([("P#pay", True), ("P#priv", True), ("C#pay", False)], "target string, resolved boolean")
    up = spark.createDataFrame([("C", "P", 1)], "type string, ancestor string, depth int")
    assert pairs(derive.dispatch_edges(calls, m, up), "source", "target") == [("P#pay", "C#pay(int)")]


def test_channels(spark):
    cols = "owner string, channel_kind string, channel string, qualified string, phase string"
    pub = spark.createDataFrame([("S#place", "event", "OrderPlaced", "a.OrderPlaced", None), ("S#send", "topic", "orders", None, None)], cols)
    lis = spark.createDataFrame([("L#one", "event", "OrderPlaced", "a.OrderPlaced", "AFTER_COMMIT"), ("L#other", "event", "OrderPlaced", "b.OrderPlaced", None), ("L#t", "topic", "orders", None, None), ("S#send", "topic", "orders", None, None)], cols)
    assert set(pairs(derive.channel_edges(pub, lis), "source", "target", "confidence")) == {("S#place", "L#one", 1.0), ("S#send", "L#t", 0.85)}


def test_broken_graphs_are_reported(spark):
    n = spark.createDataFrame([("a", "method"), ("a", "method"), ("b", "thing")], "id string, kind string")
    e = spark.createDataFrame([("a", "zzz", "CALLS")], "source string, target string, kind string")
    assert {r.rule for r in GraphSession(n, e).violations().collect()} == {"node key", "node kind", "dangling target"}


def test_pages_begin_with_the_head_of_the_list(spark):
    from strandline.tools import call

    n = spark.createDataFrame([(f"C#m{i}", "method", f"C#m{i}") for i in range(12)], "id string, kind string, qualified_name string")
    e = spark.createDataFrame([(f"C#m{i}", f"C#m{j}", "CALLS") for i in range(12) for j in range(i)], "source string, target string, kind string")
    g = GraphSession(n, e)
    whole = [r.id for r in call(g, "find_hotspots", limit=12)["rows"].orderBy("fan_in", ascending=False).collect()]
    got = call(g, "find_hotspots", limit=12, max_tokens=100)
    first = [r.id for r in got["rows"].orderBy("position").collect()]
    meta = got["page"].first()
    assert first == whole[: len(first)] and first[0] == "C#m0" and meta.truncated and meta.next_cursor == len(first) and meta.total == 12 and "cursor" in meta.hint
    rest = call(g, "find_hotspots", limit=12, cursor=meta.next_cursor)
    assert [r.id for r in rest["rows"].orderBy("position").collect()] == whole[len(first) :] and not rest["page"].first().truncated


def test_all_simple_paths_without_a_limit(spark):
    n = spark.createDataFrame([(x, "method", x) for x in "abcd"], "id string, kind string, qualified_name string")
    e = spark.createDataFrame([(x, y, "CALLS") for x, y in ("ab", "ac", "ad", "bd", "cd", "bc", "cb")], "source string, target string, kind string")
    got = walk.trace_path(GraphSession(n, e), "a", "d", 5, None)
    assert ["".join(r.path) for r in got.orderBy("path_no").collect()] == ["ad", "abd", "acd", "abcd", "acbd"]


def test_sql_over_the_graph(spark):
    n = spark.createDataFrame([("a", "method"), ("b", "class")], "id string, kind string")
    g = GraphSession(n, spark.createDataFrame([("b", "a", "CONTAINS")], "source string, target string, kind string"))
    assert [tuple(r) for r in g.sql("SELECT n.kind, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.target GROUP BY n.kind").collect()] == [("method", 1)]
    with pytest.raises(ValueError):
        g.sql("DROP TABLE nodes")


def test_many_pointcuts_go_in_batches(spark, monkeypatch):
    monkeypatch.setattr(derive, "ADVICE_BATCH", 3)
    m = spark.createDataFrame([(f"a.T{i}#run", f"a.T{i}", "run", 0, [], []) for i in range(8)], "id string, type_id string, name string, arity int, annotations array<string>, type_annotations array<string>")
    a = spark.createDataFrame([(f"A#x{i}", "Before", f"ops{i}()") for i in range(8)], "advice string, advice_kind string, pointcut string")
    named = spark.createDataFrame([(f"ops{i}", f"within(a.T{i})") for i in range(8)], "name string, expression string")
    assert set(pairs(derive.advice_edges(a, m, named), "source", "target")) == {(f"A#x{i}", f"a.T{i}#run") for i in range(8)}
