"""Queries that take the whole graph, by brute force."""

from conftest import SF

from strandline import queries as graph_queries
from strandline.operators import cycles
from strandline.plans.tables import graph

QUERIES = graph_queries.queries()


def brute_cycles(edges):
    """{component: members} by Kosaraju's two walks."""
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b), back.setdefault(b, []).append(a)
    seen, order = set(), []
    for root in sorted({x for e in edges for x in e}):
        todo = [(root, iter(out.get(root, [])))] if root not in seen else []
        seen.add(root)
        while todo:
            nxt = next((x for x in todo[-1][1] if x not in seen), None)
            if nxt is None:
                order.append(todo.pop()[0])
            else:
                seen.add(nxt)
                todo.append((nxt, iter(out.get(nxt, []))))
    found, seen = {}, set()
    for root in reversed(order):
        members, todo = [], [root] if root not in seen else []
        seen.update(todo)
        while todo:
            members.append(x := todo.pop())
            fresh = {y for y in back.get(x, []) if y not in seen}
            seen |= fresh
            todo += fresh
        if len(members) > 1:
            found[min(members)] = ",".join(sorted(members))
    return found


def test_cycles_of_the_whole_graph(spark):
    g = graph(spark, SF)
    ids = {r.id for r in cycles.callable_ids(g).collect()}
    edges = [(r.source, r.target) for r in g.edges_of("CALLS").select("source", "target").distinct().collect() if r.source in ids and r.target in ids]
    got = {r.component: (r.size, r.members) for r in QUERIES["find_cycles"](spark, SF).collect()}
    want = brute_cycles(edges)
    assert got == {c: (m.count(",") + 1, m) for c, m in want.items()} and want


def test_advice_sees_every_callable(spark):
    g = graph(spark, SF)
    want = {r.id for r in g.nodes.filter("kind IN ('method', 'constructor')").collect()}
    assert {r.id for r in graph_queries._methods(g).collect()} == want
    assert any(not x.startswith("order:") for x in want)


def test_references_of_every_node(spark):
    assert QUERIES["compactify"](spark, SF).count() == graph(spark, SF).nodes.count()
