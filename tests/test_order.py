"""Limited lists are the heads of the full ones, in the stated order; ranked search by a naive BM25."""

import math
import re

import pytest
from conftest import SF

from strandline.operators import relational as rel
from strandline.operators import traversal as walk
from strandline.plans.tables import graph

LISTS = {
    "hotspots": (rel.hotspots, lambda r: (-r.fan_in, -r.fan_out, r.qualified_name, r.id)),
    "dead_code": (rel.dead_code, lambda r: (r.qualified_name, r.id)),
    "external_dependencies": (rel.external_dependencies, lambda r: (-r.references, r.package)),
    "find_entry_points": (lambda g, limit: rel.find_entry_points(g, None, limit), lambda r: (r.entry_kind, r.qualified_name, r.id)),
    "find_unresolved": (lambda g, limit: rel.find_unresolved(g, limit=limit), lambda r: (r.caller, r.line, r.source, r.target)),
    "find_routes": (lambda g, limit: rel.wiring_edges(g, "ROUTES", None, limit), lambda r: (r.source_name, r.target_name, r.source, r.target)),
    "get_callers": (lambda g, limit: walk.get_callers(g, "part:1", 2, limit), lambda r: (r.depth, r.id)),
    "get_callees": (lambda g, limit: walk.get_callees(g, "part:1", 2, limit), lambda r: (r.depth, r.id)),
    "trace_execution": (lambda g, limit: walk.trace_execution(g, "part:1", 2, limit), lambda r: (r.depth, r.id)),
    "find_implementations": (lambda g, limit: walk.find_implementations(g, "nation:3", 3, limit), lambda r: (r.depth, r.qualified_name, r.id)),
}


@pytest.mark.parametrize("name", sorted(LISTS))
def test_a_limited_list_is_the_head_of_the_full_one(spark, name):
    run, key = LISTS[name]
    g = graph(spark, SF)
    full, head = run(g, limit=None).collect(), run(g, limit=7).collect()
    some = lambda rows: [tuple(v for k, v in r.asDict().items() if k != "truncated") for r in rows]
    assert len(head) == min(7, len(full)) > 0 and some(head) == some(sorted(full, key=key)[:7])


@pytest.mark.parametrize("query", ["order1", "geo customer1", "part_1", "BUILDING", "nothing here"])
def test_ranked_search_equals_naive_bm25(spark, query):
    g = graph(spark, SF)
    terms = rel.query_terms(query)
    docs = {}
    for r in g.nodes.select("id", "qualified_name", "name").collect():
        docs[r.id] = (r, [re.findall(r"[^\W_]+", (x or "").lower()) for x in (r.id, r.qualified_name, r.name)])

    def times(fields, phrase):
        return sum(all(f[i + k].startswith(p) if k == len(phrase) - 1 else f[i + k] == p for k, p in enumerate(phrase)) for f in fields for i in range(len(f) - len(phrase) + 1))

    tf = {i: [times(f, p) for p in terms] for i, (_, f) in docs.items()}
    size = {i: sum(map(len, f)) for i, (_, f) in docs.items()}
    average, n = sum(size.values()) / len(size), len(docs)
    df = [sum(t[k] > 0 for t in tf.values()) for k in range(len(terms))]
    want = []
    for i, (r, _) in docs.items():
        if all(tf[i]):
            score = -sum(max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) * t * (rel.K1 + 1) / (t + rel.K1 * (1 - rel.B + rel.B * size[i] / average)) for t, d in zip(tf[i], df))
            q, qn, name = query.strip().lower(), r.qualified_name.lower(), (r.name or "").lower()
            rank = 0 if qn == q else 1 if i.lower() == q else 2 if name == q else 3 if qn.startswith(q) else 4 if i.lower().startswith(q) else 5
            want.append((rank, round(score, 6), len(r.qualified_name), r.qualified_name, i))
    got = [(r["rank"], round(r.score, 6), len(r.qualified_name), r.qualified_name, r.id) for r in rel.search_full_text(g, query, None, 25).collect()]
    assert got == sorted(want)[:25] and (got or query == "nothing here")
