"""The query catalogue by name: parameters with their bounds, groups, and one call that answers or says why not."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from strandline.config import limits
from strandline.operators import cycles, impact, output
from strandline.operators import relational as rel
from strandline.operators import traversal as walk
from strandline.session import EDGE_KINDS, GraphSession

# Least and largest value of the numeric parameters.
TOKENS = (100, 200_000)


@dataclass(frozen=True)
class Tool:
    group: str
    run: Callable[..., DataFrame]
    bounds: dict[str, tuple[int, int]]
    needs: str | None = None
    paged: tuple[str, ...] = ()


def _wiring(kind: str) -> Callable[..., DataFrame]:
    return lambda g, symbol=None, limit=50: rel.wiring_edges(g, kind, symbol, limit)


WALK = {"max_depth": (1, 50), "limit": (1, 500)}
TOOLS: dict[str, Tool] = {
    "index_status": Tool("index", rel.index_status, {}),
    "get_schema": Tool("index", rel.get_schema, {}),
    "search_symbols": Tool("search", rel.search_symbols, {"limit": (1, 200)}, paged=("rank", "score", "id")),
    "get_node": Tool("search", rel.get_node, {}, "symbol"),
    "get_callers": Tool("calls", walk.get_callers, WALK, "symbol", ("depth", "id")),
    "get_callees": Tool("calls", walk.get_callees, WALK, "symbol", ("depth", "id")),
    "trace_path": Tool("calls", walk.trace_path, {"max_depth": (1, 50), "limit": (1, 100)}, "source", ("path_no",)),
    "trace_execution": Tool("calls", walk.trace_execution, {"max_depth": (1, 50), "limit": (1, 1000)}, "symbol", ("depth", "id")),
    "get_subgraph": Tool("calls", lambda g, symbol, radius=2, edge_kinds=walk.SUBGRAPH_KINDS, limit=500: walk.get_subgraph(g, symbol, radius, edge_kinds, limit)[0], {"radius": (1, 6), "limit": (1, 2000)}, "symbol"),
    "find_implementations": Tool("types", walk.find_implementations, {"max_depth": (1, 20), "limit": (1, 500)}, "symbol", ("depth", "qualified_name")),
    "find_aspects": Tool("types", rel.find_aspects, {"limit": (1, 200)}, paged=("aspect", "advice")),
    "get_decorators": Tool("types", rel.get_decorators, {}, "symbol", ("member",)),
    "find_annotated": Tool("types", rel.find_annotated, {"limit": (1, 500)}, paged=("qualified_name", "id")),
    "find_hotspots": Tool("insight", rel.hotspots, {"limit": (1, 200), "min_fan_in": (0, 1 << 31)}, paged=("-fan_in", "-fan_out", "qualified_name", "id")),
    "find_dead_code": Tool("insight", rel.dead_code, {"limit": (1, 500)}, paged=("qualified_name", "id")),
    "find_entry_points": Tool("insight", rel.find_entry_points, {"limit": (1, 500)}, paged=("entry_kind", "qualified_name", "id")),
    "find_injections": Tool("wiring", _wiring("INJECTS"), {"limit": (1, 500)}, paged=("source_name", "target_name", "source", "target")),
    "find_reflections": Tool("wiring", _wiring("REFLECTS"), {"limit": (1, 500)}, paged=("source_name", "target_name", "source", "target")),
    "find_routes": Tool("wiring", _wiring("ROUTES"), {"limit": (1, 500)}, paged=("source_name", "target_name", "source", "target")),
    "find_event_flows": Tool("wiring", _wiring("EMITS"), {"limit": (1, 500)}, paged=("source_name", "target_name", "source", "target")),
    "find_external_dependencies": Tool("insight", rel.external_dependencies, {"limit": (1, 500)}, paged=("-references", "package")),
    "find_unresolved": Tool("insight", rel.find_unresolved, {"limit": (1, 5000)}, paged=("caller", "line", "target")),
    "impact_analysis": Tool("impact", lambda g, symbol, details=False, **args: (impact.impact_details if details else impact.impact_analysis)(g, symbol, **args), {"max_depth": (1, 50), "limit": (1, 1000)}, "symbol"),
    "change_impact": Tool("impact", impact.change_impact, {"max_depth": (1, 50), "limit": (1, 1000), "max_symbols": (1, 200)}),
    "explain_symbol": Tool("impact", impact.explain_symbol, {"max_depth": (1, 5), "limit": (1, 500)}, "symbol"),
    "find_cycles": Tool("insight", cycles.find_cycles, {"min_size": (1, 100), "limit": (1, 500)}, paged=("-size", "component")),
    "export_graph": Tool("insight", output.export_graph, {"radius": (1, 5), "limit": (1, 1000)}),
}


PROMPT = "trace-call-path"


def _held(tool: Tool, args: dict) -> dict:
    """args with the environment's default limit and depth, where it names any and the call does not."""
    given, held = limits(), dict(args)
    for name, variable, value in (("limit", "STRANDLINE_DEFAULT_LIMIT", given.default_limit), ("max_depth", "STRANDLINE_MAX_DEPTH", given.max_depth)):
        if name in tool.bounds and held.get(name) is None and os.environ.get(variable, "").strip():
            held[name] = min(max(value, tool.bounds[name][0]), tool.bounds[name][1])
    return held


def resource(g: GraphSession, name: str) -> DataFrame:
    """The resources `schema` and `status`."""
    return {"schema": rel.get_schema, "status": rel.index_status}[name](g)


def prompt(g: GraphSession, source: str, target: str) -> str:
    """The text of the prompt trace-call-path: the call paths between two symbols, numbered, or what to do where there are none."""
    paths = [r.path for r in walk.trace_path(g, source, target, limit=10).orderBy("path_no").collect()]
    if not paths:
        return f"No call path leads from {source} to {target}. Look both up with search_symbols, and at what is around them with get_subgraph."
    return f"Call paths from {source} to {target}:\n\n" + "\n".join(f"{i}. {' -> '.join(p)}" for i, p in enumerate(paths, 1)) + "\n\nGo on with get_callers or get_callees of what lies between."


def call(g: GraphSession, name: str, max_tokens: int | None = None, cursor: int | None = None, compact: bool = False, **args) -> dict:
    """{ok, rows} or {ok: False, error, suggestions}; a page and its meta where a budget or cursor is given.

    compact: references to symbols are given by their qualified names alone.
    """
    tool = TOOLS.get(name)
    if tool is None:
        return {"ok": False, "error": f"no tool {name}", "suggestions": sorted(TOOLS)}
    for k, (low, high) in {**tool.bounds, "max_tokens": TOKENS}.items():
        value = max_tokens if k == "max_tokens" else args.get(k)
        if value is not None and not low <= value <= high:
            return {"ok": False, "error": f"{k} must be between {low} and {high}", "suggestions": []}
    unknown = set(args.get("edge_kinds") or ()) - set(EDGE_KINDS)
    if unknown:
        return {"ok": False, "error": f"no edge kind {sorted(unknown)}", "suggestions": list(EDGE_KINDS)}
    if name == "change_impact" and not (args.get("symbols") or args.get("files") or args.get("diff")):
        return {"ok": False, "error": "give symbols, files or a diff", "suggestions": []}
    if tool.needs and walk.resolve(g, args[tool.needs]) is None:
        return {"ok": False, "error": f"no symbol {args[tool.needs]}", "suggestions": [r.id for r in rel.suggest_symbols(g, args[tool.needs]).collect()]}
    df = tool.run(g, **_held(tool, args))
    if tool.paged and (max_tokens is not None or cursor is not None):
        df = output.apply_budget(df, tool.paged, max_tokens, cursor or 0)
        return {"ok": True, "rows": output.compactify(df) if compact else df, "page": output.page_meta(df)}
    return {"ok": True, "rows": output.compactify(df) if compact else df}
