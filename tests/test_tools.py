"""Type texts, limits by environment, the line protocol, prompts, resources, star imports, and reports with their rows."""

import io
import json

import pytest

from strandline import config
from strandline.__main__ import serve
from strandline.operators import impact
from strandline.operators import relational as rel
from strandline.session import GraphSession
from strandline.sources.crawl import PARSERS, CrawlOptions, crawl, parsed_files, register_language
from strandline.sources.rules import EXTENSIONS
from strandline.sources.store import Store
from strandline.sources.type_text import is_builtin_type_text, normalize_type_text
from strandline.tools import call, prompt, resource


@pytest.mark.parametrize(
    "text, name",
    [
        ("Optional[User]", "User"), ("Promise<Array<Order>>", "Order"), ("readonly Item[]", "Item"), ("User | null", "User"), ("null | undefined | A.B", "A.B"), ("Map<string, User>", "Map"), ("-> List[int]", "int"),
        ("A & B", "A"), ("'Later'", "Later"), (": final Thing", "Thing"), ("typing.Optional['X']", "X"), ("Annotated[Svc, Depends(f)]", "Svc"), ("", ""), (None, ""), ("None", ""), ("Dict[str, List[int]]", "Dict"), ("Promise<A | B>", "A"),
    ],
)
def test_type_texts(text, name):
    assert normalize_type_text(text) == name


def test_builtin_types():
    assert all(map(is_builtin_type_text, ("string", "Promise<void>", "int", "{ id: string }", "() => void", "Optional[str]")))
    assert not any(map(is_builtin_type_text, ("User", "", None, "Promise<User>")))


def test_limits_by_environment(capsys):
    assert config.limits({}) == config.Limits(50, 10, 1_000_000)
    assert config.limits({"STRANDLINE_DEFAULT_LIMIT": "99999", "STRANDLINE_MAX_DEPTH": "x", "STRANDLINE_MAX_FILE_BYTES": "2e3"}) == config.Limits(5000, 10, 2000)
    assert capsys.readouterr().err.count("\n") == 2


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {
        "lib/util.py": "class Tool:\n    def use(self):\n        return 1\n\ndef helper():\n    return Tool()\n",
        "app.py": "from lib.util import *\n\n@app.get('/x')\n@cached(ttl=5)\ndef run():\n    if ready:\n        helper()\n    t = Tool()\n    t.use()\n",
        "A.java": "package a;\nimport b.*;\nclass A { B b; void go() { b.work(1); } }\n",
        "B.java": "package b;\npublic class B { public void work(int n) {} }\n",
        "note.toy": "hello\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    s = Store(spark, str(tmp_path_factory.mktemp("store") / "s"))
    s.first = s.crawl_project(str(root))
    s.root = str(root)
    return s


def calls(g):
    return {(r.source, r.target) for r in g.edges_of("CALLS").collect()}


def test_star_imports_and_notes_on_edges(store):
    g = store.graph()
    assert {("module:app#run", "module:lib.util#helper"), ("module:app#run", "lib.util.Tool#use"), ("a.A#go", "b.B#work")} <= calls(g)
    guarded = next(r for r in g.edges_of("CALLS").collect() if r.target == "module:lib.util#helper")
    assert guarded.guards == ["ready"] and guarded.control_flow == ["branch"]
    notes = {r.annotation: (r.arguments, r.decorator) for r in rel.get_decorators(g, "module:app#run").collect()}
    assert notes == {"@app.get": ("'/x'", True), "@cached": ("ttl=5", False)}
    assert [r.arguments for r in rel.find_annotated(g, "cached").collect()] == ["ttl=5"]
    assert store.first["edges_by_kind"]["CALLS"] == g.edges_of("CALLS").count() and rel.index_status(g).first().last_crawl > 0


def test_another_language(spark, store):
    def parse(text, module, language, aliases, package):
        empty = dict.fromkeys(("imports", "methods", "fields", "calls", "routes", "injections", "reflections"), [])
        return {"package": "", "module_id": module, **empty, "types": [{"id": f"toy.{text.strip()}", "kind": "class", "name": text.strip(), "parents": [], "interfaces": [], "start_line": 0, "end_line": 0, "annotations": []}]}

    register_language("toy", [".toy"], parse)
    try:
        got = parsed_files(crawl(spark, store.root, options=CrawlOptions(language="toy"))).collect()
        assert [(r.language, r.types[0].id) for r in got] == [("toy", "toy.hello")]
    finally:
        del PARSERS["toy"], EXTENSIONS[".toy"]


def test_line_protocol_prompt_and_resources(store, monkeypatch):
    asked = [{"tool": "get_callers", "args": {"symbol": "b.B#work"}}, {"tool": "no"}, {"tool": "trace-call-path", "args": {"source": "a.A#go", "target": "b.B#work"}}, {"tool": "find_entry_points", "args": {"max_tokens": 500}}]
    out = io.StringIO()
    serve(store, io.StringIO("\n".join(map(json.dumps, asked)) + "\nnonsense\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["ok"] for x in got] == [True, False, True, True, False]
    assert got[0]["rows"][0]["id"] == "a.A#go" and "1. a.A#go -> b.B#work" in got[2]["text"] and got[3]["page"][0]["truncated"] is False
    assert "search_symbols" in prompt(store.graph(), "b.B#work", "a.A#go")
    assert resource(store.graph(), "schema").count() == 29 and resource(store.graph(), "status").first().nodes > 0
    monkeypatch.setenv("STRANDLINE_DEFAULT_LIMIT", "1")
    assert call(store.graph(), "find_unresolved")["rows"].count() <= 1


def test_reports_list_what_they_count(spark):
    n = spark.createDataFrame([("I", "interface", "I", "I", "/i"), ("I#m", "method", "I#m", "m", "/i"), ("C", "class", "C", "C", "/c"), ("C#m", "method", "C#m", "m", "/c"), ("X#a", "method", "X#a", "a", "/x"), ("X#b", "method", "X#b", "b", "/x")], "id string, kind string, qualified_name string, name string, file_path string")
    n = n.selectExpr("*", "id = 'X#b' AS entry_point", "if(id = 'X#b', 'http', null) AS entry_point_kind", "0 AS start_line", "9 AS end_line")
    e = spark.createDataFrame([("I", "I#m", "CONTAINS"), ("C", "C#m", "CONTAINS"), ("C", "I", "IMPLEMENTS"), ("X#a", "I#m", "CALLS"), ("X#b", "X#a", "CALLS"), ("R", "I#m", "ROUTES")], "source string, target string, kind string")
    g = GraphSession(n, e)
    got = {tuple(r) for r in impact.impact_details(g, "I#m", 5).collect()}
    assert got == {("caller", "X#a", "1"), ("caller", "X#b", "2"), ("entry point", "X#b", "http"), ("route", "R", "I#m"), ("implementation", "C", "C#m"), ("file", "/i", None), ("file", "/x", None), ("file", "/c", None)}
    assert {r.id for r in call(g, "impact_analysis", symbol="I#m", details=True)["rows"].collect()} == {i for _, i, _ in got}
    total = impact.change_totals(impact.change_impact(g, ["I#m", "X#a"]), g, files=["x", "gone.py"]).first()
    assert (total.symbols, total.callers, total.files, total.entry_points, total.unmatched) == (2, 1, 2, 1, ["gone.py"])


def test_route_handlers_and_injections_by_tier(spark, tmp_path):
    root = tmp_path / "t"
    for name, text in {
        "web/h.ts": "export function list(req, res) { res.send(1); }\n",
        "web/app.ts": "import express from 'express';\nimport { list } from './h';\nconst app = express();\napp.get('/list', list);\napp.get('/own', own);\nfunction own() {}\napp.get('/two', two);\nclass A { two() {} }\nclass B { two() {} }\n",
        "api.py": "from fastapi import Depends\nfrom outside.db import Session\n\ndef run(s=Depends(Session), n=Depends(int)):\n    return s\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    s = Store(spark, str(tmp_path / "s"))
    s.crawl_project(str(root))
    g = s.graph()
    routes = {r.path: (r.target, r.confidence) for r in g.edges_of("ROUTES").collect()}
    assert routes == {"/list": ("module:web.h#list", 0.85), "/own": ("module:web.app#own", 1.0), "/two": ("web.app.A#two", 0.6)}
    assert {(r.source, r.target, r.confidence) for r in g.edges_of("INJECTS").collect()} == {("module:api#run", "ext:outside", 0.8)}
