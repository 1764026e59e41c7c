"""Source trees to graphs: discovery, incremental crawls, declarations, resolution, wiring and derived edges."""

import os

import pytest

from strandline.sources.aliases import aliases_of, match_alias
from strandline.sources.crawl import CrawlOptions, crawl, discover, ignore_pattern, parse_text
from strandline.sources.store import Store
from strandline.streaming.watch import watch
from strandline.tools import TOOLS, call

FILES = {
    "src/main/java/com/acme/Payment.java": "package com.acme;\npublic interface Payment { void pay(int n); }\n",
    "src/main/java/com/acme/CardPayment.java": "package com.acme;\npublic class CardPayment implements Payment { public void pay(int n) { log(n); } private void log(int n) {} }\n",
    "src/main/java/com/acme/UpiPayment.java": "package com.acme;\npublic class UpiPayment implements Payment { public void pay(int n) { System.out.println(n); } }\n",
    "src/main/java/com/acme/Checkout.java": """package com.acme;
import org.springframework.stereotype.Service;
@Service
public class Checkout {
  private final Payment payment;
  public Checkout(Payment payment) { this.payment = payment; }
  public void checkout(int n) { if (n > 0) { payment.pay(n); } events.publishEvent(new OrderPlaced(n)); }
  void render(int a) {} void render(String b) {}
  void both() { render(1); new Receipt(); }
  void either(Object x) { render(x); } void text() { render("s"); } void wide() { size(2); } void size(String s) {} void size(long n) {}
}
class Receipt {}
class OrderPlaced { OrderPlaced(int n) {} }
""",
    "src/main/java/com/acme/Audit.java": """package com.acme;
@Aspect
public class Audit {
  @Before("execution(* com.acme.Checkout.checkout(..))")
  public void before() {}
}
class Mailer { @TransactionalEventListener public void on(OrderPlaced e) {} }
@RestController @RequestMapping("/orders")
class OrderController {
  @Autowired Checkout checkout;
  @PostMapping("/{id}") public void place(int id) { checkout.checkout(id); }
}
""",
    "py/api.py": """from .service import Service, helper
import requests

@app.post("/orders")
def create(order: Order, s: Service = Depends(get_service)):
    s.save(order)
    helper(1)
    requests.get("x")
    mystery.run()

def get_service():
    return Service()

if __name__ == "__main__":
    get_service()
""",
    "py/service.py": "class Base:\n    def save(self, x):\n        self.check(x)\n    def check(self, x):\n        print(x)\n\nclass Service(Base):\n    def check(self, x):\n        return getattr(self, 'save')\n\ndef helper(n):\n    return n\n",
    "web/app.ts": "import { Store } from './store';\nimport express from 'express';\nconst app = express();\nexport class Shop { constructor(private store: Store) {} open(id: string) { return this.store.find(id); } }\napp.get('/open', (req, res) => { res.send(1); });\napp.post('/go', go);\nexport function go(s: Store) { s.find('x'); }\n",
    "web/store.ts": "export class Store { find(id: string) { return id; } }\n",
    "tsconfig.json": '{ // aliases\n "extends": "./tsconfig.base", "compilerOptions": { "baseUrl": ".", }, }',
    "tsconfig.base.json": '{"compilerOptions": {"paths": {"@web/*": ["./web/*"]}}}',
    "web/deep/use.ts": "import { Store } from '@web/store';\nexport function use(s: Store) { s.find('y'); }\n",
    "node_modules/x/index.js": "function no() {}\n",
    "py/broken.py": "def (:\n",
    "README.md": "no source\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "py/blob.py").write_bytes(b"\0\1")
    return root


@pytest.fixture(scope="module")
def store(spark, tree, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store") / "s"))
    s.first = s.crawl_project(str(tree))
    return s


@pytest.fixture(scope="module")
def graph(store):
    return store.graph().persist()


def edges(g, kind):
    return {(r.source, r.target) for r in g.edges_of(kind).select("source", "target").collect()}


def test_discovery(spark, tree):
    found = {r.path: r.language for r in discover(spark, str(tree)).collect()}
    assert set(found) == {k for k in FILES if k.endswith((".java", ".py", ".ts"))} | {"py/blob.py"} and found["web/app.ts"] == "typescript"
    only = {r.path for r in discover(spark, str(tree), CrawlOptions(ignore_lines=["py/*", "!py/api.py"], language="python")).collect()}
    assert only == {"py/api.py"}


def test_aliases():
    configs = {"tsconfig.json": '{"extends": "./a"}', "a.json": '{"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"], "@/x/*": ["y/*"], "one": ["two.ts"]}}}'}
    found = aliases_of(configs)
    assert match_alias("@/x/z", found) == "src/y/z" and match_alias("@/q", found) == "src/q" and match_alias("one", found) == "src/two.ts" and match_alias("react", found) is None
    assert aliases_of({}) == {} and aliases_of({"tsconfig.json": "{ nonsense"}) == {}


def test_ignore_patterns():
    import re

    hit = lambda glob, path: bool(re.search(ignore_pattern(glob), path))
    assert hit("*.log", "a/b.log") and hit("build/", "x/build/y") and not hit("/build", "x/build/y") and hit("a/**/z", "a/b/c/z") and hit("a/**/z", "a/z") and not hit("*.log", "a.logs")


def test_statuses(store, tree, spark):
    assert store.first["rebuilt"] and store.first["added"] == len([k for k in FILES if k.endswith((".java", ".py", ".ts"))]) + 1
    errors = {r.path: r.error for r in store.manifest().filter("error IS NOT NULL").collect()}
    assert errors["py/blob.py"] == "binary" and errors["py/broken.py"].startswith("SyntaxError")


def test_the_graph_is_sound(graph):
    assert graph.violations().count() == 0
    held = {t for _, t in edges(graph, "CONTAINS")} | {s for s, _ in edges(graph, "DECLARED_IN")}
    assert {r.id for r in graph.nodes.filter("kind IN ('method', 'constructor')").collect()} <= held


def test_java_calls(graph):
    calls = {(r.source, r.target): r for r in graph.edges_of("CALLS").collect()}
    pay = calls["com.acme.Checkout#checkout", "com.acme.Payment#pay"]
    assert pay.conditional and pay.resolved and pay.confidence is None
    assert ("com.acme.CardPayment#pay", "com.acme.CardPayment#log") in calls
    assert calls["com.acme.Checkout#both", "com.acme.Receipt#<init>"].confidence == 0.9
    render = calls["com.acme.Checkout#both", "com.acme.Checkout#render"]
    assert render.confidence == 0.95 and render.alternatives is None  # a whole number tells render(int)
    either = calls["com.acme.Checkout#either", "com.acme.Checkout#render"]
    assert either.confidence == 0.6 and either.alternatives == ["com.acme.Checkout#render(String)"]
    assert ("com.acme.Checkout#text", "com.acme.Checkout#render(String)") in calls and ("com.acme.Checkout#wide", "com.acme.Checkout#size(long)") in calls
    unknown = calls["com.acme.UpiPayment#pay", "__unknown__:System.out.println"]
    assert not unknown.resolved and unknown.confidence == 0 and unknown.reason
    assert ("com.acme.OrderController#place", "com.acme.Checkout#checkout") in calls


def test_python_and_script_calls(graph):
    calls = {(r.source, r.target): r for r in graph.edges_of("CALLS").collect()}
    save = calls["module:py.api#create", "py.service.Base#save"]
    assert save.confidence == 0.9  # typed, but inherited
    assert calls["module:py.api#create", "module:py.service#helper"].confidence == 0.85
    assert ("module:py.api#create", "ext:requests") in calls and ("module:py.api#create", "__unknown__:mystery.run") in calls
    assert ("py.service.Base#check", "ext:python") in calls
    assert ("web.app.Shop#open", "web.store.Store#find") in calls and ("module:web.app#go", "web.store.Store#find") in calls
    assert ("module:web.deep.use#use", "web.store.Store#find") in calls  # by a path alias


def test_derived_edges(graph):
    assert {("com.acme.Payment#pay", "com.acme.CardPayment#pay"), ("com.acme.Payment#pay", "com.acme.UpiPayment#pay"), ("py.service.Base#check", "py.service.Service#check")} == edges(graph, "DYNAMIC_DISPATCH")
    assert edges(graph, "ADVISES") == {("com.acme.Audit#before", "com.acme.Checkout#checkout")}
    assert edges(graph, "EMITS") == {("com.acme.Checkout#checkout", "com.acme.Mailer#on")}


def test_wiring(graph):
    routes = {(r.http_method, r.path, r.target) for r in graph.edges_of("ROUTES").collect()}
    assert routes == {("POST", "/orders", "module:py.api#create"), ("POST", "/orders/{id}", "com.acme.OrderController#place"), ("GET", "/open", "module:web.app#<anonymous@5>"), ("POST", "/go", "module:web.app#go")}
    assert {("com.acme.Checkout", "com.acme.Payment"), ("com.acme.OrderController", "com.acme.Checkout"), ("module:py.api#create", "module:py.api#get_service")} <= edges(graph, "INJECTS")
    assert ("py.service.Service#check", "py.service.Base#save") in edges(graph, "REFLECTS")
    assert ("com.acme.CardPayment", "com.acme.Payment") in edges(graph, "IMPLEMENTS") and ("py.service.Service", "py.service.Base") in edges(graph, "EXTENDS")
    entry = {r.id: r.entry_point_kind for r in graph.nodes.filter("entry_point").collect()}
    assert entry["module:py.api#create"] == "http" and entry["module:py.api#get_service"] == "cli" and entry["module:web.app#go"] == "http"


def test_tools(graph):
    assert len(TOOLS) == 27
    assert call(graph, "get_callers", symbol="com.acme.Payment#pay", limit=10)["rows"].first().id == "com.acme.Checkout#checkout"
    miss = call(graph, "get_callers", symbol="Checkout#chekout")
    assert not miss["ok"] and isinstance(miss["suggestions"], list)
    assert not call(graph, "get_callers", symbol="com.acme.Payment#pay", limit=501)["ok"]
    assert not call(graph, "nothing")["ok"] and not call(graph, "change_impact")["ok"] and not call(graph, "get_subgraph", symbol="x", edge_kinds=["NO"])["ok"]
    page = call(graph, "find_entry_points", max_tokens=100)["rows"].collect()
    assert page and page[0].next_cursor is not None


def test_incremental(store, tree, spark):
    assert store.crawl_project(str(tree))["rebuilt"] is False
    os.utime(tree / "web/store.ts", (1, 1))
    (tree / "py/service.py").write_text(FILES["py/service.py"] + "\ndef more():\n    return helper(2)\n")
    out = store.crawl_project(str(tree))
    assert (out["updated"], out["touched"], out["removed"]) == (1, 1, 0)
    assert ("module:py.service#more", "module:py.service#helper") in edges(store.graph(), "CALLS")
    os.remove(tree / "web/app.ts")
    assert store.crawl_project(str(tree), CrawlOptions(language="python"))["removed"] == 0
    assert store.crawl_project(str(tree))["removed"] == 1
    assert store.graph().nodes.filter("id = 'module:web.app#go'").count() == 0
    with pytest.raises(ValueError):
        store.crawl_project("/elsewhere")


def test_large_files_and_force(spark, tree):
    out = {r.path: r.status for r in crawl(spark, str(tree), None, CrawlOptions(max_file_bytes=100)).collect()}
    assert out["py/api.py"] == "too-large" and out["web/store.ts"] == "added"


def test_merges(graph, spark):
    g = Store.remove_file(graph, "web/store.ts")
    assert g.violations().count() == 0 and g.nodes.filter("id = 'web.store.Store'").count() == 0
    left = Store.prune_orphans(g)
    assert left.nodes.count() <= g.nodes.count()
    marked = Store.mark_entry_point(graph, spark.createDataFrame([("com.acme.Audit#before", "cli")], "id string, entry_point_kind string"))
    assert marked.nodes.filter("id = 'com.acme.Audit#before'").first().entry_point
    both = Store.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, "c")]


def test_watching(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    g()\n\ndef g():\n    pass\n")
    s = Store(spark, str(tmp_path / "store"))
    watch(spark, str(root), s, str(tmp_path / "check"), once=True).awaitTermination(120)
    assert ("module:a#f", "module:a#g") in edges(s.graph(), "CALLS")


@pytest.mark.parametrize("text, language", [("class {", "java"), ("}}}}", "typescript"), ("", "java"), ("'unclosed", "typescript"), ("class A<T extends B<T>> { <R> R f(", "java"), ("﻿", "python"), ("x = (" * 50, "python")])
def test_odd_sources_do_not_stop_a_crawl(text, language):
    parsed, error = parse_text(text, "m", language)
    assert (parsed is None) != (error is None)


def test_relative_imports_of_a_package():
    from strandline.sources.parse_python import parse

    modules = lambda text, module, package: [(i["module"], i["fqn"]) for i in parse(text, module, package)["imports"]]
    assert modules("from .a import b", "pkg", True) == [("pkg.a", "pkg.a.b")]
    assert modules("from .a import b", "pkg.mod", False) == [("pkg.a", "pkg.a.b")]
    assert modules("from . import b", "pkg.sub", True) == [("pkg.sub", "pkg.sub.b")]
    assert modules("from ..a import b", "pkg.sub", True) == [("pkg.a", "pkg.a.b")]
    assert modules("from .a import b", "mod", False) == [("a", "a.b")]


def test_named_pointcuts_advise_and_project_files_are_ignored(spark, tmp_path):
    root = tmp_path / "p"
    for name, text in {
        "A.java": 'package a;\nclass Shop { public void sell() {} public void close() {} }\n',
        "B.java": 'package a;\n@Aspect\nclass Audit {\n  @Pointcut("execution(* a.Shop.sell(..))")\n  public void selling() {}\n  @Before("selling()")\n  public void before() {}\n}\n',
        "gen/C.java": "package a;\nclass Gen {}\n", "old/D.java": "package a;\nclass Old {}\n", ".gitignore": "# made\ngen/\n", ".strandline.json": '{"exclude": ["old/*"]}',
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    s = Store(spark, str(tmp_path / "s"))
    s.crawl_project(str(root))
    g = s.graph()
    assert edges(g, "ADVISES") == {("a.Audit#before", "a.Shop#sell")}
    assert {r.path for r in s.manifest().collect()} == {"A.java", "B.java"}
    (root / "A.java").write_text("package a;\nclass Shop { public void sell() {} }\n")
    s.crawl_project(str(root))
    held = lambda: len([x for x in os.listdir(tmp_path / "s") if x != "meta"])
    assert held() == 2
    s._drop_old(1)
    assert held() == 1 and s.graph().nodes.filter("id = 'a.Shop#sell'").count() == 1
