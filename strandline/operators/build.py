"""Parsed files to the property graph: declarations, wiring, resolved calls, derived edges. Joins throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.derive import advice_edges, channel_edges, dispatch_edges, external_package_of
from strandline.operators.traversal import ancestors
from strandline.session import EDGE_COLUMNS, NODE_COLUMNS, GraphSession
from strandline.sources.rules import DECORATORS, LISTENER_ANNOTATIONS, PUBLISH_CALLS, PYTHON_BUILTINS, SCRIPT_GLOBALS, TRANSACTIONAL_PHASE
from strandline.sources.type_text import BUILTIN_TYPES

# How sure each way of resolving a call is.
CONFIDENCE = {"constructor": 1.0, "default constructor": 0.9, "self": 0.95, "typed": 1.0, "new": 0.85, "module": 0.9, "imported function": 0.85, "external": 0.8}
INHERITED = 0.9
AMBIGUOUS = 0.6
#: Literals by their look, and the type of each.
LITERALS = {r'^"(?:[^"\\]|\\.)*"$': "String", r"^'(?:[^'\\]|\\.)'$": "char", r"^(?:true|false)$": "boolean", r"^-?\d[\d_]*[lL]$": "long", r"^-?(?:\d[\d_]*|0[xX][0-9a-fA-F_]+)$": "int", r"^-?(?:\d[\d_]*)?\.?\d+(?:[eE][+-]?\d+)?[dDfF]?$": "double"}
# The parameter types that a literal's type converts to by itself.
WIDENS_TO = {
    "int": ("long", "double", "float", "Integer", "Long", "Number", "Object"), "long": ("double", "float", "Long", "Number", "Object"), "double": ("float", "Double", "Number", "Object"),
    "char": ("int", "Character", "Object"), "boolean": ("Boolean", "Object"), "String": ("CharSequence", "Object"),
}
#: How sure an injection's provider is, and a route's handler.
INJECT_PROVIDER, INJECT_UNIQUE, INJECT_EXTERNAL, INJECT_NONE = 1.0, 0.95, 0.8, 0.0
ROUTE_DIRECT, ROUTE_SCOPED, ROUTE_AMBIGUOUS = 1.0, 0.85, 0.6


def _rows(parsed: DataFrame, name: str) -> DataFrame:
    return parsed.select("file_path", "language", "module_id", "package", F.posexplode(name).alias("ordinal", "x")).select("file_path", "language", "module_id", "package", "ordinal", "x.*")


def nodes_frame(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in NODE_COLUMNS.items()])


def edges_frame(df: DataFrame, **columns: Column) -> DataFrame:
    extra = {"alternatives": "array<string>", "conditional": "boolean", "framework": "string", "control_flow": "array<string>", "guards": "array<string>"}
    return df.select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in {**EDGE_COLUMNS, **extra}.items()])


def declaration_nodes(parsed: DataFrame) -> DataFrame:
    t, m, f = (_rows(parsed, k) for k in ("types", "methods", "fields"))
    c = F.col
    out = nodes_frame(parsed, id=c("file_path"), kind=F.lit("file"), qualified_name=c("file_path"), name=F.substring_index("file_path", "/", -1), file_path=c("file_path"))
    module = parsed.filter("language <> 'java'")
    out = out.union(nodes_frame(module, id=F.concat(F.lit("module:"), "module_id"), kind=F.lit("module"), qualified_name=c("module_id"), name=F.substring_index("module_id", ".", -1), file_path=c("file_path")))
    package = parsed.filter("language = 'java' AND package <> ''").select("package").distinct()
    out = out.union(nodes_frame(package, id=c("package"), kind=F.lit("package"), qualified_name=c("package"), name=F.substring_index("package", ".", -1)))
    out = out.union(nodes_frame(t, id=c("id"), kind=c("kind"), qualified_name=c("id"), name=c("name"), file_path=c("file_path"), start_line=c("start_line"), end_line=c("end_line")))
    kind = F.when(c("is_constructor"), "constructor").otherwise("method")
    out = out.union(nodes_frame(m, id=c("id"), kind=kind, qualified_name=c("id"), name=c("name"), file_path=c("file_path"), start_line=c("start_line"), end_line=c("end_line"), entry_point=c("entry_kind").isNotNull(), entry_point_kind=c("entry_kind"), advice_kind=c("advice_kind"), proxy=F.array_join("proxies", ",")))
    out = out.union(nodes_frame(f, id=c("id"), kind=F.lit("field"), qualified_name=c("id"), name=c("name"), file_path=c("file_path"), start_line=c("start_line"), end_line=c("start_line")))
    note = _annotations(parsed).select("annotation").distinct()
    out = out.union(nodes_frame(note, id=F.concat(F.lit("@"), "annotation"), kind=F.lit("annotation"), qualified_name=c("annotation"), name=F.substring_index("annotation", ".", -1)))
    imports = _rows(parsed, "imports").select("fqn").distinct()
    return out.union(nodes_frame(imports, id=F.concat(F.lit("__import__:"), "fqn"), kind=F.lit("import"), qualified_name=c("fqn"), name=F.substring_index("fqn", ".", -1)))


def _annotations(parsed: DataFrame) -> DataFrame:
    """(id, annotation, line) of everything annotated."""
    parts = [_rows(parsed, k).select("id", F.explode("annotations").alias("a")) for k in ("types", "methods", "fields")]
    out = parts[0].union(parts[1]).union(parts[2])
    return out.select("id", F.col("a.name").alias("annotation"), F.col("a.line").alias("line"), F.col("a.arguments").alias("arguments"))


def type_names(parsed: DataFrame) -> DataFrame:
    """(file_path, name, type_id, tier): what a type's name means in a file, the nearest meaning first."""
    t = _rows(parsed, "types").select(F.col("id").alias("type_id"), F.col("name").alias("name"), "file_path", "package", "module_id")
    files = parsed.select("file_path", "package")
    own = t.select("file_path", "name", "type_id", F.lit(0).alias("tier"))
    imports = _rows(parsed, "imports").select("file_path", "simple_name", "fqn")
    imported = imports.join(t.select("type_id"), imports.fqn == F.col("type_id")).select("file_path", F.col("simple_name").alias("name"), "type_id", F.lit(1).alias("tier"))
    star = _rows(parsed, "imports").filter("simple_name = '*'").select("file_path", "module")
    by_star = star.join(t.select("name", "type_id", "module_id", "package"), (F.col("module") == F.col("module_id")) | (F.col("module") == F.col("package"))).select("file_path", "name", "type_id", F.lit(3).alias("tier"))
    near = files.join(t.filter("package <> ''").select("package", "name", "type_id"), "package").select("file_path", "name", "type_id", F.lit(2).alias("tier"))
    return own.union(imported).union(near).union(by_star).groupBy("file_path", "name").agg(F.min_by(F.struct("type_id", "tier"), F.struct("tier", "type_id")).alias("x")).select("file_path", "name", "x.type_id", "x.tier")


def resolve_types(wanted: DataFrame, parsed: DataFrame, column: str, out: str) -> DataFrame:
    """wanted (file_path, column, ...) with the type's id in `out`: an id itself, a name in scope, or a name that only one type has."""
    t = _rows(parsed, "types")
    ids = t.select(F.col("id").alias("_id")).distinct()
    unique = t.groupBy(F.col("name").alias("_name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("_unique")).filter("n = 1").drop("n")
    scope = type_names(parsed).select(F.col("file_path").alias("_f"), F.col("name").alias("_s"), F.col("type_id").alias("_scoped"))
    simple = F.substring_index(F.col(column), ".", -1)
    w = wanted.join(ids, F.col(column) == F.col("_id"), "left").join(scope, (wanted.file_path == F.col("_f")) & (F.col(column) == F.col("_s")), "left").join(unique, simple == F.col("_name"), "left")
    return w.withColumn(out, F.coalesce("_id", "_scoped", "_unique")).drop("_id", "_f", "_s", "_scoped", "_name", "_unique")


def hierarchy_edges(parsed: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS between known types; names that mean no type here are dropped."""
    t = _rows(parsed, "types")
    up = t.select("file_path", "id", F.explode("parents").alias("parent"), F.lit("EXTENDS").alias("kind")).union(t.select("file_path", "id", F.explode("interfaces").alias("parent"), F.lit("IMPLEMENTS").alias("kind")))
    return resolve_types(up, parsed, "parent", "target").filter("target IS NOT NULL AND target <> id").select(F.col("id").alias("source"), "target", "kind").distinct()


def declaration_edges(parsed: DataFrame) -> DataFrame:
    c = F.col
    t, m, f = (_rows(parsed, k) for k in ("types", "methods", "fields"))
    module = F.concat(F.lit("module:"), "module_id")
    out = edges_frame(t, source=c("file_path"), target=c("id"), kind=F.lit("CONTAINS"), line=c("start_line"))
    out = out.union(edges_frame(t, source=c("id"), target=c("file_path"), kind=F.lit("DECLARED_IN"), line=c("start_line")))
    out = out.union(edges_frame(t.filter("language = 'java' AND package <> ''"), source=c("package"), target=c("id"), kind=F.lit("CONTAINS")))
    out = out.union(edges_frame(t.filter("language <> 'java'"), source=module, target=c("id"), kind=F.lit("CONTAINS")))
    for part in (m, f):
        out = out.union(edges_frame(part, source=c("type_id"), target=c("id"), kind=F.lit("CONTAINS"), line=c("start_line")))
    out = out.union(edges_frame(_rows(parsed, "imports"), source=c("file_path"), target=F.concat(F.lit("__import__:"), "fqn"), kind=F.lit("IMPORTS")))
    out = out.union(edges_frame(_annotations(parsed), source=c("id"), target=F.concat(F.lit("@"), "annotation"), kind=F.lit("ANNOTATED_WITH"), line=c("line"), arguments=F.array_join("arguments", ", "), decorator=c("annotation").isin(*DECORATORS) | F.substring_index("annotation", ".", -1).isin(*DECORATORS)))
    return out.union(edges_frame(hierarchy_edges(parsed), source=c("source"), target=c("target"), kind=c("kind")))


def simple_type(text: Column) -> Column:
    """A type's own name, without its package, arguments and dimensions."""
    return F.element_at(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[<\[(].*$|\.\.\.$", "")), r"\."), -1)


def argument_type(text: Column) -> Column:
    """The type of an argument that is a literal, a construction or a cast; null for all else."""
    t = F.trim(text)
    made = F.coalesce(F.nullif(F.regexp_extract(t, r"^new\s*([A-Z][\w.$]*)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^\(\s*([A-Za-z][\w.]*)\s*\)\s*[\w\"'(]", 1), F.lit("")))
    kind = F.when(made.isNotNull(), simple_type(made))
    for pattern, name in LITERALS.items():
        kind = kind.when(t.rlike(pattern), F.lit(name))
    return kind


def overload_score(types: Column, hints: Column) -> Column:
    """Over the arguments whose type is known: 2 for an equal parameter type, 1 for one that it widens to."""
    wide = F.create_map(*[x for name, to in WIDENS_TO.items() for x in (F.lit(name), F.array(*map(F.lit, to)))])
    one = lambda p: F.when(p["hints"].isNull() | p["types"].isNull(), 0).when(p["types"] == p["hints"], 2).when(F.coalesce(F.array_contains(F.try_element_at(wide, p["hints"]), p["types"]), F.lit(False)), 1).otherwise(0)
    return F.aggregate(F.arrays_zip(types.alias("types"), hints.alias("hints")), F.lit(0), lambda n, p: n + one(p))


def resolve_calls(parsed: DataFrame, up: DataFrame) -> DataFrame:
    """One row a call site: caller, target, resolved, confidence, reason, alternatives, conditional, line, ordinal.

    A call's receiver names a type (by declaration, field, parameter, construction or itself), the enclosing type or
    its parents; bare names are members of the enclosing type or module, or imported functions. Among the members of
    that name the nearest ancestor wins, then equal arity, then the types of literal arguments, then the first declared;
    ties cap the confidence.
    """
    m = _rows(parsed, "methods").select(F.col("id").alias("mid"), "type_id", "name", F.size("params").alias("arity"), F.transform("params", lambda p: simple_type(p["type"])).alias("types"), F.coalesce("optional", F.lit(0)).alias("optional"), F.coalesce("variadic", F.lit(False)).alias("variadic"), "ordinal")
    calls = _rows(parsed, "calls").withColumn("caller", F.coalesce("method_id", "type_id")).withColumn("n_args", F.size("arguments")).withColumn("hints", F.transform("arguments", argument_type))
    calls = calls.select("file_path", "language", "module_id", "ordinal", "line", "receiver", "receiver_type", "name", "n_args", "hints", "type_id", "caller", "is_constructor", "control_flow", "guards")
    site = ["file_path", "ordinal"]
    in_type = ~F.col("type_id").startswith("module:")
    new = F.col("receiver_type").startswith("new:")
    typed = F.when(F.col("is_constructor"), F.col("name")).when(new, F.substr("receiver_type", F.lit(5))).when((F.col("receiver_type") == "super") | (F.col("receiver_type") == F.col("type_id")), F.col("type_id")).otherwise(F.col("receiver_type"))
    want = resolve_types(calls.withColumn("wanted", typed), parsed, "wanted", "named")
    bare = F.col("receiver").isNull() & ~F.col("is_constructor")
    want = want.withColumn("start", F.when(bare, F.col("type_id")).otherwise(F.col("named"))).withColumn("member", F.when(F.col("is_constructor"), "<init>").otherwise(F.col("name")))
    way = F.when(F.col("is_constructor"), "constructor").when(new, "new").when(bare & ~in_type, "module").when(bare | (F.col("receiver_type") == "super") | (F.col("receiver_type") == F.col("type_id")), "self").otherwise("typed")
    want = want.withColumn("way", way)
    reach = up.select("type", "ancestor", "depth").union(_rows(parsed, "types").select(F.col("id").alias("type"), F.col("id").alias("ancestor"), F.lit(0).alias("depth"))).union(parsed.filter("language <> 'java'").select(F.concat(F.lit("module:"), "module_id").alias("type"), F.concat(F.lit("module:"), "module_id").alias("ancestor"), F.lit(0).alias("depth")))
    hit = want.join(reach, want.start == reach.type).filter((F.col("receiver_type").isNull() | (F.col("receiver_type") != "super")) | (F.col("depth") > 0))
    hit = hit.filter((F.col("way") != "constructor") | (F.col("depth") == 0))
    hit = hit.join(m.select("mid", F.col("type_id").alias("ancestor"), F.col("name").alias("member"), "arity", "optional", "variadic", "types", F.col("ordinal").alias("decl")), ["ancestor", "member"])
    # a bare call in a type may mean a function of its module
    outer = want.filter(bare & in_type & (F.col("language") != "java")).withColumn("ancestor", F.concat(F.lit("module:"), "module_id")).withColumn("type", F.col("ancestor")).withColumn("depth", F.lit(50))
    outer = outer.withColumn("way", F.lit("module")).join(m.select("mid", F.col("type_id").alias("ancestor"), F.col("name").alias("member"), "arity", "optional", "variadic", "types", F.col("ordinal").alias("decl")), ["ancestor", "member"])
    imports = _rows(parsed, "imports").filter("imported_name IS NOT NULL").select(F.col("file_path").alias("_f"), F.col("simple_name").alias("_n"), F.concat(F.lit("module:"), "module").alias("ancestor"), "imported_name")
    from_import = want.filter(bare).join(imports, (want.file_path == F.col("_f")) & (want.name == F.col("_n"))).drop("_f", "_n").withColumn("member", F.col("imported_name")).drop("imported_name").withColumn("type", F.col("ancestor")).withColumn("depth", F.lit(60)).withColumn("way", F.lit("imported function"))
    from_import = from_import.join(m.select("mid", F.col("type_id").alias("ancestor"), F.col("name").alias("member"), "arity", "optional", "variadic", "types", F.col("ordinal").alias("decl")), ["ancestor", "member"])
    star = _rows(parsed, "imports").filter("simple_name = '*'").select(F.col("file_path").alias("_f"), F.concat(F.lit("module:"), "module").alias("ancestor")).distinct()
    from_star = want.filter(bare).join(star, want.file_path == F.col("_f")).drop("_f").withColumn("type", F.col("ancestor")).withColumn("depth", F.lit(70)).withColumn("way", F.lit("imported function"))
    from_star = from_star.join(m.select("mid", F.col("type_id").alias("ancestor"), F.col("name").alias("member"), "arity", "optional", "variadic", "types", F.col("ordinal").alias("decl")), ["ancestor", "member"])
    modules = _rows(parsed, "imports").select(F.col("file_path").alias("_f"), F.col("simple_name").alias("_n"), F.concat(F.lit("module:"), "fqn").alias("ancestor"))
    by_module = want.filter(F.col("receiver").isNotNull() & F.col("named").isNull()).join(modules, (want.file_path == F.col("_f")) & (want.receiver == F.col("_n"))).drop("_f", "_n").withColumn("type", F.col("ancestor")).withColumn("depth", F.lit(0)).withColumn("way", F.lit("module"))
    by_module = by_module.join(m.select("mid", F.col("type_id").alias("ancestor"), F.col("name").alias("member"), "arity", "optional", "variadic", "types", F.col("ordinal").alias("decl")), ["ancestor", "member"])
    found = hit.unionByName(outer).unionByName(from_import).unionByName(from_star).unionByName(by_module)
    fit = F.when((F.col("arity") == F.col("n_args")) & ~F.col("variadic"), 0).when(F.col("variadic") & (F.col("n_args") >= F.col("arity") - 1), 1).when((F.col("n_args") < F.col("arity")) & (F.col("n_args") >= F.col("arity") - F.col("optional")), 1).when(F.col("arity") > F.col("n_args"), 3).otherwise(4)
    found = found.withColumn("cand", F.struct("depth", fit.alias("fit"), (-overload_score(F.col("types"), F.col("hints"))).alias("unlike"), "decl", "mid", "way"))
    best = found.groupBy(*site).agg(F.sort_array(F.collect_list("cand")).alias("c"))
    best = best.select(*site, F.col("c")[0].alias("b"), F.transform(F.filter("c", lambda x: (x["depth"] == F.col("c")[0]["depth"]) & (x["fit"] == F.col("c")[0]["fit"]) & (x["unlike"] == F.col("c")[0]["unlike"])), lambda x: x["mid"]).alias("ties"))
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    base = F.element_at(table, F.col("b.way")) * F.when((F.col("b.depth") > 0) & (F.col("b.depth") < 50), INHERITED).otherwise(1.0)
    tied = F.size("ties") > 1
    chosen = best.select(*site, F.col("b.mid").alias("target"), F.round(F.when(tied, F.least(base, F.lit(AMBIGUOUS))).otherwise(base), 2).alias("confidence"), F.when(tied, F.slice("ties", 2, 20)).alias("alternatives"))
    every = want.join(chosen, site, "left")
    default = F.col("target").isNull() & F.col("is_constructor") & F.col("named").isNotNull()
    builtin = F.col("target").isNull() & ((bare & (F.col("language") == "python") & F.col("name").isin(*PYTHON_BUILTINS)) | ((F.col("language") != "python") & (F.col("language") != "java") & F.substring_index(F.coalesce("receiver", "name"), ".", 1).isin(*SCRIPT_GLOBALS)))
    outside = _rows(parsed, "imports").select(F.col("file_path").alias("_f"), F.col("simple_name").alias("_n"), F.col("module").alias("_module"), "fqn").join(parsed.select(F.col("module_id").alias("_known")).distinct(), F.col("_module") == F.col("_known"), "left_anti")
    head = F.substring_index(F.coalesce("receiver", "name"), ".", 1)
    every = every.join(outside.groupBy("_f", "_n").agg(F.min("_module").alias("_module")), (every.file_path == F.col("_f")) & (head == F.col("_n")), "left")
    external = F.col("target").isNull() & F.col("_module").isNotNull() & F.col("named").isNull()
    label = F.concat_ws(".", "receiver", "name")
    target = F.when(F.col("target").isNotNull(), F.col("target")).when(default, F.concat("named", F.lit("#<init>"))).when(external, F.concat(F.lit("ext:"), external_package_of(F.col("_module")))).when(builtin, F.concat(F.lit("ext:"), F.col("language"))).otherwise(F.concat(F.lit("__unknown__:"), label))
    kind = F.when(F.col("target").isNotNull(), "resolved").when(default, "default").when(external | builtin, "external").otherwise("unknown")
    reason = F.when(F.col("named").isNotNull(), F.concat(F.lit("no such member of "), "named")).when(F.col("receiver").isNotNull(), "unknown receiver type").otherwise("unknown function")
    return every.select(
        "file_path", "language", "caller", target.alias("target"), kind.alias("outcome"), "line", "ordinal", F.when(kind == "unknown", 0.0).when(kind == "external", CONFIDENCE["external"]).when(kind == "default", CONFIDENCE["default constructor"]).otherwise(F.col("confidence")).alias("confidence"),
        F.when(kind == "unknown", reason).alias("reason"), "alternatives", (F.array_contains("control_flow", "branch") | F.array_contains("control_flow", "exception")).alias("conditional"), "named", "name", "receiver", "control_flow", "guards",
    )


def call_graph(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes that calls bring in, CALLS edges): of several sites of one pair the last one stays."""
    c = F.col
    last = calls.groupBy("caller", "target").agg(F.max_by(F.struct("outcome", "line", "confidence", "reason", "alternatives", "conditional", "named", "file_path", "control_flow", "guards"), F.struct("line", "ordinal")).alias("x")).select("caller", "target", "x.*")
    sure = (c("confidence") < 1) | (c("outcome") == "unknown")
    edges = edges_frame(last, source=c("caller"), target=c("target"), kind=F.lit("CALLS"), line=c("line"), resolved=c("outcome") != "unknown", confidence=F.when(sure, c("confidence")), reason=c("reason"), alternatives=c("alternatives"), conditional=c("conditional"), control_flow=c("control_flow"), guards=c("guards"))
    ctor = last.filter("outcome = 'default'")
    edges = edges.union(edges_frame(ctor.select("named", "target").distinct(), source=c("named"), target=c("target"), kind=F.lit("CONTAINS")))
    new = nodes_frame(ctor.select("target").distinct(), id=c("target"), kind=F.lit("constructor"), qualified_name=c("target"), name=F.lit("<init>"))
    new = new.union(nodes_frame(last.filter("outcome = 'external'").select("target").distinct(), id=c("target"), kind=F.lit("external_symbol"), qualified_name=F.regexp_replace("target", "^ext:", ""), name=F.regexp_replace("target", "^ext:", "")))
    return new.union(nodes_frame(last.filter("outcome = 'unknown'").select("target").distinct(), id=c("target"), kind=F.lit("unknown_symbol"), qualified_name=F.regexp_replace("target", "^__unknown__:", ""), name=F.substring_index("target", ".", -1))), edges


def wiring(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of external references, injections, reflection and routes."""
    c = F.col
    known = parsed.select(c("module_id").alias("_m")).distinct()
    types = _rows(parsed, "types").select(c("id").alias("_t"))
    ext = _rows(parsed, "imports").join(known, c("module") == c("_m"), "left_anti").join(types, c("fqn") == c("_t"), "left_anti").select("file_path", F.concat(F.lit("ext:"), external_package_of(c("module"))).alias("target")).distinct()
    edges = edges_frame(ext, source=c("file_path"), target=c("target"), kind=F.lit("REFERENCES"))
    nodes = nodes_frame(ext.select("target").distinct(), id=c("target"), kind=F.lit("external_symbol"), qualified_name=F.regexp_replace("target", "^ext:", ""), name=F.regexp_replace("target", "^ext:", ""))
    m = _rows(parsed, "methods").select(c("id").alias("mid"), c("name").alias("mname"), "type_id", c("file_path").alias("mfile"), c("module_id").alias("mmodule"))
    builtin = c("type").isin(*BUILTIN_TYPES) | c("type").rlike(r"[{}()=>]")
    inj = resolve_types(_rows(parsed, "injections").filter("type IS NOT NULL").filter(~builtin), parsed, "type", "provider")
    fn = m.filter(c("type_id").startswith("module:")).groupBy(c("mname")).agg(F.min("mid").alias("function"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    out = _rows(parsed, "imports").join(known, c("module") == c("_m"), "left_anti").groupBy(c("file_path").alias("_f"), c("simple_name").alias("_n")).agg(F.min("module").alias("_from"))
    inj = inj.join(fn, inj.type == c("mname"), "left").join(out, (inj.file_path == c("_f")) & (inj.type == c("_n")), "left")
    inj = inj.withColumn("target", F.coalesce("provider", "function", F.concat(F.lit("ext:"), external_package_of(c("_from"))), F.concat(F.lit("__inject__:"), "type")))
    sure = F.when(c("provider").isNotNull(), INJECT_UNIQUE).when(c("function").isNotNull(), INJECT_PROVIDER).when(c("_from").isNotNull(), INJECT_EXTERNAL).otherwise(INJECT_NONE)
    edges = edges.union(edges_frame(inj, source=c("owner_id"), target=c("target"), kind=F.lit("INJECTS"), line=c("line"), confidence=sure, framework=c("framework"), resolved=sure > 0))
    nodes = nodes.union(nodes_frame(inj.filter(c("target").startswith("__inject__:")).select("target").distinct(), id=c("target"), kind=F.lit("unknown_symbol"), qualified_name=c("target"), name=c("target")))
    ref = resolve_types(_rows(parsed, "reflections").filter("target IS NOT NULL AND owner_id IS NOT NULL"), parsed, "target", "found")
    ref = ref.join(m.groupBy("mname").agg(F.min("mid").alias("method"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n"), ref.target == c("mname"), "left").withColumn("to", F.coalesce("found", "method", F.concat(F.lit("__reflect__:"), "target")))
    sure = F.when(c("found").isNotNull(), 0.9).when(c("method").isNotNull(), 0.6).otherwise(0.0)
    edges = edges.union(edges_frame(ref, source=c("owner_id"), target=c("to"), kind=F.lit("REFLECTS"), line=c("line"), confidence=sure, resolved=sure > 0))
    nodes = nodes.union(nodes_frame(ref.filter(c("to").startswith("__reflect__:")).select("to").distinct(), id=c("to"), kind=F.lit("unknown_symbol"), qualified_name=c("to"), name=c("to")))
    r = _rows(parsed, "routes")
    site = ["file_path", "module_id", "handler", "http_method", "path", "line", "framework"]
    there = [*(r[x] for x in site), c("mid")]
    tier = lambda df, n, sure: df.select(*there, F.lit(n).alias("tier"), F.lit(sure).alias("sure"))
    by_id = tier(r.join(m.select("mid"), r.handler == c("mid")), 0, ROUTE_DIRECT)
    in_module = tier(r.join(m, (r.handler == c("mname")) & (c("type_id") == F.concat(F.lit("module:"), r.module_id))), 1, ROUTE_DIRECT)
    in_file = tier(r.join(m, (r.handler == c("mname")) & (r.file_path == c("mfile"))), 2, ROUTE_DIRECT)
    named = _rows(parsed, "imports").filter("imported_name IS NOT NULL").select(c("file_path").alias("_f"), c("simple_name").alias("_n"), F.concat(F.lit("module:"), "module").alias("_owner"), c("imported_name").alias("_is"))
    imported = tier(r.join(named, (r.file_path == c("_f")) & (r.handler == c("_n"))).join(m, (c("type_id") == c("_owner")) & (c("mname") == c("_is"))), 3, ROUTE_SCOPED)
    found = by_id.union(in_module).union(in_file).union(imported).distinct()
    best = found.groupBy(*site).agg(F.min("tier").alias("best"))
    ranked = found.join(best.select(*[c(x).alias(f"_{x}") for x in site], "best"), F.expr(" AND ".join(f"{x} <=> _{x}" for x in site))).filter("tier = best")
    hit = ranked.groupBy(*site).agg(F.min("mid").alias("mid"), F.min("sure").alias("sure"), F.count(F.lit(1)).alias("n")).withColumn("confidence", F.when(c("n") > 1, F.least(c("sure"), F.lit(ROUTE_AMBIGUOUS))).otherwise(c("sure")))
    source = F.when(F.col("file_path").endswith(".java"), F.col("file_path")).otherwise(F.concat(F.lit("module:"), "module_id"))
    edges = edges.union(edges_frame(hit, source=source, target=c("mid"), kind=F.lit("ROUTES"), line=c("line"), confidence=c("confidence"), http_method=c("http_method"), path=c("path"), framework=c("framework")))
    return nodes, edges


def channels(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(publishers, listeners) as channel_edges() takes them."""
    m = _rows(parsed, "methods")
    note = m.select("file_path", "id", "params", F.explode("annotations").alias("a"))
    kinds = F.create_map(*[F.lit(x) for kv in LISTENER_ANNOTATIONS.items() for x in kv])
    lis = note.withColumn("channel_kind", F.element_at(kinds, F.col("a.name"))).filter("channel_kind IS NOT NULL")
    text = F.regexp_extract(F.array_join("a.arguments", " "), "[\"'`]([^\"'`]+)[\"'`]", 1)
    lis = lis.withColumn("channel", F.when(F.col("channel_kind") == "event", F.when(F.size("params") > 0, F.col("params")[0]["type"])).otherwise(F.nullif(text, F.lit(""))))
    phase = F.when(F.col("a.name") == "TransactionalEventListener", F.coalesce(F.nullif(F.regexp_extract(F.array_join("a.arguments", " "), r"TransactionPhase\.(\w+)", 1), F.lit("")), F.lit(TRANSACTIONAL_PHASE)))
    lis = resolve_types(lis.filter("channel IS NOT NULL"), parsed, "channel", "qualified").select(F.col("id").alias("owner"), "channel_kind", "channel", "qualified", phase.alias("phase"))
    sends = F.create_map(*[F.lit(x) for kv in PUBLISH_CALLS.items() for x in kv])
    pub = _rows(parsed, "calls").filter("method_id IS NOT NULL AND receiver IS NOT NULL AND size(arguments) > 0").withColumn("channel_kind", F.element_at(sends, F.col("name"))).filter("channel_kind IS NOT NULL")
    first = F.col("arguments")[0]
    made = F.regexp_extract(first, r"^new\s*([A-Z]\w*)", 1)
    literal = F.regexp_extract(first, "^[\"'`]([^\"'`]+)[\"'`]$", 1)
    pub = pub.withColumn("channel", F.nullif(F.when(F.col("channel_kind") == "event", made).otherwise(literal), F.lit(""))).filter("channel IS NOT NULL")
    pub = resolve_types(pub, parsed, "channel", "qualified").select(F.col("method_id").alias("owner"), "channel_kind", "channel", "qualified", F.lit(None).cast("string").alias("phase"))
    return pub, lis


def named_pointcuts(methods: DataFrame) -> DataFrame:
    """(name, expression) of the methods that only name a pointcut; of equal names the first by id."""
    note = F.filter("annotations", lambda a: a["name"] == "Pointcut")
    found = methods.select("id", "name", F.get(note, 0)["arguments"].alias("given")).filter("given IS NOT NULL")
    text = F.array_join(F.regexp_extract_all(F.array_join("given", " "), F.lit(r'"((?:[^"\\\\]|\\\\.)*)"'), 1), "")
    return found.groupBy("name").agg(F.min_by(text, "id").alias("expression"))


def build_graph(parsed: DataFrame) -> GraphSession:
    """The whole graph of parsed files; of equal keys the first declared stays, edges to nowhere are dropped."""
    from strandline.functions.lineage import settle

    parsed = settle(parsed)
    up = ancestors(GraphSession(parsed.sparkSession.createDataFrame([], "id string"), hierarchy_edges(parsed)))
    calls = settle(resolve_calls(parsed, up))
    call_nodes, call_edges = call_graph(calls)
    wire_nodes, wire_edges = wiring(parsed)
    m = _rows(parsed, "methods")
    t = _rows(parsed, "types").select(F.col("id").alias("type_id"), F.transform("annotations", lambda a: a["name"]).alias("type_annotations"))
    methods = m.select("id", "type_id", "name", F.size("params").alias("arity"), "ordinal", F.coalesce("modifiers", F.array()).cast("array<string>").alias("modifiers"), F.transform("annotations", lambda a: a["name"]).alias("annotations"))
    c = F.col
    dispatch = dispatch_edges(calls.select("target", (c("outcome") == "resolved").alias("resolved")), methods, up)
    given = m.filter("advice_kind IS NOT NULL").select(c("id").alias("advice"), "advice_kind", F.coalesce("pointcut", F.lit("")).alias("pointcut"))
    advised = methods.join(t, "type_id", "left").withColumn("type_annotations", F.coalesce("type_annotations", F.array().cast("array<string>")))
    advice = advice_edges(given, advised, named_pointcuts(m))
    events = channel_edges(*channels(parsed))
    derived = edges_frame(dispatch, source=c("source"), target=c("target"), kind=c("kind"), confidence=c("confidence")).union(edges_frame(advice, source=c("source"), target=c("target"), kind=c("kind"), confidence=c("confidence"))).union(edges_frame(events, source=c("source"), target=c("target"), kind=c("kind"), confidence=c("confidence"), channel=c("channel")))
    nodes = declaration_nodes(parsed).withColumn("_o", F.lit(0)).union(call_nodes.union(wire_nodes).withColumn("_o", F.lit(1)))
    best = nodes.groupBy("id").agg(F.min_by(F.struct(*[x for x in NODE_COLUMNS if x != "id"]), F.struct("_o", "kind", "qualified_name", "file_path")).alias("x")).select("id", "x.*")
    edges = declaration_edges(parsed).union(call_edges).union(wire_edges).union(derived)
    keep = edges.groupBy("source", "target", "kind").agg(F.min_by(F.struct(*[x for x in edges.columns if x not in ("source", "target", "kind")]), F.coalesce("line", F.lit(-1))).alias("x")).select("source", "target", "kind", "x.*")
    ids = best.select("id")
    keep = keep.join(ids, keep.source == ids.id, "left_semi").join(ids, keep.target == ids.id, "left_semi")
    routed = keep.filter("kind = 'ROUTES'").select(c("target").alias("id"), F.lit("http").alias("_http")).distinct()
    best = best.join(routed, "id", "left").withColumn("entry_point", F.coalesce("entry_point", F.lit(False)) | c("_http").isNotNull()).withColumn("entry_point_kind", F.coalesce("entry_point_kind", "_http")).drop("_http")
    return GraphSession(settle(best), settle(keep))
