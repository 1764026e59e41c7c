"""Lookups, search, wiring and whole-graph reports: one declarative plan each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.top import first
from strandline.operators.traversal import edge_kind_policy, resolve
from strandline.session import CALLABLE_KINDS, EDGE_KINDS, NODE_KINDS, GraphSession

K1, B = 1.2, 0.75
#: A letter that no query holds: it stands between columns, so that no phrase runs across.
BREAK = "\u01c0"
#: First parts of ids that a filter lists.
HEADS = 20

# SQL LIKE patterns of test code (any letter case), on paths with forward slashes, on paths as they
# are, and on qualified names.
TEST_DIRS = ("%/test/%", "%/tests/%", "%/__tests__/%")
TEST_FILES = ("%test\\_%.py", "%\\_test.py", "%conftest.py", "%.test.ts", "%.spec.ts", "%.test.tsx", "%.spec.tsx", "%.test.js", "%.spec.js")
TEST_NAMES = ("%Test#%", "%Tests#%", "%IT#%")


# -- lookups

def get_node(g: GraphSession, symbol: str) -> DataFrame:
    """The node with this id, else the first of this qualified name by kind and id; lines count from one."""
    hit = g.nodes.filter((F.col("id") == symbol) | (F.col("qualified_name") == symbol))
    return hit.orderBy((F.col("id") == symbol).desc(), "kind", "id").limit(1).select("id", "kind", "qualified_name", "name", "file_path", (F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"))


def file_nodes(g: GraphSession, path: str) -> DataFrame:
    return g.nodes.filter(F.col("file_path") == path).select("id", "kind", "qualified_name", "name")


def find_entry_points(g: GraphSession, kind: str | None = None, limit: int | None = 50) -> DataFrame:
    hit = g.nodes.filter("entry_point").select("id", "qualified_name", F.coalesce("entry_point_kind", F.lit("unknown")).alias("entry_kind"), "file_path")
    return (hit if kind is None else hit.filter(F.col("entry_kind") == kind)).transform(first, limit, "entry_kind", "qualified_name", "id")


def index_status(g: GraphSession) -> DataFrame:
    n = g.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files"))
    last = F.lit(g.crawled_at).cast("long").alias("last_crawl")
    return n.crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges"))).select("nodes", "edges", "files", last)


def get_schema(g: GraphSession) -> DataFrame:
    rows = [("node", k) for k in NODE_KINDS] + [("edge", k) for k in EDGE_KINDS]
    return g.spark.createDataFrame(rows, "element string, kind string")


# -- search

def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[list[str]]:
    """Up to eight terms; a term with underscores is a phrase whose last token is a prefix."""
    terms = [t for t in re.split(r"[^a-z0-9_]+", query.strip().lower()) if t][:8]
    return [p for p in ([x for x in t.split("_") if x] for t in terms) if p]


def _phrase_at(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in the tokens, its last token as a prefix."""
    def here(i: Column) -> Column:
        fits = F.lit(True)
        for k, token in enumerate(phrase):
            at = F.get(tokens, i + k)
            fits = fits & F.coalesce(at.startswith(token) if k == len(phrase) - 1 else at == token, F.lit(False))
        return fits

    return F.size(F.filter(F.sequence(F.lit(0), F.size(tokens)), here))


def _rank(q: str) -> Column:
    qn, i, name = F.lower("qualified_name"), F.lower("id"), F.lower("name")
    return F.when(qn == q, 0).when(i == q, 1).when(name == q, 2).when(qn.startswith(q), 3).when(i.startswith(q), 4).otherwise(5)


def search_full_text(g: GraphSession, query: str, kind: str | None = None, limit: int | None = 50) -> DataFrame:
    """All terms as prefixes; exact names first, then BM25 over id, qualified name and name."""
    terms = query_terms(query)
    q = query.strip().lower()
    nodes = g.nodes if kind is None else g.nodes.filter(F.col("kind") == kind)
    if not terms:
        return nodes.limit(0).select("id", "kind", "qualified_name", F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
    docs = nodes.select("id", "kind", "qualified_name", "name", _tokens(F.concat_ws(f" {BREAK} ", "id", "qualified_name", "name")).alias("t"))
    hits = docs.select("id", "kind", "qualified_name", "name", F.size(F.filter("t", lambda t: t != BREAK)).alias("dl"), *[_phrase_at(F.col("t"), p).alias(f"tf{i}") for i, p in enumerate(terms)])
    stats = hits.agg(F.count(F.lit(1)).alias("total"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    found = hits.filter(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(stats)  # stats is one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("total") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.select("id", "kind", "qualified_name", _rank(q).alias("rank"), score.alias("score")).transform(first, limit, "rank", "score", F.length("qualified_name"), "qualified_name", "id")


def search_substring(g: GraphSession, query: str, kind: str | None = None, limit: int | None = 50) -> DataFrame:
    q = query.strip().lower()
    nodes = g.nodes if kind is None else g.nodes.filter(F.col("kind") == kind)
    hit = nodes.filter(F.lower("id").contains(q) | F.lower("qualified_name").contains(q))
    return hit.select("id", "kind", "qualified_name", _rank(q).alias("rank"), F.lit(0.0).alias("score")).transform(first, limit, "rank", F.length("qualified_name"), "qualified_name", "id")


def search_symbols(g: GraphSession, query: str, kind: str | None = None, limit: int | None = 50) -> DataFrame:
    """The full-text arm, or the substring arm where that finds nothing."""
    found = search_full_text(g, query, kind, limit)
    return search_substring(g, query, kind, limit) if found.isEmpty() else found


def suggest_symbols(g: GraphSession, symbol: str, limit: int | None = 8) -> DataFrame:
    """Candidates for a symbol that was not found: search by its last part."""
    parts = [p for p in re.split(r"[.#$<>]", symbol) if len(p) > 1]
    return search_symbols(g, parts[-1] if parts else symbol[-20:], None, limit)


# -- annotations and wiring

def find_annotated(g: GraphSession, annotation: str, kind: str | None = None, limit: int | None = 50) -> DataFrame:
    name = annotation.removeprefix("@")
    a = g.nodes.filter(F.col("kind") == "annotation").filter((F.col("id") == f"@{name}") | (F.col("qualified_name") == name) | F.col("qualified_name").endswith(f".{name}") | (F.lower("name") == name.lower()))
    a = a.select(F.col("id").alias("annotation"))
    e = g.edges_of("ANNOTATED_WITH").select("source", F.col("target").alias("annotation"), "line", "arguments")
    s = g.nodes.select(F.col("id").alias("source"), "kind", "qualified_name")
    hit = e.join(a, "annotation").join(s if kind is None else s.filter(F.col("kind") == kind), "source")
    return hit.select(F.col("source").alias("id"), "kind", "qualified_name", "annotation", "line", "arguments").transform(first, limit, "qualified_name", "id", "annotation")


def get_decorators(g: GraphSession, symbol: str, include_members: bool = False) -> DataFrame:
    """(member, annotation, line, arguments, decorator): of the symbol, and of the members it contains that have any."""
    at = resolve(g, symbol)
    own = g.spark.createDataFrame([(at,)] if at else [], "member string")
    if include_members:
        inner = g.nodes.filter(F.col("kind").isin("method", "constructor", "field")).select(F.col("id").alias("member"))
        own = own.union(g.edges_of("CONTAINS").filter(F.col("source") == at).select(F.col("target").alias("member")).join(inner, "member"))
    e = g.edges_of("ANNOTATED_WITH").select(F.col("source").alias("member"), F.col("target").alias("annotation"), "line", "arguments", "decorator")
    return own.join(e, "member").orderBy("member", "annotation")


def wiring_edges(g: GraphSession, kind: str, symbol: str | None = None, limit: int | None = 50) -> DataFrame:
    """All edges of a kind with both ends, or those that touch the symbol; none for an unknown symbol."""
    e = g.edges_of(kind)
    if symbol is not None:
        at = resolve(g, symbol)
        # one end at a time, as a condition on either end reaches no table below a join
        e = e.filter(F.col("source") == at).union(e.filter((F.col("target") == at) & ~F.col("source").eqNullSafe(at))) if at else e.limit(0)
    s = g.nodes.select(F.col("id").alias("source"), F.col("qualified_name").alias("source_name"))
    t = g.nodes.select(F.col("id").alias("target"), F.col("qualified_name").alias("target_name"))
    return e.join(s, "source").join(t, "target").select("source", "source_name", "target", "target_name", "line", "confidence", "channel", "http_method", "path").transform(first, limit, "source_name", "target_name", "source", "target")


def find_aspects(g: GraphSession, limit: int | None = 50) -> DataFrame:
    """(aspect, advice, advice_kind, n_targets, targets) of aspects; a member that advises nothing and has no kind is left out."""
    aspects = g.nodes.filter(F.col("kind") == "aspect").select(F.col("id").alias("aspect"), F.col("qualified_name").alias("aspect_name")).transform(first, limit, "aspect_name", "aspect")
    held = g.edges_of("CONTAINS").select(F.col("source").alias("aspect"), F.col("target").alias("advice"))
    members = g.nodes.filter(F.col("kind").isin(*CALLABLE_KINDS)).select(F.col("id").alias("advice"), "advice_kind")
    targets = g.edges_of("ADVISES").groupBy(F.col("source").alias("advice")).agg(F.sort_array(F.collect_set("target")).alias("t"))
    all_ = aspects.join(held, "aspect").join(members, "advice").join(targets, "advice", "left").filter("advice_kind IS NOT NULL OR t IS NOT NULL")
    return all_.select("aspect", "advice", "advice_kind", F.coalesce(F.size("t"), F.lit(0)).alias("n_targets"), F.coalesce(F.array_join("t", ","), F.lit("")).alias("targets"))


# -- aggregates

def hotspots(g: GraphSession, limit: int | None = 50, min_fan_in: int = 0, include_dynamic: bool = True) -> DataFrame:
    """Callables by how many distinct callers and callees they have, and how often they are advised."""
    kinds = edge_kind_policy(include_dynamic)
    e = g.edges_of(*kinds, "ADVISES")
    calls = e.filter(F.col("kind").isin(*kinds)).select("source", "target").distinct()
    fan_in = calls.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    fan_out = calls.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    advised = e.filter("kind = 'ADVISES'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("advised"))
    n = g.nodes.filter(F.col("kind").isin(*CALLABLE_KINDS)).select("id", "qualified_name")
    every = n.join(fan_in, "id", "left").join(fan_out, "id", "left").join(advised, "id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out", "advised")]
    return every.select("id", "qualified_name", *zero).filter(F.col("fan_in") >= min_fan_in).transform(first, limit, F.desc("fan_in"), F.desc("fan_out"), "qualified_name", "id")


def external_dependencies(g: GraphSession, limit: int | None = 50) -> DataFrame:
    """External packages by references, with the number of files and the kinds of edges that lead there."""
    x = g.nodes.filter("kind = 'external_symbol'").select(F.col("id").alias("target"))
    s = g.nodes.select(F.col("id").alias("source"), "file_path")
    e = g.edges.select("source", "target", "kind").join(x, "target").join(s, "source")
    got = e.groupBy("target").agg(F.count(F.lit(1)).alias("references"), F.count_distinct("file_path").alias("files"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return got.select(F.regexp_replace("target", "^ext:", "").alias("package"), "references", "files", "kinds").transform(first, limit, F.desc("references"), "package")


def unresolved_by_reason(g: GraphSession, reason: str | None = None, caller_kind: str | None = None) -> DataFrame:
    return _unresolved(g, reason, caller_kind).groupBy(F.coalesce("reason", F.lit("unresolved")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def _unresolved(g: GraphSession, reason: str | None, caller_kind: str | None) -> DataFrame:
    e = g.edges_of("CALLS").filter("NOT resolved")
    if reason is not None:
        e = e.filter(F.lower(F.coalesce("reason", F.lit("unresolved"))).contains(reason.lower()))
    n = g.nodes.select(F.col("id").alias("source"), F.col("qualified_name").alias("caller"), F.col("kind").alias("caller_kind"))
    e = e.join(n, "source")
    return e if caller_kind is None else e.filter(F.col("caller_kind") == caller_kind)


def find_unresolved(g: GraphSession, reason: str | None = None, caller_kind: str | None = None, limit: int | None = 2000) -> DataFrame:
    """Unresolved calls, and on each row whether the limit cut the list."""
    every = _unresolved(g, reason, caller_kind)
    total = every.agg(F.count(F.lit(1)).alias("total"))
    rows = every.select("source", "caller", "target", "line", F.coalesce("reason", F.lit("unresolved")).alias("reason")).transform(first, limit, "caller", "line", "source", "target")
    return rows.crossJoin(total).withColumn("truncated", F.lit(False) if limit is None else F.col("total") > limit)  # total is one row


def unresolved_for_node(g: GraphSession, symbol: str) -> DataFrame:
    at = resolve(g, symbol)
    e = g.edges_of("CALLS").filter("NOT resolved").filter((F.col("source") == at) | (F.col("target") == at))
    return e.select(F.when(F.col("source") == at, "outgoing").otherwise("incoming").alias("direction"), "source", "target", "line", F.coalesce("reason", F.lit("unresolved")).alias("reason"))


def edge_counts_by_kind(g: GraphSession) -> DataFrame:
    return g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(g: GraphSession) -> DataFrame:
    return g.edges.groupBy("kind", F.when(F.col("confidence").isNull(), "none").otherwise(F.format_string("%.2f", "confidence")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(g: GraphSession, cases: DataFrame) -> DataFrame:
    """Per edge kind, how labelled cases (source, target, kind, expected) fare against the graph."""
    e = g.edges.select("source", "target", "kind", F.lit(True).alias("there"))
    c = cases.join(e, ["source", "target", "kind"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    tally = {"tp": F.col("expected") & F.col("there"), "fp": ~F.col("expected") & F.col("there"), "fn": F.col("expected") & ~F.col("there"), "tn": ~F.col("expected") & ~F.col("there")}
    t = c.groupBy("kind").agg(*[F.sum(v.cast("long")).alias(k) for k, v in tally.items()])
    share = lambda a, b: F.round(F.when(a + b > 0, a / (a + b)).otherwise(1.0), 4)
    return t.select("kind", *tally, share(F.col("tp"), F.col("fp")).alias("precision"), share(F.col("tp"), F.col("fn")).alias("recall"))


def latency_percentiles(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank p50 and p95 of a measured value; equal values are counted before they are ranked."""
    counts = samples.groupBy(by, value).agg(F.count(value).alias("_n"))
    upto, all_ = Window.partitionBy(by).orderBy(value), Window.partitionBy(by)
    ranked = counts.select(by, F.col(value).cast("double").alias("_v"), F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(all_).alias("_all"))
    return ranked.groupBy(by).agg(*[F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col("_v"))).alias(f"p{p}") for p in (50, 95)])


def dead_code(g: GraphSession, limit: int | None = 50, include_constructors: bool = False, include_tests: bool = False, include_dynamic: bool = True) -> DataFrame:
    """Callables that nothing calls or advises, entry points and main apart; those without a path only with the tests."""
    kinds = [k for k in CALLABLE_KINDS if include_constructors or k != "constructor"]
    used = g.edges_of(*edge_kind_policy(include_dynamic), "ADVISES").select(F.col("target").alias("id")).distinct()
    n = g.nodes.filter(F.col("kind").isin(*kinds) & (F.coalesce("name", F.lit("")) != "main") & ~F.coalesce("entry_point", F.lit(False)))
    if not include_tests:
        path = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
        for column, patterns in ((path, TEST_DIRS), (F.col("file_path"), TEST_FILES), (F.col("qualified_name"), TEST_NAMES)):
            for p in patterns:
                n = n.filter(~column.ilike(p))
    return n.join(used, "id", "left_anti").select("id", "kind", "qualified_name", "file_path").transform(first, limit, "qualified_name", "id")


def proxy_call_info(g: GraphSession, symbol: str | None = None) -> DataFrame:
    """Direct callers of a proxied callable, or of all; inert where caller and callee share their type, so that no proxy stands between."""
    me = g.nodes.filter("proxy IS NOT NULL")
    me = (me if symbol is None else me.filter(F.col("id") == resolve(g, symbol))).select(F.col("id").alias("target"), "proxy", F.col("qualified_name").alias("callee"))
    s = g.nodes.select(F.col("id").alias("source"), F.col("qualified_name").alias("caller"))
    owner = lambda c: F.substring_index(c, "#", 1)
    # where the ids' first parts are few, calls of other sorts of nodes are left out before they are derived
    head = F.substring_index("target", ":", 1)
    heads = [r[0] for r in me.select(head.alias("head")).distinct().limit(HEADS + 1).collect()]
    e = g.edges_of("CALLS")
    e = e.filter(head.isin(heads)) if len(heads) <= HEADS else e
    return e.join(me, "target").join(s, "source").select("source", "target", "proxy", (owner(F.col("caller")) == owner(F.col("callee"))).alias("inert"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in the order."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    head = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_head"))
    return head.select(*[F.col(c) if c in keys else F.col("_head")[c].alias(c) for c in df.columns])
