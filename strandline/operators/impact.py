"""What a change reaches: single symbols, and whole diffs by one multi-source closure."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.lineage import settle
from strandline.functions.top import first
from strandline.operators.relational import get_decorators
from strandline.operators.traversal import bfs, edge_kind_policy, find_implementations, get_callees, get_callers, oriented, resolve
from strandline.session import CALLABLE_KINDS, TYPE_KINDS, GraphSession

# How much each finding adds to a changed symbol's score.
RISK_POINTS = {"high": 1000, "medium": 100, "low": 0}
POINTS = {"routes": 20, "entry_points": 20, "injections": 10, "advice": 10, "event_flows": 5, "callers": 1}
HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def targets_of(g: GraphSession, roots: DataFrame) -> DataFrame:
    """(root, id): each root, and for one that is not callable the callables it contains."""
    kinds = g.nodes.select("id", F.col("kind").isin(*CALLABLE_KINDS).alias("callable"))
    held = g.edges_of("CONTAINS").select("source", F.col("target").alias("member"))
    inner = kinds.filter("callable").select(F.col("id").alias("member"))
    types = roots.join(kinds.filter("NOT callable"), roots.root == kinds.id).select("root")
    members = types.join(held, types.root == held.source).join(inner, "member").select("root", F.col("member").alias("id"))
    return roots.select("root", F.col("root").alias("id")).union(members).distinct()


def impact_callers(g: GraphSession, roots: DataFrame, max_depth: int = 10, include_dynamic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(targets, callers with depth, root by root): one closure for all roots, a root's own targets left out of its callers."""
    targets = settle(targets_of(g, roots))
    return targets, bfs(oriented(g.steps_of(*edge_kind_policy(include_dynamic)), "in"), targets, max_depth)


def _nearest(found: DataFrame, limit: int | None) -> DataFrame:
    """At most `limit` callers of each root, nearest first."""
    if limit is None:
        return found.select("root", "id", "depth")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("depth", "id"))).filter(F.col("n") <= limit).select("root", "id", "depth")


def impact_summary(g: GraphSession, roots: DataFrame, max_depth: int = 10, include_dynamic: bool = True, limit: int | None = 200, reached: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row a root: callers, entry points, routes, flows, implementations, files and risk."""
    targets, found = reached or impact_callers(g, roots, max_depth, include_dynamic)
    capped = _nearest(found, limit)
    callers = capped.groupBy("root").agg(F.count(F.lit(1)).alias("callers"), F.sum((F.col("depth") == 1).cast("long")).alias("direct_callers"))
    reach = capped.select("root", "id").union(targets.select("root", "id")).distinct()
    entry = reach.join(g.nodes.filter("entry_point").select("id"), "id").groupBy("root").agg(F.count(F.lit(1)).alias("entry_points"))

    def touching(kind: str, name: str) -> DataFrame:
        e = g.edges_of(kind).select("source", "target")
        ends = e.join(targets, e.source == targets.id).select("root", "source", "target").union(e.join(targets, e.target == targets.id).select("root", "source", "target"))
        return ends.distinct().groupBy("root").agg(F.count(F.lit(1)).alias(name))

    owner = g.edges_of("CONTAINS").select(F.col("source").alias("owner"), F.col("target").alias("root"))
    kinds = g.nodes.select(F.col("id").alias("root"), "kind")
    typed = roots.join(kinds, "root")
    types = typed.filter(~F.col("kind").isin(*CALLABLE_KINDS)).select("root", F.col("root").alias("id")).union(typed.filter(F.col("kind").isin(*CALLABLE_KINDS)).join(owner, "root").select("root", F.col("owner").alias("id")))
    subs = bfs(oriented(g.steps_of("EXTENDS", "IMPLEMENTS"), "in"), types, max_depth).select("root", "id").join(g.nodes.filter(F.col("kind").isin(*TYPE_KINDS)).select("id"), "id")
    impl = subs.groupBy("root").agg(F.count(F.lit(1)).alias("implementations"))
    involved = roots.select("root", F.col("root").alias("id")).union(capped.select("root", "id")).union(subs.select("root", "id"))
    files = involved.join(g.nodes.select("id", "file_path"), "id").groupBy("root").agg(F.count_distinct("file_path").alias("files"))
    out = roots.select("root")
    for part in (callers, entry, touching("ROUTES", "routes"), touching("EMITS", "event_flows"), impl, files):
        out = out.join(part, "root", "left")
    names = ("callers", "direct_callers", "entry_points", "routes", "event_flows", "implementations", "files")
    out = out.select("root", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    return out.withColumn("risk", F.when(F.col("entry_points") > 0, "high").when(F.col("direct_callers") > 0, "medium").otherwise("low"))


def impact_details(g: GraphSession, symbol: str, max_depth: int = 10, include_dynamic: bool = True, limit: int | None = 200) -> DataFrame:
    """(section, id, detail): what impact_analysis() counts, row by row: callers with depth, entry points, routes, event flows, implementations with the members they override, files."""
    at = resolve(g, symbol)
    targets, found = impact_callers(g, g.spark.createDataFrame([(at,)] if at else [], "root string"), max_depth, include_dynamic)
    callers = settle(_nearest(found, limit).select("id", "depth"))
    mine = targets.select("id")
    reach = callers.select("id").union(mine).distinct()
    row = lambda section, df, detail: df.select(F.lit(section).alias("section"), "id", detail.cast("string").alias("detail"))
    out = row("caller", callers, F.col("depth"))
    out = out.union(row("entry point", g.nodes.filter("entry_point").join(reach, "id", "left_semi"), F.col("entry_point_kind")))
    for section, kind in (("route", "ROUTES"), ("event flow", "EMITS")):
        e = g.edges_of(kind)
        ends = e.join(mine, e.source == mine.id, "left_semi").union(e.join(mine, e.target == mine.id, "left_semi")).select("source", "target").distinct()
        out = out.union(row(section, ends.withColumnRenamed("source", "id"), F.col("target")))
    me = g.nodes.filter(F.col("id") == at)
    kind = me.select("kind").first()
    owner = g.edges_of("CONTAINS").filter(F.col("target") == at).select(F.col("source").alias("id"))
    types = owner if kind and kind.kind in CALLABLE_KINDS else me.select("id")
    subs = bfs(oriented(g.steps_of("EXTENDS", "IMPLEMENTS"), "in"), types.select(F.col("id").alias("root"), "id"), max_depth).select("id").distinct().join(g.nodes.filter(F.col("kind").isin(*TYPE_KINDS)).select("id"), "id")
    held = g.edges_of("CONTAINS").select(F.col("source").alias("id"), F.col("target").alias("member"))
    same = g.nodes.join(me.select(F.col("name").alias("name")).distinct(), "name").filter(F.col("kind").isin(*CALLABLE_KINDS)).select(F.col("id").alias("member"))
    overrides = subs.join(held.join(same, "member"), "id").groupBy("id").agg(F.min("member").alias("override"))
    out = out.union(row("implementation", subs.join(overrides, "id", "left"), F.col("override")))
    files = me.select("id").union(callers.select("id")).union(subs).distinct().join(g.nodes.select("id", "file_path"), "id").filter("file_path IS NOT NULL").select(F.col("file_path").alias("id")).distinct()
    return out.union(row("file", files, F.lit(None)))


def change_totals(changes: DataFrame, g: GraphSession, max_depth: int = 10, include_dynamic: bool = True, files: list[str] = (), diff: str = "") -> DataFrame:
    """One row for a report of change_impact(): symbols, distinct callers, files and entry points that they reach, and the given files that no known file matches."""
    roots = settle(changes.select("root").distinct())
    targets, found = impact_callers(g, roots, max_depth, include_dynamic)
    reach = found.select("id").union(targets.select("id")).distinct().join(g.nodes.select("id", "file_path", "entry_point"), "id")
    callers = found.join(targets.select("id").distinct(), "id", "left_anti").agg(F.count_distinct("id").alias("callers"))
    given = sorted({normal_path(f) for f in files} | {h.file for h in parse_unified_diff(diff)})
    known = match_files(g.spark.createDataFrame([(f,) for f in given], "file string"), g.nodes)
    lost = g.spark.createDataFrame([(f,) for f in given], "file string").join(known.select("file").distinct(), "file", "left_anti").agg(F.sort_array(F.collect_list("file")).alias("unmatched"))
    return roots.agg(F.count(F.lit(1)).alias("symbols")).crossJoin(callers).crossJoin(reach.agg(F.count_distinct("file_path").alias("files"), F.count(F.when(F.col("entry_point"), 1)).alias("entry_points"))).crossJoin(lost)  # one row each


def impact_analysis(g: GraphSession, symbol: str, max_depth: int = 10, include_dynamic: bool = True, limit: int | None = 200) -> DataFrame:
    at = resolve(g, symbol)
    return impact_summary(g, g.spark.createDataFrame([(at,)] if at else [], "root string"), max_depth, include_dynamic, limit)


# -- diffs

@dataclass(frozen=True)
class Hunk:
    file: str
    start: int
    end: int


def normal_path(path: str) -> str:
    p = path.strip().replace("\\", "/")
    p = p[1:-1] if len(p) > 1 and p[0] == p[-1] == '"' else p
    for head in ("a/", "b/", "./"):
        p = p.removeprefix(head)
    return p


def parse_unified_diff(diff: str) -> list[Hunk]:
    """The line ranges on the new side; a hunk that only deletes anchors one line; deleted files are left out."""
    hunks, current = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0].strip()
            current = None if name == "/dev/null" else normal_path(name) or None
        elif current and (m := HUNK.match(line)):
            start, count = int(m[1]), 1 if m[2] is None else int(m[2])
            hunks.append(Hunk(current, start, start + max(count, 1) - 1))
    return hunks


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """(diff_id, file, start, end) of many diffs (diff_id, diff), in DataFrame functions: the file of a hunk is the last header before it."""
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\r?\n")).alias("no", "line"))
    head = F.col("line").startswith("+++ ")
    name = F.regexp_replace(F.trim(F.expr("split(substr(line, 5), '\t')[0]")), r"^(b/|a/|\./)", "")
    marked = lines.withColumn("name", F.when(head, F.when(name == "/dev/null", "").otherwise(name)))
    filled = marked.withColumn("file", F.last("name", ignorenulls=True).over(Window.partitionBy("diff_id").orderBy("no")))
    hunk = filled.filter(F.col("line").rlike(HUNK.pattern) & (F.col("file") != ""))
    start, count = F.regexp_extract("line", HUNK.pattern, 1).cast("int"), F.regexp_extract("line", HUNK.pattern, 2)
    n = F.when(count == "", 1).otherwise(F.greatest(F.expr("try_cast(nullif(regexp_extract(line, '\\\\+[0-9]+,([0-9]+)', 1), '') as int)"), F.lit(1)))
    return hunk.select("diff_id", "file", start.alias("start"), (start + n - 1).alias("end"))


def match_files(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(file, file_path): equal paths, or one the end of the other on a slash; by equi-joins on all suffixes."""
    def suffixes(c: str):
        parts = F.split(F.replace(F.col(c), F.lit("\\"), F.lit("/")), "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    w, k = wanted.select("file").distinct(), known.select("file_path").filter("file_path IS NOT NULL").distinct()
    a = k.select("file_path", F.explode(suffixes("file_path")).alias("s")).join(w.select("file", F.replace(F.col("file"), F.lit("\\"), F.lit("/")).alias("s")), "s")
    b = w.select("file", F.explode(suffixes("file")).alias("s")).join(k.select("file_path", F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")).alias("s")), "s")
    return a.select("file", "file_path").union(b.select("file", "file_path")).distinct()


def declarations(g: GraphSession) -> DataFrame:
    """(id, kind, file_path, first, last): spans in lines from one; without a start there is no span."""
    n = g.nodes.filter(F.col("kind").isin(*TYPE_KINDS, *CALLABLE_KINDS) & F.col("start_line").isNotNull())
    return n.select("id", "kind", "file_path", (F.col("start_line") + 1).alias("first"), (F.greatest(F.coalesce("end_line", "start_line"), "start_line") + 1).alias("last"))


def owners(g: GraphSession) -> DataFrame:
    """(member, owner): by CONTAINS or DECLARED_IN."""
    return g.edges_of("CONTAINS").select(F.col("target").alias("member"), F.col("source").alias("owner")).union(g.edges_of("DECLARED_IN").select(F.col("source").alias("member"), F.col("target").alias("owner"))).distinct()


def diff_declarations(g: GraphSession, hunks: DataFrame) -> DataFrame:
    """(id) of declarations that hunks (file, start, end) overlap; a type goes where a member inside it was touched."""
    d = declarations(g)
    files = match_files(hunks, d)
    touched = hunks.join(files, "file").join(d, "file_path").filter("first <= end AND last >= start").select("id", "kind", "file_path", "first", "last").distinct()
    member = touched.filter(F.col("kind").isin(*CALLABLE_KINDS)).select(F.col("id").alias("member"), F.col("first").alias("f"), F.col("last").alias("l"))
    inside = member.join(owners(g), "member").select(F.col("owner").alias("id"), "f", "l").join(touched.select("id", "first", "last"), "id").filter("first <= f AND last >= l AND last - first > l - f").select("id").distinct()
    return touched.filter(F.col("kind").isin(*CALLABLE_KINDS)).select("id").union(touched.filter(F.col("kind").isin(*TYPE_KINDS)).select("id").join(inside, "id", "left_anti")).distinct()


def file_declarations(g: GraphSession, files: DataFrame) -> DataFrame:
    """(id): the files' types, and methods whose owner is a module."""
    d = declarations(g).join(match_files(files, declarations(g)), "file_path")
    modules = g.nodes.filter("kind = 'module'").select(F.col("id").alias("owner"))
    top = owners(g).join(modules, "owner").select(F.col("member").alias("id"))
    return d.filter(F.col("kind").isin(*TYPE_KINDS)).select("id").union(d.filter("kind = 'method'").select("id").join(top, "id", "left_semi")).distinct()


def change_impact(g: GraphSession, symbols: list[str] = (), files: list[str] = (), diff: str = "", max_depth: int = 10, include_dynamic: bool = True, limit: int | None = 20, max_symbols: int | None = 25) -> DataFrame:
    """The changed declarations with what they reach, the highest score first."""
    spark = g.spark
    roots = spark.createDataFrame([(r,) for r in {resolve(g, s) for s in symbols} - {None}], "id string")
    if files:
        roots = roots.union(file_declarations(g, spark.createDataFrame([(normal_path(f),) for f in files], "file string")))
    if hunks := parse_unified_diff(diff):
        roots = roots.union(diff_declarations(g, spark.createDataFrame([(h.file, h.start, h.end) for h in hunks], "file string, start int, end int")))
    roots = roots.select(F.col("id").alias("root")).distinct()
    roots = settle(roots)
    targets, found = impact_callers(g, roots, max_depth, include_dynamic)
    base = impact_summary(g, roots, max_depth, include_dynamic, limit, (targets, found))
    capped = _nearest(found, limit)
    reach = capped.select("root", "id").union(targets.select("root", "id")).distinct()

    def side(kind: str, end: str, who: DataFrame, name: str) -> DataFrame:
        e = g.edges_of(kind).select("source", "target")
        return e.join(who, e[end] == who.id).select("root", "source", "target").distinct().groupBy("root").agg(F.count(F.lit(1)).alias(name))

    inj = g.edges_of("INJECTS").select("source", "target")
    injections = inj.join(roots, (inj.source == roots.root)).select("root", "source", "target").union(inj.join(roots, inj.target == roots.root).select("root", "source", "target")).distinct().groupBy("root").agg(F.count(F.lit(1)).alias("injections"))
    out = base.drop("routes", "event_flows")
    for part in (injections, side("ADVISES", "target", targets, "advice"), side("ROUTES", "target", reach, "routes"), side("EMITS", "source", reach, "event_flows")):
        out = out.join(part, "root", "left")
    out = out.select("root", "callers", "direct_callers", "entry_points", "implementations", "files", "risk", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("injections", "advice", "routes", "event_flows")])
    risk = F.when(F.col("risk") == "high", RISK_POINTS["high"]).when(F.col("risk") == "medium", RISK_POINTS["medium"]).otherwise(RISK_POINTS["low"])
    score = risk
    for name, points in POINTS.items():
        score = score + points * F.col(name)
    return out.withColumn("score", score.cast("long")).transform(first, max_symbols, F.desc("score"), "root")


def explain_symbol(g: GraphSession, symbol: str, max_depth: int = 1, include_dynamic: bool = True, limit: int | None = 50, wiring_limit: int | None = 200) -> DataFrame:
    """(section, id, detail): everything about one symbol, a row each, and (count, section, rows) of every section."""
    at = resolve(g, symbol)
    row = lambda section, df, detail: df.select(F.lit(section).alias("section"), "id", detail.cast("string").alias("detail"))
    members = g.edges_of("CONTAINS").filter(F.col("source") == at).select(F.col("target").alias("id")).join(g.nodes.select("id", "kind"), "id")
    out = row("decorator", get_decorators(g, symbol).groupBy(F.col("member").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("annotation")), ",").alias("annotations")), F.col("annotations"))
    inner = get_decorators(g, symbol, include_members=True).filter(F.col("member") != at)
    out = out.union(row("member decorator", inner.select(F.col("member").alias("id"), "annotation"), F.col("annotation")))
    out = out.union(row("member", members.transform(first, limit, "id"), F.col("kind")))
    for section, fn in (("caller", get_callers), ("callee", get_callees)):
        out = out.union(row(section, fn(g, symbol, max_depth, limit, include_dynamic), F.col("edge_kind")))
    out = out.union(row("implementation", find_implementations(g, symbol, limit=limit), F.col("relation")))
    for section, kind in (("route", "ROUTES"), ("injection", "INJECTS"), ("reflection", "REFLECTS")):
        e = g.edges_of(kind).filter((F.col("source") == at) | (F.col("target") == at))
        out = out.union(row(section, e.select(F.when(F.col("source") == at, F.col("target")).otherwise(F.col("source")).alias("id"), "source").transform(first, wiring_limit, "id", "source"), F.when(F.col("source") == at, "out").otherwise("in")))
    out = settle(out)
    return out.union(out.groupBy("section").agg(F.count(F.lit(1)).cast("string").alias("n")).select(F.lit("count"), F.col("section"), "n"))
