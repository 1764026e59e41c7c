"""Edges that follow from others: dynamic dispatch, advice by pointcut, events by channel."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import stored

#: Pointcuts that one pass over the methods tests.
ADVICE_BATCH = 100
# The confidence of each kind of pointcut term, and of an empty pointcut.
TERM_CONFIDENCE = {"execution": 0.9, "call": 0.85, "within": 0.85, "@annotation": 0.85, "@within": 0.8, "target": 0.55, "this": 0.55, "args": 0.6}
EMPTY_CONFIDENCE = 0.3
DISPATCH_CONFIDENCE = 0.8
CHANNEL_QUALIFIED, CHANNEL_SIMPLE = 1.0, 0.85
MODIFIERS = ("public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default")
DISPATCH_BARRED = ("private", "static", "final")


def external_package_of(name: Column) -> Column:
    """The package of an external name: a scoped name's first two parts, else up to the first slash, then the first dot."""
    scoped = F.regexp_extract(name, r"^(@[^/]+/[^/]+)", 1)
    return F.when(scoped != "", scoped).otherwise(F.substring_index(F.substring_index(name, "/", 1), ".", 1))


def stale_files(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(path) that the manifest has and the disk has not."""
    return manifest.select("path").filter("path IS NOT NULL").distinct().join(present.select("path"), "path", "left_anti")


# -- pointcuts: compiled to column expressions over (type_id, name, arity, annotations, type_annotations)

def split_top(text: str, separator: str) -> list[str]:
    """Parts between separators outside of brackets."""
    parts, depth, at, i = [], 0, 0, 0
    while i < len(text):
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if depth == 0 and text.startswith(separator, i):
            parts.append(text[at:i])
            i += len(separator)
            at = i
        else:
            i += 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def name_pattern(glob: str) -> str:
    return "^" + ".*".join(re.escape(p) for p in glob.split("*")) + "$"


def type_pattern(glob: str) -> str:
    """One star stays within a package level; two dots cross any number of them."""
    out, first = "^", True
    for part in glob.split("."):
        if part == "":
            out += r"(?:\.[^.]+)*"
        else:
            out += ("" if first else r"\.") + "[^.]*".join(re.escape(p) for p in part.split("*"))
        first = False
    return out + "$"


def _name(glob: str) -> Column:
    return F.lit(True) if glob in ("", "*") else F.col("name").rlike(name_pattern(glob))


def _type(glob: str, column: str = "type_id") -> Column:
    return F.lit(True) if glob.strip() in ("", "*", "..") else F.col(column).rlike(type_pattern(glob.strip()))


def _arity(params: str) -> Column:
    parts = split_top(params, ",")
    return F.lit(True) if ".." in parts else F.col("arity") == len(parts)


def _annotated(pattern: str, column: str) -> Column:
    glob = pattern.strip()
    if not glob:
        return F.size(column) > 0
    simple, full = name_pattern(glob.split(".")[-1]), type_pattern(glob)
    return F.exists(column, lambda a: F.substring_index(a, ".", -1).rlike(simple) | a.rlike(full))


def _execution(signature: str) -> Column:
    m = re.fullmatch(r"(?s)([^(]*)\((.*)\)[^)]*", signature)
    words = [w for w in m[1].split() if w not in MODIFIERS and not w.startswith("@")] if m else []
    if not words:
        return F.lit(False)
    types, _, name = words[-1].rpartition(".")
    return _name(name) & _type(types or "*") & _arity(m[2])


def _term(term: str) -> tuple[Column, Column]:
    """(matches, confidence); a negated term that matches has confidence zero."""
    body = term.lstrip("! \t\n")
    negated = "!" in term[: len(term) - len(body)]
    m = re.fullmatch(r"(?s)([\w@]+)\s*\((.*)\)", body)
    kind = m[1] if m else ""
    if kind in ("execution", "call"):
        hit = _execution(m[2].strip())
    elif kind in ("within", "target", "this"):
        hit = _type(m[2])
    elif kind == "@annotation":
        hit = _annotated(m[2], "annotations")
    elif kind == "@within":
        hit = _annotated(m[2], "type_annotations")
    elif kind == "args":
        hit = _arity(m[2])
    else:
        hit = F.lit(False)
    return (~hit, F.lit(0.0)) if negated else (hit, F.lit(TERM_CONFIDENCE.get(kind, 0.0)))


def pointcut_confidence(expression: str) -> Column:
    """The best confidence of the branches that match; null where none does."""
    if not (expression or "").strip():
        return F.lit(EMPTY_CONFIDENCE)
    best = []
    for group in split_top(expression, "||"):
        terms = [_term(t) for t in split_top(group, "&&")]
        hit, low = F.lit(True), F.lit(1.0)
        for h, c in terms:
            hit, low = hit & h, F.least(low, c)
        best.append(F.when(hit, low))
    return F.greatest(*best, F.lit(None).cast("double")) if len(best) > 1 else best[0]


def expand_pointcuts(advice: list[tuple[str, str, str]], named: dict[str, str]) -> list[tuple[str, str, str]]:
    """References to named pointcuts, name() or Type.name(), replaced by their expressions; a cycle stays as it is."""
    def expand(text: str, seen: frozenset[str]) -> str:
        def one(m: re.Match) -> str:
            name = m[1].split(".")[-1]
            return m[0] if name in seen or name not in named else f"({expand(named[name], seen | {name})})"

        return re.sub(r"(?<![\w@.*])([A-Za-z_][\w.]*)\(\)", one, text)

    def plain(text: str) -> str:
        while text.startswith("(") and split_top(text, "\0") == [text] and _closes(text):
            text = text[1:-1].strip()
        return text

    out = []
    for who, kind, text in advice:
        groups = [[plain(t) for t in split_top(g, "&&")] for g in split_top(plain(expand(text, frozenset())), "||")]
        out.append((who, kind, " || ".join(" && ".join(g) for g in groups)))
    return out


def _closes(text: str) -> bool:
    """Whether the first bracket closes at the end."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i == len(text) - 1
    return False


def advice_edges(advice: DataFrame, methods: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(source, target, kind, advice_kind, pointcut, confidence): advice (advice, advice_kind, pointcut) on the methods its pointcut takes.

    Advice is a short list that stands in the sources; its pointcuts are conditions over the methods, ADVICE_BATCH of them
    in one pass, each pass written down, so that plans stay small however many there are. References to the named
    pointcuts (name, expression) are replaced first.
    """
    listed = [tuple(r) for r in advice.select("advice", "advice_kind", F.coalesce("pointcut", F.lit(""))).distinct().orderBy("advice", "advice_kind").collect()]
    if named is not None:
        listed = expand_pointcuts(listed, {r[0]: r[1] for r in named.select("name", "expression").collect()})
    out = None
    for at in range(0, len(listed), ADVICE_BATCH):
        hits = []
        for who, kind, text in listed[at : at + ADVICE_BATCH]:
            sure = pointcut_confidence(text)
            hits.append(F.when(sure.isNotNull() & (F.col("id") != who), F.struct(F.lit(who).alias("source"), F.lit(kind).alias("advice_kind"), F.lit(text).alias("pointcut"), sure.alias("confidence"))))
        taken = methods.select(F.col("id").alias("target"), F.explode(F.array_compact(F.array(*hits))).alias("h"))
        part = taken.select("h.source", "target", F.lit("ADVISES").alias("kind"), "h.advice_kind", "h.pointcut", "h.confidence")
        part = stored(part) if len(listed) > ADVICE_BATCH else part
        out = part if out is None else out.union(part)
    empty = methods.limit(0).select(F.lit("").alias("source"), F.col("id").alias("target"), F.lit("ADVISES").alias("kind"), F.lit("").alias("advice_kind"), F.lit("").alias("pointcut"), F.lit(0.0).alias("confidence"))
    return empty if out is None else out.groupBy("source", "target", "kind").agg(F.max_by(F.struct("advice_kind", "pointcut", "confidence"), "confidence").alias("x")).select("source", "target", "kind", "x.*")


def dispatch_edges(calls: DataFrame, methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(source, target, kind, confidence): a resolved call of T#m may run the override of m in any type below T.

    Methods are (id, type_id, name, arity, ordinal, modifiers); constructors and names with a private, static or
    final declaration in T are not dispatched. Of several overrides one of equal arity is taken, else the first.
    """
    barred = methods.filter(F.arrays_overlap("modifiers", F.array(*[F.lit(m) for m in DISPATCH_BARRED]))).select("type_id", "name").distinct()
    base = methods.filter(F.col("name") != "<init>").join(barred, ["type_id", "name"], "left_anti")
    called = calls.filter("resolved").select(F.col("target").alias("id")).distinct().join(base, "id").select(F.col("id").alias("source"), F.col("type_id").alias("ancestor"), "name", F.col("arity").alias("want"))
    below = called.join(ancestors.select("type", "ancestor"), "ancestor").withColumnRenamed("type", "type_id")
    found = below.join(methods.select("type_id", "name", "arity", "ordinal", F.col("id").alias("target")), ["type_id", "name"])
    best = found.groupBy("source", "type_id").agg(F.min_by("target", F.struct(F.col("arity") != F.col("want"), "ordinal", "target")).alias("target"))
    return best.filter("source <> target").select("source", "target", F.lit("DYNAMIC_DISPATCH").alias("kind"), F.lit(DISPATCH_CONFIDENCE).alias("confidence")).distinct()


def channel_edges(publishers: DataFrame, listeners: DataFrame) -> DataFrame:
    """(source, target, kind, channel_kind, channel, confidence, phase): who publishes on a channel reaches who listens there.

    Both sides are (owner, channel_kind, channel, qualified, phase); qualified names that differ are different events.
    """
    p = publishers.select(F.col("owner").alias("source"), "channel_kind", "channel", F.col("qualified").alias("pq"))
    q = listeners.select(F.col("owner").alias("target"), "channel_kind", "channel", F.col("qualified").alias("lq"), "phase")
    pairs = p.join(q, ["channel_kind", "channel"]).filter("source <> target AND (pq IS NULL OR lq IS NULL OR pq = lq)")
    rated = pairs.withColumn("confidence", F.when(F.col("pq").isNotNull() & F.col("lq").isNotNull(), CHANNEL_QUALIFIED).otherwise(CHANNEL_SIMPLE))
    return rated.groupBy("source", "target", "channel_kind", "channel").agg(F.max("confidence").alias("confidence"), F.min("phase").alias("phase")).select("source", "target", F.lit("EMITS").alias("kind"), "channel_kind", "channel", "confidence", "phase")
