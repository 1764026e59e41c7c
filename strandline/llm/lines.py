"""Line dedup by a suffix array over line-ID sequences, in DataFrame functions only.

A run of lines with CHARS characters or more is deleted wherever it stands but for the first place, places being
ordered by (doc_id, text hash, line); single short lines that merely recur stay. So of every maximal repeated run that
long, all copies but the first go, whatever the number of its lines.

Lines (cut at line feeds) become IDs; the suffixes of every document's ID sequence are ranked by prefix doubling: the
rank of the first 2n lines comes from the ranks of the first n and of the n after them, in range-sorted order. The
suffixes that share their first n lines are an interval of the array with a common prefix of n lines at least. What
is covered by a repeated run of CHARS characters is covered by its least parts: from each of its lines on the
fewest lines that have CHARS, or, near its end, the fewest that end there. So a document's windows are these, one or
two a line, found by running sums; a window of n lines names an interval by two ranks of the level below n (its
first and its last lines), and all but the interval's first place go. Ranks are needed, and made, only for runs that
lie within such a window; the windows found are merged to the maximal runs.

Null texts hold no line; empty lines count like others; rows that repeat doc_id and text are one document, whose
decisions hold for each of them; a null doc_id counts as the largest number. Lines and documents are known by
128-bit hashes. Hot lines are pre-aggregated, and joined as the many side against one row a rank, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, positions, stored, text_column, unused

CHARS = 20
DOC = ["doc", "r1", "r2"]


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    doc, text = docs["doc_id"].cast("long"), text_column(docs)
    return F.xxhash64(doc, text), F.xxhash64(F.lit(1), doc, text)


def lines_and_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (DOC, pos, h1, h2, chars), and the windows (DOC, pos, n) of two lines or more."""
    r1, r2 = _keys(docs)
    ids = F.transform(F.split(text_column(docs), "\n"), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"), F.length(x).alias("chars")))
    whole = docs.filter("text is not null").select(F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("doc"), r1.alias("r1"), r2.alias("r2"), ids.alias("ids"))
    plain = whole.groupBy(*DOC).agg(F.first("ids").alias("ids")).select(*DOC, F.posexplode("ids").alias("pos", "id")).select(*DOC, "pos", "id.*")
    upto = F.sum(F.col("chars").cast("long")).over(Window.partitionBy(*DOC).orderBy("pos"))
    summed = plain.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("chars"))
    # Side 0 looks for the first line that brings CHARS, side 1 for the last from which on there are CHARS: in falling
    # order of the sums, the line last seen before a question. Lines that have CHARS alone are not in question.
    event = lambda side, asks, key, tie: F.struct(F.lit(side).alias("side"), F.lit(asks).alias("asks"), key.alias("key"), tie.alias("tie"))
    pos, high, low = F.col("pos"), F.col("upto"), F.col("before")
    lines = F.array(event(0, 0, high, pos), event(1, 0, -low, -pos))
    both = F.concat(lines, F.array(event(0, 1, low + CHARS, pos), event(1, 1, CHARS - high, pos)))
    events = summed.select(*DOC, "pos", "h1", "h2", "chars", F.explode(F.when(F.col("chars") < CHARS, both).otherwise(lines)).alias("e")).select(*DOC, "pos", "h1", "h2", "chars", "e.*")
    seen = Window.partitionBy(*DOC, "side").orderBy(F.col("key").desc(), "asks", F.col("tie").desc())
    told = events.withColumn("to", F.last(F.when(F.col("asks") == 0, F.col("pos")), ignorenulls=True).over(seen))
    told = stored(told.filter("asks = 0 and side = 0 or asks = 1 and to is not null").select(*DOC, "pos", *[F.when(F.col("asks") == 0, F.col(c)).alias(c) for c in ("h1", "h2", "chars")], F.when(F.col("asks") == 1, F.col("to")).alias("to")))
    windows = told.filter("to is not null").select(*DOC, F.least("pos", "to").alias("pos"), (F.abs(F.col("to") - F.col("pos")) + 1).alias("n")).filter("n > 1")
    return told.filter("to is null").drop("to"), windows


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(r1, r2, runs): of every document that has any, the maximal runs of lines that go, as (start, stop) in order."""
    lines, windows = lines_and_windows(docs)
    place = F.struct(*DOC, "pos")
    ids = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("many"), F.min(place).alias("first")).filter("many > 1")
    ranked = positions(ids.select("h1", "h2", "first"), [F.col("h1"), F.col("h2")], "rank")
    live = stored(lines.join(ranked, ["h1", "h2"]).select(*DOC, "pos", "rank", F.col("chars").alias("total"), F.col("chars").alias("head"), F.col("chars").alias("tail"), (place != F.col("first")).alias("later")))
    found = live.filter(f"later and total >= {CHARS}").select(*DOC, F.col("pos").alias("start"), F.col("pos").alias("stop"))
    live = live.drop("later")
    longest = windows.agg(F.max("n")).first()[0] or 0
    n = 1
    while n <= longest:
        # a window of n to 2n - 1 lines: its first n lines and its last n lines
        ends = live.select(*DOC, (F.col("pos")).alias("last"), F.col("rank").alias("b"))
        asked = windows.filter(F.col("n").between(n, 2 * n - 1)).distinct().join(live.select(*DOC, "pos", F.col("rank").alias("a")), [*DOC, "pos"]).withColumn("last", F.col("pos") + F.col("n") - n).join(ends, [*DOC, "last"])
        asked = cut(asked.select(*DOC, "pos", "n", "a", "b"))
        firsts = asked.groupBy("n", "a", "b").agg(F.count(F.lit(1)).alias("many"), F.min(place).alias("first")).filter("many > 1").drop("many")
        found = found.union(asked.join(firsts, ["n", "a", "b"]).filter(place != F.col("first")).select(*DOC, F.col("pos").alias("start"), (F.col("pos") + F.col("n") - 1).alias("stop")))
        if 2 * n > longest:
            break
        after = live.select(*DOC, (F.col("pos") - n).alias("pos"), F.col("rank").alias("next"), F.col("total").alias("more"), F.col("tail").alias("end"))
        pairs = live.join(after, [*DOC, "pos"]).select(*DOC, "pos", "rank", "next", (F.col("total") + F.col("more")).alias("total"), "head", F.col("end").alias("tail"))
        pairs = cut(pairs.filter(f"total - head < {CHARS} or total - tail < {CHARS}"))
        ranked = positions(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many"), [F.col("rank"), F.col("next")], "new")
        live = cut(pairs.join(ranked, ["rank", "next"]).select(*DOC, "pos", F.col("new").alias("rank"), "total", "head", "tail"))
        n *= 2
        if live.isEmpty():
            break
    order = Window.partitionBy(*DOC).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("opens", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(order))
    merged = apart.groupBy(*DOC, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs")).select("r1", "r2", "runs")


def _with_runs(docs: DataFrame, name: str) -> DataFrame:
    """docs with the runs that go as a column of that name (null where nothing goes)."""
    a, b = unused(docs, "line_r1", "line_r2")
    r1, r2 = _keys(docs)
    left = docs.withColumn(a, r1).withColumn(b, r2)
    runs = repeated_runs(docs).select(F.col("r1").alias("_run_r1"), F.col("r2").alias("_run_r2"), F.col("runs").alias(name))
    return left.join(runs, (left[a] == runs["_run_r1"]) & (left[b] == runs["_run_r2"]), "left").select(*[left[c] for c in docs.columns], runs[name])


def _kept(text: Column, runs: Column) -> Column:
    """The lines that stay, put together again; null if nothing stays."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["stop"] + 1)
    gone = F.flatten(F.transform(runs, lambda x, i: F.concat(F.array_repeat(F.lit(False), x["start"] - before(i)), F.array_repeat(F.lit(True), x["stop"] - x["start"] + 1))))
    stay = F.filter(F.arrays_zip(F.split(text, "\n").alias("l"), gone.alias("g")), lambda x: ~F.coalesce(x["g"], F.lit(False)))
    return F.when(F.size(stay) > 0, F.array_join(F.transform(stay, lambda x: x["l"]), "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256 for every row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    kept = F.coalesce(F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(_kept(F.col("text"), F.col("runs"))), F.lit(""))
    return _with_runs(plain, "runs").select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda n, x: n + x["stop"] - x["start"] + 1), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def with_lines_removed(docs: DataFrame) -> DataFrame:
    """docs with their texts' repeated line runs removed; documents left without any line go."""
    runs, rest = unused(docs, "runs", "rest")
    d = _with_runs(docs, runs)
    d = d.withColumn(rest, F.when(d[runs].isNull(), d["text"]).otherwise(_kept(d["text"].cast("string"), d[runs])))
    return d.filter(d[runs].isNull() | d[rest].isNotNull()).select(*[F.col(rest).alias("text") if c == "text" else F.col(c) for c in docs.columns])


#: Every window of any number of lines that has CHARS characters, and would not without its first or its last line.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS l, unnest(generate_series(1, len(ls))) AS pos FROM d),
s AS (SELECT doc_id, pos, length(l) AS chars, sum(length(l)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM p),
e AS (
  SELECT a.doc_id, a.pos, b.pos - a.pos + 1 AS n FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos
  WHERE b.upto - a.upto + a.chars >= {CHARS} AND (b.upto - a.upto < {CHARS} OR b.upto - b.chars - a.upto + a.chars < {CHARS})
),
w AS (SELECT e.doc_id, e.pos, e.n, list_slice(ls, pos, pos + n - 1) AS win FROM e JOIN d USING (doc_id)),
f AS (SELECT win, min({{'d': doc_id, 'p': pos}}) AS first FROM w GROUP BY win HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.pos, w.n FROM w JOIN f USING (win) WHERE w.doc_id <> f.first.d OR w.pos <> f.first.p),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + n - 1)) AS pos FROM r),
c AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE NOT before) AS n_runs, list(pos) AS gone
  FROM (SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) = pos - 1, false) AS before FROM g) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
  sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
