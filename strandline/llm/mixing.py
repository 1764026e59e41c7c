"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; no target passes
MOST times its source's size, and what that frees is shared anew by weight until no target is above.

Entropy balancing: of all document rates between 0 and MOST, those closest to one in relative entropy that meet the
word target of every source. The dual has one multiplier a source, and the rate of a document is exponentially
tilted by its words, exp(multiplier * words / the source's mean), MOST at most. Newton steps, kept within a bracket,
solve it: each sums gradient and second derivative over all documents in one aggregation (documents of one source and
size, whose terms are equal, are counted beforehand). A source whose target is MOST times its size has rate MOST.
Rounding: within chunks of a source of about CHUNK rows (so that a source of any size spreads over tasks) the largest
documents are rounded first and each passes the words that it takes too much or too little on to the next; of what is
left, a copy more of one document and a copy less of its neighbour in size take off what they can.

Null texts have size 0, are in the mix once and take nothing; a null source is a source of its own; rows that repeat
doc_id, source and size are rounded one by one, in lots of CHUNK rows; an empty table gives an empty mix; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.lineage import small
from strandline.llm.common import cut, positions, stored, text_column, unused

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
CHUNK = 200
NEWTON_STEPS = 80
#: A target is met to this share.
NEAR = 1e-9


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(counted: DataFrame) -> DataFrame:
    """(place, source, source_size, n, target) from (source, size, n), n rows of one source and size."""
    stats = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    ranked = cut(positions(stats, [F.col("source").asc_nulls_last()], "place").withColumn("weight", F.col("place") % 3 + 1))
    cap = F.col("source_size") * MOST
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = (F.col("weight") * level > cap) if capped >= 0 else F.lit(False)
        now = ranked.agg(F.sum(F.when(over, cap).otherwise(0)).alias("fixed"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if now.n == capped or not now.open:
            break
        capped, level = now.n, (total - now.fixed) / now.open
    return ranked.select("place", "source", "source_size", "n", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def rate_of(multiplier: Column, size: Column, mean: Column) -> Column:
    return F.exp(F.least(multiplier * size / mean, F.lit(math.log(MOST))))


def multipliers(counted: DataFrame, targets: DataFrame, sources: int) -> DataFrame:
    """targets and each source's mean size and multiplier, which is null where all rates are MOST, or 0 for want of words."""
    mean = F.col("source_size") / F.col("n")
    solvable = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < F.col("source_size") * MOST * (1 - NEAR))
    start = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log(F.col("target") / F.col("source_size"))))
    free = cut(targets.filter(solvable).select("place", "source", "target", mean.alias("mean"), start.alias("at"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
    terms = stored(counted.join(small(free.select("place", "source", "mean"), sources), counted.source.eqNullSafe(free.source)).select("place", "size", "n", (F.col("size") / F.col("mean")).alias("x")).filter("size > 0"))
    for _ in range(NEWTON_STEPS):
        rate = F.exp(F.least(F.col("at") * F.col("x"), F.lit(math.log(MOST))))
        mass = F.col("n") * F.col("size") * rate
        bent = F.when(F.col("at") * F.col("x") < math.log(MOST), mass * F.col("x")).otherwise(0.0)
        sums = terms.join(small(free, sources), "place").groupBy("place").agg(F.sum(mass).alias("words"), F.sum(bent).alias("slope"))
        low = F.when(F.col("words") < F.col("target"), F.col("at")).otherwise(F.col("low"))
        high = F.when(F.col("words") > F.col("target"), F.col("at")).otherwise(F.col("high"))
        known = free.join(sums, "place").withColumn("low", low).withColumn("high", high).withColumn("off", F.abs(F.col("words") / F.col("target") - 1))
        newton = F.col("at") + F.when(F.col("slope") > 0, (F.col("target") - F.col("words")) / F.col("slope"))
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high"))) & (F.abs(newton - F.col("at")) < 4 * (1 + F.abs("at")))
        halved = F.coalesce((F.col("low") + F.col("high")) / 2, 2 * F.greatest(F.col("low"), F.lit(0.0)) + 1, 2 * F.least(F.col("high"), F.lit(0.0)) - 1)
        known = stored(known.withColumn("next", F.when(F.col("off") <= NEAR, F.col("at")).when(inside, newton).otherwise(halved)))
        free = known.select("place", "source", "target", "mean", F.col("next").alias("at"), "low", "high")
        if (known.agg(F.max("off")).first()[0] or 0.0) <= NEAR:
            break
    return targets.join(free.select("place", "mean", F.col("at").alias("multiplier")), "place", "left")


def rounded(units: DataFrame, rates: DataFrame, sources: int) -> DataFrame:
    """copies for lots of n_rows equal rows (doc_id, source, size, lot): error diffusion from the largest document down, chunk by chunk."""
    rate = F.when(F.col("multiplier").isNotNull(), rate_of(F.col("multiplier"), F.col("size"), F.col("mean"))).otherwise(F.when(F.col("target") > 0, F.lit(float(MOST))).otherwise(0.0))
    lots = units.select("doc_id", "source", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("n_rows") / CHUNK).cast("long") - 1), lambda i: F.least(F.lit(CHUNK), F.col("n_rows") - i * CHUNK))).alias("lot", "n_rows"))
    one = small(rates, sources)
    placed = lots.join(one, lots.source.eqNullSafe(rates.source)).select(
        "doc_id", lots.source, "size", "lot", "n_rows", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64("doc_id", "size", "lot"), F.ceil(F.col("n") / CHUNK).cast("long")).alias("chunk")
    )
    item = F.struct((-F.col("size")).alias("order"), "doc_id", "lot", "size", "n_rows", "rate")
    chunks = placed.groupBy("source", "chunk").agg(F.sort_array(F.collect_list(item)).alias("items"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))

    def take(state: Column, x: Column) -> Column:
        size, n = x["size"].cast("double"), x["n_rows"]
        owed = state["owed"] + size * n * x["rate"]
        copies = F.when(size > 0, F.greatest(F.lit(0), F.least(n * MOST, F.round(owed / size).cast("long")))).otherwise(n)
        return F.struct((owed - copies * size).alias("owed"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<bigint>").alias("copies"))
    done = chunks.withColumn("state", F.aggregate("items", start, take)).withColumn("owed", F.col("state.owed")).withColumn("copies", F.col("state.copies"))
    # what is left over: one copy more of a document and one less of its neighbour in size, where that brings it down
    item_at, copies_at = (lambda i, c=c: F.get(F.col(c), i) for c in ("items", "copies"))

    def swap(i: Column, up: int) -> Column:
        more, less = (i, i + 1) if up > 0 else (i + 1, i)
        can = (copies_at(more) < item_at(more)["n_rows"] * MOST) & (copies_at(less) > 0) & (item_at(i + 1)["size"] > 0)
        return F.when(can, F.struct(F.abs(F.col("owed") - up * (item_at(i)["size"] - item_at(i + 1)["size"])).alias("off"), more.alias("more"), less.alias("less")))

    places = F.when(F.size("items") > 1, F.sequence(F.lit(0), F.size("items") - 2))
    done = done.withColumn("swap", F.when(F.abs("owed") >= 1, F.array_min(F.flatten(F.transform(places, lambda i: F.array(swap(i, 1), swap(i, -1)))))))
    moved = lambda i: (i == F.col("swap.more")).cast("long") - (i == F.col("swap.less")).cast("long")
    done = done.withColumn("copies", F.when(F.col("swap.off") < F.abs("owed"), F.transform("copies", lambda x, i: x + moved(i))).otherwise(F.col("copies")))
    out = done.select("source", "source_size", "target", F.explode(F.arrays_zip("items", "copies")).alias("x"))
    return out.select("x.items.doc_id", "source", "x.items.size", "x.items.lot", "x.items.n_rows", "source_size", "target", "x.copies")


def _mix(sizes: DataFrame) -> DataFrame:
    units = stored(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")))
    counted = stored(units.groupBy("source", "size").agg(F.sum("n_rows").alias("n")))
    targets = cut(source_targets(counted))
    sources = targets.count()
    return rounded(units, cut(multipliers(counted, targets, sources)), sources)


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), words(text_column(docs)).alias("size"))


def _share(copies: Column, n: Column, i: Column) -> Column:
    """Of `copies` dealt to n rows, those of row i."""
    return F.floor(copies / n) + (i < copies % n).cast("long")


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs."""
    rows = _mix(_sizes(docs)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_rows").cast("int") - 1)))
    each = rows.withColumn("copies", _share(F.col("copies"), F.col("n_rows"), F.col("i")).cast("int"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes at least once, with copies and taken, named with underscores before where docs has such columns.

    Of rows that repeat doc_id, source and size, which ones get a copy more goes by the hash of their texts.
    """
    size, row, copies, taken = unused(docs, "size", "row", "copies", "taken")
    mix = _mix(_sizes(docs)).groupBy("doc_id", "source", "size").agg(F.sum("n_rows").alias("n_rows"), F.sum("copies").alias("copies")).filter("copies > 0")
    left = docs.withColumn(size, words(text_column(docs)))
    on = left["doc_id"].cast("long").eqNullSafe(mix["doc_id"]) & left["source"].cast("string").eqNullSafe(mix["source"]) & (left[size] == mix["size"])
    both = left.join(mix, on).select(*[left[c] for c in docs.columns], left[size], mix["n_rows"].alias(row), mix["copies"].alias(copies))
    alone = both.filter(F.col(row) == 1).select(*docs.columns, size, F.col(copies).cast("int").alias(copies))
    order = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64(F.col("text")))
    several = both.filter(F.col(row) > 1).select(*docs.columns, size, _share(F.col(copies), F.col(row), F.row_number().over(order) - 1).cast("int").alias(copies))
    every = alone.union(several).filter(F.col(copies) > 0)
    return every.select(*docs.columns, copies, (F.col(size) * F.col(copies)).cast("long").alias(taken))
