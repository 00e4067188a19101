"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

A document's size is its number of words.  Sources, by code point and null
last, weigh 1, 2, 3 and so on again, and share the sum of all sizes by weight;
no target may exceed ``most`` times its source's size, and what is above goes
to the others by weight until none is above.

Every document of a source expects the same number of copies, its source's
target over its size.  Expected copies are summed over the source in an order
(size band, hash bucket, size, doc_id), one random offset per source is added,
and a document is emitted once for each whole number that its step crosses: at
most ``most`` rounded up.  Ordered by size, the words taken stay within a few
documents of the target.

A source may hold any share of the rows: ranks are counted in blocks (source,
band, bucket); block sizes meet band by band, and band sizes, some hundred at
most, source by source.

Defined results: null or wordless text has size 0; such documents take part
with size 0; a source of size 0 has target 0 and takes nothing; repeated rows
are documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightwords.llm.common import pick, unpack, word_count
from flightwords.session import materialize

WEIGHTS = (1, 2, 3)
MOST = 3
BUCKETS = 256
SEED = 42


def _fraction(*parts: Column) -> Column:
    """A number in [0, 1) made from text, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of (source, size) rows.

    min(most * size, level * weight) with the level at which the targets sum up
    to all sizes: sources are taken by the level at which they are capped, and
    prefix sums tell where the level lies.  One row per source in one window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.select("*", w.alias("w"))
    cap = F.col("source_size") * F.lit(float(most))
    by_cap = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the level if all sources up to the one before are capped; the first that it doesn't cap fixes it
    tried = per.select("*", cap.alias("cap"), level.alias("level"))
    fixed = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)
    return tried.select(
        "source", "source_size", "n_docs",
        F.when(fixed.isNull(), F.col("cap")).otherwise(F.least("cap", fixed["level"] * F.col("w"))).alias("target"),
    )


def band(size: Column) -> Column:
    """Digits and the first two of them: bands of at most a tenth, by text only."""
    s = size.cast("string")
    return (F.length(s) * 100 + F.substring(F.rpad(s, 2, "0"), 1, 2).cast("int")).cast("int")


def copies(docs: DataFrame, row: bool = False, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (and ``row``) of every document."""
    carried = ["row"] if row else []

    def sized(d: DataFrame) -> DataFrame:
        bucket = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int") % BUCKETS
        d = d.withColumn("size", word_count(F.col("text"))).withColumn("tie", F.md5(F.coalesce("text", F.lit(""))))
        return d.withColumns({"band": band(F.col("size")), "bucket": bucket}).drop("text")

    # texts are measured once; the counts below work on this narrow table
    narrow = materialize(sized(pick(docs, "doc_id", "source", "text")))
    d = sized(pick(docs, "doc_id", "source", "text", row=True)) if row else narrow
    blocks = narrow.groupBy("source", "band", "bucket").agg(F.count(F.lit(1)).alias("n"))
    goal = targets(narrow, weights, most)
    # null sources meet as one: the join key is a text that no other source can have
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    # earlier bands of the source, then earlier buckets of the band: some hundred rows a window each
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = blocks.groupBy("source", "band").agg(F.sum("n").alias("n"))
    bands = bands.select(key.alias("key"), "band", before(Window.partitionBy("source").orderBy("band")).alias("band_start"))
    goal = bands.join(goal.select(key.alias("key"), "source_size", "target"), "key")
    start = blocks.select(key.alias("key"), "band", "bucket", before(Window.partitionBy("source", "band").orderBy("bucket")).alias("in_band"))
    start = start.join(goal, ["key", "band"]).withColumn("start", F.col("band_start") + F.col("in_band")).drop("band_start", "in_band")
    inside = Window.partitionBy("key", "band", "bucket").orderBy("size", F.col("doc_id").asc_nulls_last(), "tie")
    ranked = d.withColumn("key", key).withColumn("local", F.row_number().over(inside)).drop("tie")
    d = ranked.join(start, ["key", "band", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _fraction(F.lit(str(seed)), F.col("key"))
    rank = F.col("start") + F.col("local")
    n = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return d.select("doc_id", "source", "size", "source_size", "target", n.cast("long").alias("copies"), *carried)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was drawn, all columns as they are."""
    drawn = copies(docs, row=True, **options).filter("copies > 0")
    return unpack(drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row"), docs.columns)
