"""Window operators for keys that may hold a large share of all rows.

A plain window puts a whole key into one task.  Here the ordered key is cut
into blocks; each block is one window partition, and only one summary row per
block meets the others of its key.  The rows then meet their summaries where they
already lie, merged: their files may look small enough to broadcast all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def block_of(order: Column, size: int = BLOCK) -> Column:
    return F.floor(order / F.lit(size)).cast("bigint")


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], value: Column, out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a key (and this one)."""
    keys = list(keys)
    d = df.withColumn("_block", block)
    totals = d.groupBy(*keys, "_block").agg(F.sum(value).alias("_n"))
    before = totals.select(*keys, "_block", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    local = d.withColumn("_local", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return local.join(before.hint("merge"), [*keys, "_block"]).withColumn(out, F.col("_before") + F.col("_local")).drop(
        "_block", "_before", "_local"
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], out: str
) -> DataFrame:
    """1-based position inside the key."""
    return running_sum(df, keys, block, order, F.lit(1).cast("bigint"), out)


def carry_last(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], value: Column, out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Latest non-NULL ``value`` at or before each row of a key (before it if not inclusive)."""
    keys = list(keys)
    d = df.withColumn("_block", block).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    local = d.withColumn("_local", F.last("_v", ignorenulls=True).over(w))
    ends = d.filter("_v IS NOT NULL").groupBy(*keys, "_block").agg(
        F.max_by("_v", F.struct(*order)).alias("_end")
    )
    blocks = d.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    carried = blocks.select(*keys, "_block", F.last("_end", ignorenulls=True).over(_earlier(keys)).alias("_carry"))
    return local.join(carried.hint("merge"), [*keys, "_block"]).withColumn(out, F.coalesce("_local", "_carry")).drop(
        "_block", "_v", "_local", "_carry"
    )


def last_n(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The ``n`` latest rows of every key.

    Counting rows per block first leaves only the blocks that can hold one of
    them, so the final ranking sees about ``n`` plus one block per key.
    """
    keys = list(keys)
    d = df.withColumn("_block", block)
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "_block").count()
    needed = (
        counts.withColumn("_later", F.coalesce(F.sum("count").over(later), F.lit(0)))
        .filter(F.col("_later") < n)
        .select(*keys, "_block")
    )
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    ranked = d.join(needed, [*keys, "_block"], "left_semi").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    ranked = ranked.withColumn(rank, F.col("_rn").cast("bigint")) if rank else ranked
    return ranked.drop("_block", "_rn")


def neighbours(df: DataFrame, keys: Sequence[str], order: Column, reach: Column, size: float) -> DataFrame:
    """Rows spread over value blocks of ``size`` together with the rows of the
    previous block that lie within ``reach`` of the block start.

    Adds ``_block`` and ``_own`` (True in the row's own block): a range window
    per (key, block) filtered to ``_own`` equals one over the whole key.
    """
    own = F.floor(order / F.lit(size)).cast("bigint")
    near_end = order + reach >= (own + 1) * F.lit(size)
    spread = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(spread)).withColumn("_own", F.col("_block") == own)


def running_max(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Largest ``value`` of the earlier rows of a key; NULL on its first row."""
    keys = list(keys)
    d = df.withColumn("_block", block)
    tops = d.groupBy(*keys, "_block").agg(F.max(value).alias("_top"))
    before = tops.select(*keys, "_block", F.max("_top").over(_earlier(keys)).alias("_before"))
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_local", F.max(value).over(w))
    return local.join(before.hint("merge"), [*keys, "_block"]).withColumn(out, F.greatest("_local", "_before")).drop(
        "_block", "_local", "_before"
    )


def interval_clusters(
    df: DataFrame, keys: Sequence[str], start: str, end: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Groups overlapping intervals: ``out`` is the start of the first one.

    An interval that begins at or after every earlier end opens a new group, so
    a decision made from left to right never reaches across groups.
    """
    order = [F.col(start)]
    d = running_max(df, keys, block_of(F.col(start), block), order, end, "_reach")
    opens = F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), F.col(start))
    return carry_last(d, keys, block_of(F.col(start), block), order, opens, out).drop("_reach")
