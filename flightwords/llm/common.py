"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators' contracts mean it, and its complement.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Rows and bytes that a worker is handed at a time, if texts are in them.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, row: bool = False) -> DataFrame:
    """Only the named columns, and on demand ``row``: all columns as one struct.

    Columns are taken by position, so that further columns of any name, names
    differing in case only included, cannot clash with those of an operator.
    """
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = [flat[f"c{df.columns.index(n)}"].alias(n) for n in names]
    if row:
        out.append(F.struct(*[flat[f"c{i}"].alias(n) for i, n in enumerate(df.columns)]).alias("row"))
    return flat.select(*out)


def unpack(df: DataFrame, names: list[str], row: str = "row") -> DataFrame:
    """The columns that ``pick(row=True)`` packed, under their own names."""
    return df.select(f"{row}.*").toDF(*names)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of ASCII-white-space separated words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD + "+")).cast("long")


def in_small_batches(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """What ``run`` returns, after it has written or gathered it: rows reach Python by SMALL_BATCHES.

    A worker holds a batch, and the executor beside it holds it twice, outside its heap:
    as vectors and as the bytes that are sent, both grown by doubling.
    """
    before = {k: spark.conf.get(k, None) for k in SMALL_BATCHES}
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
