"""Session helpers: local test sessions, checkpoint folder, size checks."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only when it was counted to hold at most this
# many rows.  A plan row is well under 1 kB, so this is a few hundred MB at most.
BROADCAST_ROW_LIMIT = 200_000


def local_session(cores: int | str = 8, name: str = "flightwords", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _scratch()


@functools.cache
def _scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Used for compact intermediate tables that several later steps scan: it is
    computed once, survives the loss of any executor, and its file sizes let
    Catalyst choose join strategies from facts.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"flightwords-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """True when ``df`` holds at most ``limit`` rows (the count stops there)."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint behind a size check; above it Catalyst shuffles both sides
    and AQE splits skewed keys."""
    return F.broadcast(df) if fits(df, limit) else df
