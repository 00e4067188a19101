"""Frame files: one JSON object with four subframes of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import WORD_MAX

# Fixed value: the frame file format.
FORMAT = "arinc717-frame"
SCHEMA = "format STRING, version INT, wps INT, frame_index BIGINT, subframes ARRAY<ARRAY<INT>>, _bad STRING"


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(subframe rows, rejected files with the reason) (SRC-05).  Frame files are a few kB each."""
    return parse_frames(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def parse_frames(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read_frames`` of texts (file, value)."""
    f = raw.withColumn("f", F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_bad"})).select("file", "f.*")
    shape = (F.size("subframes") == 4) & F.forall("subframes", lambda s: F.size(s) == F.col("wps"))
    inside = F.forall("subframes", lambda s: F.forall(s, lambda w: w.between(0, WORD_MAX)))
    problem = (
        F.when(F.col("_bad").isNotNull() | F.col("format").isNull() | (F.col("format") != FORMAT), "not a frame file")
        .when(F.coalesce(F.col("wps") <= 0, F.lit(True)) | ~F.coalesce(shape, F.lit(False)), "wrong number of words")
        .when(~F.coalesce(inside, F.lit(False)), "word outside 0..4095")
    )
    f = f.withColumn("problem", problem)
    good = f.filter("problem IS NULL").select(
        F.col("file").alias("recording_id"), F.coalesce("frame_index", F.lit(0)).alias("frame_index"), "wps",
        F.posexplode("subframes").alias("i", "words"),
    )
    return good.withColumn("subframe", F.col("i") + 1).drop("i"), f.filter("problem IS NOT NULL").select("file", "problem")


def frame_json(subframes: DataFrame) -> DataFrame:
    """One JSON text per complete frame (SNK-03)."""
    g = subframes.groupBy("recording_id", "frame_index").agg(
        F.array_sort(F.collect_list(F.struct("subframe", "words"))).alias("s")
    ).filter(F.size("s") == 4)
    return g.select("recording_id", "frame_index", F.to_json(F.struct(
        F.lit(FORMAT).alias("format"), F.lit(1).alias("version"), F.size(F.get("s", F.lit(0))["words"]).alias("wps"), "frame_index",
        F.transform("s", lambda x: x["words"]).alias("subframes"),
    )).alias("value"))


def write_frames(subframes: DataFrame, path: str) -> None:
    """A folder per frame, each with one file."""
    frame_json(subframes).write.partitionBy("recording_id", "frame_index").text(path)
