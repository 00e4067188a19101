"""Word-level views: what is mapped to a cell, and the bits behind a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import extract_bits
from ..schemas import DECODABLE_STATES, LINEAR_TYPES, WORD_BITS
from ..session import broadcast_if_small
from .decode import decode, decodable
from .mapping import occurrence_map

CELL_SAMPLE = ("decoded", "eng_value", "eng_label", "status")


def cells(parameters: DataFrame, segments: DataFrame) -> DataFrame:
    """Mapped cells: one row per (document, subframe, word, parameter, occurrence, segment)."""
    occ = occurrence_map(parameters, segments).select(
        "document_id", "param_id", "occ", F.col("error").isNotNull().alias("broken")
    )
    return (
        segments.filter("seq IS NOT NULL").withColumn("subframe", F.explode("subframes"))
        .select("document_id", "subframe", "word", "param_id", "occ", "seq", "lsb", "msb")
        .withColumnRenamed("seq", "segment").join(occ, ["document_id", "param_id", "occ"])
    )


def word_inspector(subframes: DataFrame, plans: DataFrame, mapped: DataFrame) -> DataFrame:
    """Every mapped cell of every subframe with its bits and its sample (JON-02).

    Decoded cells come straight from the decode pass; only cells of unusable
    subframes or broken occurrences have no sample.
    """
    samples = decode(decodable(subframes), plans, keep=("segs",)).filter("subframe IS NOT NULL")
    from_samples = samples.withColumn("g", F.explode("segs")).select(
        "recording_id", "document_id", "seq", "subframe", F.col("g.word").alias("word"), "param_id", "occ",
        F.col("g.seq").alias("segment"), F.col("g.lsb").alias("lsb"), F.col("g.msb").alias("msb"), *CELL_SAMPLE,
    )
    usable = F.col("state").isin(*DECODABLE_STATES)
    bare = (
        subframes.withColumn("_usable", usable)
        .select("recording_id", "document_id", "seq", "subframe", "_usable")
        .join(broadcast_if_small(mapped), ["document_id", "subframe"])
        .filter(~F.col("_usable") | F.col("broken"))
        .select("recording_id", "document_id", "seq", "subframe", "word", "param_id", "occ", "segment", "lsb", "msb",
                F.lit(None).cast("double").alias("decoded"), F.lit(None).cast("double").alias("eng_value"),
                F.lit(None).cast("string").alias("eng_label"), F.lit(None).cast("string").alias("status"))
    )
    return from_samples.unionByName(bare)


def parameter_bits(samples: DataFrame) -> DataFrame:
    """The 12 bits of every word behind a traced sample, mapped ones marked (JON-03)."""
    lo, hi = F.least("g.lsb", "g.msb"), F.greatest("g.lsb", "g.msb")
    return (
        samples.withColumn("g", F.explode("trace"))
        .withColumn("bit", F.explode(F.sequence(F.lit(WORD_BITS), F.lit(1), F.lit(-1))))
        .select(
            "recording_id", "seq", "param_id", "occ", F.col("g.seq").alias("segment"), F.col("g.word").alias("word"),
            "bit", extract_bits(F.col("g.word_value"), F.col("bit"), F.col("bit")).alias("is_set"),
            F.col("bit").between(lo, hi).alias("mapped"),
        )
    )


def sample_view(samples: DataFrame, parameters: DataFrame) -> DataFrame:
    """The 13-column sample table: samples joined to their parameter (JON-04)."""
    dim = parameters.select(
        "document_id", "param_id", "description", "ptype", "source_type",
        F.when(F.col("ptype").isin(*LINEAR_TYPES), F.col("resolution")).alias("resolution"),
        F.when(F.col("ptype").isin(*LINEAR_TYPES), F.col("offset")).alias("offset"),
    )
    return samples.drop("description").join(broadcast_if_small(dim), ["document_id", "param_id"], "left").select(
        "recording_id", "seq", F.col("param_name").alias("mnemonic"), "description", "ptype", "occ", "subframe",
        "raw_bits", "decoded", "resolution", "offset", "eng_value", "eng_label", "unit", "source_type", "status",
    )
