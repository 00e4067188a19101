"""Mapping documents prepared for decoding: one row per (occurrence, subframe).

``sample_plans`` folds parameters and segments into self-contained rows, so a
decode is one join (broadcast when the mapping is small, shuffled otherwise)
followed by plain expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import bcd_capacity
from ..schemas import (
    ANALOG_SIGNED, ANALOG_UNSIGNED, BCD, DISCRETE, RAW, SUBFRAME_COUNT, WORD_BITS,
)

MODE_FRAME = "frame"
MODE_SUBFRAME = "subframe"

# Messages of mapping problems, shared by decode, error tables and tests.
NO_OCCURRENCES = "parameter has no occurrences"
NO_SEGMENTS = "occurrence has no segments"
DISAGREE = "segments disagree on subframes"
NO_SUBFRAMES = "segment has no subframes"


def subframe_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def with_bit_fields(segments: DataFrame) -> DataFrame:
    """Adds lo / hi / width and the static error of a segment, if any."""
    lo, hi = F.least("lsb", "msb"), F.greatest("lsb", "msb")
    bad = (
        F.when(~F.col("lsb").between(1, WORD_BITS), F.concat(F.lit("lsb="), F.col("lsb").cast("string"), F.lit(" outside 1..12")))
        .when(~F.col("msb").between(1, WORD_BITS), F.concat(F.lit("msb="), F.col("msb").cast("string"), F.lit(" outside 1..12")))
    )
    return (
        segments.withColumn("lo", lo).withColumn("width", F.when(bad.isNull(), hi - lo + 1).otherwise(0))
        .withColumn("bit_error", bad)
    )


def occurrences(segments: DataFrame) -> DataFrame:
    """One row per (document, parameter, occurrence) with its ordered segments."""
    segs = with_bit_fields(segments)
    seg = F.struct("seq", "word", "lsb", "msb", "lo", "width", F.col("bcd_weight").alias("weight"), "bit_error")
    present = F.col("seq").isNotNull()
    grouped = segs.groupBy("document_id", "param_id", "occ").agg(
        F.array_sort(F.collect_list(F.when(present, seg))).alias("segs"),
        F.collect_set(F.when(present, subframe_set(F.col("subframes")))).alias("sets"),
        F.sum(F.when(present, F.col("width"))).cast("int").alias("width"),
        F.bool_and(F.when(present, F.col("bcd_weight").isNotNull())).alias("weighted"),
    )
    return grouped.withColumn("subframes", F.get("sets", F.lit(0))).withColumn(
        "error",
        F.when(F.size("segs") == 0, NO_SEGMENTS)
        .when(F.size("sets") > 1, DISAGREE)
        .when(F.size("subframes") == 0, NO_SUBFRAMES),
    ).drop("sets")


def first_label_map(states: Column) -> Column:
    """State table as a map that keeps the first label of a repeated value."""
    firsts = F.filter(
        states,
        lambda s, i: ~F.exists(F.slice(states, F.lit(1), i), lambda e: e["value"] == s["value"]),
    )
    return F.when(F.size(states) > 0, F.map_from_entries(firsts))


def occurrence_map(parameters: DataFrame, segments: DataFrame) -> DataFrame:
    """Every parameter with its occurrences, or with one NULL-occurrence error row."""
    occ = occurrences(segments)
    joined = parameters.join(occ, ["document_id", "param_id"], "left")
    return (
        joined.withColumn("error", F.when(F.col("occ").isNull(), NO_OCCURRENCES).otherwise(F.col("error")))
        .withColumn("occ", F.coalesce("occ", F.lit(0)))
        .withColumn("weighted", (F.col("ptype") == BCD) & F.coalesce("weighted", F.lit(False)))
        .withColumn("labels", first_label_map(F.col("states")))
    )


def mapping_errors(parameters: DataFrame, segments: DataFrame) -> DataFrame:
    """Occurrence-level INVALID_MAPPING rows (DEC-03), one per parameter or occurrence."""
    return (
        occurrence_map(parameters, segments).filter("error IS NOT NULL")
        .select("document_id", "param_ord", "param_id", "occ", F.col("error").alias("message"))
    )


def sample_plans(
    documents: DataFrame, parameters: DataFrame, segments: DataFrame, mode: str = MODE_SUBFRAME
) -> DataFrame:
    """Rows ``(document_id, deliver_on, …)``: what to decode when a subframe arrives.

    ``deliver_on`` is the subframe whose arrival produces the sample,
    ``sample_subframe`` the one the sample reports.  Mapping-level errors are
    delivered once per frame with SF1; in whole-frame mode so are samples whose
    subframe number lies outside 1..4.
    """
    docs = documents.select("document_id", F.col("wps").alias("doc_wps"))
    plan = occurrence_map(parameters, segments).join(docs, "document_id")
    target = F.when(
        F.col("error").isNull(),
        F.transform(
            F.col("subframes"),
            lambda s: F.struct(
                F.when(s.between(1, SUBFRAME_COUNT), s).otherwise(F.lit(1 if mode == MODE_FRAME else 0)).alias("on"),
                s.alias("sf"),
            ),
        ),
    ).otherwise(F.array(F.struct(F.lit(1).alias("on"), F.lit(None).cast("int").alias("sf"))))
    plan = plan.withColumn("target", F.explode(target)).filter("target.on > 0").withColumn("sf", F.col("target.sf"))

    # A subframe row joins only where its length is the document's, so every
    # addressing problem of a sample is known here, per plan row.
    faults = F.transform("segs", lambda s: segment_fault(s, F.col("sf"), F.col("doc_wps")))
    plan = plan.withColumn("_faults", F.when(F.col("error").isNull(), faults))
    at = F.array_position(F.transform("_faults", lambda e: e.isNotNull()), F.lit(True)).cast("int")
    plan = plan.withColumn("failing", F.when(at > 0, at))
    words = F.transform(
        F.when(F.col("failing").isNull(), F.col("segs")).otherwise(F.slice("segs", F.lit(1), F.col("failing"))),
        lambda s: s["word"],
    )
    return plan.select(
        "document_id", "doc_wps", F.col("target.on").alias("deliver_on"), F.col("sf").alias("sample_subframe"),
        "param_ord", "param_id", F.col("mnemonic").alias("param_name"), "description", "occ",
        F.coalesce("error", F.get("_faults", F.col("failing") - 1)).alias("message"),
        F.col("error").isNotNull().alias("occurrence_error"), "failing",
        F.when(F.col("error").isNull(), F.array_min(words)).otherwise(1).alias("first_word"),
        "segs", F.col("width").alias("bit_width"), "weighted", "ptype", "unit", "minimum", "maximum",
        "resolution", "offset", "formula_type", "true_state", "false_state", "labels",
    )


def segment_fault(seg: Column, subframe: Column, wps: Column) -> Column:
    """Why a segment cannot be read from a frame of ``wps`` words (DEC-04), or NULL."""
    head = F.concat(F.lit("segment #"), seg["seq"].cast("string"), F.lit(": "))
    return (
        F.when(seg["bit_error"].isNotNull(), F.concat(head, seg["bit_error"]))
        .when(~subframe.between(1, SUBFRAME_COUNT), F.concat(head, F.lit("subframe "), subframe.cast("string"), F.lit(" outside 1..4")))
        .when(
            ~seg["word"].between(1, wps),
            F.concat(head, F.lit("word "), seg["word"].cast("string"), F.lit(" outside 1.."), wps.cast("string")),
        )
    )


# -- ranges and rates ------------------------------------------------------

HALF_STEP = 0.499


def first_occurrence(parameters: DataFrame, segments: DataFrame) -> DataFrame:
    """Parameters with the segments of their first listed occurrence."""
    occ = occurrences(segments).withColumn("wsum", F.aggregate("segs", F.lit(0.0), lambda a, s: a + 9 * s["weight"]))
    first = occ.groupBy("document_id", "param_id").agg(
        F.min_by(F.struct("width", "wsum", "weighted", "subframes"), "occ").alias("f")
    )
    return parameters.join(first, ["document_id", "param_id"], "left").select(
        *[F.col(c) for c in parameters.columns], "f.*"
    )


def representable_range(parameters: DataFrame, segments: DataFrame) -> DataFrame:
    """Engineering range the bit field can hold (MAP-10) and the declared range
    clipped to it (MAP-11)."""
    p = first_occurrence(parameters, segments)
    two = F.lit(2.0)
    signed = F.col("ptype") == ANALOG_SIGNED
    lo = F.when(signed, -F.pow(two, F.col("width") - 1)).otherwise(0.0)
    hi = (
        F.when(signed, F.pow(two, F.col("width") - 1) - 1)
        .when((F.col("ptype") == BCD) & F.col("weighted"), F.col("wsum"))
        .when(F.col("ptype") == BCD, bcd_capacity(F.col("width")).cast("double"))
        .otherwise(F.pow(two, F.col("width")) - 1)
    )
    res = F.when(F.col("resolution") == 0, 1.0).otherwise(F.col("resolution"))
    has = F.col("width") > 0
    p = p.withColumn("_lo", F.when(has, lo)).withColumn("_hi", F.when(has, hi))
    a = F.col("offset") + (F.col("_lo") - HALF_STEP) * res
    b = F.col("offset") + (F.col("_hi") + HALF_STEP) * res
    raw = F.col("ptype") == RAW
    p = p.withColumn("rep_low", F.when(raw, F.col("_lo")).otherwise(F.least(a, b))).withColumn(
        "rep_high", F.when(raw, F.col("_hi")).otherwise(F.greatest(a, b))
    )
    p = p.withColumn("rep_low", F.when(has, F.col("rep_low"))).withColumn("rep_high", F.when(has, F.col("rep_high")))
    declared = F.coalesce(F.col("maximum") > F.col("minimum"), F.lit(False))
    clip_lo, clip_hi = F.greatest("minimum", "rep_low"), F.least("maximum", "rep_high")
    use_clip = declared & (clip_hi > clip_lo)
    discrete = F.col("ptype") == DISCRETE
    low = F.when(discrete, 0.0).when(use_clip, clip_lo).otherwise(F.coalesce("rep_low", F.when(declared, F.col("minimum")), F.lit(0.0)))
    high = F.when(discrete, 1.0).when(use_clip, clip_hi).otherwise(F.coalesce("rep_high", F.when(declared, F.col("maximum")), F.lit(1.0)))
    return p.select("document_id", "param_ord", "param_id", "rep_low", "rep_high", low.alias("low"), high.alias("high"))


def recording_rate(parameters: DataFrame, segments: DataFrame) -> DataFrame:
    """Samples per frame and Hz of each parameter (MAP-12)."""
    occ = occurrences(segments).filter("error IS NULL")
    rate = occ.groupBy("document_id", "param_id").agg(F.sum(F.size("subframes")).alias("samples_per_frame"))
    return parameters.join(rate, ["document_id", "param_id"], "left").select(
        "document_id", "param_ord", "param_id",
        F.coalesce("samples_per_frame", F.lit(0)).cast("bigint").alias("samples_per_frame"),
        (F.coalesce("samples_per_frame", F.lit(0)) / 4.0).alias("rate_hz"),
    )


__all__ = [
    "MODE_FRAME", "MODE_SUBFRAME", "mapping_errors", "occurrence_map", "occurrences",
    "recording_rate", "representable_range", "sample_plans", "ANALOG_UNSIGNED",
]
