"""Engineering values to words, and the closed-loop check.

A scenario is a table (recording_id, frame_index, ord, param_id, value, label):
``value`` for numbers, ``label`` for discrete states.  Within a frame the writes
take effect in ``ord`` order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import bcd_encode, shift_left, shift_right
from ..schemas import (
    ANALOG_SIGNED, ANALOG_UNSIGNED, BCD, DISCRETE, LINEAR_TYPES, OUT_OF_RANGE, RAW, SUBFRAME_COUNT, VALID,
)
from ..session import broadcast_if_small
from .mapping import occurrence_map

ENCODED, ENCODE_ERROR = "ENCODED", "ENCODE_ERROR"
LADDER_TOLERANCE = 1e-9


def encodable(parameters: DataFrame, segments: DataFrame) -> DataFrame:
    """Parameters a scenario may set (ENC-01)."""
    listed = segments.groupBy("document_id", "param_id", "occ").agg(F.count("seq").alias("n")).groupBy(
        "document_id", "param_id"
    ).agg(F.min("n").alias("fewest"))
    linear = F.col("ptype").isin(*LINEAR_TYPES)
    return (
        parameters.join(listed, ["document_id", "param_id"])
        .filter((F.col("fewest") > 0) & F.col("ptype").isin(*LINEAR_TYPES, DISCRETE, RAW))
        .filter(~linear | ((F.col("formula_type") == "linear") & (F.col("resolution") != 0)))
        .drop("fewest")
    )


def tolerance() -> Column:
    """Largest error quantization explains (SCL-31)."""
    return F.when(F.col("ptype").isin(*LINEAR_TYPES), F.abs("resolution") / 2 + 1e-9).otherwise(0.0)


def blank_subframes(frames: DataFrame, wps: int, sync_words: Iterable[int] | None = None) -> DataFrame:
    """Four all-zero subframes per row of ``frames``, with sync words if given (ENC-06)."""
    sync = list(sync_words or [])
    first = F.get(F.array(*[F.lit(s) for s in sync]), F.col("subframe") - 1) if sync else F.lit(0)
    return frames.withColumn("subframe", F.explode(F.array(*[F.lit(i) for i in range(1, SUBFRAME_COUNT + 1)]))).withColumn(
        "words", F.concat(F.array(F.coalesce(first, F.lit(0))), F.array_repeat(F.lit(0), wps - 1))
    )


def dictionary(scenario: DataFrame) -> DataFrame:
    """One value per (frame, parameter): the last one given, at its first position."""
    keys = [c for c in ("recording_id", "frame_index", "document_id", "param_id") if c in scenario.columns]
    return scenario.groupBy(*keys).agg(
        F.min("ord").alias("ord"), F.max_by(F.struct("value", "label"), "ord").alias("v")
    ).select(*keys, "ord", "v.*")


def _of_document(df: DataFrame, document_id: str | None) -> tuple[DataFrame, list[str]]:
    """Mapping rows of one document, or of all, with the columns that tell parameters apart."""
    if document_id is None:
        return df, ["document_id", "param_id"]
    return df.filter(F.col("document_id") == document_id), ["param_id"]


def patterns(scenario: DataFrame, parameters: DataFrame, segments: DataFrame, document_id: str | None) -> DataFrame:
    """Bit pattern of every scenario value and occurrence (ENC-02, ENC-03).

    Rows that cannot be encoded carry status ENCODE_ERROR and a message; an
    unknown parameter is such a row too.  Without ``document_id`` every row of
    the scenario names its own document.
    """
    mine, by = _of_document(parameters, document_id)
    occ = occurrence_map(mine, segments).select(
        *by, "ptype", "occ", "segs", "width", "weighted", "resolution", "offset", "formula_type",
        "true_state", "false_state", F.lit(True).alias("known"),
    )
    j = scenario.join(broadcast_if_small(occ), by, "left")
    kind, width = F.col("ptype"), F.col("width")
    number = F.coalesce("value", F.col("label").try_cast("double"))
    scaled = (number - F.col("offset")) / F.nullif("resolution", F.lit(0.0))
    # numbers beyond BIGINT fit no field; limits of fields of 63 bits and more are BIGINT's own
    raw = F.rint(scaled).try_cast("bigint")
    one, most = F.lit(1).cast("bigint"), F.lit(2**63 - 1)
    limit = F.when(width < 63, shift_left(one, width)).otherwise(most)
    half = F.when(width < 64, shift_left(one, F.least(width, F.lit(63)) - 1)).otherwise(most)
    mask = F.when(width < 63, shift_left(one, width) - 1).when(width == 63, most)
    upper = F.upper(F.trim("label"))
    discrete = (
        F.when(F.col("label").isNull() & F.col("value").isin(0.0, 1.0), F.col("value").try_cast("bigint"))
        .when(upper == F.upper(F.trim(F.coalesce("true_state", F.lit("TRUE")))), F.lit(1).cast("bigint"))
        .when(upper == F.upper(F.trim(F.coalesce("false_state", F.lit("FALSE")))), F.lit(0).cast("bigint"))
    )
    whole = number.try_cast("bigint")
    linear = F.col("formula_type") == "linear"
    plain = (
        F.when((kind == ANALOG_SIGNED) & linear & raw.between(-half, half - 1), F.when(raw >= 0, raw).otherwise(raw.bitwiseAND(mask)))
        .when((kind == ANALOG_UNSIGNED) & linear & (raw >= 0) & (raw < limit), raw)
        .when((kind == BCD) & linear & (raw >= 0) & (bcd_encode(raw) < limit), bcd_encode(raw))
        .when((kind == DISCRETE) & (discrete < limit), discrete)
        .when((kind == RAW) & (whole >= 0) & (whole < limit), whole)
    )
    # Weighted BCD: one digit per segment on a decade ladder of weights.
    n = F.size("segs")
    base = F.array_min(F.transform("segs", lambda s: s["weight"]))
    ladder = F.forall(
        F.transform("segs", lambda s, i: F.abs(s["weight"] - base * F.pow(F.lit(10.0), n - 1 - i)) <= LADDER_TOLERANCE * s["weight"]),
        lambda good: good,
    )
    integer = F.rint(scaled / F.nullif(base, F.lit(0.0))).try_cast("bigint")
    digits = F.transform("segs", lambda s, i: (F.floor(integer / F.pow(F.lit(10.0), n - 1 - i)) % 10).cast("bigint"))
    roomy = F.forall(F.zip_with("segs", digits, lambda s, d: d < shift_left(F.lit(1).cast("bigint"), s["width"])), lambda b: b)
    weighted_ok = (base > 0) & ladder & (integer >= 0) & (integer < F.pow(F.lit(10.0), n)) & roomy
    joined_digits = F.aggregate(
        F.zip_with("segs", digits, lambda s, d: F.struct(s["width"].alias("w"), d.alias("d"))),
        F.lit(0).cast("bigint"), lambda a, p: shift_left(a, p["w"]).bitwiseOR(p["d"]),
    )
    pattern = F.when(F.col("weighted"), F.when(linear & weighted_ok, joined_digits)).otherwise(plain)
    out = j.withColumn("pattern", F.when(F.size("segs") > 0, pattern))
    fault = F.exists("segs", lambda s: s["bit_error"].isNotNull())
    out = out.withColumn("pattern", F.when(~F.coalesce(fault, F.lit(False)), F.col("pattern")))
    return out.withColumn("status", F.when(F.col("pattern").isNotNull(), ENCODED).otherwise(ENCODE_ERROR)).withColumn(
        "message",
        F.when(F.col("known").isNull(), F.concat(F.lit("unknown parameter id "), F.col("param_id")))
        .when(F.col("pattern").isNull(), "value does not fit the mapping"),
    )


def writes(
    encoded: DataFrame, segments: DataFrame, document_id: str | None, only_subframes: Iterable[int] | None = None
) -> DataFrame:
    """Masked writes per cell (ENC-04): which bits of which word to set."""
    later = lambda i: F.aggregate(F.slice("segs", i + 2, F.size("segs")), F.lit(0), lambda a, g: a + g["width"])
    parts = F.transform(
        "segs",
        lambda s, i: F.struct(
            s["seq"].alias("seq"), s["word"].alias("word"),
            shift_left(shift_left(F.lit(1).cast("bigint"), s["width"]) - 1, s["lo"] - 1).alias("mask"),
            shift_left(
                shift_right(F.col("pattern"), later(i)).bitwiseAND(shift_left(F.lit(1).cast("bigint"), s["width"]) - 1),
                s["lo"] - 1,
            ).alias("bits"),
        ),
    )
    mine, by = _of_document(segments, document_id)
    cells = (
        encoded.filter(F.col("status") == ENCODED)
        .select("recording_id", "frame_index", "ord", *by, "occ", F.inline(parts))
    )
    where = mine.filter(F.col("seq").isNotNull()).select(*by, "occ", "seq", F.explode("subframes").alias("subframe"))
    if only_subframes is not None:
        where = where.filter(F.col("subframe").isin(*only_subframes))
    return cells.join(broadcast_if_small(where), [*by, "occ", "seq"])


def word_updates(w: DataFrame) -> DataFrame:
    """Writes of a cell folded in scenario order into one (clear, set) pair.

    The number of writes per cell and frame is bounded by the mapping's overlaps.
    """
    listed = F.array_sort(F.collect_list(F.struct("ord", "occ", "seq", "mask", "bits")))
    return w.groupBy("recording_id", "frame_index", "subframe", "word").agg(
        F.bit_or("mask").alias("clear"), listed.alias("l")
    ).select(
        "recording_id", "frame_index", "subframe", "word", "clear",
        F.aggregate("l", F.lit(0).cast("bigint"), lambda a, p: a.bitwiseAND(F.bitwise_not(p["mask"])).bitwiseOR(p["bits"])).alias("set"),
    )


def apply_updates(subframes: DataFrame, updates: DataFrame) -> DataFrame:
    """Read-modify-write of only the mapped bits (ENC-05)."""
    keys = ["recording_id", "frame_index", "subframe"]
    per_subframe = updates.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.struct("clear", "set")))).alias("u")
    )

    def edit(word: Column, i: Column) -> Column:
        u = F.try_element_at("u", i + 1)
        changed = word.cast("bigint").bitwiseAND(F.bitwise_not(u["clear"])).bitwiseOR(u["set"]).cast("int")
        return F.when(u.isNotNull(), changed).otherwise(word)

    j = subframes.join(per_subframe, keys, "left")
    return j.withColumn("words", F.when(F.col("u").isNull(), F.col("words")).otherwise(F.transform("words", edit))).drop("u")


def scenario_frames(
    scenario: DataFrame, base: DataFrame, parameters: DataFrame, segments: DataFrame, document_id: str | None = None
) -> DataFrame:
    """Base subframes with the whole scenario written into them (ENC-07).

    Scenario rows name their documents unless one is given for all; values and
    cells meet the mapping in joins, and the writes of a word are folded by order.
    """
    enc = patterns(scenario, parameters, segments, document_id)
    return apply_updates(base, word_updates(writes(enc, segments, document_id)))


def closed_loop(scenario: DataFrame, encoded: DataFrame, samples: DataFrame, parameters: DataFrame) -> DataFrame:
    """Requested against decoded values (ENC-08)."""
    keys = ["recording_id", "frame_index", "param_id"]
    first = (
        samples.filter(F.col("status").isin(VALID, OUT_OF_RANGE))
        .groupBy(*keys).agg(F.min_by(F.struct("eng_value", "eng_label"), F.struct("occ", "subframe")).alias("fs"))
        .select(*keys, F.col("fs.eng_value").alias("eng_value"), F.col("fs.eng_label").alias("eng_label"))
    )
    pattern = encoded.groupBy(*keys).agg(F.max_by("pattern", "occ").alias("raw_pattern"), F.min("status").alias("status"),
                                         F.max("status").alias("worst"))
    dim = parameters.select("param_id", "ptype", tolerance().alias("tolerance"))
    j = scenario.join(pattern, keys).join(first, keys, "left").join(broadcast_if_small(dim), "param_id")
    delta = F.abs(F.col("eng_value") - F.col("value"))
    numeric = F.col("label").isNull()
    passed = F.when(numeric, F.coalesce(delta <= F.col("tolerance"), F.lit(False))).otherwise(
        F.coalesce(F.upper(F.trim("label")) == F.upper(F.trim("eng_label")), F.lit(False))
    )
    return j.select(
        *keys, "value", "label", F.coalesce("raw_pattern", F.lit(0)).alias("raw_pattern"), "worst", "eng_value", "eng_label",
        F.when(numeric, delta).alias("delta"), "tolerance", passed.alias("passed"),
    )


__all__ = [
    "apply_updates", "blank_subframes", "closed_loop", "dictionary", "encodable", "patterns",
    "scenario_frames", "tolerance", "word_updates", "writes",
]
