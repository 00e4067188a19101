"""Words to engineering values: one join, then code-generated expressions.

The words of a subframe stay one array; a plan row (see ``mapping``) says
which bits to take.  Between the scan and the samples there is no shuffle as
long as the mapping is small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import bcd_value, shift_left, shift_right
from ..schemas import (
    ANALOG_SIGNED, BCD, DECODABLE_STATES, DISCRETE, INVALID_BCD, INVALID_MAPPING, LINEAR_TYPES, OUT_OF_RANGE,
    RAW, UNSUPPORTED_TYPE, VALID,
)
from ..session import BROADCAST_ROW_LIMIT, broadcast_if_small, materialize

# Widest field that is shifted together as BIGINT.  Wider ones are read from
# their exact bits: digits and labels hold at any width, numbers are rounded
# once, to the nearest DOUBLE, and raw_integer is given wherever it fits.
MAX_EXACT_WIDTH = 62
WIDE = "decimal(38,0)"

# Rows of either side that a group of the fleet's join holds, about.
SLICE_ROWS, HOT_ROWS = 256, 16_384

TRACE_COLUMNS = ("segs", "failing", "occurrence_error", "ptype")

# UDF-01: user types.  Name -> (decoded, engineering) from the assembled integer
# and its bit width; both must be plain Columns.
CUSTOM_TYPES: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {}


def register_type(name: str, build: Callable[[Column, Column], tuple[Column, Column]]) -> None:
    """Add a parameter type: ``build(raw, width)`` returns (decoded, engineering)."""
    CUSTOM_TYPES[name] = build


def apart(value: Column) -> Column:
    """``value``, by way of a function over arrays, which Spark keeps out of a stage's one loop.

    The JVM compiles no method above 8000 bytes of code.  The loop of a whole decode is
    longer and ran interpreted; projections on their own are cut into small methods.
    """
    return F.get(F.transform(F.array(value), lambda x: x), F.lit(0))


def decodable(subframes: DataFrame) -> DataFrame:
    """Only subframes that carry usable data (DEC-19)."""
    return subframes.filter(F.col("state").isin(*DECODABLE_STATES) & (F.col("subframe") != 0))


def plan_profile(plans: DataFrame) -> dict:
    """Size and shape of the mapping, from one small job over it."""
    row = plans.agg(
        F.count("*").alias("rows"),
        F.max(F.size("segs")).alias("parts"),
        F.max("bit_width").alias("width"),
        F.bool_or("weighted").alias("weighted"),
    ).first()
    return {
        "small": row["rows"] <= BROADCAST_ROW_LIMIT,
        "parts": max(1, row["parts"] or 1),
        "wide": (row["width"] or 0) > MAX_EXACT_WIDTH,
        "weighted": bool(row["weighted"]),
    }


def flat_plans(plans: DataFrame, profile: dict) -> DataFrame:
    """Plan rows with everything a sample does not decide already decided.

    Per part: word index, right shift, mask and left shift (a missing part has
    mask 0); a sign bit of 0 for unsigned fields; NULL conversion for types
    that have none; final status, labels and unit where they are static.  What
    is left per sample is short enough for one compiled loop.
    """
    ok, kind, linear = F.col("message").isNull(), F.col("ptype"), F.col("formula_type") == "linear"
    one = F.lit(1).cast("bigint")
    out = ["document_id", "doc_wps", "deliver_on", "sample_subframe", "param_ord", "param_id", "param_name", "occ", "bit_width"]
    for i in range(profile["parts"]):
        seg = F.get("segs", F.lit(i))
        later = F.aggregate(F.slice("segs", F.lit(i + 2), F.size("segs")), F.lit(0), lambda a, g: a + g["width"])
        out += [
            F.when(ok, F.coalesce(seg["word"] - 1, F.lit(0))).alias(f"idx{i}"),
            F.coalesce(seg["lo"] - 1, F.lit(0)).alias(f"shr{i}"),
            F.coalesce(shift_left(one, seg["width"]) - 1, F.lit(0)).alias(f"msk{i}"),
            F.coalesce(F.when(seg.isNotNull(), later), F.lit(0)).alias(f"shl{i}"),
            F.coalesce(seg["weight"], F.lit(0.0)).alias(f"wt{i}"),
            F.coalesce(seg["width"], F.lit(0)).alias(f"width{i}"),
        ]
    converted = kind.isin(*LINEAR_TYPES) & linear
    known = kind.isin(*LINEAR_TYPES, DISCRETE, RAW, *CUSTOM_TYPES)
    discrete = ok & (kind == DISCRETE)
    why = F.coalesce(
        "message",
        F.when(~known, F.concat(F.lit("unsupported parameter type "), kind)),
        F.when(kind.isin(*LINEAR_TYPES) & ~linear, F.concat(F.lit("unsupported formula_type "), F.col("formula_type"))),
    )
    return plans.select(
        *out,
        F.when(kind == ANALOG_SIGNED, shift_left(one, F.col("bit_width") - 1)).otherwise(0).alias("sign_bit"),
        F.when(converted | kind.isin(DISCRETE, RAW), F.lit(1).cast("bigint")).alias("has_value"),
        ((kind == BCD) & linear).alias("is_bcd"),
        "weighted",
        F.when(kind == RAW, 1.0).when(converted, F.col("resolution")).alias("scale"),
        F.when(kind == RAW, 0.0).when(converted, F.col("offset")).alias("bias"),
        "minimum", "maximum",
        F.when(discrete, F.map_filter("labels", lambda _k, label: label != "")).alias("labels"),
        F.when(discrete, F.coalesce("true_state", F.lit("TRUE"))).alias("label_set"),
        F.when(discrete, F.coalesce("false_state", F.lit("FALSE"))).alias("label_clear"),
        F.when(~discrete, F.col("unit")).alias("unit"),
        F.when(~ok, INVALID_MAPPING).when(why.isNotNull(), UNSUPPORTED_TYPE).alias("fixed_status"),
        why.alias("fixed_message"),
        ((F.col("first_word") - 1) / F.col("doc_wps")).alias("t_part"),
        *[c for c in plans.columns if c in profile.get("keep", ())],
    )


def decode(
    subframes: DataFrame,
    plans: DataFrame,
    trace: bool = False,
    profile: dict | None = None,
    keep: tuple[str, ...] = (),
    on: tuple[str, ...] = (),
) -> DataFrame:
    """Samples of every subframe row that matches a plan row.

    ``subframes`` needs recording_id, document_id, seq, frame_index, subframe,
    t_end and words.  ``trace=True`` adds the per-segment derivation; ``keep``
    names further plan columns to pass through; ``on`` names further columns of
    both sides that must be equal.
    """
    profile = profile or plan_profile(plans)
    parts = profile["parts"]
    extra = [c for c in keep] + [c for c in TRACE_COLUMNS if trace and c not in keep]
    side = flat_plans(plans, {**profile, "keep": (*extra, *on)})
    side = F.broadcast(side) if profile["small"] else side
    joined = (
        subframes.alias("s")
        .join(
            side.alias("p"),
            (F.col("s.document_id") == F.col("p.document_id"))
            & (F.col("s.subframe") == F.col("p.deliver_on"))
            & (F.size("s.words") == F.col("p.doc_wps"))
            & reduce(Column.__and__, [F.col(f"s.{c}") == F.col(f"p.{c}") for c in on], F.lit(True)),
        )
        .select(
            *[F.col(f"s.{c}") for c in ("recording_id", "document_id", "seq", "frame_index", "t_end", "words")],
            *[F.col(f"p.{c}") for c in side.columns if c not in ("document_id", "deliver_on")],
        )
    )
    fields = [
        shift_right(F.get("words", F.col(f"idx{i}")), F.col(f"shr{i}")).bitwiseAND(F.col(f"msk{i}")) for i in range(parts)
    ]
    narrow = F.col("bit_width") <= MAX_EXACT_WIDTH
    if profile["wide"] or profile["weighted"]:
        joined = joined.select("*", *[f.alias(f"x{i}") for i, f in enumerate(fields)])
        fields = [F.col(f"x{i}") for i in range(parts)]
    raw = reduce(Column.bitwiseOR, [shift_left(f, F.col(f"shl{i}")) for i, f in enumerate(fields)])
    if profile["wide"]:
        by_part = [F.when(F.col(f"width{i}") > 0, F.lpad(F.bin(f), F.col(f"width{i}"), F.lit("0"))) for i, f in enumerate(fields)]
        every = F.when(~narrow & fields[0].isNotNull(), F.concat_ws("", *by_part))
        joined = joined.withColumn("wide_bits", every)
        shown = F.regexp_replace("wide_bits", "^0+(?=.)", "")
        fits = F.when(F.length(shown) <= MAX_EXACT_WIDTH, F.conv(shown, 2, 10).cast("bigint"))
        raw = F.when(narrow, raw).otherwise(fits)
    joined = joined.withColumn("raw_integer", apart(raw))

    v = F.col("raw_integer")
    number = (v - shift_left(v.bitwiseAND(F.col("sign_bit")), F.lit(1))).cast("double")
    digits = bcd_value(v).cast("double")
    if profile["wide"]:
        digits = F.when(narrow, digits).otherwise(wide_digits(F.col("wide_bits")).try_cast("double"))
    if profile["weighted"]:
        total = reduce(lambda a, b: a + b, [bcd_value(f) * F.col(f"wt{i}") for i, f in enumerate(fields)], F.lit(0.0))
        digits = F.when(F.col("weighted"), F.round(total, 10)).otherwise(digits)
    if profile["wide"]:
        number = F.when(narrow, number).otherwise(wide_number(fields))
    decoded = F.when(F.col("is_bcd"), digits).when(F.col("has_value").isNotNull(), number)
    custom = {name: build(v, F.col("bit_width")) for name, build in CUSTOM_TYPES.items()}
    for name, (value, _eng) in custom.items():
        decoded = decoded.when(F.col("ptype") == name, value.cast("double"))
    joined = joined.withColumn("decoded", decoded)

    eng = F.col("decoded") * F.col("scale") + F.col("bias")
    for name, (_value, e) in custom.items():
        eng = F.when(F.col("ptype") == name, e.cast("double")).otherwise(eng)
    joined = joined.withColumn("eng_value", eng)
    e = F.col("eng_value")
    bad_digit = F.col("is_bcd") & F.col("decoded").isNull()
    status = F.coalesce(
        "fixed_status",
        F.when(bad_digit, INVALID_BCD).when((e < F.col("minimum")) | (e > F.col("maximum")), OUT_OF_RANGE).otherwise(VALID),
    )
    message = F.coalesce(
        "fixed_message",
        F.when(bad_digit, "invalid BCD digit").when(e < F.col("minimum"), "below minimum").when(
            e > F.col("maximum"), "above maximum"
        ),
    )
    is_set = v != 0
    bits = F.lpad(F.bin("raw_integer"), F.col("bit_width"), F.lit("0"))
    if profile["wide"]:
        is_set = F.when(narrow, is_set).otherwise(F.contains("wide_bits", F.lit("1")))
        bits = F.when(narrow, bits).otherwise(F.col("wide_bits"))
    label = F.coalesce(F.try_element_at("labels", v), F.when(is_set, F.col("label_set")).when(~is_set, F.col("label_clear")))
    out = [
        "recording_id", "document_id", "seq", "frame_index", F.col("sample_subframe").alias("subframe"),
        "param_ord", "param_id", "param_name", "occ",
        # The subframe started one second before its last word.
        (F.col("t_end") - 1.0 + F.col("t_part")).alias("t"),
        bits.alias("raw_bits"), "raw_integer", "decoded", "eng_value", label.alias("eng_label"), "unit",
        apart(status).alias("status"), message.alias("message"), *keep,
    ]
    if trace:
        used = F.col("decoded").isNotNull() & F.col("ptype").isin(*LINEAR_TYPES)
        out += [
            F.when(v.isNotNull() | fields[0].isNotNull(), F.col("bit_width")).alias("width"),
            F.when(used, F.col("scale")).alias("used_resolution"),
            F.when(used, F.col("bias")).alias("used_offset"),
            segment_trace(F.col("failing")).alias("trace"),
        ]
    return joined.select(*out)


def decode_fleet(
    subframes: DataFrame, plans: DataFrame, slice_rows: int = SLICE_ROWS, hot_rows: int = HOT_ROWS, **options
) -> DataFrame:
    """``decode`` against a mapping too large to broadcast (JON-01).

    The plan rows of a document's subframe number are cut into slices of about
    ``slice_rows`` by parameter, and a subframe row goes to the slices of its own
    document only.  Where more than ``hot_rows`` subframes share a document and
    number they are spread over salts, and the slices are repeated for each.
    A group of the join so holds about ``slice_rows`` plan rows and ``hot_rows``
    subframes, however many recordings use one document.
    """
    profile = {**(options.pop("profile", None) or plan_profile(plans)), "small": False}
    parts = lambda rows: F.ceil(F.count(F.lit(1)) / rows).cast("int")
    sliced = plans.groupBy("document_id", "deliver_on").agg(parts(slice_rows).alias("_slices"))
    heat = subframes.groupBy("document_id", F.col("subframe").alias("deliver_on")).agg(parts(hot_rows).alias("_salts"))
    cuts = broadcast_if_small(materialize(sliced.join(heat, ["document_id", "deliver_on"])))
    own = F.pmod(F.xxhash64("param_id", "occ"), F.col("_slices")).cast("int")
    p = plans.join(cuts, ["document_id", "deliver_on"]).withColumn("_slice", own)
    p = p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_slices", "_salts")
    s = subframes.join(cuts.withColumnRenamed("deliver_on", "subframe"), ["document_id", "subframe"])
    s = s.withColumn("_salt", F.pmod(F.xxhash64("recording_id", "seq"), F.col("_salts")).cast("int"))
    s = s.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices", "_salts")
    return decode(s, p, profile=profile, on=("_slice", "_salt"), **options)


def wide_digits(bits: Column) -> Column:
    """The nibbles of a bit text as digits; no number when one is above 9."""
    full = F.lpad(bits, (F.ceil(F.length(bits) / 4) * 4).cast("int"), F.lit("0"))
    nibbles = F.transform(F.sequence(F.lit(1), F.length(full), F.lit(4)), lambda i: F.conv(F.substr(full, i, F.lit(4)), 2, 16))
    text = F.array_join(nibbles, "")
    return F.when(text.rlike("^[0-9]+$"), text)


def wide_number(fields: list[Column]) -> Column:
    """Value of a field too wide for BIGINT: whole in DECIMAL up to 126 bits, beyond that in DOUBLE."""
    exact, whole, near = F.lit(0).cast(WIDE), F.lit(1).cast(WIDE), F.lit(0.0)
    for i, f in enumerate(fields):
        step = shift_left(F.lit(1).cast("bigint"), F.col(f"width{i}"))
        exact = F.try_add(F.try_multiply(exact, step).try_cast(WIDE), f).try_cast(WIDE)
        whole = F.try_multiply(whole, step).try_cast(WIDE)
        near = near * step.cast("double") + f.cast("double")
    # ``sign_bit`` wraps around for such widths; its presence alone marks a signed field.
    negative = (F.col("sign_bit") != 0) & F.startswith("wide_bits", F.lit("1"))
    signed = F.when(negative, F.try_subtract(exact, whole)).otherwise(exact).cast("double")
    return F.coalesce(signed, F.when(negative, near - F.pow(F.lit(2.0), F.col("bit_width"))).otherwise(near))


def segment_trace(failing: Column) -> Column:
    """Per-segment derivation, up to and including the segment that failed (1-based)."""
    def one(seg: Column, i: Column) -> Column:
        word_value = F.when(failing.isNull() | (i + 1 < failing), F.get("words", seg["word"] - 1))
        taken = shift_right(word_value.cast("bigint"), seg["lo"] - 1).bitwiseAND(
            shift_left(F.lit(1).cast("bigint"), seg["width"]) - 1
        )
        return F.struct(
            seg["seq"].alias("seq"), F.col("sample_subframe").alias("subframe"), seg["word"].alias("word"),
            seg["lsb"].alias("lsb"), seg["msb"].alias("msb"), seg["width"].alias("width"),
            word_value.alias("word_value"), taken.alias("extracted"),
            F.lpad(F.bin(taken), seg["width"], F.lit("0")).alias("bits"),
        )

    kept = F.when(failing.isNull(), F.col("segs")).otherwise(F.slice("segs", F.lit(1), failing))
    empty = F.filter(F.transform(F.col("segs"), one), lambda s: F.lit(False))
    return F.when(~F.col("occurrence_error"), F.transform(kept, one)).otherwise(empty)


def numeric_value() -> Column:
    """The value a series stores (DEC-18): engineering, else decoded, finite only."""
    value = F.coalesce("eng_value", "decoded")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def effective_decimals() -> Column:
    """Display decimals (DEC-20): stated, 0 for discretes, else what the resolution needs."""
    from ..functions.numbers import resolution_decimals

    return F.coalesce(
        F.col("decimals"), F.when(F.col("ptype") == DISCRETE, 0), resolution_decimals(F.col("resolution"))
    )
