"""Document rows to mapping parameters, by rules that report what they assumed.

Rows are (document_id, row_no) plus the 19 raw text fields.  Everything is
column expressions; only document-level evidence and duplicate names aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.numbers import parse_frequency, parse_number, split_number_pair
from ..functions.types import normalize_source_type, one_line
from ..schemas import ANALOG_SIGNED, ANALOG_UNSIGNED, BCD, DISCRETE, FRAME_SECONDS, RAW_FIELDS, UNKNOWN
from ..session import materialize
from . import blocks

ERROR, WARNING, INFO = "error", "warning", "info"
AUTO = "auto"
OCCURRENCES, SEGMENTS, GROUPED = "occurrences", "segments", "grouped"
HZ, SECONDS = "hz", "seconds"
PER_WORD, RANGE_PER_WORD = "per_word", "range_per_word"
MIN_LAYOUT_EVIDENCE = 3

# Sign column words, and the words a damaged type is compared with.
SIGNED_HINTS = ("S", "SIGNED", "Y", "YES", "2'S", "TWO'S", "2S", "+/-", "±", "SGN", "TRUE")
UNSIGNED_HINTS = ("U", "UNSIGNED", "N", "NO", "+", "UNS", "FALSE", "-")
TYPE_WORDS = ("DISCRETE", "BNR", "BCD", "SIGNED", "UNSIGNED", "ANALOG", "STATUS", "RAW")
CLOSE_TYPE = 0.66
# Fields whose low confidence sends a row to review.
CRITICAL_FIELDS = (
    "parameter_name", "mnemonic_and_name", "parameter_type", "sign", "frequency", "word_location", "subframe", "msb", "lsb",
    "bits", "resolution", "offset",
)


@dataclass(frozen=True)
class Conventions:
    """How a document is known to be written; "auto" asks the document."""

    default_wps: int = 256
    confidence: float = 0.6
    blank_subframe_means_all: bool = False
    zero_subframe_means_all: bool = True
    multiword_bits: str = AUTO
    multiword_meaning: str = AUTO
    frequency_unit: str = AUTO
    resolution_pair: str = AUTO
    decimal_comma: bool = False
    column_overrides: dict = field(default_factory=dict)
    # UDF-02: further document conventions, name -> (rows, conventions) -> DataFrame
    # keyed by document_id whose columns are joined to the rows.
    detectors: dict = field(default_factory=dict)


def _raw(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _issue(cond: Column, severity: str, rule: str, fld: str | None = None) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(fld).cast("string").alias("field")))


def _add(df: DataFrame, *issues: Column) -> DataFrame:
    return df.withColumn("issues", F.concat("issues", F.array_compact(F.array(*issues))))


# -- document evidence (AGG-08, AGG-09, NRM-10) ----------------------------

def frequency_hz(value: Column, unit: Column) -> Column:
    return F.when(unit == SECONDS, F.when(value > 0, 1.0 / value)).otherwise(value)


def expected_occurrences(hz: Column, subframes: Column) -> Column:
    """Occurrences per subframe a rate implies (SCL-28); NULL below one per frame."""
    per_frame = hz * FRAME_SECONDS
    return F.when((per_frame >= 1) & (F.size(subframes) > 0), per_frame / F.size(subframes))


def frequency_evidence(rows: DataFrame, conv: Conventions = Conventions()) -> DataFrame:
    """Rows per document consistent with the rate as Hz, as seconds, and usable."""
    r = rows.select(
        "document_id", parse_frequency(cells.digit_repair(_raw("frequency"))).alias("v"),
        cells.word_groups(cells.digit_repair(_raw("word_location"))).alias("g"),
        cells.subframe_field(_raw("subframe"), conv.blank_subframe_means_all, conv.zero_subframe_means_all)["subframes"].alias("s"),
    )
    usable = (F.col("v") > 0) & F.col("g").isNotNull() & F.col("s").isNotNull()
    n = F.size("g")
    actual = F.when(F.exists("g", lambda x: F.size(x) > 1) | (n == 1), n)

    def consistent(unit: str) -> Column:
        e = expected_occurrences(frequency_hz(F.col("v"), F.lit(unit)), F.col("s"))
        whole = F.abs(e - F.rint(e)) <= 1e-9
        fits = F.when(actual.isNotNull(), F.rint(e) == actual).otherwise(F.rint(e).isin(1.0) | (F.rint(e) == n))
        return usable & whole & fits

    return r.groupBy("document_id").agg(
        F.count_if(consistent(HZ)).alias("hz_ok"), F.count_if(consistent(SECONDS)).alias("seconds_ok"), F.count_if(usable).alias("usable")
    )


def bits_evidence(rows: DataFrame) -> DataFrame:
    """Rows per document whose MSB and LSB cells are ranges over word pairs."""
    fix = lambda n: cells.digit_repair(_raw(n))
    r = rows.select("document_id", cells.bit_tokens(fix("msb")).alias("m"), cells.bit_tokens(fix("lsb")).alias("l"),
                    cells.word_groups(fix("word_location")).alias("g"))
    one = lambda c: (F.size(c) == 1) & F.get(c, F.lit(0))["is_range"]
    return r.groupBy("document_id").agg(
        F.count_if(one("m") & one("l") & F.forall("g", lambda x: F.size(x) == 2)).alias("range_rows")
    )


def effective_conventions(rows: DataFrame, conv: Conventions = Conventions()) -> DataFrame:
    """(document_id, frequency_unit, multiword_bits): declared, else from evidence."""
    e = frequency_evidence(rows, conv).join(bits_evidence(rows), "document_id")
    unit = F.lit(conv.frequency_unit) if conv.frequency_unit != AUTO else F.when(F.col("seconds_ok") > F.col("hz_ok"), SECONDS).otherwise(HZ)
    layout = F.lit(conv.multiword_bits) if conv.multiword_bits != AUTO else F.when(
        F.col("range_rows") >= MIN_LAYOUT_EVIDENCE, RANGE_PER_WORD).otherwise(AUTO)
    return e.select("document_id", unit.alias("frequency_unit"), layout.alias("multiword_bits"))


# -- one row ---------------------------------------------------------------

def _name(df: DataFrame) -> DataFrame:
    """Mnemonic and description; a stacked cell gives both (NRM-02)."""
    lines = F.filter(F.transform(F.split(_raw("mnemonic_and_name"), "\n"), one_line), lambda x: x != "")
    first, rest = F.get(lines, F.lit(0)), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), " ")
    name, text = one_line(_raw("parameter_name")), one_line(_raw("description"))
    return df.withColumn("mnemonic", F.coalesce(F.nullif(name, F.lit("")), first)).withColumn(
        "description_", F.coalesce(F.nullif(text, F.lit("")), rest))


def _provenance(df: DataFrame, conv: Conventions) -> DataFrame:
    """Text source, confidence and continuation notes (NRM-09), where the row has them."""
    issues = []
    if "text_source" in df.columns:
        issues.append(_issue(F.col("text_source").isin("ocr", "text_layer"), INFO, "normalize.ocr"))
    if "confidences" in df.columns:
        issues += [_issue((F.try_element_at("confidences", F.lit(f)) < conv.confidence) & (F.trim(_raw(f)) != ""), WARNING,
                          "normalize.ocr_confidence", f) for f in CRITICAL_FIELDS]
    if "continued" in df.columns:
        issues.append(_issue(F.col("continued"), INFO, "extract.continuation"))
    return _add(df, *issues) if issues else df


def _type(df: DataFrame) -> DataFrame:
    """Canonical type with split-word and closest-word repair, and the sign column (NRM-03)."""
    source = F.nullif(one_line(_raw("parameter_type")), F.lit(""))
    df = df.withColumn("_src", source).withColumn("_kind", normalize_source_type(source))
    joined = F.replace("_src", F.lit(" "), F.lit(""))
    key = F.upper(joined)
    best = cells.closest(key, [(w, w) for w in TYPE_WORDS])
    close = F.when((F.length(key) >= 3) & (best["score"] >= CLOSE_TYPE), normalize_source_type(best["field"]))
    together = F.nullif(normalize_source_type(joined), F.lit(UNKNOWN))
    unknown = (F.col("_kind") == UNKNOWN) & F.col("_src").isNotNull()
    df = df.withColumn("_fix", F.when(unknown, F.coalesce(together, close))).withColumn("_kind", F.coalesce("_fix", "_kind"))
    sign = F.upper(one_line(_raw("sign")))
    becomes = sign.isin(*SIGNED_HINTS) & (F.col("_kind") == ANALOG_UNSIGNED)
    df = df.withColumn("_signed", becomes)
    df = _add(
        df, _issue(F.col("_fix").isNotNull(), WARNING, "normalize.type_repaired", "parameter_type"),
        _issue(F.col("_signed"), INFO, "normalize.sign_column", "sign"),
        _issue(sign.isin(*UNSIGNED_HINTS) & (F.col("_kind") == ANALOG_SIGNED), WARNING, "normalize.sign_conflict", "sign"),
        _issue((sign != "") & ~sign.isin(*SIGNED_HINTS, *UNSIGNED_HINTS), WARNING, "normalize.sign_column", "sign"),
        _issue(F.col("_kind") == UNKNOWN, WARNING, "normalize.type", "parameter_type"),
    )
    return df.withColumn("ptype", F.when(F.col("_signed"), ANALOG_SIGNED).otherwise(F.col("_kind"))).withColumn(
        "source_type", F.when(F.col("_signed"), F.concat(F.coalesce("_src", F.lit("BNR")), F.lit(" (signed)"))).otherwise(F.col("_src"))
    ).drop("_src", "_kind", "_fix", "_signed")


def bit_specs(msb: Column, lsb: Column, bits: Column, groups: Column) -> Column:
    """Struct (specs, groups, forced, precedence) aligned with the flattened words;
    NULL when the cells do not describe them (NRM-04)."""
    n = F.size(F.flatten(groups))
    spec = lambda h, low: F.struct(h.alias("msb"), low.alias("lsb"))
    spread = lambda a: F.when(F.size(a) == n, a).when(F.size(a) == 1, F.array_repeat(F.get(a, F.lit(0)), n))
    m, low, b = cells.bit_tokens(msb), cells.bit_tokens(lsb), cells.bit_tokens(bits)
    ranges = F.transform(b, lambda t: spec(t["high"], t["low"]))
    single = F.forall(F.concat(m, low), lambda t: ~t["is_range"])
    pairs = F.when(F.size(m) == F.size(low), F.zip_with(m, low, lambda a, c: spec(a["high"], c["high"])))
    two_singles = F.forall(groups, lambda g: F.size(g) == 1) & (n == 2)
    regrouped = F.when(two_singles, F.array(F.flatten(groups))).otherwise(groups)
    range_pair = (F.size(m) == 1) & (F.size(low) == 1) & F.get(m, F.lit(0))["is_range"] & F.get(low, F.lit(0))["is_range"]
    range_pair = range_pair & F.forall(regrouped, lambda g: F.size(g) == 2)
    both = F.array(spec(F.get(m, F.lit(0))["high"], F.get(m, F.lit(0))["low"]), spec(F.get(low, F.lit(0))["high"], F.get(low, F.lit(0))["low"]))
    ranged = F.flatten(F.array_repeat(both, F.size(regrouped)))
    has_bits, has_pair = F.trim(bits) != "", (F.trim(msb) != "") & (F.trim(lsb) != "")
    forced = ~has_bits & ~F.coalesce(single, F.lit(False))
    specs = F.when(has_bits, spread(ranges)).when(has_pair & single, spread(pairs)).when(has_pair & range_pair, ranged)
    return F.when(specs.isNotNull(), F.struct(
        specs.alias("specs"), F.when(forced, regrouped).otherwise(groups).alias("groups"), forced.alias("forced"),
        (has_bits & ((F.trim(msb) != "") | (F.trim(lsb) != ""))).alias("precedence"),
    ))


def _location(df: DataFrame, conv: Conventions) -> DataFrame:
    """Words, subframes and bits with repairs; ``failure`` names what cannot be read."""
    df = df.withColumn("_w", cells.repaired(_raw("word_location"), cells.word_groups))
    sub = lambda t: cells.subframe_field(t, conv.blank_subframe_means_all, conv.zero_subframe_means_all)
    text = _raw("subframe")
    df = df.withColumn("_s1", sub(text)).withColumn("_s2", sub(cells.digit_repair(text)))
    sub_fixed = F.col("_s1.subframes").isNull() & F.col("_s2.subframes").isNotNull()
    df = df.withColumn("_sub_fixed", sub_fixed).withColumn("_s", F.when(sub_fixed, F.col("_s2")).otherwise(F.col("_s1")))
    fields = [_raw(n) for n in ("msb", "lsb", "bits")]
    df = df.withColumn("_b1", bit_specs(*fields, F.col("_w.value"))).withColumn(
        "_b2", bit_specs(*[cells.digit_repair(f) for f in fields], F.col("_w.value")))
    df = df.withColumn("_b", F.coalesce("_b1", "_b2"))
    no_bits = (F.trim(fields[2]) == "") & ((F.trim(fields[0]) == "") | (F.trim(fields[1]) == ""))
    failure = (
        F.when(F.coalesce("mnemonic", F.lit("")) == "", "normalize.name").when(F.col("_w.value").isNull(), "normalize.word")
        .when(F.col("_s.subframes").isNull(), "normalize.subframe").when(F.col("_b").isNull(), F.when(no_bits, "normalize.bits_missing").otherwise("normalize.bits"))
    )
    df = df.withColumn("failure", failure)
    named = F.coalesce("mnemonic", F.lit("")) != ""
    worded = named & F.col("_w.value").isNotNull()
    placed = worded & F.col("_s.subframes").isNotNull()
    declared = F.col("multiword_bits") == RANGE_PER_WORD
    ok = F.col("failure").isNull()
    df = _add(
        df, _issue(worded & F.col("_w.fixed"), WARNING, "normalize.word_repaired", "word_location"),
        _issue(placed & F.col("_sub_fixed"), WARNING, "normalize.subframe_repaired", "subframe"),
        _issue(placed & (F.col("_s.note") == "blank"), WARNING, "normalize.subframe_blank", "subframe"),
        _issue(placed & (F.col("_s.note") == "zero"), INFO, "normalize.subframe_zero", "subframe"),
        _issue(ok & F.col("_b1").isNull(), WARNING, "normalize.bits_repaired", "msb"),
        _issue(ok & F.col("_b.precedence"), INFO, "normalize.bits_precedence", "bits"),
        _issue(ok & F.col("_b.forced") & declared, INFO, "normalize.bits_layout", "msb"),
        _issue(ok & F.col("_b.forced") & ~declared, WARNING, "normalize.bits_layout", "msb"),
        _issue(ok & F.exists("_b.specs", lambda s: s["msb"] < s["lsb"]), INFO, "normalize.bit_order", "msb"),
    )
    return df.select("*", F.col("_s.subframes").alias("subframes"), F.col("_b.specs").alias("specs"), F.col("_b.groups").alias("groups"),
                     F.col("_b.forced").alias("forced")).drop("_w", "_s", "_s1", "_s2", "_sub_fixed", "_b", "_b1", "_b2")


def _layout(df: DataFrame, conv: Conventions) -> DataFrame:
    """Occurrences, segments or groups, from the rate as evidence (NRM-05)."""
    ok = F.col("failure").isNull()
    df = df.withColumn("_f", cells.repaired(_raw("frequency"), parse_frequency))
    stated = ok & (F.trim(_raw("frequency")) != "")
    hz = F.when(stated, frequency_hz(F.col("_f.value"), F.col("frequency_unit")))
    df = df.withColumn("rate_hz", hz).withColumn("_exp", expected_occurrences(F.col("rate_hz"), F.col("subframes")))
    # a rate that no document can hold is as unusable as an uneven one
    uneven = (F.abs(F.col("_exp") - F.rint("_exp")) > 1e-9) | (F.abs("_exp") > 2**31 - 1)
    df = df.withColumn("_uneven", F.coalesce(uneven, F.lit(False))).withColumn("expected", F.when(~F.col("_uneven"), F.rint("_exp").try_cast("int")))
    n_words, n_groups = F.size(F.flatten("groups")), F.size("groups")
    grouped = F.col("forced") | F.exists("groups", lambda g: F.size(g) > 1)
    identical = F.size(F.array_distinct("specs")) == 1
    guess = F.when(identical, OCCURRENCES).otherwise(SEGMENTS)
    free = ~grouped & (n_words > 1)
    if conv.multiword_meaning != AUTO:
        meaning, guessed = F.lit(conv.multiword_meaning), F.lit(False)
    else:
        known = F.when(F.col("expected") == n_words, OCCURRENCES).when(F.col("expected") == 1, SEGMENTS)
        meaning, guessed = F.coalesce(known, guess), free & known.isNull()
    meaning = F.when(grouped, GROUPED).when(n_words == 1, OCCURRENCES).otherwise(meaning)
    df = df.withColumn("meaning", F.when(ok, meaning)).withColumn("_guessed", guessed)
    actual = F.when(F.col("meaning") == GROUPED, n_groups).when(F.col("meaning") == SEGMENTS, 1).otherwise(n_words)
    return _add(
        df, _issue(stated & F.col("_f.fixed"), WARNING, "normalize.frequency_repaired", "frequency"),
        _issue(stated & F.col("rate_hz").isNull(), WARNING, "normalize.frequency", "frequency"),
        _issue(F.col("rate_hz") * FRAME_SECONDS < 1, ERROR, "normalize.superframe", "frequency"),
        _issue(F.col("_uneven"), WARNING, "normalize.frequency", "frequency"),
        _issue(ok & F.col("_guessed"), WARNING, "normalize.multiword", "word_location"),
        _issue(ok & (F.col("expected") != actual), WARNING, "normalize.frequency", "frequency"),
    ).drop("_f", "_exp", "_uneven", "_guessed")


def _occurrences(df: DataFrame) -> DataFrame:
    """Segments as one array (NRM-06) and the even-spacing check (WIN-05)."""
    def seg(occ: Column, seq: Column, word: Column, at: Column) -> Column:
        s = F.get("specs", at)
        return F.struct(occ.cast("int").alias("occ"), seq.cast("int").alias("seq"), word.alias("word"), s["lsb"].alias("lsb"), s["msb"].alias("msb"))

    words = F.flatten("groups")
    offset = lambda g: F.aggregate(F.slice("groups", F.lit(1), g), F.lit(0), lambda a, x: a + F.size(x))
    segs = (
        F.when(F.col("meaning") == SEGMENTS, F.transform(words, lambda w, i: seg(F.lit(1), i + 1, w, i)))
        .when(F.col("meaning") == GROUPED, F.flatten(F.transform(
            "groups", lambda g, gi: F.transform(g, lambda w, k: seg(gi + 1, k + 1, w, offset(gi) + k)))))
        .when(F.col("meaning") == OCCURRENCES, F.transform(words, lambda w, i: seg(i + 1, F.lit(1), w, i)))
    )
    df = df.withColumn("segments", segs)
    firsts = F.transform(F.filter("segments", lambda s: s["seq"] == 1), lambda s: s["word"])
    df = df.withColumn("_firsts", firsts)
    n = F.size("_firsts")
    gaps = F.transform(F.slice("_firsts", F.lit(2), n), lambda w, i: w - F.get("_firsts", i))
    uneven = (n > 1) & F.exists(gaps, lambda g: F.abs(g - F.col("wps") / n) > 1e-9)
    return _add(df, _issue(uneven, WARNING, "normalize.spacing", "word_location")).drop("_firsts")


def _conversion(df: DataFrame, conv: Conventions) -> DataFrame:
    """Resolution and offset, alone or as a pair in one cell (NRM-07)."""
    ok = F.col("failure").isNull()
    number = lambda t: parse_number(t, conv.decimal_comma)
    df = df.withColumn("_rt", cells.cell_value(_raw("resolution"))).withColumn("_ot", cells.cell_value(_raw("offset")))
    df = df.withColumn("_pair", cells.repaired(F.col("_rt"), split_number_pair)).withColumn("_r", cells.repaired(_raw("resolution"), number))
    df = df.withColumn("_o", cells.repaired(_raw("offset"), number))
    pair, has_r, has_o = F.col("_pair.value").isNotNull(), F.col("_rt") != "", F.col("_ot") != ""
    swapped = conv.resolution_pair == "resolution_offset"
    first, second = number(F.col("_pair.value.first")), number(F.col("_pair.value.second"))
    res = F.when(pair, first if swapped else second).when(has_r, F.col("_r.value"))
    off = F.when(pair, second if swapped else first).when(has_o, F.col("_o.value"))
    df = df.withColumn("resolution_", F.coalesce(res, F.lit(1.0))).withColumn("offset_", F.coalesce(off, F.lit(0.0)))
    analog = F.col("ptype").isin(ANALOG_SIGNED, ANALOG_UNSIGNED)
    alone = ok & ~pair
    column_offset = number(F.col("_ot"))
    return _add(
        df, _issue(ok & pair & F.col("_pair.fixed"), WARNING, "normalize.resolution_repaired", "resolution"),
        _issue(ok & pair, INFO if conv.resolution_pair != AUTO else WARNING, "normalize.resolution_pair", "resolution"),
        _issue(ok & pair & has_o & F.coalesce(column_offset != 0, F.lit(True)), WARNING, "normalize.offset_conflict", "offset"),
        _issue(alone & has_r & F.col("_r.fixed"), WARNING, "normalize.resolution_repaired", "resolution"),
        _issue(alone & has_r & F.col("_r.value").isNull(), ERROR, "normalize.resolution", "resolution"),
        _issue(alone & ~has_r & analog, ERROR, "normalize.resolution", "resolution"),
        _issue(alone & ~has_r & (F.col("ptype") == BCD), INFO, "normalize.resolution_default", "resolution"),
        _issue(alone & has_o & F.col("_o.fixed"), WARNING, "normalize.offset_repaired", "offset"),
        _issue(alone & has_o & F.col("_o.value").isNull(), ERROR, "normalize.offset", "offset"),
    ).drop("_rt", "_ot", "_pair", "_r", "_o")


def _limits_and_states(df: DataFrame, conv: Conventions) -> DataFrame:
    """Limits, discrete width and states from free text (NRM-08)."""
    ok = F.col("failure").isNull()
    empty = lambda n: F.trim(_raw(n)) == ""
    number = lambda n: F.when(~empty(n), parse_number(_raw(n), conv.decimal_comma))
    df = df.withColumn("minimum_", number("minimum")).withColumn("maximum_", number("maximum"))
    text = lambda n: F.nullif(cells.cell_value(_raw(n)), F.lit(""))
    lines = F.filter(F.transform(F.split(_raw("true_state"), "\n"), F.trim), lambda x: x != "")
    discrete = ok & (F.col("ptype") == DISCRETE)
    wide = discrete & (F.array_max(F.transform("specs", lambda s: s["msb"] - s["lsb"] + 1)) > 1)
    listed = wide & (F.size(lines) > 1)
    note = F.concat(F.coalesce(F.concat(text("notes"), F.lit(" ")), F.lit("")), F.lit("States: "), F.array_join(lines, "; "))
    df = df.withColumn("_wide", F.coalesce(wide, F.lit(False))).withColumn("notes_", F.when(listed, note).otherwise(text("notes")))
    df = df.withColumn("_t", F.when(~F.coalesce(listed, F.lit(False)), text("true_state"))).withColumn("_z", text("false_state"))
    df = df.withColumn("_inf", cells.states_from_text(F.concat_ws(" ", _raw("description"), _raw("notes"), _raw("mnemonic_and_name"))))
    inferred = discrete & F.col("_t").isNull() & F.col("_z").isNull() & (F.col("_inf.one").isNotNull() | F.col("_inf.zero").isNotNull())
    df = df.withColumn("_use", F.coalesce(inferred, F.lit(False)))
    df = _add(
        df, *[_issue(ok & ~empty(n) & F.col(f"{n}_").isNull(), WARNING, f"normalize.{n}", n) for n in ("minimum", "maximum")],
        _issue(F.col("_wide"), WARNING, "normalize.discrete_width", "true_state"),
        _issue(F.col("_use"), WARNING, "normalize.states_inferred", "true_state"),
    )
    return df.withColumn("true_state_", F.when(F.col("_use"), F.col("_inf.one")).otherwise(F.col("_t"))).withColumn(
        "false_state_", F.when(F.col("_use"), F.col("_inf.zero")).otherwise(F.col("_z"))).drop("_wide", "_t", "_z", "_inf", "_use")


def normalize(rows: DataFrame, conv: Conventions = Conventions(), wps: DataFrame | None = None) -> DataFrame:
    """One row per document row: the candidate parameter, its segments, its issues.

    ``wps`` (document_id, wps) is the detected word rate; others use the default
    (NRM-12).  ``failure`` names the rule that left a row without a candidate.
    """
    df = rows.join(effective_conventions(rows, conv), "document_id")
    for detect in conv.detectors.values():
        df = df.join(detect(rows, conv), "document_id", "left")
    if wps is not None:
        df = df.join(wps.select("document_id", F.col("wps").alias("_wps")), "document_id", "left")
    df = df.withColumn("wps", F.coalesce(F.col("_wps") if wps is not None else F.lit(None), F.lit(conv.default_wps)))
    df = df.withColumn("issues", F.array().cast("array<struct<severity:string,rule:string,field:string>>"))
    df = _conversion(_occurrences(_layout(_location(_type(_provenance(_name(df), conv)), conv), conv)), conv)
    df = _limits_and_states(df, conv)
    df = _add(df, F.when(F.col("failure").isNotNull(), F.struct(F.lit(ERROR).alias("severity"), F.col("failure").alias("rule"), F.lit(None).cast("string").alias("field"))))
    unit = F.nullif(cells.cell_value(_raw("units")), F.lit(""))
    return df.select(
        "document_id", "row_no", "wps", "mnemonic", F.col("description_").alias("description"), "source_type", "ptype", unit.alias("unit"),
        F.col("minimum_").alias("minimum"), F.col("maximum_").alias("maximum"), F.col("resolution_").alias("resolution"),
        F.col("offset_").alias("offset"), F.lit("linear").alias("formula_type"), F.col("true_state_").alias("true_state"),
        F.col("false_state_").alias("false_state"), F.col("notes_").alias("notes"), "subframes", "meaning", "rate_hz", "segments",
        "failure", "issues",
    )


def qualify_duplicates(items: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """Mnemonics repeated in a document get their description or a number (NRM-11)."""
    made = F.col("failure").isNull()
    d = items.withColumn("_key", F.when(made, F.upper("mnemonic")))
    counts = d.filter("_key IS NOT NULL").groupBy("document_id", "_key").agg(F.count("*").alias("_times"))
    d = d.join(counts, ["document_id", "_key"], "left")
    repeated = d.filter("_times > 1").select("document_id", "_key", "row_no")
    nth = blocks.row_numbers(repeated, ["document_id", "_key"], blocks.block_of(F.col("row_no"), block), [F.col("row_no")], "_nth")
    d = d.join(nth.drop("_key"), ["document_id", "row_no"], "left")
    described = (F.coalesce("description", F.lit("")) != "") & (F.upper("description") != F.upper("mnemonic"))
    name = F.when(F.col("_nth").isNull(), F.col("mnemonic")).when(described, F.concat("mnemonic", F.lit(": "), "description")).otherwise(
        F.concat("mnemonic", F.lit(" #"), F.col("_nth").cast("string")))
    d = _add(d, _issue(F.col("_nth").isNotNull(), INFO, "normalize.mnemonic_qualified", "parameter_name"))
    return d.withColumn("mnemonic", name).drop("_key", "_times", "_nth")


def with_ids(items: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """Parameter ids ``pdf-0001`` … in document order (NRM-12)."""
    d = blocks.row_numbers(items, ["document_id"], blocks.block_of(F.col("row_no"), block), [F.col("row_no")], "param_ord")
    n = F.col("param_ord").cast("string")
    return d.withColumn("param_ord", F.col("param_ord").cast("int")).withColumn("param_id", F.concat(F.lit("pdf-"), F.lpad(n, F.greatest(F.length(n), F.lit(4)), F.lit("0"))))


def candidate_tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parameters, segments) of the rows that have a candidate."""
    good = items.filter("failure IS NULL")
    none = F.lit(None)
    pars = good.select(
        "document_id", "param_ord", "param_id", "mnemonic", "description", "source_type", "ptype", "unit", "minimum", "maximum",
        "resolution", "offset", "formula_type", none.cast("int").alias("decimals"), "true_state", "false_state",
        none.cast("array<struct<value:bigint,label:string>>").alias("states"), "notes",
    )
    segs = good.select("document_id", "param_id", "subframes", F.inline("segments")).select(
        "document_id", "param_id", "occ", "seq", "subframes", "word", "lsb", "msb", none.cast("double").alias("bcd_weight")
    )
    return pars, segs


# -- cells to rows (NRM-01, WIN-07, WIN-08, SCL-14) ------------------------

STRUCTURE = ("word_location", "parameter_type", "msb", "lsb", "bits", "frequency", "resolution")
CONTINUATION = ("parameter_name", "mnemonic_and_name", "description", "units", "true_state", "false_state", "notes")


def rows_from_cells(raw: DataFrame, overrides: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw rows, skipped tables) from extracted cells.

    The first row of a table is its header when it maps at least three fields
    including a name and the words; otherwise the previous header of the same
    width is inherited.  Repeated header rows are dropped and rows without
    structural cells are appended to the row before them.
    """
    tab = ["document_id", "table_no"]
    c = raw.withColumn("text", cells.clean_cell(F.col("text"))).withColumn("key", cells.normalize_header(F.col("text")))
    width = c.groupBy(*tab).agg(F.max("col_no").alias("width"), F.min(F.when(F.col("text") != "", F.col("row_no"))).alias("first"))
    own = {_key_text(k): v for k, v in (overrides or {}).items()}
    head = materialize(c.join(width, tab).filter(F.col("row_no") == F.col("first")).withColumn("m", cells.header_field(F.col("key"), own)))
    # First exact match per field wins over fuzzy ones.
    best = head.filter("m.field IS NOT NULL").groupBy(*tab, F.col("m.field").alias("field")).agg(
        F.min(F.struct(F.when(F.col("m.rank") == 2, 1).otherwise(0).alias("fuzzy"), "col_no")).alias("b"))
    best = best.select(*tab, "field", F.col("b.col_no").alias("col_no"), F.col("b.fuzzy").alias("fuzzy"))
    best = best.groupBy(*tab, "col_no").agg(F.min_by("field", F.struct("fuzzy", "field")).alias("field"))
    heads = best.groupBy(*tab).agg(F.map_from_entries(F.collect_list(F.struct("col_no", "field"))).alias("map"))
    keys = head.groupBy(*tab).agg(F.array_sort(F.collect_list(F.struct("col_no", "key"))).alias("keys"))
    fields = F.map_values("map")
    is_head = (F.size(fields) >= 3) & F.array_contains(fields, "word_location") & (
        F.array_contains(fields, "parameter_name") | F.array_contains(fields, "mnemonic_and_name"))
    t = materialize(width.join(heads, tab, "left").join(keys, tab, "left").withColumn("own", F.coalesce(is_head, F.lit(False))))
    previous = F.when(F.col("own"), F.struct("map", "keys", "width"))
    t = blocks.carry_last(t, ["document_id"], blocks.block_of(F.col("table_no")), [F.col("table_no")], previous, "h")
    usable = F.col("own") | (F.col("h").isNotNull() & (F.col("h.width") == F.col("width")))
    skipped = t.filter(~F.coalesce(usable, F.lit(False))).select(*tab, F.lit("PDF_TABLE_SKIPPED").alias("code"))
    t = t.filter(usable).select(*tab, "first", "own", F.col("h.map").alias("map"), F.col("h.keys").alias("head_keys"))
    body = c.join(t, tab).filter((F.col("row_no") > F.col("first")) | (~F.col("own") & (F.col("row_no") == F.col("first"))))
    f = F.try_element_at("map", F.col("col_no"))
    row = ["document_id", "page", "table_no", "row_no"]
    rows = body.groupBy(*row).agg(
        *[F.max(F.when(f == name, F.col("text"))).alias(name) for name in RAW_FIELDS],
        F.map_from_entries(F.collect_list(F.when(f.isNotNull() & F.col("confidence").isNotNull(), F.struct(f, F.col("confidence"))))).alias("confidences"),
        F.max(F.when(F.col("source").isin("ocr", "text_layer"), F.col("source"))).alias("text_source"),
        F.map_from_entries(F.collect_list(F.when(f.isNull() & (F.col("text") != ""), F.struct(F.concat(F.lit("column "), F.col("col_no").cast("string")), "text")))).alias("extra"),
        F.array_sort(F.collect_list(F.struct("col_no", "key"))).alias("keys"), F.first("head_keys").alias("head_keys"),
        F.max("text").alias("_any"),
    ).filter((F.col("_any") != "") & (F.col("keys") != F.col("head_keys"))).drop("keys", "head_keys", "_any")
    return merge_continuations(materialize(rows)), skipped


def _key_text(text: str) -> str:
    import re

    return " ".join(re.sub(r"[^A-Za-z0-9=/]+", " ", re.sub(r"(?i)\(s\)", "s", text)).upper().split())


def merge_continuations(rows: DataFrame) -> DataFrame:
    """Tail rows joined line by line to the row they continue (WIN-07)."""
    bare = F.lit(True)
    for n in STRUCTURE:
        bare = bare & (F.trim(_raw(n)) == "")
    texty = F.lit(False)
    for n in CONTINUATION:
        texty = texty | (F.trim(_raw(n)) != "")
    # 2 ** 21 tables a page and rows a table; one table is one run of numbers
    order = F.shiftleft(F.col("page").cast("bigint"), 42) + F.shiftleft(F.col("table_no").cast("bigint"), 21) + F.col("row_no")
    d = rows.withColumn("_at", order).withColumn("_tail", bare & texty)
    d = blocks.carry_last(d, ["document_id"], blocks.block_of(F.col("page"), 64), [F.col("_at")], F.when(~F.col("_tail"), F.col("_at")), "_start")
    first = d.groupBy("document_id").agg(F.min("_at").alias("_first"))
    d = d.join(first, "document_id").withColumn("_start", F.coalesce("_start", "_first"))
    joined = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.trim(_raw(n)) != "", F.struct("_at", F.trim(_raw(n)).alias("x"))))), lambda s: s["x"]), "\n").alias(n)
    head = [n for n in rows.columns if n not in ("document_id", *CONTINUATION)]
    out = d.groupBy("document_id", "_start").agg(
        *[F.min_by(n, "_at").alias(n) for n in head], *[joined(n) for n in CONTINUATION], (F.count("*") > 1).alias("continued")
    )
    return out.withColumnRenamed("row_no", "table_row").withColumnRenamed("_start", "row_no")
