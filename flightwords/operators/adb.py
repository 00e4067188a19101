"""ADB records to mapping tables and back, as DataFrame work.

A document is a settings record and parameter records of 238 positional fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import plain_decimal
from ..functions.types import normalize_source_type, vendor_type_text
from ..functions.words import absolute_word, decode_selector, split_absolute
from ..schemas import BCD, DISCRETE, LINEAR_TYPES, SUBFRAME_COUNT
from .decode import effective_decimals
from .mapping import subframe_set

# Record layout.
SETTING, SETTING_MIN, SYNC_AT = "Setting", 11, 7
VALUES_AT, LABELS_AT, SLOTS = 10, 42, 32
SAMPLES_AT, PARTS_AT, LOCATIONS_AT, LOCATION_FIELDS, RECORD = 74, 75, 76, 5, 238
SELECTOR_ALL = "1234"

KEY = ["document_id", "record_index"]


def _field(i: int) -> Column:
    return F.trim(F.get("fields", F.lit(i)))


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def _unreadable(text: Column, value: Column) -> Column:
    return (text != "") & value.isNull()


def _whole(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("int"), _number(text).try_cast("int"))


def documents(records: DataFrame) -> DataFrame:
    """Settings records as documents; ``problem`` is set where one is unusable."""
    s = records.filter("record_index = 0")
    wps = _field(2).try_cast("int")
    sync = F.transform(F.slice("fields", SYNC_AT + 1, SUBFRAME_COUNT), lambda x: F.trim(x).try_cast("int"))
    problem = (
        F.when(_field(0) != SETTING, "first record must begin with Setting")
        .when(F.size("fields") < SETTING_MIN, "settings record is too short")
        .when(F.coalesce(wps <= 0, F.lit(True)), "words per subframe must be positive")
        .when(F.exists(sync, lambda x: x.isNull()), "invalid sync word")
    )
    none = F.lit(None).cast("string")
    return s.select(
        "document_id", F.col("document_id").alias("name"), wps.alias("wps"), sync.alias("sync_words"), none.alias("aircraft_type"),
        none.alias("revision"), none.alias("issue_date"), F.lit(None).cast("boolean").alias("superframe_present"),
        F.lit("adb").alias("source_type"), F.col("document_id").alias("source_filename"), "source_hash",
        F.col("fields").alias("settings_raw"), F.lit("IMPORTED").alias("status"), problem.alias("problem"),
    )


def legacy_settings(docs: DataFrame) -> DataFrame:
    """Settings fields of unknown meaning (MAP-05)."""
    return docs.select("document_id", F.posexplode("settings_raw").alias("position", "value")).filter(
        F.col("position").isin(1, 3, 6) | (F.col("position") >= SETTING_MIN)
    )


def _with_states(p: DataFrame) -> DataFrame:
    """State table, labels and BCD weights of each record (MAP-02)."""
    slots = F.transform(
        F.arrays_zip(F.slice("fields", VALUES_AT + 1, SLOTS).alias("v"), F.slice("fields", LABELS_AT + 1, SLOTS).alias("l")),
        lambda s, i: F.struct(F.trim(s["v"]).alias("v"), F.trim(s["l"]).alias("l"), i.alias("slot")),
    )
    p = p.withColumn("_slots", slots).withColumn("_bcd", F.col("ptype") == BCD)
    used = F.filter("_slots", lambda s: (s["v"] != "") | (s["l"] != ""))
    states = F.transform(used, lambda s: F.struct(
        F.coalesce(s["v"].try_cast("bigint"), s["slot"].cast("bigint")).alias("value"), s["l"].alias("label")))
    weights = F.filter(F.transform(F.filter("_slots", lambda s: s["v"] != ""), lambda s: s["v"].try_cast("double")), lambda w: w.isNotNull())
    odd_state = F.transform(
        F.filter(used, lambda s: s["v"].try_cast("bigint").isNull()),
        lambda s: F.concat(F.lit("state slot "), (s["slot"] + 1).cast("string"), F.lit(": slot index used")),
    )
    odd_weight = F.transform(
        F.filter("_slots", lambda s: (s["v"] != "") & s["v"].try_cast("double").isNull()),
        lambda s: F.concat(F.lit("BCD digit weight slot "), (s["slot"] + 1).cast("string"), F.lit(" ignored")),
    )
    empty = F.array().cast("array<struct<value:bigint,label:string>>")
    p = (
        p.withColumn("_states", F.when(F.col("_bcd"), empty).otherwise(states))
        .withColumn("weights", F.when(F.col("_bcd"), weights).otherwise(F.array().cast("array<double>")))
        .withColumn("slot_warnings", F.when(F.col("_bcd"), odd_weight).otherwise(odd_state))
    )
    label = lambda v: F.get(F.transform(F.filter("_states", lambda s: (s["value"] == v) & (s["label"] != "")), lambda s: s["label"]), F.lit(0))
    values = F.transform("_states", lambda s: s["value"])
    two = F.forall(values, lambda v: v.isin(0, 1)) & (F.size(F.array_distinct(values)) == F.size(values))
    return (
        p.withColumn("true_state", label(1)).withColumn("false_state", label(0))
        .withColumn("states", F.when(two, empty).otherwise(F.col("_states"))).drop("_slots", "_states", "_bcd")
    )


def parsed(records: DataFrame) -> DataFrame:
    """Parameter records with typed columns (MAP-01); ``problem`` marks rejects."""
    wps = documents(records).filter("problem IS NULL").select("document_id", "wps")
    p = records.filter("record_index > 0").join(wps, "document_id")
    idx = F.format_string("%04d", F.col("record_index"))
    numbers = {"minimum": 4, "maximum": 5, "_scale": 6, "_offset": 7}
    p = p.select(
        "*", F.concat(F.lit("adb-"), idx).alias("param_id"), F.col("record_index").alias("param_ord"),
        F.coalesce(F.nullif(_field(0), F.lit("")), F.concat(F.lit("PARAM_"), idx)).alias("mnemonic"), _field(1).alias("description"),
        F.nullif(_field(2), F.lit("")).alias("source_type"), normalize_source_type(_field(2)).alias("ptype"),
        F.nullif(_field(3), F.lit("")).alias("unit"), *[_number(_field(i)).alias(n) for n, i in numbers.items()],
        _whole(_field(8)).alias("decimals"), _whole(_field(SAMPLES_AT)).alias("samples"),
        F.greatest(F.coalesce(_whole(_field(PARTS_AT)), F.lit(1)), F.lit(1)).alias("parts"),
        F.lit("linear").alias("formula_type"), F.lit(None).cast("string").alias("notes"),
    )
    p = p.withColumn("resolution", F.coalesce("_scale", F.lit(1.0))).withColumn("offset", F.coalesce("_offset", F.lit(0.0)))
    p = _with_states(p)
    p = p.withColumn("locations", _locations())
    bad_number = [_unreadable(_field(i), F.col(n)) for n, i in numbers.items()] + [
        _unreadable(_field(8), F.col("decimals")), _unreadable(_field(SAMPLES_AT), F.col("samples")),
        _unreadable(_field(PARTS_AT), _whole(_field(PARTS_AT))),
    ]
    any_bad = bad_number[0]
    for b in bad_number[1:]:
        any_bad = any_bad | b
    loc_problem = F.get(F.filter(F.transform("locations", lambda x: x["problem"]), lambda x: x.isNotNull()), F.lit(0))
    return p.withColumn(
        "problem", F.when(F.size("fields") < RECORD, "record is too short").when(any_bad, "invalid number").otherwise(loc_problem)
    ).drop("_scale", "_offset")


def _locations() -> Column:
    """Used location groups with subframes and relative word (MAP-03)."""
    wps = F.col("wps")
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)),
        lambda i: F.struct(
            i.alias("slot"), *[F.trim(F.get("fields", LOCATIONS_AT + i * LOCATION_FIELDS + k)).alias(n)
                               for k, n in enumerate(("sel", "w", "l", "m", "flag"))]
        ),
    )
    used = F.filter(raw, lambda x: F.concat(x["sel"], x["w"], x["l"], x["m"]) != "")

    def place(x: Column) -> Column:
        word, lsb, msb = (x[c].try_cast("int") for c in ("w", "l", "m"))
        absolute = x["sel"].isin("", SELECTOR_ALL) | (word > wps)
        sf, rel = split_absolute(word, wps)
        chosen = decode_selector(x["sel"])
        problem = (
            F.when(word.isNull() | lsb.isNull() | msb.isNull(), "location is not a number")
            .when(word < 1, "word outside the frame").when(absolute & (sf > SUBFRAME_COUNT), "word beyond the frame")
            .when(~absolute & chosen.isNull(), "invalid subframe selector")
        )
        return F.struct(
            x["slot"].alias("slot"), F.when(absolute, F.array(sf)).otherwise(chosen).alias("sfs"),
            F.when(absolute, rel).otherwise(word).alias("word"), lsb.alias("lsb"), msb.alias("msb"), x["flag"].alias("flag"),
            (absolute & ~x["sel"].isin("", SELECTOR_ALL)).alias("ignored"), problem.alias("problem"),
        )

    return F.transform(used, place)


PARAMETER_COLUMNS = (
    "document_id", "param_ord", "param_id", "mnemonic", "description", "source_type", "ptype", "unit", "minimum", "maximum",
    "resolution", "offset", "formula_type", "decimals", "true_state", "false_state", "states", "notes",
)


def parameters(p: DataFrame) -> DataFrame:
    return p.filter("problem IS NULL").select(*PARAMETER_COLUMNS)


def rejects(p: DataFrame) -> DataFrame:
    return p.filter("problem IS NOT NULL").select("document_id", "record_index", "mnemonic", "problem")


def segments(p: DataFrame) -> DataFrame:
    """Locations folded to occurrences (MAP-04).

    A record holds at most 32 locations, so every group here is tiny.
    """
    good = p.filter("problem IS NULL")
    loc = good.select(*KEY, "param_id", "parts", "weights", F.posexplode("locations").alias("n", "loc"))
    loc = loc.withColumn("sample", F.floor(F.col("n") / F.col("parts"))).withColumn("part", F.col("n") % F.col("parts"))
    sample = loc.groupBy(*KEY, "param_id", "parts", "weights", "sample").agg(
        F.array_sort(F.collect_list(F.struct("part", "loc.word", "loc.lsb", "loc.msb"))).alias("shape"),
        F.transform(F.array_sort(F.collect_list(F.struct("part", "loc.sfs"))), lambda x: x["sfs"]).alias("sfs"),
    )
    occ = sample.groupBy(*KEY, "param_id", "parts", "weights", "shape").agg(
        F.min("sample").alias("first"), F.collect_list("sfs").alias("all")
    ).withColumn("occ", F.row_number().over(Window.partitionBy(*KEY).orderBy("first")))
    seg = occ.select("document_id", "param_id", "parts", "weights", "occ", "all", F.size("shape").alias("n"), F.explode("shape").alias("s"))
    merged = subframe_set(F.flatten(F.transform("all", lambda a: F.get(a, F.col("s.part")))))
    weight = F.when(F.size("weights") == F.col("parts"), F.get("weights", F.col("s.part")))
    return seg.select(
        "document_id", "param_id", "occ", (F.col("n") - F.col("s.part")).cast("int").alias("seq"), merged.alias("subframes"),
        F.col("s.word").alias("word"), F.col("s.lsb").alias("lsb"), F.col("s.msb").alias("msb"), weight.alias("bcd_weight"),
    )


def warnings(p: DataFrame) -> DataFrame:
    """Everything that had to be guessed or ignored (MAP-05)."""
    n = F.size("locations")
    notes = F.concat(
        F.col("slot_warnings"),
        F.transform(F.filter("locations", lambda x: x["ignored"]),
                    lambda x: F.concat(F.lit("location "), (x["slot"] + 1).cast("string"), F.lit(": subframe selector ignored"))),
        F.array_compact(F.array(
            F.when(F.col("samples") * F.col("parts") != n, "sample count does not match the locations"),
            F.when(n % F.col("parts") != 0, "locations do not divide into parts"),
            F.when((F.size("weights") > 0) & (F.size("weights") != F.col("parts")), "BCD digit weights ignored"),
        )),
    )
    return p.filter("problem IS NULL").select("document_id", "param_id", F.explode(notes).alias("warning"))


# -- writing ---------------------------------------------------------------

def settings_record(docs: DataFrame) -> DataFrame:
    """Settings fields for export (MAP-07)."""
    old = F.col("settings_raw")
    whole_frame = (F.col("wps") * SUBFRAME_COUNT).cast("string")
    get = lambda i: F.trim(F.get(old, F.lit(i)))
    follows = (get(5) == "") | (get(5).try_cast("int") == SUBFRAME_COUNT * get(2).try_cast("int"))
    template = F.array(*[F.lit(x) for x in (SETTING, "1", "", "1", "12", "", "0", "", "", "", "")])
    base = F.when(old.isNull(), template).otherwise(F.concat(old, F.array_repeat(F.lit(""), F.greatest(SETTING_MIN - F.size(old), F.lit(0)))))
    sync = lambda i: F.get("sync_words", i - SYNC_AT).cast("string")
    fields = F.transform(base, lambda x, i: (
        F.when(i == 2, F.col("wps").cast("string"))
        .when((i == 5) & (old.isNull() | F.coalesce(follows, F.lit(False))), whole_frame)
        .when(i.between(SYNC_AT, SYNC_AT + 3), F.coalesce(sync(i), x)).otherwise(x)
    ))
    return docs.select("document_id", F.lit(0).alias("record_index"), fields.alias("fields"))


def generated_records(docs: DataFrame, pars: DataFrame, segs: DataFrame) -> DataFrame:
    """Parameter records built from the model (MAP-06); ``problem`` where one does not fit."""
    s = segs.filter("seq IS NOT NULL").join(docs.select("document_id", "wps"), "document_id")
    s = s.withColumn("sfs", subframe_set(F.col("subframes")))
    per_occ = s.groupBy("document_id", "param_id", "occ").agg(
        F.count("*").alias("n"), F.count_distinct(F.size("sfs")).alias("shapes")
    )
    uniform = per_occ.groupBy("document_id", "param_id").agg(
        ((F.count_distinct("n") == 1) & (F.max("shapes") == 1)).alias("uniform"), F.max("n").alias("n")
    )
    e = s.join(uniform, ["document_id", "param_id"]).select("*", F.posexplode("sfs").alias("k", "sf"))
    sample = Window.partitionBy("document_id", "param_id", "occ", "k")
    e = e.withColumn("lead", F.when(F.col("uniform"), F.min("sf").over(sample)).otherwise(F.col("sf")))
    place = F.struct(
        F.col("lead"), F.col("occ"), F.when(F.col("uniform"), F.col("k")).otherwise(0).alias("k"), (-F.col("seq")).alias("o"),
        F.array(F.lit(SELECTOR_ALL), absolute_word(F.col("sf"), F.col("word"), F.col("wps")).cast("string"),
                F.col("lsb").cast("string"), F.col("msb").cast("string"), F.lit("")).alias("f"),
    )
    first_occ = F.struct("occ", (-F.col("seq")).alias("o"), F.col("bcd_weight").alias("w"))
    loc = e.groupBy("document_id", "param_id").agg(
        F.array_sort(F.collect_list(place)).alias("places"), F.first("uniform").alias("uniform"), F.first("n").alias("n"),
        F.array_sort(F.collect_set(first_occ)).alias("ws"),
    )
    p = pars.join(loc, ["document_id", "param_id"], "left")
    count = F.coalesce(F.size("places"), F.lit(0))
    parts = F.when(F.col("uniform"), F.col("n")).otherwise(1)
    parts = F.coalesce(parts, F.lit(1))
    implied = F.array_compact(F.array(
        F.when(F.col("false_state").isNotNull(), F.struct(F.lit(0).cast("bigint").alias("value"), F.col("false_state").alias("label"))),
        F.when(F.col("true_state").isNotNull(), F.struct(F.lit(1).cast("bigint").alias("value"), F.col("true_state").alias("label"))),
    ))
    states = F.when(F.coalesce(F.size("states"), F.lit(0)) > 0, F.col("states")).otherwise(implied)
    discrete, bcd = F.col("ptype") == DISCRETE, F.col("ptype") == BCD
    states = F.when(discrete, states).otherwise(F.array().cast("array<struct<value:bigint,label:string>>"))
    first_ws = F.transform(F.filter("ws", lambda x: x["occ"] == F.get("ws", F.lit(0))["occ"]), lambda x: x["w"])
    weights = F.when(bcd & F.coalesce(F.col("uniform"), F.lit(False)) & F.forall(first_ws, lambda w: w.isNotNull()), first_ws).otherwise(
        F.array().cast("array<double>"))

    def padded(a: Column, n: int) -> Column:
        return F.concat(a, F.array_repeat(F.lit(""), F.greatest(n - F.size(a), F.lit(0))))

    slot_values = F.when(bcd, F.transform(weights, plain_decimal)).otherwise(F.transform(states, lambda x: x["value"].cast("string")))
    kind = F.when(discrete, F.when(F.size(states) > 0, "Discrete").otherwise("")).when(F.col("ptype").isin(*LINEAR_TYPES), "-").otherwise("")
    head = F.array(
        "mnemonic", F.coalesce("description", F.lit("")), vendor_type_text(F.col("ptype"), F.col("source_type")), F.coalesce("unit", F.lit("")),
        plain_decimal(F.col("minimum")), plain_decimal(F.col("maximum")), plain_decimal(F.col("resolution")), plain_decimal(F.col("offset")),
        effective_decimals().cast("string"), kind,
    )
    fields = F.concat(
        head, padded(slot_values, SLOTS), padded(F.transform(states, lambda x: x["label"]), SLOTS),
        F.array(F.floor(count / parts).cast("string"), parts.cast("string")),
        padded(F.coalesce(F.flatten(F.transform("places", lambda x: x["f"])), F.array().cast("array<string>")), SLOTS * LOCATION_FIELDS),
        F.array(F.lit(""), F.lit("")),
    )
    problem = F.when(F.size(states) > SLOTS, "too many discrete states").when(count > SLOTS, "too many sample locations")
    return p.select("document_id", F.col("param_ord").alias("record_index"), "param_id", fields.alias("fields"), problem.alias("problem"))


def export(docs: DataFrame, pars: DataFrame, segs: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Records to write: the preserved raw one where the parameter is still what it
    says, else a generated one (SNK-04).  Documents with a problem are left out."""
    from . import diff

    made = generated_records(docs, pars, segs)
    if raw is not None:
        again = parsed(raw)
        pair = lambda d: d.withColumn("pair_id", F.col("document_id"))
        numbered = lambda s, q: pair(s.join(q.select("document_id", "param_id", "param_ord"), ["document_id", "param_id"]))
        old_p, old_s = parameters(again), segments(again)
        changed = diff.parameter_differences(pair(pars), pair(old_p), ignore=("notes",)).select("pair_id", "param_ord").unionByName(
            diff.mapping_differences(numbered(segs, pars), numbered(old_s, old_p)).select("pair_id", "param_ord")
        ).distinct().select(F.col("pair_id").alias("document_id"), F.col("param_ord").alias("record_index"), F.lit(True).alias("changed"))
        keep = raw.filter("record_index > 0").select("document_id", "record_index", F.col("fields").alias("raw_fields"))
        made = made.join(keep, KEY, "left").join(changed, KEY, "left")
        reuse = F.col("raw_fields").isNotNull() & F.col("changed").isNull()
        made = made.withColumn("fields", F.when(reuse, F.col("raw_fields")).otherwise(F.col("fields"))).withColumn(
            "problem", F.when(~reuse, F.col("problem")))
    refused = made.filter("problem IS NOT NULL").select("document_id").distinct()
    rows = settings_record(docs).unionByName(made.select("document_id", "record_index", "fields"))
    return rows.join(refused, "document_id", "left_anti")
