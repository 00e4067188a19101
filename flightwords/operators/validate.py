"""Validation of mapping documents: one row per issue.

Columns: document_id, severity, rule, param_id, related_id, message.  The rules
are filters and keyed aggregations over documents, parameters and segments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import shift_left
from ..schemas import CANONICAL_TYPES, DISCRETE, LINEAR_TYPES, SUBFRAME_COUNT, UNKNOWN, WORD_BITS, WORD_MAX
from .mapping import subframe_set

ERROR, WARNING = "error", "warning"


def _issue(df: DataFrame, severity: str, rule: str, message: Column, param: Column | None = None,
           related: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string")
    return df.select(
        "document_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
        (text if param is None else param).alias("param_id"), (text if related is None else related).alias("related_id"),
        message.alias("message"),
    )


def _checked(df: DataFrame, checks: list[tuple], param: Column | None = None) -> DataFrame:
    """Issues of a table in one pass: every (condition, severity, rule, message) that holds for a row."""
    found = F.array_compact(F.array(*[
        F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message")))
        for condition, severity, rule, message in checks
    ]))
    none = F.lit(None).cast("string")
    rows = df.select("document_id", (none if param is None else param).alias("param_id"), F.inline(found))
    return rows.select("document_id", "severity", "rule", "param_id", none.alias("related_id"), "message")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def union(issues: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def structural(documents: DataFrame, parameters: DataFrame, segments: DataFrame) -> DataFrame:
    c, pid = F.col, F.col("param_id")
    listed = segments.select("document_id", "param_id").distinct()
    empty = segments.groupBy("document_id", "param_id", "occ").agg(F.count("seq").alias("n")).filter("n = 0")
    segs = segments.filter("seq IS NOT NULL").join(documents.select("document_id", "wps"), "document_id")
    where = _text("occ ", c("occ"), " seg ", c("seq"), ": ")
    outside = lambda name: ~c(name).between(1, WORD_BITS)
    bad_sf = (F.size("subframes") == 0) | F.exists("subframes", lambda s: ~s.between(1, SUBFRAME_COUNT))
    linear = c("ptype").isin(*LINEAR_TYPES)
    syncs = documents.select("document_id", F.explode("sync_words").alias("sync"))
    return union([
        _checked(documents, [
            (c("wps") <= 0, ERROR, "structural.wps", _text("invalid WPS ", c("wps"))),
            (F.size("sync_words") != SUBFRAME_COUNT, WARNING, "structural.sync_words", _text(F.size("sync_words"), " sync words defined, expected 4")),
        ]),
        _checked(syncs, [(~c("sync").between(0, WORD_MAX), ERROR, "structural.sync_words", _text("sync word ", c("sync"), " outside 0..4095"))]),
        _issue(parameters.join(listed, ["document_id", "param_id"], "left_anti"), ERROR, "structural.mapping_empty",
               F.lit("parameter has no mapping"), pid),
        _issue(empty, ERROR, "structural.mapping_empty", _text("occurrence ", c("occ"), " has no segments"), pid),
        _checked(segs, [
            (~c("word").between(1, c("wps")), ERROR, "structural.word_range", _text(where, "word ", c("word"), " outside 1..", c("wps"))),
            *[(outside(n), ERROR, "structural.bit_range", _text(where, f"{n} ", c(n), " outside 1..12")) for n in ("lsb", "msb")],
            (bad_sf, ERROR, "structural.subframe", _text(where, "invalid subframes ", F.array_join("subframes", ","))),
        ], pid),
        _checked(parameters.filter(linear), [
            (c("resolution") == 0, ERROR, "structural.resolution", F.lit("resolution must be non-zero")),
            (c("formula_type") != "linear", WARNING, "structural.formula", _text("unsupported formula_type ", c("formula_type"))),
        ], pid),
    ])


def mapping(segments: DataFrame, occurrences: DataFrame | None = None) -> DataFrame:
    """Duplicate indexes and disagreeing subframes.

    ``occurrences`` (document_id, param_id, occ, one row per listed occurrence)
    lets repeated occurrence indexes show; segments alone cannot repeat one.
    """
    c, pid = F.col, F.col("param_id")
    segs = segments.filter("seq IS NOT NULL")
    sequences = segs.groupBy("document_id", "param_id", "occ", "seq").count().filter("count > 1")
    sets = segs.groupBy("document_id", "param_id", "occ").agg(
        F.size(F.collect_set(subframe_set(c("subframes")))).alias("n")
    ).filter("n > 1")
    issues = [
        _issue(sequences, ERROR, "mapping.segment_sequence",
               _text("occ ", c("occ"), ": segment sequence ", c("seq"), " used ", c("count"), " times"), pid),
        _issue(sets, ERROR, "mapping.subframe_consistency",
               _text("occ ", c("occ"), ": segments disagree on subframes"), pid),
    ]
    if occurrences is not None:
        repeated = occurrences.groupBy("document_id", "param_id", "occ").count().filter("count > 1")
        issues.append(_issue(repeated, ERROR, "mapping.occurrence_index",
                             _text("occurrence index ", c("occ"), " used ", c("count"), " times"), pid))
    return union(issues)


def bit_overlaps(parameters: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs of parameters sharing bits of a cell (JON-05), once per (pair, subframe, word).

    The join key includes the bit, so two parameters meet only where they truly
    overlap; of their common bits the lowest one reports the pair.
    """
    lo, hi = F.least("lsb", "msb"), F.greatest("lsb", "msb")
    one = F.lit(1).cast("bigint")
    mask = shift_left(shift_left(one, hi - lo + 1) - 1, lo - 1)
    cells = (
        segments.filter((lo >= 1) & (hi <= WORD_BITS)).withColumn("mask", mask)
        .withColumn("subframe", F.explode(F.filter("subframes", lambda s: s.between(1, SUBFRAME_COUNT))))
        .groupBy("document_id", "subframe", "word", "param_id").agg(F.bit_or("mask").alias("mask"))
        .join(parameters.select("document_id", "param_id", "param_ord"), ["document_id", "param_id"])
    )
    bits = cells.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)))).filter(
        shift_left(one, F.col("bit")).bitwiseAND(F.col("mask")) != 0
    )
    a = bits.select("document_id", "subframe", "word", "bit", F.col("param_id").alias("param_id"),
                    F.col("param_ord").alias("ord_a"), F.col("mask").alias("mask_a"))
    b = bits.select("document_id", "subframe", "word", "bit", F.col("param_id").alias("related_id"),
                    F.col("param_ord").alias("ord_b"), F.col("mask").alias("mask_b"))
    common = F.col("mask_a").bitwiseAND(F.col("mask_b"))
    lowest = common.bitwiseAND(-common) == shift_left(one, F.col("bit"))
    return (
        a.join(b, ["document_id", "subframe", "word", "bit"])
        .filter((F.col("ord_a") < F.col("ord_b")) & lowest)
        .select("document_id", "param_id", "related_id", "subframe", "word")
    )


def semantic(parameters: DataFrame, segments: DataFrame) -> DataFrame:
    c, pid = F.col, F.col("param_id")
    unlabelled = (
        (c("ptype") == DISCRETE) & (F.coalesce("true_state", F.lit("")) == "") & (F.coalesce("false_state", F.lit("")) == "")
        & (F.coalesce(F.size("states"), F.lit(0)) <= 0)
    )
    return union([
        _checked(parameters, [
            (~c("ptype").isin(*CANONICAL_TYPES), ERROR, "semantic.type", _text("unrecognized canonical type ", c("ptype"))),
            (c("ptype") == UNKNOWN, WARNING, "semantic.type", _text("source type ", F.coalesce("source_type", F.lit("none")), " did not normalize")),
            (unlabelled, WARNING, "semantic.discrete_states", F.lit("discrete without state labels")),
            (c("minimum") > c("maximum"), ERROR, "semantic.range", F.lit("minimum above maximum")),
        ], pid),
        _issue(bit_overlaps(parameters, segments), WARNING, "semantic.overlap",
               _text("overlap in SF", c("subframe"), " word ", c("word")), pid, c("related_id")),
    ])


def validate(documents: DataFrame, parameters: DataFrame, segments: DataFrame) -> DataFrame:
    """All three layers (SET-01)."""
    return union([structural(documents, parameters, segments), mapping(segments), semantic(parameters, segments)])


def issue_counts(issues: DataFrame) -> DataFrame:
    """Errors and warnings per document (AGG-03)."""
    return issues.groupBy("document_id").agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings")
    )


def concerning(issues: DataFrame, param_id: str) -> DataFrame:
    """Issues that involve a parameter on either side (VAL-10)."""
    return issues.filter((F.col("param_id") == param_id) | (F.col("related_id") == param_id))
