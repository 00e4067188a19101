"""Validation, comparison, ranges and rates of mapping documents made of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, mapping, validate
from . import bridge
from .decode_queries import long
from .registry import query
from .sqltext import PART


def _part(spark, sf_dir):
    return bridge.part_mapping(spark, sf_dir)


ISSUE = "document_id, severity, rule, param_id, related_id"

STRUCTURAL_SQL = f"""
  SELECT doc AS document_id, 'error' AS severity, 'structural.wps' AS rule, NULL AS param_id, NULL AS related_id FROM pdoc WHERE wps <= 0
  UNION ALL SELECT doc, 'warning', 'structural.sync_words', NULL, NULL FROM pdoc WHERE len(sync) <> 4
  UNION ALL SELECT doc, 'error', 'structural.sync_words', NULL, NULL FROM pdoc, unnest(sync) u(s) WHERE s NOT BETWEEN 0 AND 4095
  UNION ALL SELECT doc, 'error', 'structural.mapping_empty', pid, NULL FROM ppar WHERE pid NOT IN (SELECT pid FROM pseg)
  UNION ALL SELECT s.doc, 'error', 'structural.word_range', pid, NULL FROM pseg s JOIN pdoc d ON d.doc = s.doc
            WHERE word NOT BETWEEN 1 AND wps
  UNION ALL SELECT doc, 'error', 'structural.bit_range', pid, NULL FROM pseg WHERE lsb NOT BETWEEN 1 AND 12
  UNION ALL SELECT doc, 'error', 'structural.bit_range', pid, NULL FROM pseg WHERE msb NOT BETWEEN 1 AND 12
  UNION ALL SELECT doc, 'error', 'structural.resolution', pid, NULL FROM ppar
            WHERE ptype IN ('analog_signed', 'analog_unsigned', 'bcd') AND res = 0
  UNION ALL SELECT doc, 'warning', 'structural.formula', pid, NULL FROM ppar
            WHERE ptype IN ('analog_signed', 'analog_unsigned', 'bcd') AND formula <> 'linear'"""
MAPPING_SQL = """
  SELECT doc AS document_id, 'error' AS severity, 'mapping.segment_sequence' AS rule, pid AS param_id, NULL AS related_id
  FROM pseg GROUP BY doc, pid, seq HAVING count(*) > 1
  UNION ALL SELECT doc, 'error', 'mapping.subframe_consistency', pid, NULL FROM pseg GROUP BY doc, pid HAVING count(DISTINCT sf) > 1"""
OVERLAP_SQL = """
  SELECT DISTINCT a.doc AS document_id, a.pid AS param_id, b.pid AS related_id, a.sf::BIGINT AS subframe, a.word::BIGINT AS word
  FROM pseg a JOIN pseg b ON a.doc = b.doc AND a.sf = b.sf AND a.word = b.word AND a.ord < b.ord
  WHERE a.lsb BETWEEN 1 AND 12 AND b.lsb BETWEEN 1 AND 12
    AND least(a.msb, b.msb) >= greatest(a.lsb, b.lsb)"""
SEMANTIC_SQL = f"""
  SELECT doc AS document_id, 'error' AS severity, 'semantic.type' AS rule, pid AS param_id, NULL AS related_id FROM ppar WHERE ptype = 'odd'
  UNION ALL SELECT doc, 'warning', 'semantic.type', pid, NULL FROM ppar WHERE ptype = 'unknown'
  UNION ALL SELECT doc, 'warning', 'semantic.discrete_states', pid, NULL FROM ppar WHERE ptype = 'discrete' AND tlab IS NULL
  UNION ALL SELECT doc, 'error', 'semantic.range', pid, NULL FROM ppar WHERE lo > hi
  UNION ALL SELECT document_id, 'warning', 'semantic.overlap', param_id, related_id FROM ({OVERLAP_SQL})"""


def _issues(name, sql, build):
    @query(name, f"WITH {PART} {sql}")
    def run(spark, sf_dir):
        return build(*_part(spark, sf_dir)).select(*ISSUE.split(", "))

    return run


_issues("validate_structural", STRUCTURAL_SQL, validate.structural)
_issues("validate_mapping", MAPPING_SQL, lambda d, p, s: validate.mapping(s))
_issues("validate_semantic", SEMANTIC_SQL, lambda d, p, s: validate.semantic(p, s))


@query(
    "issue_counts",
    f"""WITH {PART}, i AS ({STRUCTURAL_SQL} UNION ALL {MAPPING_SQL} UNION ALL {SEMANTIC_SQL})
    SELECT document_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
    FROM i GROUP BY ALL""",
)
def issue_counts(spark, sf_dir):
    """Errors and warnings of all rules per document (SET-01, AGG-03)."""
    return validate.issue_counts(validate.validate(*_part(spark, sf_dir)))


@query(
    "issues_concerning",
    f"""WITH {PART}, i AS ({STRUCTURAL_SQL} UNION ALL {MAPPING_SQL} UNION ALL {SEMANTIC_SQL})
    SELECT {ISSUE} FROM i WHERE param_id = 'part-25' OR related_id = 'part-25'""",
)
def issues_concerning(spark, sf_dir):
    return validate.concerning(validate.validate(*_part(spark, sf_dir)), "part-25").select(*ISSUE.split(", "))


@query("bit_overlap", f"WITH {PART} {OVERLAP_SQL}")
def bit_overlap(spark, sf_dir):
    _, pars, segs = _part(spark, sf_dir)
    return validate.bit_overlaps(pars, segs).select("document_id", "param_id", "related_id", long("subframe"), long("word"))


@query(
    "recording_rate",
    f"""WITH {PART}, ok AS (SELECT doc, pid FROM pseg GROUP BY doc, pid HAVING count(DISTINCT sf) = 1)
    SELECT p.doc AS document_id, p.pid AS param_id, CASE WHEN ok.pid IS NULL THEN 0 ELSE 1 END::BIGINT AS samples_per_frame,
           CASE WHEN ok.pid IS NULL THEN 0 ELSE 1 END / 4.0::DOUBLE AS rate_hz
    FROM ppar p LEFT JOIN ok ON ok.pid = p.pid""",
)
def recording_rate(spark, sf_dir):
    """Samples per frame and Hz (MAP-12)."""
    _, pars, segs = _part(spark, sf_dir)
    return mapping.recording_rate(pars, segs).drop("param_ord")


@query(
    "representable_range",
    f"""WITH {PART},
    w AS (SELECT doc, pid, sum(CASE WHEN lsb BETWEEN 1 AND 12 AND msb BETWEEN 1 AND 12 THEN msb - lsb + 1 ELSE 0 END)::BIGINT AS width
          FROM pseg GROUP BY doc, pid),
    r AS (SELECT p.*, w.width,
            CASE WHEN width > 0 THEN CASE WHEN ptype = 'analog_signed' THEN -pow(2.0::DOUBLE, width - 1) ELSE 0.0::DOUBLE END END AS raw_lo,
            CASE WHEN width > 0 THEN CASE WHEN ptype = 'analog_signed' THEN pow(2.0::DOUBLE, width - 1) - 1
                 WHEN ptype = 'bcd' THEN pow(10.0::DOUBLE, width // 4) - 1 + pow(10.0::DOUBLE, width // 4) * CASE width % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 7 END
                 ELSE pow(2.0::DOUBLE, width) - 1 END END AS raw_hi,
            CASE WHEN res = 0 THEN 1.0::DOUBLE ELSE res END AS r_
          FROM ppar p LEFT JOIN w ON w.pid = p.pid),
    e AS (SELECT *, CASE WHEN width > 0 THEN CASE WHEN ptype = 'raw' THEN raw_lo ELSE off_ + (raw_lo - 0.499::DOUBLE) * r_ END END AS rep_low,
                    CASE WHEN width > 0 THEN CASE WHEN ptype = 'raw' THEN raw_hi ELSE off_ + (raw_hi + 0.499::DOUBLE) * r_ END END AS rep_high FROM r),
    k AS (SELECT *, coalesce(hi > lo, false) AS declared, greatest(lo, rep_low) AS cl, least(hi, rep_high) AS ch FROM e)
    SELECT doc AS document_id, pid AS param_id, rep_low, rep_high,
           CASE WHEN ptype = 'discrete' THEN 0.0::DOUBLE WHEN declared AND rep_low IS NULL THEN lo
                WHEN declared AND ch > cl THEN cl ELSE coalesce(rep_low, 0.0::DOUBLE) END AS low,
           CASE WHEN ptype = 'discrete' THEN 1.0::DOUBLE WHEN declared AND rep_high IS NULL THEN hi
                WHEN declared AND ch > cl THEN ch ELSE coalesce(rep_high, 1.0::DOUBLE) END AS high
    FROM k""",
)
def representable_range(spark, sf_dir):
    """Range the field can hold and the declared range clipped to it (MAP-10, MAP-11)."""
    _, pars, segs = _part(spark, sf_dir)
    return mapping.representable_range(pars, segs).drop("param_ord")


def _revised(spark, sf_dir):
    """The part documents and a revision of them: rates, units, scales, shown decimals and bits changed."""
    docs, pars, segs = _part(spark, sf_dir)
    docs = docs.withColumn("settings_raw", F.lit(None).cast("array<string>")).withColumn("pair_id", F.col("document_id"))
    pars = pars.withColumn("pair_id", F.col("document_id"))
    segs = segs.join(pars.select("document_id", "param_id", "param_ord", "pair_id"), ["document_id", "param_id"])
    docs2 = docs.withColumn("wps", F.lit(64))
    pars2 = pars.withColumn("unit", F.when(F.col("unit") != "bolt", F.col("unit"))).withColumn(
        "resolution", F.when(F.col("ptype") == "bcd", F.lit(1.0)).otherwise(F.col("resolution"))
    )
    size = F.col("minimum") + 10
    pars2 = pars2.withColumn("offset", F.col("offset") + F.when(size % 4 == 0, 0.5).otherwise(0.0)).withColumn(
        "decimals", F.when(size % 9 == 0, 2).otherwise(F.col("decimals")))
    segs2 = segs.withColumn("msb", F.when(F.col("word") > 50, F.lit(12)).otherwise(F.col("msb")))
    return (docs, pars, segs), (docs2, pars2, segs2)


@query(
    "document_diff",
    f"""WITH {PART},
    shown AS (SELECT *, CASE WHEN ptype = 'discrete' OR p_size IN (13) OR p_size % 8 = 0 THEN 0 WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS dec FROM ppar),
    both_ AS (SELECT *, CASE WHEN p_size % 9 = 0 THEN 2 WHEN ptype = 'bcd' THEN 0 ELSE dec END AS dec2 FROM shown)
    SELECT doc AS document_id, NULL::BIGINT AS param_ord, 'wps' AS what, wps::VARCHAR AS "left", '64' AS "right" FROM pdoc WHERE wps <> 64
    UNION ALL SELECT doc, ord, 'unit', 'bolt', NULL FROM ppar WHERE unit = 'bolt'
    UNION ALL SELECT doc, ord, 'resolution', res::DOUBLE::VARCHAR, '1.0' FROM ppar WHERE ptype = 'bcd' AND res <> 1.0
    UNION ALL SELECT doc, ord, 'offset', off_::VARCHAR, (off_ + 0.5::DOUBLE)::VARCHAR FROM ppar WHERE p_size % 4 = 0
    UNION ALL SELECT doc, ord, 'decimals', dec::VARCHAR, dec2::VARCHAR FROM both_ WHERE dec <> dec2
    UNION ALL SELECT doc, ord, 'word/lsb/msb', word || ',' || lsb || ',' || msb, word || ',' || lsb || ',12'
              FROM pseg WHERE word > 50 AND msb <> 12""",
)
def document_diff(spark, sf_dir):
    """All differences of every document from its revision (DIF-01)."""
    left, right = _revised(spark, sf_dir)
    d = diff.differences(left, right)
    return d.select(F.col("pair_id").alias("document_id"), long("param_ord"), "what", "left", "right")


@query(
    "document_diff_numbers",
    f"""WITH {PART} SELECT doc AS document_id, ord AS param_ord, 'resolution' AS what, res AS before
    FROM ppar WHERE ptype = 'bcd' AND res <> 1.0""",
)
def document_diff_numbers(spark, sf_dir):
    left, right = _revised(spark, sf_dir)
    d = diff.parameter_differences(left[1], right[1]).filter("what = 'resolution'")
    return d.select(F.col("pair_id").alias("document_id"), long("param_ord"), "what", F.col("left").cast("double").alias("before"))


@query(
    "validate_odd_subframes",
    f"""WITH {PART} SELECT doc AS document_id, pid AS param_id, count(*) AS n, max(seq)::BIGINT AS last_seq FROM pseg
    WHERE CAST(substr(pid, 6) AS BIGINT) % 9 IN (0, 1) GROUP BY ALL""",
)
def validate_odd_subframes(spark, sf_dir):
    """Segments without a subframe, or in one that no frame has (VAL-03)."""
    docs, pars, segs = _part(spark, sf_dir)
    k = F.substr("param_id", F.lit(6)).cast("bigint") % 9
    odd = F.when(k == 0, F.array(F.lit(0), F.lit(5))).when(k == 1, F.array().cast("array<int>")).otherwise(F.col("subframes"))
    issues = validate.structural(docs, pars, segs.withColumn("subframes", odd)).filter("rule = 'structural.subframe'")
    seq = F.regexp_extract("message", r"seg (\d+)", 1).cast("bigint")
    return issues.groupBy("document_id", "param_id").agg(F.count("*").alias("n"), F.max(seq).alias("last_seq"))


@query(
    "validate_repeated_occurrences",
    f"""WITH {PART}, o AS (SELECT DISTINCT doc, pid FROM pseg)
    SELECT doc AS document_id, pid AS param_id, 'occurrence index 1 used ' || (CAST(substr(pid, 6) AS BIGINT) % 3 + 1) || ' times' AS message
    FROM o WHERE CAST(substr(pid, 6) AS BIGINT) % 3 > 0""",
)
def validate_repeated_occurrences(spark, sf_dir):
    """Occurrence indexes listed more than once (VAL-05)."""
    _, _, segs = _part(spark, sf_dir)
    listed = segs.select("document_id", "param_id", "occ").distinct()
    times = (F.substr("param_id", F.lit(6)).cast("bigint") % 3 + 1).cast("int")
    listed = listed.withColumn("t", F.explode(F.sequence(F.lit(1), times))).drop("t")
    issues = validate.mapping(segs, listed).filter("rule = 'mapping.occurrence_index'")
    return issues.select("document_id", "param_id", "message")
