"""Mapping files: CSV documents made of the part table, read, folded, reported and written again.

Sixteen parts make one file.  Part size and type decide what a record holds, so
that every branch of the reader has rows: quoted names, slots used as values,
weights, frame-wide and relative words, ignored selectors, damaged records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adb
from ..session import materialize
from ..sources import adb_files
from . import bridge
from .registry import query

TYPES = {
    "ECONOMY": ("Signed Analog", "analog_signed"), "LARGE": ("unsigned", "analog_unsigned"), "MEDIUM": ("BCD", "bcd"),
    "PROMO": ("Discrete", "discrete"), "STANDARD": ("raw", "raw"), "SMALL": ("Special", "unknown"),
}
_CASE = lambda k: "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{v[k]}'" for t, v in TYPES.items()) + " ELSE 'odd' END"

# Records as the files hold them, without the reader: a(doc, idx, pid, k, s, kind, ...).
A = f"""
a AS (
  SELECT 'A' || CAST(p_partkey // 16 AS VARCHAR) AS doc, p_partkey % 16 + 1 AS idx,
         'adb-' || lpad(CAST(p_partkey % 16 + 1 AS VARCHAR), 4, '0') AS pid, p_partkey AS k, p_size AS s, {_CASE(0)} AS source, {_CASE(1)} AS kind,
         CASE WHEN p_size = 50 THEN 'word beyond the frame' WHEN p_size = 49 THEN 'invalid number' WHEN p_size = 48 THEN 'record is too short' END AS problem,
         'N' || p_partkey || CASE WHEN p_size % 5 = 0 THEN ', "x"' ELSE '' END AS name,
         CASE WHEN {_CASE(1)} = 'bcd' THEN 2 ELSE 1 END AS parts
  FROM part),
loc AS (
  SELECT a.*, n, CASE WHEN s % 4 = 0 THEN [1, 3] ELSE [1 + (w0 - 1) // 64] END AS sfs, CASE WHEN s % 4 = 0 THEN w0 ELSE (w0 - 1) % 64 + 1 END AS word
  FROM a, range(0, 2) r(n), LATERAL (SELECT CASE s % 4 WHEN 0 THEN s + n WHEN 3 THEN 65 + s + n ELSE s + n + 64 * (k % 4) END AS w0)
  WHERE problem IS NULL AND (n = 0 OR parts = 2 OR s % 3 = 0))
"""


def _records(spark, sf_dir) -> DataFrame:
    """(document_id, record_index, fields) of every file."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    names = F.create_map(*[F.lit(x) for t, v in TYPES.items() for x in (t, v[0])])
    source = F.coalesce(F.try_element_at(names, F.col("p_type")), F.lit("odd"))
    bcd, discrete = F.col("p_type") == "MEDIUM", F.col("p_type") == "PROMO"
    pad = lambda a, n: F.concat(a, F.array_repeat(F.lit(""), n - F.size(a)))
    none = F.array().cast("array<string>")
    few = lambda *x: F.array(*[F.lit(v) for v in x])
    values = F.when(bcd & (s % 4 == 0), few("10", "q")).when(bcd, few("1", "10")).when(discrete & (s % 2 == 0), few("0", "1")).when(
        discrete, few("0", "1", "two")).otherwise(none)
    labels = F.when(discrete & (s % 2 == 0), F.array(F.concat(F.lit("OFF "), text(k)), F.lit("ON"))).when(discrete, few("A", "B", 'C, "c"')).otherwise(none)
    two = bcd | (s % 3 == 0)
    word = lambda n: text(F.when(s == 50, 400).when(s % 4 == 0, s + n).when(s % 4 == 3, 65 + s + n).otherwise(s + n + 64 * (k % 4)))
    selector = F.when(s % 4 == 0, "13").when(s % 4 == 1, "1234").when(s % 4 == 3, "24").otherwise("")
    place = lambda n: F.array(selector, word(n), F.lit("1"), text(F.lit(8 + n)), F.lit(""))
    places = F.when(two, F.concat(place(0), place(1))).otherwise(place(0))
    head = F.array(
        F.concat(F.lit("N"), text(k), F.when(s % 5 == 0, ', "x"').otherwise("")), F.lit("é"), source, F.when(s % 2 == 0, "kg").otherwise(""),
        F.concat(F.lit("-"), text(s)), F.concat(text(s), F.lit(".5")), F.when(s == 49, "bad").when(s % 7 == 0, "").otherwise(F.concat(text(s), F.lit("e-2"))),
        F.when(s % 2 == 0, text(s)).otherwise(""), F.when(s % 3 == 0, "2").otherwise(""), F.lit("-"),
    )
    samples = F.when(~bcd & (s % 3 == 0), "2").otherwise(F.when(s % 6 == 1, "3").otherwise("1"))
    record = F.concat(head, pad(values, 32), pad(labels, 32), F.array(samples, F.when(bcd, "2").otherwise("1")), pad(places, 160), few("", ""))
    doc = F.concat(F.lit("A"), F.expr("p_partkey div 16").cast("string"))
    rows = bridge.table(spark, sf_dir, "part").select(
        doc.alias("document_id"), (k % 16 + 1).cast("int").alias("record_index"), F.when(s == 48, F.slice(record, 1, 20)).otherwise(record).alias("fields"))
    setting = few(*"Setting,7,64,1,12,256,u,583,1464,2631,3512,more".split(","))
    return rows.unionByName(rows.select("document_id").distinct().select("document_id", F.lit(0).alias("record_index"), setting.alias("fields")))


def _read(spark, sf_dir) -> DataFrame:
    """The files' bytes through the CSV reader.  A lost record index is the reader's: files without all sixteen parts close up."""
    return adb_files.records_of(adb_files.contents(_records(spark, sf_dir)))


# The reader numbers the records it finds; a last file may hold fewer parts than sixteen.
NUM = A + """,
num AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc ORDER BY idx) AS idx) FROM a),
b AS (SELECT * REPLACE ('adb-' || lpad(CAST(idx AS VARCHAR), 4, '0') AS pid) FROM num),
lc AS (SELECT l.* REPLACE (b.pid AS pid, b.idx AS idx) FROM loc l JOIN b ON b.k = l.k)
"""


@query(
    "adb_records",
    f"""WITH {NUM} SELECT doc AS document_id, idx::BIGINT AS record_index, CASE WHEN s = 48 THEN 20 ELSE 238 END::BIGINT AS fields, name FROM b
    UNION ALL SELECT DISTINCT doc, 0, 12, 'Setting' FROM b""",
)
def adb_records(spark, sf_dir):
    """Every record of every file, quoted fields included (SRC-06)."""
    return _read(spark, sf_dir).select(
        "document_id", F.col("record_index").cast("bigint").alias("record_index"), F.size("fields").cast("bigint").alias("fields"),
        F.get("fields", F.lit(0)).alias("name"))


@query(
    "adb_parameters",
    f"""WITH {NUM} SELECT doc AS document_id, idx::BIGINT AS param_ord, pid AS param_id, name AS mnemonic, 'é' AS description, source AS source_type, kind AS ptype,
      CASE WHEN s % 2 = 0 THEN 'kg' END AS unit, -s::DOUBLE AS minimum, s + 0.5::DOUBLE AS maximum,
      CASE WHEN s % 7 = 0 THEN 1.0::DOUBLE ELSE CAST(s || 'e-2' AS DOUBLE) END AS resolution, CASE WHEN s % 2 = 0 THEN s ELSE 0 END::DOUBLE AS "offset",
      CASE WHEN s % 3 = 0 THEN 2 END::BIGINT AS decimals,
      CASE WHEN kind = 'discrete' THEN CASE WHEN s % 2 = 0 THEN 'ON' ELSE 'B' END END AS true_state,
      CASE WHEN kind = 'discrete' THEN CASE WHEN s % 2 = 0 THEN 'OFF ' || k ELSE 'A' END END AS false_state
    FROM b WHERE problem IS NULL""",
)
def adb_parameters(spark, sf_dir):
    """Records to parameters (MAP-01)."""
    p = adb.parameters(adb.parsed(materialize(_read(spark, sf_dir))))
    return p.select(
        "document_id", F.col("param_ord").cast("bigint").alias("param_ord"), "param_id", "mnemonic", "description", "source_type", "ptype", "unit", "minimum",
        "maximum", "resolution", "offset", F.col("decimals").cast("bigint").alias("decimals"), "true_state", "false_state")


@query(
    "adb_states",
    f"""WITH {NUM} SELECT doc AS document_id, pid AS param_id, v.value::BIGINT AS value, v.label
    FROM b, (VALUES (0, 'A'), (1, 'B'), (2, 'C, "c"')) v(value, label) WHERE problem IS NULL AND kind = 'discrete' AND s % 2 = 1""",
)
def adb_states(spark, sf_dir):
    """State tables of more than two states; a slot without a number counts as its own (MAP-02)."""
    p = adb.parameters(adb.parsed(materialize(_read(spark, sf_dir))))
    return p.select("document_id", "param_id", F.inline("states")).select("document_id", "param_id", "value", "label")


@query(
    "adb_locations_fold",
    f"""WITH {NUM}, part_of AS (
      SELECT *, CASE WHEN parts = 2 THEN 0 ELSE n END AS sample, CASE WHEN parts = 2 THEN n ELSE 0 END AS part FROM lc)
    SELECT doc AS document_id, pid AS param_id, (sample + 1)::BIGINT AS occ, (parts - part)::BIGINT AS seq,
           array_to_string(sfs, ',') AS subframes, word::BIGINT AS word, 1::BIGINT AS lsb, (8 + n)::BIGINT AS msb,
           CASE WHEN parts = 2 AND s % 4 <> 0 THEN CASE WHEN part = 0 THEN 1.0::DOUBLE ELSE 10.0::DOUBLE END END AS bcd_weight
    FROM part_of""",
)
def adb_locations_fold(spark, sf_dir):
    """Locations to occurrences and segments (MAP-03, MAP-04, SET-02, SCL-05)."""
    seg = adb.segments(adb.parsed(materialize(_read(spark, sf_dir))))
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return seg.select(
        "document_id", "param_id", big("occ"), big("seq"), F.array_join(F.col("subframes").cast("array<string>"), ",").alias("subframes"), big("word"),
        big("lsb"), big("msb"), "bcd_weight")


@query(
    "adb_warnings",
    f"""WITH {NUM}, g AS (SELECT * FROM b WHERE problem IS NULL)
    SELECT doc AS document_id, pid AS param_id, 'state slot 3: slot index used' AS warning FROM g WHERE kind = 'discrete' AND s % 2 = 1
    UNION ALL SELECT doc, pid, 'BCD digit weight slot 2 ignored' FROM g WHERE kind = 'bcd' AND s % 4 = 0
    UNION ALL SELECT doc, pid, 'BCD digit weights ignored' FROM g WHERE kind = 'bcd' AND s % 4 = 0
    UNION ALL SELECT doc, pid, 'location ' || (n + 1) || ': subframe selector ignored' FROM lc WHERE s % 4 = 3
    UNION ALL SELECT doc, pid, 'sample count does not match the locations' FROM g WHERE s % 3 <> 0 AND s % 6 = 1""",
)
def adb_warnings(spark, sf_dir):
    """What the reader guessed or ignored (MAP-05)."""
    return adb.warnings(adb.parsed(materialize(_read(spark, sf_dir))))


@query(
    "adb_rejects",
    f"""WITH {NUM} SELECT doc AS document_id, idx::BIGINT AS record_index, problem FROM b WHERE problem IS NOT NULL""",
)
def adb_rejects(spark, sf_dir):
    return adb.rejects(adb.parsed(materialize(_read(spark, sf_dir)))).select("document_id", F.col("record_index").cast("bigint").alias("record_index"), "problem")


@query(
    "adb_settings",
    f"""WITH {NUM} SELECT DISTINCT doc AS document_id, 64::BIGINT AS wps, '583,1464,2631,3512' AS sync, v.position::BIGINT AS position, v.value
    FROM b, (VALUES (1, '7'), (3, '1'), (6, 'u'), (11, 'more')) v(position, value)""",
)
def adb_settings(spark, sf_dir):
    """Settings with the fields of unknown meaning kept (MAP-05, MAP-07)."""
    docs = materialize(adb.documents(_read(spark, sf_dir)))
    legacy = adb.legacy_settings(docs)
    return docs.join(legacy, "document_id").select(
        "document_id", F.col("wps").cast("bigint").alias("wps"), F.array_join(F.col("sync_words").cast("array<string>"), ",").alias("sync"),
        F.col("position").cast("bigint").alias("position"), "value")



@query(
    "adb_roundtrip",
    f"""WITH {NUM}, g AS (SELECT * FROM b WHERE problem IS NULL), c AS (SELECT doc, count(*) AS n FROM lc GROUP BY doc)
    SELECT g.doc AS document_id, count(*)::BIGINT AS parameters, any_value(c.n)::BIGINT AS segments, 0::BIGINT AS changed FROM g JOIN c ON c.doc = g.doc GROUP BY g.doc""",
)
def adb_roundtrip(spark, sf_dir):
    """Files written from the model alone and read again: the same parameters and segments (MAP-06, SNK-04)."""
    records = materialize(_read(spark, sf_dir))
    first = adb.parsed(records)
    docs, pars, segs = adb.documents(records).drop("problem"), materialize(adb.parameters(first)), materialize(adb.segments(first))
    again = adb.parsed(materialize(adb_files.records_of(adb_files.contents(adb.export(docs, pars, segs)))))
    # the writer numbers records anew where some were rejected, spells types its own way and states the decimals it shows
    place = lambda p: p.select("document_id", "mnemonic", "param_id")
    old, new = adb.parameters(again), place(adb.parameters(again)).withColumnRenamed("param_id", "new_id")
    told = ("param_ord", "param_id", "source_type", "decimals")
    par_changes = pars.drop(*told).exceptAll(old.drop(*told)).select("document_id")
    ids = place(pars).join(new, ["document_id", "mnemonic"]).select("document_id", F.col("new_id").alias("param_id"), F.col("param_id").alias("old_id"))
    back = adb.segments(again).join(ids, ["document_id", "param_id"]).drop("param_id").withColumnRenamed("old_id", "param_id").select(*segs.columns)
    changes = par_changes.unionByName(segs.exceptAll(back).select("document_id")).groupBy("document_id").agg(F.count("*").alias("changed"))
    counts = pars.groupBy("document_id").agg(F.count("*").alias("parameters")).join(segs.groupBy("document_id").agg(F.count("*").alias("segments")), "document_id")
    return counts.join(changes, "document_id", "left").select("document_id", "parameters", "segments", F.coalesce("changed", F.lit(0).cast("bigint")).alias("changed"))
