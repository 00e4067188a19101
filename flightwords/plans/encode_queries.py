"""Encoding of a scenario made of events, and its closed-loop report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode as dec
from ..operators import encode
from ..schemas import SYNC_WORDS
from . import bridge
from .decode_queries import long, prepared
from .registry import query
from .sqltext import cells_sql

# Two events share a frame; the event type picks the parameter.
SCN = """
scn AS (
  SELECT CAST(event_id // 1024 AS VARCHAR) AS rec, event_id // 2 AS fi, event_id AS ord,
         CASE event_type WHEN 'view' THEN 'S10' WHEN 'click' THEN 'U12' WHEN 'purchase' THEN 'W3' WHEN 'signup' THEN 'D1'
              ELSE CASE WHEN value < 5 THEN 'NOWHERE' ELSE 'S21' END END AS pid,
         CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN value * 100 ELSE value END AS value,
         CASE WHEN event_type = 'signup' THEN CASE WHEN value > 20 THEN ' open' ELSE 'Shut' END END AS label
  FROM events),
dict AS (SELECT rec, fi, pid, min(ord) AS ord, arg_max(struct_pack(v := value, l := label), ord) AS s FROM scn GROUP BY ALL),
raw AS (
  SELECT rec, fi, pid, ord, s.v AS value, s.l AS label,
         CASE pid WHEN 'S10' THEN round_even(s.v / 0.3::DOUBLE, 0) WHEN 'U12' THEN round_even(s.v / 0.25::DOUBLE, 0)
              WHEN 'S21' THEN round_even(s.v / 0.5::DOUBLE, 0) WHEN 'W3' THEN round_even(s.v, 0)
              WHEN 'D1' THEN CASE WHEN s.l = ' open' THEN 1 ELSE 0 END END::BIGINT AS r
  FROM dict),
pat AS (
  SELECT *, CASE pid WHEN 'S10' THEN CASE WHEN r <= 511 THEN r END WHEN 'U12' THEN CASE WHEN r <= 4095 THEN r END
                     WHEN 'S21' THEN CASE WHEN r <= 1048575 THEN r END WHEN 'D1' THEN r
                     WHEN 'W3' THEN CASE WHEN r < 1000 THEN (r // 100) * 256 + (r // 10 % 10) * 16 + r % 10 END END AS pattern
  FROM raw)
"""


def scenario(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    pid = (
        F.when(kind == "view", "S10").when(kind == "click", "U12").when(kind == "purchase", "W3").when(kind == "signup", "D1")
        .when(F.col("value") < 5, "NOWHERE").otherwise("S21")
    )
    entries = e.select(
        F.expr("event_id div 1024").cast("string").alias("recording_id"), F.expr("event_id div 2").alias("frame_index"),
        F.col("event_id").alias("ord"), pid.alias("param_id"),
        F.when(kind == "error", F.col("value") * 100).when(kind != "signup", F.col("value")).alias("value"),
        F.when(kind == "signup", F.when(F.col("value") > 20, " open").otherwise("Shut")).alias("label"),
    )
    return encode.dictionary(entries)


def _encoded(spark, sf_dir):
    _, pars, segs = bridge.literal_mapping(spark)
    scn = scenario(spark, sf_dir)
    return scn, encode.patterns(scn, pars, segs, bridge.DOCUMENT_ID), pars, segs


@query(
    "encode_patterns",
    f"""WITH {SCN} SELECT p.rec AS recording_id, p.fi AS frame_index, p.pid AS param_id, o.occ::BIGINT AS occ, p.pattern,
      CASE WHEN p.pattern IS NULL THEN 'ENCODE_ERROR' ELSE 'ENCODED' END AS status
    FROM pat p JOIN (VALUES ('S10', 1), ('S10', 2), ('U12', 1), ('S21', 1), ('D1', 1), ('W3', 1), ('NOWHERE', NULL)) o(pid, occ) ON o.pid = p.pid""",
)
def encode_patterns(spark, sf_dir):
    """Bit pattern per scenario value and occurrence (ENC-02, ENC-03)."""
    _, enc, _, _ = _encoded(spark, sf_dir)
    return enc.select("recording_id", "frame_index", "param_id", long("occ"), "pattern", "status")


@query(
    "encode_words",
    f"""WITH {SCN}, cell(pid, sfs, word, lo_, width, shift) AS ({cells_sql('S10', 'U12', 'S21', 'D1', 'W3')}),
    fr AS (SELECT DISTINCT rec, fi FROM scn),
    wr AS (SELECT p.rec, p.fi, u.sf, c.word, sum(((p.pattern >> c.shift) & ((1 << c.width) - 1)) << (c.lo_ - 1)) AS bits
           FROM pat p JOIN cell c ON c.pid = p.pid, unnest(c.sfs) u(sf) WHERE p.pattern IS NOT NULL GROUP BY ALL)
    SELECT f.rec AS recording_id, f.fi AS frame_index, s.sf::BIGINT AS subframe, w.w::BIGINT AS word,
           CASE WHEN w.w = 1 THEN [583, 1464, 2631, 3512][s.sf] ELSE coalesce(x.bits, 0) END::BIGINT AS word_value
    FROM fr f, range(1, 5) s(sf), range(1, 65) w(w)
    LEFT JOIN wr x ON x.rec = f.rec AND x.fi = f.fi AND x.sf = s.sf AND x.word = w.w
    WHERE w.w = 1 OR coalesce(x.bits, 0) <> 0""",
)
def encode_words(spark, sf_dir):
    """Every non-zero word of the frames a scenario builds (ENC-04…07)."""
    scn, enc, _, segs = _encoded(spark, sf_dir)
    frames = scn.select("recording_id", "frame_index").distinct()
    base = encode.blank_subframes(frames, bridge.WPS, SYNC_WORDS)
    built = encode.apply_updates(base, encode.word_updates(encode.writes(enc, segs, bridge.DOCUMENT_ID)))
    words = built.select("recording_id", "frame_index", long("subframe"), F.posexplode("words").alias("i", "v"))
    return words.filter("v <> 0").select(
        "recording_id", "frame_index", "subframe", (F.col("i") + 1).cast("bigint").alias("word"), F.col("v").cast("bigint").alias("word_value")
    )


@query(
    "closed_loop",
    f"""WITH {SCN}, k AS (
      SELECT p.rec AS recording_id, p.fi AS frame_index, p.pid AS param_id, p.value, p.label, coalesce(pattern, 0) AS raw_pattern,
        CASE pid WHEN 'S10' THEN (coalesce(pattern, 0)::DOUBLE * 0.3::DOUBLE + 0.0::DOUBLE)
                 WHEN 'U12' THEN coalesce(pattern, 0)::DOUBLE * 0.25::DOUBLE WHEN 'S21' THEN coalesce(pattern, 0)::DOUBLE * 0.5::DOUBLE
                 WHEN 'W3' THEN CASE WHEN pattern IS NULL THEN 0.0::DOUBLE
                   ELSE round(0.0::DOUBLE + (r // 100) * 100.0::DOUBLE + (r // 10 % 10) * 10.0::DOUBLE + (r % 10) * 1.0::DOUBLE, 10) END END AS eng_value,
        CASE WHEN pid = 'D1' THEN CASE WHEN pattern = 1 THEN 'OPEN' ELSE 'SHUT' END END AS eng_label,
        CASE pid WHEN 'S10' THEN 0.3::DOUBLE WHEN 'U12' THEN 0.25::DOUBLE WHEN 'S21' THEN 0.5::DOUBLE WHEN 'W3' THEN 1.0::DOUBLE END / 2 + 1e-9 AS tol
      FROM pat p WHERE pid <> 'NOWHERE')
    SELECT recording_id, frame_index, param_id, raw_pattern, eng_value, eng_label,
           CASE WHEN label IS NULL THEN abs(eng_value - value) <= tol ELSE true END AS passed
    FROM k""",
)
def closed_loop(spark, sf_dir):
    """Encode, decode, compare within quantization (ENC-08)."""
    scn, enc, pars, segs = _encoded(spark, sf_dir)
    frames = scn.select("recording_id", "frame_index").distinct()
    base = encode.blank_subframes(frames, bridge.WPS, SYNC_WORDS)
    built = encode.apply_updates(base, encode.word_updates(encode.writes(enc, segs, bridge.DOCUMENT_ID)))
    rows = built.withColumn("document_id", F.lit(bridge.DOCUMENT_ID)).withColumn("seq", F.col("frame_index")).withColumn(
        "t_end", F.col("frame_index").cast("double")
    )
    plan_rows, profile = prepared(spark)
    report = encode.closed_loop(scn, enc, dec.decode(rows, plan_rows, profile=profile), pars)
    return report.select("recording_id", "frame_index", "param_id", "raw_pattern", "eng_value", "eng_label", "passed")


@query(
    "encode_overflow",
    """SELECT CAST(o_orderkey AS VARCHAR) AS recording_id, p AS param_id,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL
           WHEN p = 'S10' THEN CASE WHEN round_even(x / 0.3::DOUBLE, 0) BETWEEN -512 AND 511
             THEN CAST(round_even(x / 0.3::DOUBLE, 0) AS BIGINT) & 1023 END
           WHEN p = 'R12' THEN CASE WHEN trunc(x) BETWEEN 0 AND 4095 THEN CAST(trunc(x) AS BIGINT) END
           WHEN p = 'B3' THEN CASE WHEN round_even(x, 0) BETWEEN 0 AND 999
             THEN (CAST(round_even(x, 0) AS BIGINT) // 100) * 256 + (CAST(round_even(x, 0) AS BIGINT) // 10 % 10) * 16 + CAST(round_even(x, 0) AS BIGINT) % 10 END
      END AS pattern
    FROM (SELECT o_orderkey, (o_totalprice - 150000) / 500 AS x FROM orders), (VALUES ('S10'), ('B3'), ('R12')) q(p)""",
)
def encode_overflow(spark, sf_dir):
    """Values that fit no field, up to 1e30, are error rows and stop nothing (ENC-02)."""
    _, pars, segs = bridge.literal_mapping(spark)
    o = bridge.table(spark, sf_dir, "orders")
    huge = F.when(F.col("o_orderkey") % 2 == 0, 1e30).otherwise(-1e30)
    scn = o.select(
        F.col("o_orderkey").cast("string").alias("recording_id"), F.lit(0).cast("bigint").alias("frame_index"), F.lit(1).cast("bigint").alias("ord"),
        F.explode(F.array(F.lit("S10"), F.lit("B3"), F.lit("R12"))).alias("param_id"),
        F.when(F.col("o_orderkey") % 3 == 0, huge).otherwise((F.col("o_totalprice") - 150000) / 500).alias("value"), F.lit(None).cast("string").alias("label"),
    )
    enc = encode.patterns(scn, pars, segs, bridge.DOCUMENT_ID).filter("occ = 1")
    return enc.select("recording_id", "param_id", "pattern")
