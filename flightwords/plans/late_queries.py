"""Assembly of late, short and out-of-range subframes.

Whole frames only; every third frame sends its third subframe before its second,
some subframes hold a word beyond 12 bits, some are a word short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assemble
from . import bridge
from .decode_queries import long
from .registry import query
from .sqltext import SUB

LATE_SQL = f"""{SUB},
whole AS (SELECT rec, fi FROM sub GROUP BY ALL HAVING count(*) = 4),
arr AS (
  SELECT s.rec, s.fi, s.sf, CASE WHEN s.fi % 3 = 0 THEN [1, 3, 2, 4][s.sf] ELSE s.sf END AS place,
         s.fi % 3 = 0 AS swapped, s.state = 'INVALID' OR s.c % 10 = 0 OR s.c % 13 = 0 AS bad
  FROM sub s JOIN whole w ON w.rec = s.rec AND w.fi = s.fi),
named AS (SELECT *, CASE WHEN bad THEN 'INVALID' WHEN swapped AND sf = 2 THEN 'LATE' ELSE 'RECEIVED' END AS st FROM arr),
slots AS (
  SELECT a.rec, a.fi, a.sf, a.place, a.st,
         string_agg(CASE WHEN b.place <= a.place THEN b.st WHEN b.sf = 2 AND a.place = 2 AND a.swapped THEN 'MISSING' ELSE 'PENDING' END, ',' ORDER BY b.sf) AS slots
  FROM named a JOIN named b ON b.rec = a.rec AND b.fi = a.fi GROUP BY ALL)
"""


def _late(spark, sf_dir) -> DataFrame:
    s = bridge.subframe_headers(spark, sf_dir).withColumn("words", F.array(*bridge.word_values(F.col("c"), F.col("subframe"))))
    whole = s.groupBy("recording_id", "frame_index").count().filter("count = 4").drop("count")
    s = s.join(whole, ["recording_id", "frame_index"], "left_semi")
    place = F.when(F.col("frame_index") % 3 == 0, F.get(F.array(*[F.lit(x) for x in (1, 3, 2, 4)]), F.col("subframe") - 1)).otherwise(F.col("subframe"))
    beyond = F.concat(F.array(F.lit(4096)), F.slice("words", 2, bridge.WPS))
    words = F.when(F.col("c") % 10 == 0, beyond).when(F.col("c") % 13 == 0, F.slice("words", 1, bridge.WPS - 1)).otherwise(F.col("words"))
    s = s.withColumn("seq", F.col("frame_index") * 4 + place).withColumn("words", words).drop("c")
    return s


def _arrivals(spark, sf_dir) -> DataFrame:
    return assemble.arrivals(assemble.headers(_late(spark, sf_dir), bridge.WPS, "frame_index"))


@query(
    "assemble_late",
    f"WITH {LATE_SQL} SELECT rec AS recording_id, fi AS frame_index, sf::BIGINT AS subframe, st AS state, slots, place = 4 AS done FROM slots",
)
def assemble_late(spark, sf_dir):
    """Arrivals in the order they came: late ones, words out of range, wrong lengths (STR-04, STR-05, DEC-19)."""
    a = _arrivals(spark, sf_dir)
    return a.select("recording_id", "frame_index", long("subframe"), "state", F.array_join("slot_states", ",").alias("slots"), F.col("frame_completed").alias("done"))


@query(
    "assembler_late_stats",
    f"""WITH {LATE_SQL} SELECT rec AS recording_id, count(*) AS subframes, count(*) FILTER (place = 4) AS frames, 0::BIGINT AS missing_subframes,
      count(*) FILTER (bad) AS invalid_subframes, count(*) FILTER (swapped AND sf = 2) AS out_of_order, 0::BIGINT AS incomplete_frames FROM named GROUP BY rec""",
)
def assembler_late_stats(spark, sf_dir):
    """Counters with arrivals out of order (AGG-04)."""
    return assemble.stats(_arrivals(spark, sf_dir))


@query(
    "invalid_cells",
    f"""WITH {SUB} SELECT rec AS recording_id, seq, sf::BIGINT AS subframe, w::BIGINT AS word FROM sub, (VALUES (1), (7)) v(w) WHERE c % 10 = 0 AND (w = 1 OR c % 3 = 0)""",
)
def invalid_cells(spark, sf_dir):
    """Every word beyond 12 bits, by its cell; the kept words are masked and of full length (STR-05)."""
    h = bridge.subframe_headers(spark, sf_dir)
    w = bridge.word_values(F.col("c"), F.col("subframe"))
    bad = F.col("c") % 10 == 0
    words = F.array(F.when(bad, 5000).otherwise(w[0]), *w[1:6], F.when(bad & (F.col("c") % 3 == 0), -1).otherwise(w[6]), *w[7:])
    s = h.withColumn("words", words)
    kept = s.select("recording_id", "seq", assemble.invalid_cells().alias("cells"), assemble.fixed_words(s, bridge.WPS).alias("fixed"))
    clean = (F.size("fixed") == bridge.WPS) & F.forall("fixed", lambda x: x.between(0, 4095))
    return kept.filter(clean).select("recording_id", "seq", F.inline("cells")).select("recording_id", "seq", long("subframe"), long("word"))
