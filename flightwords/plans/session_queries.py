"""Session files: written, damaged, read, summed up and checked before a replay.

Recordings of number 1 modulo 3 are torn from their 128th second on, those of
number 2 modulo 3 carry a version that no reader knows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SYNC_WORDS
from ..session import checkpoint_dir
from ..sources import sessions
from . import bridge
from .decode_queries import long
from .registry import query
from .sqltext import SUB, word_of

KEPT = f"""{SUB},
kept AS (SELECT * FROM sub WHERE state <> 'MISSING' AND rec::BIGINT % 3 <> 2 AND NOT (rec::BIGINT % 3 = 1 AND seq >= rec::BIGINT * 512 + 128))
"""


def _heads(subs: DataFrame) -> DataFrame:
    r = F.col("recording_id").cast("bigint")
    return subs.select("recording_id").distinct().select(
        "recording_id", F.concat(F.lit("D"), (r % 5).cast("string")).alias("dataframe_name"), F.when(r % 4 == 0, 128).otherwise(64).alias("wps"),
        F.array(*[F.lit(s) for s in SYNC_WORDS]).alias("sync_words"),
    )


def _recorded(spark, sf_dir) -> DataFrame:
    """Lines read back from files."""
    subs = sessions.recordable(bridge.subframes(spark, sf_dir)).filter("state <> 'MISSING'").withColumn("t", F.col("t_end"))
    lines = sessions.session_lines(_heads(subs), subs)
    r, rank, seq = F.col("recording_id").cast("bigint"), F.col("ord").getField("col1"), F.col("ord").getField("col2")
    torn = (r % 3 == 1) & (rank == 1) & (seq >= r * 512 + 128)
    unknown = (r % 3 == 2) & (rank == 0)
    line = F.when(torn, F.substr("line", F.lit(1), F.lit(40))).when(unknown, F.replace("line", F.lit('"version":1'), F.lit('"version":2'))).otherwise(F.col("line"))
    path = os.path.join(checkpoint_dir(spark), f"sessions-{uuid.uuid4().hex}")
    sessions.write_sessions(lines.withColumn("line", line), path)
    return sessions.read_written(spark, path)


@query(
    "session_subframes",
    f"""WITH {KEPT} SELECT rec AS recording_id, fi AS frame_index, sf::BIGINT AS subframe, state, t_end AS t, 64::BIGINT AS n_words, {word_of('64')}::BIGINT AS last_word FROM kept""",
)
def session_subframes(spark, sf_dir):
    """Subframes of readable sessions up to the first torn line (SRC-01, SRC-02, SNK-01, SNK-02)."""
    s = sessions.subframes(sessions.records(_recorded(spark, sf_dir))).filter("problem IS NULL")
    return s.select("recording_id", "frame_index", long("subframe"), "state", "t", F.size("words").cast("bigint").alias("n_words"),
                    F.element_at("words", -1).cast("bigint").alias("last_word"))


@query(
    "session_summary",
    f"""WITH {KEPT} SELECT rec AS recording_id, count(*) AS subframes, 0::BIGINT AS samples, 0::BIGINT AS events, arg_min(t_end, seq) AS first_t, arg_max(t_end, seq) AS last_t,
      arg_max(t_end, seq) - arg_min(t_end, seq) AS duration FROM kept GROUP BY rec""",
)
def session_summary(spark, sf_dir):
    """Totals from the end record, or counted where it can't be reached (SRC-04, AGG-10)."""
    return sessions.summary(sessions.records(_recorded(spark, sf_dir)))


@query(
    "session_guard",
    f"""WITH {SUB}, h AS (SELECT DISTINCT rec, rec::BIGINT AS r FROM sub WHERE state <> 'MISSING')
    SELECT rec AS recording_id, CASE WHEN r % 3 = 2 THEN 'unsupported session version' END AS unreadable,
      CASE WHEN r % 4 = 0 AND r % 5 < 4 THEN 'recorded at another word rate' END AS problem,
      CASE WHEN r % 5 IN (1, 3) THEN 'recorded with another mapping' END AS warning FROM h""",
)
def session_guard(spark, sf_dir):
    """Sessions against the mapping they would be replayed with (JON-08); one mapping in five is missing."""
    heads = sessions.headers(_recorded(spark, sf_dir)).withColumnRenamed("problem", "unreadable").withColumn("document_id", F.col("dataframe_name"))
    docs = spark.range(4).select(
        F.concat(F.lit("D"), F.col("id").cast("string")).alias("document_id"), F.lit(64).alias("wps"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("D"), F.col("id").cast("string"))).otherwise("other").alias("name"))
    return sessions.replay_guard(heads, docs).select(F.col("session").alias("recording_id"), "unreadable", "problem", "warning")
