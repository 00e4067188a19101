"""Recorded sessions: JSON Lines in, JSON Lines out.

Files are read as splittable text; the order of lines comes from the file name,
the split offset and the position inside the split, so one huge session is read
by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import hex_to_words, words_to_hex
from ..session import materialize

# The session file format.
FORMAT, VERSION = "arinc717-session", 1
HEADER = (
    "format STRING, version INT, created DOUBLE, dataframe_name STRING, dataframe_source STRING, dataframe_hash STRING, "
    "wps INT, sync_words ARRAY<INT>, source_type STRING, port STRING, baudrate INT, protocol_mode STRING, notes STRING"
)
RECORD = (
    "kind STRING, t DOUBLE, frame BIGINT, sf INT, state STRING, words STRING, id STRING, name STRING, occ INT, raw BIGINT, "
    "`dec` DOUBLE, eng STRING, unit STRING, status STRING, event STRING, message STRING, subframes BIGINT, samples BIGINT, "
    "events BIGINT, first_t DOUBLE, last_t DOUBLE, _bad STRING"
)


def read_lines(spark: SparkSession, path: str, key: Column | None = None) -> DataFrame:
    """(session, at, line): non-blank lines with a sortable position.

    A session is a file, or with ``key`` whatever names it (a partition column
    of a folder of part files).
    """
    raw = spark.read.text(path)
    at = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    name = key if key is not None else F.col("_metadata.file_path")
    return raw.select(name.cast("string").alias("session"), at.alias("at"), F.trim("value").alias("line")).filter("line <> ''")


def headers(lines: DataFrame) -> DataFrame:
    """First line of every session, parsed, with ``problem`` set where it is not a
    session header."""
    first = lines.groupBy("session").agg(F.min("at").alias("at"), F.min_by("line", "at").alias("line"))
    h = first.withColumn("h", F.from_json("line", HEADER))
    problem = (
        F.when(F.col("h.format").isNull() | (F.col("h.format") != FORMAT), "not a session file")
        .when(F.coalesce(F.col("h.version") != VERSION, F.lit(True)), "unsupported session version")
    )
    return h.select("session", "at", "h.*", problem.alias("problem"))


def records(lines: DataFrame) -> DataFrame:
    """Records of readable sessions up to the first unparseable line (SRC-01)."""
    good = headers(lines).filter("problem IS NULL").select("session", F.col("at").alias("_head"))
    body = lines.join(good, "session").filter(F.col("at") > F.col("_head")).drop("_head")
    parsed = body.withColumn("r", F.from_json("line", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    torn = F.col("r").isNull() | F.col("r._bad").isNotNull()
    ends = parsed.filter(torn).groupBy("session").agg(F.min("at").alias("_end"))
    kept = parsed.join(ends, "session", "left").filter(F.col("_end").isNull() | (F.col("at") < F.col("_end")))
    return kept.select("session", "at", "r.*").drop("_bad")


def of_kind(recs: DataFrame, kind: str) -> DataFrame:
    return recs.filter(F.col("kind") == kind)


def subframes(recs: DataFrame) -> DataFrame:
    """Subframe records (SRC-02); ``words`` is NULL and ``problem`` set for a bad word string."""
    s = of_kind(recs, "subframe").withColumn("_w", hex_to_words(F.col("words")))
    words = F.col("_w")
    return s.select(
        F.col("session").alias("recording_id"), "at", "t", F.col("frame").alias("frame_index"), F.col("sf").alias("subframe"),
        F.coalesce("state", F.lit("RECEIVED")).alias("state"), words.alias("words"),
        F.when(words.isNull(), "unreadable word string").alias("problem"),
    )


def samples(recs: DataFrame) -> DataFrame:
    """Sample records with their defaults (SRC-03)."""
    number = F.col("eng").try_cast("double")
    return of_kind(recs, "sample").select(
        F.col("session").alias("recording_id"), "at", F.col("id").alias("param_id"), F.coalesce("name", "id").alias("param_name"),
        "t", F.coalesce("frame", F.lit(0)).alias("frame_index"), F.coalesce("sf", F.lit(0)).alias("subframe"),
        F.coalesce("occ", F.lit(1)).alias("occ"), F.col("raw").alias("raw_integer"), F.col("dec").alias("decoded"),
        number.alias("eng_value"), F.when(number.isNull(), F.col("eng")).alias("eng_label"), "unit",
        F.coalesce("status", F.lit("VALID")).alias("status"),
    )


def events(recs: DataFrame) -> DataFrame:
    return of_kind(recs, "event").select(F.col("session").alias("recording_id"), "at", "t", F.col("event").alias("kind"), "message")


def summary(recs: DataFrame) -> DataFrame:
    """Totals of each session: from its end record, else counted (SRC-04, AGG-10)."""
    kind = F.col("kind")
    stamped = F.col("t").isNotNull()
    counted = recs.groupBy("session").agg(
        F.count_if(kind == "subframe").alias("subframes"), F.count_if(kind == "sample").alias("samples"),
        F.count_if(kind == "event").alias("events"),
        F.min_by(F.when(stamped, F.col("t")), F.when(stamped, F.col("at"))).alias("first_t"),
        F.max_by(F.when(stamped, F.col("t")), F.when(stamped, F.col("at"))).alias("last_t"),
        F.min_by(F.when(kind == "end", F.struct("subframes", "samples", "events", "first_t", "last_t")),
                 F.when(kind == "end", F.col("at"))).alias("end"),
    )
    pick = [F.when(F.col("end").isNotNull(), F.col(f"end.{c}")).otherwise(F.col(c)).alias(c)
            for c in ("subframes", "samples", "events", "first_t", "last_t")]
    return counted.select(F.col("session").alias("recording_id"), *pick).withColumn("duration", F.col("last_t") - F.col("first_t"))


def recordable(arrivals: DataFrame) -> DataFrame:
    """Closing rows are not recorded (SNK-02)."""
    return arrivals.filter(F.col("subframe") != 0)


def _json(*cols) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def session_lines(heads: DataFrame, subs: DataFrame, smp: DataFrame | None = None, evs: DataFrame | None = None) -> DataFrame:
    """Lines of session files (SNK-01): (recording_id, ord, line).

    ``heads`` has recording_id and the header columns; records carry ``seq``.
    """
    names = [c.split()[0] for c in HEADER.split(", ") if c.split()[0] not in ("format", "version")]
    have = [F.col(c) if c in heads.columns else F.lit(None).alias(c) for c in names]
    head = heads.select("recording_id", F.struct(F.lit(0), F.lit(0).cast("bigint"), F.lit(0), F.lit(0), F.lit(0)).alias("ord"),
                        F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), *have)).alias("line"))

    def order(rank: int, a="0", b="0") -> Column:
        return F.struct(F.lit(1), F.col("seq").cast("bigint"), F.lit(rank), F.expr(a).cast("int"), F.expr(b).cast("int"))

    parts = [subs.select("recording_id", order(0).alias("ord"), "t", F.lit("subframe").alias("what"), _json(
        F.lit("subframe").alias("kind"), "t", F.col("frame_index").alias("frame"), F.col("subframe").alias("sf"), "state",
        words_to_hex(F.col("words")).alias("words"),
    ).alias("line"))]
    if smp is not None:
        value = F.when(F.col("eng_value").isNotNull(), F.to_json(F.struct(F.col("eng_value").alias("eng")))).otherwise(
            F.to_json(F.struct(F.col("eng_label").alias("eng")), {"ignoreNullFields": "false"})
        )
        flat = _json(
            F.lit("sample").alias("kind"), "t", F.col("param_id").alias("id"), F.col("param_name").alias("name"),
            F.col("frame_index").alias("frame"), F.coalesce("subframe", F.lit(0)).alias("sf"), "occ",
            F.col("raw_integer").alias("raw"), F.col("decoded").alias("dec"), "unit", "status",
        )
        line = F.concat(F.regexp_replace(flat, r"\}$", ","), F.regexp_replace(value, r"^\{", ""))
        parts.append(smp.select("recording_id", order(1, "param_ord", "occ").alias("ord"), "t", F.lit("sample").alias("what"), line.alias("line")))
    if evs is not None:
        parts.append(evs.select("recording_id", order(2).alias("ord"), "t", F.lit("event").alias("what"), _json(
            F.lit("event").alias("kind"), "t", F.col("kind").alias("event"), "message").alias("line")))
    body = parts[0]
    for p in parts[1:]:
        body = body.unionByName(p)
    totals = body.groupBy("recording_id").agg(
        *[F.count_if(F.col("what") == k).alias(f"{k}s") for k in ("subframe", "sample", "event")],
        F.min_by("t", "ord").alias("first_t"), F.max_by("t", "ord").alias("last_t"),
    )
    end = totals.select("recording_id", F.struct(F.lit(2), F.lit(0).cast("bigint"), F.lit(0), F.lit(0), F.lit(0)).alias("ord"),
                        _json(F.lit("end").alias("kind"), "subframes", "samples", "events", "first_t", "last_t").alias("line"))
    return head.unionByName(body.select("recording_id", "ord", "line")).unionByName(end)


def write_sessions(lines: DataFrame, path: str, files: int | None = None) -> None:
    """One folder per recording; its part files in name order are the session.

    Ranges of (recording, position) are written in parallel, so a long session
    becomes several part files instead of one task.
    """
    n = files or max(2, lines.sparkSession.sparkContext.defaultParallelism)
    (
        materialize(lines).repartitionByRange(n, "recording_id", "ord").sortWithinPartitions("recording_id", "ord")
        .select("recording_id", F.col("line").alias("value")).write.partitionBy("recording_id").text(path)
    )


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Lines of sessions written by ``write_sessions``."""
    return read_lines(spark, path, F.col("recording_id"))


def replay_guard(heads: DataFrame, documents: DataFrame) -> DataFrame:
    """Sessions against the document they are replayed with (JON-08).

    ``heads`` carries document_id; ``problem`` rejects, ``warning`` only informs.
    """
    d = documents.select("document_id", F.col("wps").alias("doc_wps"), F.col("name").alias("doc_name"))
    j = heads.join(d, "document_id", "left")
    return j.withColumn(
        "problem", F.when(F.col("doc_wps").isNotNull() & (F.col("doc_wps") != F.col("wps")), "recorded at another word rate")
    ).withColumn(
        "warning",
        F.when((F.coalesce("dataframe_name", F.lit("")) != "") & (F.col("dataframe_name") != F.col("doc_name")), "recorded with another mapping"),
    )
