"""Documents, frames and samples written out and read again; number and type texts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import cells, numbers, types
from ..operators import pages
from ..session import checkpoint_dir
from ..sources import frames, sessions
from . import bridge
from .decode_queries import long
from .fleet_queries import _FLEET, fleet_mapping
from .registry import query
from .session_queries import _heads
from .sqltext import SUB, word_of


def _plain(x: str) -> str:
    """Decimal spelling of a number of few decimals."""
    return f"regexp_replace(printf('%.4f', {x}), '\\.?0+$', '')"


_ROWS = f"""{_FLEET},
one AS (SELECT pid, list(word ORDER BY seq) AS words, list(greatest(lsb, msb) ORDER BY seq) AS high, list(least(lsb, msb) ORDER BY seq) AS low FROM seg GROUP BY pid),
doc_rows AS (SELECT p.*, words, high, low, len(words) = 1 OR (high[1] = high[2] AND low[1] = low[2]) AS same, array_to_string(own, ',') AS sfs FROM ppar p JOIN one USING (pid))"""


@query(
    "document_rows",
    f"""WITH {_ROWS} SELECT doc AS document_id, ord AS param_ord, name AS parameter_name, '0.5' AS frequency, array_to_string(words, ', ') AS word_location, sfs AS subframe,
      CASE WHEN same THEN high[1]::VARCHAR ELSE array_to_string(high, '/') END AS msb, CASE WHEN same THEN low[1]::VARCHAR ELSE array_to_string(low, '/') END AS lsb,
      {_plain('res')} AS resolution, {_plain('off_')} AS "offset", {_plain('lo')} AS minimum, {_plain('hi')} AS maximum FROM doc_rows""",
)
def document_rows(spark, sf_dir):
    """Every document as rows with rates and bit columns (SNK-06)."""
    _, parameters, segments = fleet_mapping(spark, sf_dir)
    rows, _ = pages.document_rows(parameters, segments)
    return rows.select("document_id", long("param_ord"), "parameter_name", "frequency", "word_location", "subframe", "msb", "lsb", "resolution", "offset", "minimum", "maximum")


@query(
    "document_rows_interval",
    f"""WITH {_ROWS} SELECT doc AS document_id, ord AS param_ord, name || chr(10) || descr AS mnemonic_and_name, '2' AS frequency, array_to_string(words, '-') AS word_location, sfs AS subframe,
      CASE WHEN len(words) = 2 THEN high[1] || '-' || low[1] ELSE high[1]::VARCHAR END AS msb, CASE WHEN len(words) = 2 THEN high[2] || '-' || low[2] ELSE low[1]::VARCHAR END AS lsb,
      CASE WHEN off_ <> 0 THEN {_plain('off_')} || ', ' ELSE '' END || {_plain('res')} AS resolution FROM doc_rows""",
)
def document_rows_interval(spark, sf_dir):
    """Every document as rows with sample intervals and word pairs (SNK-06)."""
    _, parameters, segments = fleet_mapping(spark, sf_dir)
    rows, _ = pages.document_rows(parameters, segments, "interval")
    return rows.select("document_id", long("param_ord"), "mnemonic_and_name", "frequency", "word_location", "subframe", "msb", "lsb", "resolution")


@query(
    "document_rows_refused",
    f"""WITH {_FLEET} SELECT doc AS document_id, pid AS param_id, 'no usable mapping' AS problem FROM ppar WHERE p_size = 3""",
)
def document_rows_refused(spark, sf_dir):
    """Parameters that no row can say (SNK-06)."""
    _, parameters, segments = fleet_mapping(spark, sf_dir)
    return pages.document_rows(parameters, segments)[1]


_FRAME = f"""{SUB}, sfj AS (SELECT fi, rec, sf, '[' || array_to_string(list_transform(range(1, 65), lambda w: {word_of('w')}), ',') || ']' AS j FROM sub),
fj AS (SELECT rec, fi, count(*) AS n, string_agg(j, ',' ORDER BY sf) AS body FROM sfj GROUP BY rec, fi HAVING count(*) = 4)"""


@query(
    "frame_documents",
    f"""WITH {_FRAME} SELECT rec AS recording_id, fi AS frame_index,
      md5('{{"format":"arinc717-frame","version":1,"wps":64,"frame_index":' || fi || ',"subframes":[' || body || ']}}') AS value FROM fj""",
)
def frame_documents(spark, sf_dir):
    """Every complete frame as a frame document (SNK-03)."""
    return frames.frame_json(bridge.subframes(spark, sf_dir)).select("recording_id", "frame_index", F.md5("value").alias("value"))


def _damaged(spark, sf_dir):
    """Frame documents, of which some lost a subframe, hold a word too large, are cut or name another format."""
    k = F.col("frame_index") % 10
    text = frames.frame_json(bridge.subframes(spark, sf_dir)).withColumn("file", F.col("frame_index").cast("string"))
    value = (
        F.when(k == 1, F.replace("value", F.lit('"subframes":[['), F.lit('"subframes":[[9,'))).when(k == 2, F.replace("value", F.lit("[[583,"), F.lit("[[4096,")))
        .when(k == 3, F.substr("value", F.lit(1), F.lit(300))).when(k == 4, F.replace("value", F.lit("717-frame"), F.lit("717-other"))).otherwise(F.col("value"))
    )
    return frames.parse_frames(text.select("file", value.alias("value")))


@query(
    "frame_documents_read",
    f"""WITH {_FRAME} SELECT s.fi AS frame_index, s.sf::BIGINT AS subframe, {word_of('64', 's.c', 's.sf')}::BIGINT AS last_word
    FROM sub s JOIN fj ON fj.rec = s.rec AND fj.fi = s.fi WHERE s.fi % 10 NOT IN (1, 2, 3, 4)""",
)
def frame_documents_read(spark, sf_dir):
    """Subframes of the frame documents that are whole (SRC-05)."""
    return _damaged(spark, sf_dir)[0].select("frame_index", long("subframe"), F.element_at("words", -1).cast("bigint").alias("last_word"))


@query(
    "frame_documents_refused",
    f"""WITH {_FRAME} SELECT fi::VARCHAR AS file, CASE fi % 10 WHEN 1 THEN 'wrong number of words' WHEN 2 THEN 'word outside 0..4095' ELSE 'not a frame file' END AS problem
    FROM fj WHERE fi % 10 IN (1, 2, 3, 4)""",
)
def frame_documents_refused(spark, sf_dir):
    """Frame documents that are refused, with the reason (SRC-05)."""
    return _damaged(spark, sf_dir)[1].select("file", "problem")


# -- sessions with samples and events -------------------------------------------

def _sampled(spark, sf_dir):
    """Records of sessions in which every subframe brought a sample and every fourth an event."""
    subs = bridge.subframes(spark, sf_dir).filter("state <> 'MISSING'").withColumn("t", F.col("t_end"))
    k = F.col("seq")
    smp = subs.select(
        "recording_id", "seq", "t", F.concat(F.lit("p"), (k % 3).cast("string")).alias("param_id"), F.when(k % 3 > 0, F.concat(F.lit("NAME "), (k % 3).cast("string"))).alias("param_name"),
        "frame_index", "subframe", F.lit(1).alias("param_ord"), F.when(k % 2 == 0, 2).alias("occ"), F.get("words", F.lit(1)).cast("bigint").alias("raw_integer"),
        F.lit(None).cast("double").alias("decoded"), F.when(k % 3 > 0, F.get("words", F.lit(1)) / 8.0).alias("eng_value"),
        F.when(k % 3 == 0, "DOWN").alias("eng_label"), F.lit("kt").alias("unit"), F.when(k % 5 == 0, "OUT_OF_RANGE").alias("status"))
    evs = subs.filter(k % 4 == 0).select("recording_id", "seq", "t", F.lit("SYNC_LOCKED").alias("kind"), F.lit("again").alias("message"))
    path = os.path.join(checkpoint_dir(spark), f"sessions-{uuid.uuid4().hex}")
    sessions.write_sessions(sessions.session_lines(_heads(subs), subs, smp, evs), path)
    return sessions.records(sessions.read_written(spark, path))


@query(
    "session_samples",
    f"""WITH {SUB} SELECT rec AS recording_id, 'p' || seq % 3 AS param_id, CASE WHEN seq % 3 = 0 THEN 'p0' ELSE 'NAME ' || seq % 3 END AS param_name, t_end AS t, fi AS frame_index,
      sf::BIGINT AS subframe, CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS occ, {word_of('2')}::BIGINT AS raw_integer,
      CASE WHEN seq % 3 > 0 THEN {word_of('2')} / 8.0::DOUBLE END AS eng_value, CASE WHEN seq % 3 = 0 THEN 'DOWN' END AS eng_label,
      CASE WHEN seq % 5 = 0 THEN 'OUT_OF_RANGE' ELSE 'VALID' END AS status FROM sub WHERE state <> 'MISSING'""",
)
def session_samples(spark, sf_dir):
    """Samples of sessions, with what they leave out filled in (SRC-03, SNK-01)."""
    return sessions.samples(_sampled(spark, sf_dir)).select(
        "recording_id", "param_id", "param_name", "t", long("frame_index"), long("subframe"), long("occ"), "raw_integer", "eng_value", "eng_label", "status")


@query(
    "session_totals",
    f"""WITH {SUB} SELECT rec AS recording_id, count(*) AS subframes, count(*) AS samples, count(*) FILTER (seq % 4 = 0) AS events FROM sub WHERE state <> 'MISSING' GROUP BY rec""",
)
def session_totals(spark, sf_dir):
    """Totals of sessions with samples and events (SRC-04, AGG-10)."""
    return sessions.summary(_sampled(spark, sf_dir)).select("recording_id", "subframes", "samples", "events")


# -- texts --------------------------------------------------------------------

@query(
    "number_pairs",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN (p_size - 25)::VARCHAR END AS first, CASE WHEN p_partkey % 4 < 3 THEN p_size || '.5e1' END AS second FROM part""",
)
def number_pairs(spark, sf_dir):
    """Two-number cells in three spellings, and cells that hold something else (SCL-21)."""
    k, a, b = F.col("p_partkey") % 4, (F.col("p_size") - 25).cast("string"), F.concat(F.col("p_size").cast("string"), F.lit(".5e1"))
    text = F.when(k == 0, F.concat_ws(" , ", a, b)).when(k == 1, F.concat_ws("\n", a, b)).when(k == 2, F.concat(F.translate(a, "-", "−"), F.lit(";"), b)).otherwise(F.concat_ws(" ", a, b, F.lit("x")))
    p = bridge.table(spark, sf_dir, "part").select("p_partkey", numbers.split_number_pair(text).alias("p"))
    return p.select("p_partkey", "p.first", "p.second")


@query(
    "frequencies",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN 1.0 / p_size WHEN 5 THEN NULL ELSE p_size END::DOUBLE AS hz FROM part""",
)
def frequencies(spark, sf_dir):
    """Rates in the spellings of documents (SCL-22)."""
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(n, F.lit(" Hz"))).when(k == 1, F.concat(n, F.lit(" samples/sec"))).when(k == 2, F.concat(n, F.lit(" sps")))
        .when(k == 3, F.concat(n, F.lit(" per second"))).when(k == 4, F.concat(F.lit("1/"), n)).otherwise("often")
    )
    return bridge.table(spark, sf_dir, "part").select("p_partkey", numbers.parse_frequency(text).alias("hz"))


@query(
    "subframe_cells",
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '1,2,3,4' WHEN 1 THEN '2' WHEN 2 THEN '1,3' WHEN 3 THEN '1,2,3,4' WHEN 4 THEN '2,3,4' WHEN 5 THEN '1,2,3,4' WHEN 6 THEN '1,4' END AS subframes,
      CASE p_partkey % 8 WHEN 3 THEN 'blank' WHEN 5 THEN 'zero' END AS note FROM part""",
)
def subframe_cells(spark, sf_dir):
    """Subframe cells in the spellings of documents (SCL-11, SCL-23)."""
    texts = ("all", "SF 2 (odd)", "1 & 3", " ", "2-4", "0 (all 4)", "14", "5")
    text = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % 8).cast("int"))
    p = bridge.table(spark, sf_dir, "part").select("p_partkey", cells.subframe_field(text).alias("f"))
    return p.select("p_partkey", F.array_join("f.subframes", ",").alias("subframes"), "f.note")


@query(
    "vendor_types",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'bcd ' WHEN p_type = 'ECONOMY' THEN 'Signed Analog' WHEN p_type = 'LARGE' THEN 'Unsigned Analog' WHEN p_type = 'MEDIUM' THEN 'BCD'
      WHEN p_type = 'PROMO' THEN 'Discrete' ELSE p_type END AS vendor_type FROM part""".replace("'bcd '", "'bcd'"),
)
def vendor_types(spark, sf_dir):
    """Type texts of exported records (SCL-07)."""
    p = bridge.table(spark, sf_dir, "part")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in bridge.PART_TYPES.items() for x in kv]), F.col("p_type"))
    source = F.when(F.col("p_partkey") % 3 == 0, "bcd ").otherwise(F.col("p_type"))
    return p.select("p_partkey", types.vendor_type_text(kind, source).alias("vendor_type"))


# -- readings of the same table ---------------------------------------------------

@query(
    "row_alignment",
    """WITH t AS (SELECT p_partkey // 64 AS doc, p_partkey AS k FROM part)
    SELECT doc::VARCHAR AS document_id, k AS truth_row, CASE WHEN k % 7 <> 3 THEN k * 10 END AS read_row FROM t
    UNION ALL SELECT doc::VARCHAR, NULL, k * 10 + 5 FROM t WHERE k % 11 = 4""",
)
def row_alignment(spark, sf_dir):
    """Rows of a document and of its reading, in which some are lost, some inserted and cells damaged (AGG-12)."""
    p, k = bridge.table(spark, sf_dir, "part"), F.col("p_partkey")
    own = [F.concat(F.lit("row"), k.cast("string")), F.col("p_name"), F.col("p_brand"), F.concat(F.lit("w"), (k * 3).cast("string"))]
    truth = p.select(F.expr("p_partkey div 64").cast("string").alias("document_id"), k.alias("row_no"), F.array(*own).alias("cells"))
    damaged = [F.when(k % 5 == 1, F.lit("#?")).otherwise(own[0]), F.when(k % 3 == 2, F.concat(own[1], F.lit("l"))).otherwise(own[1]), own[2], own[3]]
    read = p.select(F.expr("p_partkey div 64").cast("string").alias("document_id"), (k * 10).alias("row_no"), F.array(*damaged).alias("cells")).filter(k % 7 != 3)
    dirt = F.array(*[F.concat(F.lit(f"dirt{c} "), k.cast("string")) for c in range(4)])
    more = p.filter(k % 11 == 4).select(F.expr("p_partkey div 64").cast("string").alias("document_id"), (k * 10 + 5).alias("row_no"), dirt.alias("cells"))
    return pages.align_rows(truth, read.unionByName(more), ["document_id"])
