"""Many mapping documents at once: decode, encode, and scripts as tables.

Every 64 parts are one document, every part one of its parameters.  A third of
the recordings use document F0, each of the others its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode as dec
from ..operators import encode, mapping, series
from ..schemas import SYNC_WORDS
from . import bridge
from .decode_queries import SAMPLE_SQL, long, sample_columns
from .registry import query
from .sqltext import PAR, SEG, SMP, ST, SUB, TYPE_CASE, word_of


def fleet_mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = bridge.table(spark, sf_dir, "part")
    k, size, cents = F.col("p_partkey"), F.col("p_size"), F.floor(F.col("p_retailprice") * 100).cast("bigint")
    doc, pid = F.concat(F.lit("F"), F.expr("p_partkey div 64").cast("string")), F.concat(F.lit("F"), k.cast("string"))
    ptype = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in bridge.PART_TYPES.items() for x in kv]), F.col("p_type")), F.lit("odd"))
    text, none = (lambda c: F.lit(c).cast("string")), F.lit(None)
    parameters = p.select(
        doc.alias("document_id"), (k % 64 + 1).cast("int").alias("param_ord"), pid.alias("param_id"), F.upper("p_name").alias("mnemonic"),
        F.col("p_brand").alias("description"), F.col("p_type").alias("source_type"), ptype.alias("ptype"), F.lit("V").alias("unit"),
        (size * -20).cast("double").alias("minimum"), (size * 40).cast("double").alias("maximum"), (size / 8.0).alias("resolution"),
        (size - 25).cast("double").alias("offset"), F.when(size == 7, "table").otherwise("linear").alias("formula_type"), none.cast("int").alias("decimals"),
        F.when(size > 30, "ON").alias("true_state"), text(None).alias("false_state"), none.cast("array<struct<value:bigint,label:string>>").alias("states"),
        text(None).alias("notes"),
    )
    lsb = (cents % 6 + 1).cast("int")
    sfs = F.array_sort(F.array((k % 4 + 1).cast("int"), ((k + 1) % 4 + 1).cast("int")))

    def seg(seq, word, low, high):
        return F.struct(F.lit(1).alias("occ"), F.lit(seq).alias("seq"), sfs.alias("subframes"), word.cast("int").alias("word"), low.alias("lsb"), high.alias("msb"))

    one, two = seg(1, k % 31 + 2, lsb, lsb + 4 + (cents % 3).cast("int")), seg(2, k % 29 + 34, F.lit(1), F.lit(8))
    listed = F.when((size > 25) & (F.col("p_type") != "MEDIUM"), F.array(one, two)).otherwise(F.array(one))
    segments = p.filter(size != 3).select(doc.alias("document_id"), pid.alias("param_id"), F.inline(listed)).withColumn("bcd_weight", F.lit(None).cast("double"))
    documents = p.select(doc.alias("document_id")).distinct().select(
        "document_id", F.col("document_id").alias("name"), F.lit(bridge.WPS).alias("wps"), F.array(*[F.lit(s) for s in SYNC_WORDS]).alias("sync_words"))
    return documents, parameters, segments


def fleet_subframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("recording_id").cast("bigint")
    document = F.concat(F.lit("F"), F.when(number % 3 == 0, F.lit("0")).otherwise(F.col("recording_id")))
    return bridge.subframes(spark, sf_dir).withColumn("document_id", document)


_FLEET = f"""
ppar AS (
  SELECT 'F' || CAST(p_partkey // 64 AS VARCHAR) AS doc, CAST(p_partkey % 64 + 1 AS BIGINT) AS ord, 'F' || CAST(p_partkey AS VARCHAR) AS pid, upper(p_name) AS name,
         p_brand AS descr, {TYPE_CASE} AS ptype, 'V' AS unit, (p_size * -20)::DOUBLE AS lo, (p_size * 40)::DOUBLE AS hi, p_size / 8.0 AS res, (p_size - 25)::DOUBLE AS off_,
         CASE WHEN p_size = 7 THEN 'table' ELSE 'linear' END AS formula, CASE WHEN p_size > 30 THEN 'ON' END AS tlab, NULL::VARCHAR AS flab,
         p_size, p_partkey AS k, CAST(floor(p_retailprice * 100) AS BIGINT) AS cents, list_sort([(p_partkey % 4 + 1)::INT, ((p_partkey + 1) % 4 + 1)::INT]) AS own
  FROM part),
par AS (SELECT ord, pid, name, descr, ptype, unit, lo, hi, res, off_, formula, tlab, flab, doc FROM ppar),
seg AS (
  SELECT pid, 1 AS occ, 1 AS seq, own AS sfs, (k % 31 + 2)::INT AS word, (cents % 6 + 1)::INT AS lsb, (cents % 6 + 5 + cents % 3)::INT AS msb, NULL::DOUBLE AS wt
  FROM ppar WHERE p_size <> 3
  UNION ALL
  SELECT pid, 1, 2, own, (k % 29 + 34)::INT, 1, 8, NULL FROM ppar WHERE p_size > 25 AND ptype <> 'bcd'),
st AS (SELECT NULL::VARCHAR AS pid, NULL::BIGINT AS value, NULL::VARCHAR AS label WHERE false)"""
_OWN = "CASE WHEN rec::BIGINT % 3 = 0 THEN 'F0' ELSE 'F' || rec END"


def _fleet(sql: str) -> str:
    """The SQL of one literal document, read for many."""
    for old, new in (
        (f"{PAR},\n{SEG},\n{ST}", _FLEET),
        ("SELECT p.ord, p.pid, coalesce(g.occ, 0) AS occ,", "SELECT p.doc, p.ord, p.pid, coalesce(g.occ, 0) AS occ,"),
        ("GROUP BY p.ord, p.pid, g.occ)", "GROUP BY p.doc, p.ord, p.pid, g.occ)"),
        ("ON list_contains(o.sfs, s.sf) AND o.err IS NULL AND", f"ON o.doc = {_OWN.replace('rec', 's.rec')} AND list_contains(o.sfs, s.sf) AND o.err IS NULL AND"),
        ("ON (o.err IS NOT NULL AND s.sf = 1)", f"ON o.doc = {_OWN.replace('rec', 's.rec')} AND ((o.err IS NOT NULL AND s.sf = 1)"),
        ("AND list_contains(o.sfs, s.sf))\n  JOIN par", "AND list_contains(o.sfs, s.sf)))\n  JOIN par"),
    ):
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


@query("decode_fleet", f"WITH {_fleet(SMP)} SELECT {SAMPLE_SQL} FROM smp")
def decode_fleet(spark, sf_dir):
    """Samples of all recordings with all documents, plan rows met slice by slice (JON-01)."""
    plans = mapping.sample_plans(*fleet_mapping(spark, sf_dir))
    return sample_columns(dec.decode_fleet(dec.decodable(fleet_subframes(spark, sf_dir)), plans, slice_rows=8, hot_rows=512))


# -- encode ------------------------------------------------------------------

# An event sets one parameter of the document of a frame's recording.
_SCENARIO = f"""{SUB}, {_FLEET},
fr AS (SELECT DISTINCT rec, fi, {_OWN} AS doc FROM sub),
ev AS (SELECT e.event_id AS ord, f.rec, f.fi, f.doc, 'F' || (substr(f.doc, 2)::BIGINT * 64 + e.event_id * 7 % 64) AS pid, round(e.value) - e.event_id % 3 AS v
       FROM events e JOIN fr f ON f.fi = e.event_id // 5),
dict AS (SELECT rec, fi, pid, min(ord) AS ord, arg_max(v, ord) AS v FROM ev GROUP BY ALL),
wid AS (SELECT pid, sum(msb - lsb + 1)::BIGINT AS w FROM seg GROUP BY pid),
num AS (SELECT d.*, p.ptype, p.formula, wid.w, round_even((d.v - p.off_) / p.res, 0)::BIGINT AS r FROM dict d JOIN ppar p USING (pid) JOIN wid USING (pid)),
pat AS (
  SELECT *, CASE WHEN ptype IN ('analog_signed', 'analog_unsigned', 'bcd') AND formula <> 'linear' THEN NULL
    WHEN ptype = 'analog_signed' THEN CASE WHEN r BETWEEN -(1::BIGINT << (w - 1)) AND (1::BIGINT << (w - 1)) - 1 THEN r & ((1::BIGINT << w) - 1) END
    WHEN ptype = 'analog_unsigned' THEN CASE WHEN r BETWEEN 0 AND (1::BIGINT << w) - 1 THEN r END
    WHEN ptype = 'bcd' THEN CASE WHEN r BETWEEN 0 AND 99999 THEN
      nullif(least(r // 10000 * 65536 + r // 1000 % 10 * 4096 + r // 100 % 10 * 256 + r // 10 % 10 * 16 + r % 10, 1::BIGINT << w), 1::BIGINT << w) END
    WHEN ptype = 'discrete' THEN CASE WHEN v IN (0, 1) THEN v::BIGINT END
    WHEN ptype = 'raw' THEN CASE WHEN v >= 0 AND v < (1::BIGINT << w) THEN v::BIGINT END END AS pattern
  FROM num)"""


def fleet_scenario(spark, sf_dir) -> DataFrame:
    frames = fleet_subframes(spark, sf_dir).select("recording_id", "frame_index", "document_id").distinct()
    e = bridge.table(spark, sf_dir, "events").select(F.expr("event_id div 5").alias("frame_index"), F.col("event_id").alias("ord"), "value")
    number = F.substr("document_id", F.lit(2)).cast("bigint") * 64 + F.col("ord") * 7 % 64
    return e.join(frames, "frame_index").select(
        "recording_id", "frame_index", "document_id", "ord", F.concat(F.lit("F"), number.cast("string")).alias("param_id"),
        (F.round("value") - F.col("ord") % 3).alias("value"), F.lit(None).cast("string").alias("label"),
    )


@query(
    "encode_fleet",
    f"""WITH {_SCENARIO},
    cell AS (SELECT pid, seq, u.sf, word, lsb, msb - lsb + 1 AS width,
                    coalesce(sum(msb - lsb + 1) OVER (PARTITION BY pid, u.sf ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS shift
             FROM seg, unnest(sfs) u(sf)),
    bits AS (SELECT p.rec, p.fi, c.sf, c.word, b.b, arg_max((p.pattern >> (c.shift + b.b - c.lsb + 1)) & 1, (p.ord, c.seq)) AS v
             FROM pat p JOIN cell c USING (pid), range(0, 12) b(b) WHERE p.pattern IS NOT NULL AND b.b BETWEEN c.lsb - 1 AND c.lsb + c.width - 2 GROUP BY ALL),
    wr AS (SELECT rec, fi, sf, word, sum(1 << b)::BIGINT AS mask, sum(v << b)::BIGINT AS val FROM bits GROUP BY ALL)
    SELECT s.rec AS recording_id, s.fi AS frame_index, s.sf::BIGINT AS subframe, w.word::BIGINT AS word,
           (({word_of('w.word', 's.c', 's.sf')})::BIGINT & ~w.mask | w.val)::BIGINT AS word_value
    FROM wr w JOIN sub s ON s.rec = w.rec AND s.fi = w.fi AND s.sf = w.sf""",
)
def encode_fleet(spark, sf_dir):
    """Values of events written into recorded frames, each by its own document; all other bits stay (ENC-05, ENC-07)."""
    _, parameters, segments = fleet_mapping(spark, sf_dir)
    scenario = encode.dictionary(fleet_scenario(spark, sf_dir))
    base = fleet_subframes(spark, sf_dir).select("recording_id", "frame_index", "subframe", "words", F.col("words").alias("was"))
    built = encode.scenario_frames(scenario, base, parameters, segments)
    touched = encode.word_updates(encode.writes(encode.patterns(scenario, parameters, segments, None), segments, None))
    return built.join(touched.select("recording_id", "frame_index", "subframe", "word"), ["recording_id", "frame_index", "subframe"]).select(
        "recording_id", "frame_index", long("subframe"), long("word"), F.get("words", F.col("word") - 1).cast("bigint").alias("word_value"))


@query(
    "encode_fleet_untouched",
    f"""WITH {SUB} SELECT rec AS recording_id, fi AS frame_index, sf::BIGINT AS subframe, 0::BIGINT AS changed FROM sub WHERE fi > (SELECT max(event_id) // 5 FROM events)""",
)
def encode_fleet_untouched(spark, sf_dir):
    """Frames that no value names come out as they were (ENC-05)."""
    _, parameters, segments = fleet_mapping(spark, sf_dir)
    scenario = encode.dictionary(fleet_scenario(spark, sf_dir))
    last = scenario.agg(F.max("frame_index")).first()[0]
    base = fleet_subframes(spark, sf_dir).select("recording_id", "frame_index", "subframe", "words", F.col("words").alias("was"))
    built = encode.scenario_frames(scenario, base, parameters, segments)
    changed = F.size(F.filter(F.zip_with("words", "was", lambda a, b: a != b), lambda x: x)).cast("bigint")
    return built.filter(F.col("frame_index") > (-1 if last is None else last)).select("recording_id", "frame_index", long("subframe"), changed.alias("changed"))


@query(
    "encodable_parameters",
    f"""WITH {_FLEET} SELECT doc AS document_id, pid AS param_id, ptype FROM ppar
    WHERE p_size <> 3 AND ptype IN ('analog_signed', 'analog_unsigned', 'bcd', 'discrete', 'raw') AND (ptype IN ('discrete', 'raw') OR formula = 'linear')""",
)
def encodable_parameters(spark, sf_dir):
    """What a scenario may set (ENC-01)."""
    _, parameters, segments = fleet_mapping(spark, sf_dir)
    return encode.encodable(parameters, segments).select("document_id", "param_id", "ptype")


@query(
    "display_decimals",
    f"""WITH {_FLEET} SELECT doc AS document_id, pid AS param_id, CASE WHEN ptype = 'discrete' THEN 0
      WHEN p_size % 8 = 0 THEN 0 WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS decimals FROM ppar""",
)
def display_decimals(spark, sf_dir):
    """Decimals that values are shown with (DEC-20, SCL-09)."""
    _, parameters, _ = fleet_mapping(spark, sf_dir)
    return parameters.select("document_id", "param_id", dec.effective_decimals().cast("bigint").alias("decimals"))


# -- scripts -----------------------------------------------------------------

@query(
    "script_interpolate",
    """WITH pt AS (SELECT p_partkey % 40 AS k, (p_partkey * 37 % 400)::DOUBLE AS t, p_size::DOUBLE AS v FROM part),
    ends AS (SELECT k, min((t, v)) AS first, max((t, v)) AS last FROM pt GROUP BY k),
    ev AS (SELECT event_id, user_id % 45 AS k, value AS x FROM events),
    near AS (SELECT e.event_id, max((t, v)) FILTER (p.t < e.x) AS a, min((t, v)) FILTER (p.t >= e.x) AS b FROM ev e JOIN pt p ON p.k = e.k GROUP BY e.event_id)
    SELECT e.event_id, CASE WHEN x <= first[1] THEN first[2] WHEN x >= last[1] THEN last[2] ELSE a[2] + (b[2] - a[2]) * (x - a[1]) / (b[1] - a[1]) END AS y
    FROM ev e LEFT JOIN ends ON ends.k = e.k LEFT JOIN near ON near.event_id = e.event_id""",
)
def script_interpolate(spark, sf_dir):
    """Value of the script of every event's key at its position (JON-07, SCL-30)."""
    p = bridge.table(spark, sf_dir, "part")
    point = F.concat((F.col("p_partkey") * 37 % 400).cast("string"), F.lit(":"), F.col("p_size").cast("string"))
    texts = p.groupBy((F.col("p_partkey") % 40).alias("key")).agg(F.array_join(F.collect_list(point), ", ").alias("text"))
    scripts = texts.select("key", series.parse_script(F.col("text")).alias("points"))
    e = bridge.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 45).alias("key"), "value")
    return series.script_values(e, scripts, "key", "value").select("event_id", "y")


@query(
    "script_texts",
    """SELECT p_partkey % 40 AS key, string_agg((p_partkey * 37 % 400) || ':' || p_size, ', ' ORDER BY p_partkey * 37 % 400, p_size) AS script FROM part GROUP BY 1""",
)
def script_texts(spark, sf_dir):
    """Scripts put in order and written again (SCL-30)."""
    p = bridge.table(spark, sf_dir, "part")
    point = F.concat((F.col("p_partkey") * 37 % 400).cast("string"), F.lit(":"), F.col("p_size").cast("string"))
    texts = p.groupBy((F.col("p_partkey") % 40).alias("key")).agg(F.array_join(F.collect_list(point), " ").alias("text"))
    return texts.select("key", series.format_script(series.parse_script(F.col("text"))).alias("script"))
