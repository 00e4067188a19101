"""Decode, sample analytics and word-level queries over recorded subframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode as dec
from ..operators import inspect, mapping, series
from ..session import broadcast_if_small, materialize
from . import bridge
from .registry import query
from .sqltext import MAP, PTS, SMP, SUB, word_of


def long(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


_PREPARED: dict[tuple, tuple[DataFrame, dict]] = {}


def prepared(spark: SparkSession, mode: str = mapping.MODE_SUBFRAME) -> tuple[DataFrame, dict]:
    """The mapping's plan rows and their profile, prepared once per session."""
    key = (spark.sparkContext.applicationId, mode)
    if key not in _PREPARED:
        rows = mapping.sample_plans(*bridge.literal_mapping(spark), mode=mode).persist()
        _PREPARED[key] = (rows, dec.plan_profile(rows))
    return _PREPARED[key]


def plans(spark: SparkSession, mode: str = mapping.MODE_SUBFRAME) -> DataFrame:
    return prepared(spark, mode)[0]


def samples(spark: SparkSession, sf_dir: str, mode: str = mapping.MODE_SUBFRAME, **kw) -> DataFrame:
    rows, profile = prepared(spark, mode)
    return dec.decode(dec.decodable(bridge.subframes(spark, sf_dir)), rows, profile=profile, **kw)


def points(spark: SparkSession, sf_dir: str, scans: int = 1, only: tuple[str, ...] = ("*",)) -> DataFrame:
    """Stored points; written once, with the columns ``only`` names, where several steps scan them."""
    p = series.series(samples(spark, sf_dir)).select(*only)
    return materialize(p) if scans > 1 else p


SAMPLE_SQL = (
    "rec AS recording_id, seq, fi AS frame_index, sf::BIGINT AS subframe, pid AS param_id, occ::BIGINT AS occ, t, "
    "bits AS raw_bits, raw AS raw_integer, decoded, eng AS eng_value, label AS eng_label, unit, status"
)


def sample_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "recording_id", "seq", "frame_index", long("subframe"), "param_id", long("occ"), "t", "raw_bits",
        "raw_integer", "decoded", "eng_value", "eng_label", "unit", "status",
    )


@query("decode_samples", f"WITH {SMP} SELECT {SAMPLE_SQL} FROM smp")
def decode_samples(spark, sf_dir):
    """Every sample of every decodable subframe (DEC-02, 04…19)."""
    return sample_columns(samples(spark, sf_dir))


def _only(name: str, where: str):
    @query(name, f"WITH {SMP} SELECT {SAMPLE_SQL} FROM smp WHERE {where.replace('param_id', 'pid')}")
    def run(spark, sf_dir):
        return sample_columns(samples(spark, sf_dir, keep=("ptype",)).filter(where))

    return run


_only("decode_multiseg", "param_id IN ('S21', 'S30', 'R24')")
_only("decode_bcd", "ptype = 'bcd'")
_only("decode_discrete", "ptype = 'discrete'")
_only("decode_unsupported", "status = 'UNSUPPORTED_TYPE'")
_only("decode_weighted_bcd", "param_id IN ('W2', 'W3')")
_only("values_for_parameter", "param_id = 'S10'")


@query(
    "decode_frames",
    f"""WITH {SMP} SELECT {SAMPLE_SQL} FROM smp
    UNION ALL
    SELECT s.rec, s.seq, s.fi, 7, 'FSLOT', 1, (s.t_end - 1.0) + {bridge.word_at('FSLOT') - 1} / 64.0, NULL, NULL, NULL, NULL, NULL, NULL, 'INVALID_MAPPING'
    FROM sub s WHERE s.sf = 1 AND s.state = 'RECEIVED'""",
)
def decode_frames(spark, sf_dir):
    """Whole-frame mode (DEC-01): subframe numbers outside 1..4 are reported too."""
    return sample_columns(samples(spark, sf_dir, mode=mapping.MODE_FRAME))


@query(
    "decode_status_counts",
    f"WITH {SMP} SELECT rec AS recording_id, pid AS param_id, status, count(*) AS n FROM smp GROUP BY ALL",
)
def decode_status_counts(spark, sf_dir):
    return series.status_counts(samples(spark, sf_dir), "recording_id", "param_id")


@query(
    "mapping_errors",
    f"""WITH {SUB}, {MAP}
    SELECT s.rec AS recording_id, o.pid AS param_id, o.occ::BIGINT AS occ, o.err AS message, count(*) AS frames
    FROM sub s JOIN occx o ON o.err IS NOT NULL AND s.sf = 1 WHERE s.state = 'RECEIVED' GROUP BY ALL""",
)
def mapping_errors(spark, sf_dir):
    """Mapping-level errors with the number of frames each recording reports them in (DEC-03)."""
    _, pars, segs = bridge.literal_mapping(spark)
    errors = mapping.mapping_errors(pars, segs)
    first = dec.decodable(bridge.subframe_headers(spark, sf_dir)).filter("subframe = 1")
    return (
        first.join(broadcast_if_small(errors), "document_id")
        .groupBy("recording_id", "param_id", long("occ"), "message").agg(F.count("*").alias("frames"))
    )


@query(
    "decode_trace",
    f"""WITH {SUB}, {MAP},
    q AS (SELECT s.rec, s.seq, o.pid, o.occ, g.seq AS gseq, g.word, g.width, g.bad, g.lo_,
                 CAST({word_of('g.word', 's.c', 's.sf')} AS BIGINT) AS wv
          FROM sub s JOIN occx o ON o.err IS NULL AND list_contains(o.sfs, s.sf)
          JOIN segs g ON g.pid = o.pid AND g.occ = o.occ AND (o.bad_seq IS NULL OR g.seq <= o.bad_seq)
          WHERE s.state = 'RECEIVED'),
    x AS (SELECT *, CASE WHEN NOT bad THEN (wv >> (lo_ - 1)) & ((1 << width) - 1) END AS part FROM q)
    SELECT rec AS recording_id, seq, pid AS param_id, occ::BIGINT AS occ, gseq::BIGINT AS segment, word::BIGINT AS word,
           CASE WHEN NOT bad THEN wv END AS word_value, part AS extracted, lpad(bin(part), width::INT, '0') AS bits
    FROM x""",
)
def decode_trace(spark, sf_dir):
    """Per-segment derivation of every sample (DEC-15)."""
    return (
        samples(spark, sf_dir, trace=True).withColumn("g", F.explode("trace"))
        .select(
            "recording_id", "seq", "param_id", long("occ"), F.col("g.seq").cast("bigint").alias("segment"),
            F.col("g.word").cast("bigint").alias("word"), F.col("g.word_value").cast("bigint").alias("word_value"),
            F.col("g.extracted").alias("extracted"), F.col("g.bits").alias("bits"),
        )
    )


@query(
    "sample_timestamps",
    f"""WITH {SMP} SELECT rec AS recording_id, pid AS param_id, occ::BIGINT AS occ, min(t) AS first_t, max(t) AS last_t,
    count(*) AS n FROM smp GROUP BY ALL""",
)
def sample_timestamps(spark, sf_dir):
    """First and last recording time per parameter and occurrence (DEC-17)."""
    return samples(spark, sf_dir).groupBy("recording_id", "param_id", long("occ")).agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n")
    )


@query(
    "numeric_values",
    f"""WITH {PTS} SELECT rec AS recording_id, pid AS param_id, seq, occ::BIGINT AS occ, t, value FROM pts""",
)
def numeric_values(spark, sf_dir):
    """What a time series stores (DEC-18)."""
    return points(spark, sf_dir).select("recording_id", "param_id", "seq", long("occ"), "t", "value")


# -- series ----------------------------------------------------------------

def _window_sql(seconds: float, now: str = "last_t") -> str:
    return f"""
    ends AS (SELECT rec, pid, arg_max(t, (seq, occ)) AS last_t FROM pts GROUP BY ALL),
    beg AS (SELECT p.rec, p.pid, min((p.seq, p.occ)) AS b FROM pts p JOIN ends e ON e.rec = p.rec AND e.pid = p.pid
            WHERE p.t >= {now} - {seconds} GROUP BY ALL),
    win AS (SELECT p.* FROM pts p JOIN beg ON beg.rec = p.rec AND beg.pid = p.pid WHERE (p.seq, p.occ) >= beg.b)"""


def recent(spark, sf_dir, seconds: float, take=series.recent_points) -> DataFrame:
    rows, profile = prepared(spark)
    subs = dec.decodable(bridge.subframes(spark, sf_dir))
    return take(subs, lambda s: series.series(dec.decode(s, rows, profile=profile)), seconds)


def settled(stats: DataFrame) -> DataFrame:
    """Averages to six digits (moved off ties), as their last bits follow the order of addition."""
    return stats.withColumn("average", F.round(F.col("average") + 3e-8, 6))


def _series_stats(name: str, seconds: int):
    @query(
        name,
        f"""WITH {PTS}, {_window_sql(seconds)}
        SELECT rec AS recording_id, pid AS param_id, count(*) AS n, arg_max(value, (seq, occ)) AS current,
               min(value) AS minimum, max(value) AS maximum, round(avg(value) + 3e-8, 6) AS average
        FROM win GROUP BY ALL""",
    )
    def run(spark, sf_dir):
        return settled(recent(spark, sf_dir, float(seconds), series.recent_stats))

    return run


for _s in (30, 300):
    _series_stats(f"series_stats_{_s}s", _s)


@query(
    "series_stats_all",
    f"""WITH {PTS} SELECT rec AS recording_id, pid AS param_id, count(*) AS n, arg_max(value, (seq, occ)) AS current,
    min(value) AS minimum, max(value) AS maximum, round(avg(value) + 3e-8, 6) AS average FROM pts GROUP BY ALL""",
)
def series_stats_all(spark, sf_dir):
    return settled(series.series_stats(points(spark, sf_dir)))


@query(
    "ring_last_n",
    f"""WITH {PTS} SELECT rec AS recording_id, pid AS param_id, seq, occ::BIGINT AS occ, value FROM pts
    QUALIFY row_number() OVER (PARTITION BY rec, pid ORDER BY seq DESC, occ DESC) <= 100""",
)
def ring_last_n(spark, sf_dir):
    """The 100 latest points of every series (WIN-01)."""
    return series.ring(points(spark, sf_dir, scans=3, only=(*series.SERIES, "seq", "occ", "value")), 100).select("recording_id", "param_id", "seq", long("occ"), "value")


@query(
    "ring_duration",
    f"""WITH {PTS} SELECT rec AS recording_id, pid AS param_id, seq, occ::BIGINT AS occ, value FROM pts
    QUALIFY t >= max(t) OVER (PARTITION BY rec, pid) - 300""",
)
def ring_duration(spark, sf_dir):
    """Points not older than 300 s before the newest (WIN-02)."""
    return series.duration_bound(points(spark, sf_dir, scans=3, only=(*series.SERIES, "seq", "occ", "t", "value")), 300.0).select(
        "recording_id", "param_id", "seq", long("occ"), "value"
    )


@query(
    "trailing_window",
    f"""WITH {PTS}, {_window_sql(60)} SELECT rec AS recording_id, pid AS param_id, seq, occ::BIGINT AS occ, t, value FROM win""",
)
def trailing_window(spark, sf_dir):
    return recent(spark, sf_dir, 60.0).select(
        "recording_id", "param_id", "seq", long("occ"), "t", "value"
    )


def latest_samples(spark, sf_dir) -> DataFrame:
    """Samples of the only subframes that can hold a latest one."""
    rows, profile = prepared(spark)
    return dec.decode(series.latest_subframes(dec.decodable(bridge.subframes(spark, sf_dir))), rows, profile=profile)


@query(
    "latest_value",
    f"""WITH {SMP} SELECT {SAMPLE_SQL} FROM smp
    QUALIFY row_number() OVER (PARTITION BY rec, pid, occ, sf ORDER BY seq DESC) = 1""",
)
def latest_value(spark, sf_dir):
    """Latest sample per (parameter, occurrence, subframe) (WIN-04)."""
    return sample_columns(series.latest(latest_samples(spark, sf_dir)))


@query(
    "carry_forward",
    f"""WITH {SUB}, grid AS (SELECT DISTINCT rec, fi, g.sf FROM sub, (VALUES (1), (2), (3), (4)) g(sf)),
    got AS (SELECT g.rec, g.fi, g.sf, s.fi AS got FROM grid g LEFT JOIN sub s ON s.rec = g.rec AND s.fi = g.fi
            AND s.sf = g.sf AND s.state <> 'MISSING'),
    src AS (SELECT rec, fi, sf, last_value(got IGNORE NULLS) OVER (PARTITION BY rec, sf ORDER BY fi) AS source_frame FROM got)
    SELECT a.rec AS recording_id, a.fi AS frame_index, a.sf::BIGINT AS subframe, a.source_frame,
           {word_of('2', 's.c', 's.sf')}::BIGINT AS word_2
    FROM src a LEFT JOIN sub s ON s.rec = a.rec AND s.fi = a.source_frame AND s.sf = a.sf""",
)
def carry_forward(spark, sf_dir):
    """The words every slot of every frame shows (WIN-06)."""
    subs = bridge.subframes(spark, sf_dir)
    return series.with_words(series.carry_forward(subs), subs).select(
        "recording_id", "frame_index", long("subframe"), "source_frame", F.get("words", F.lit(1)).cast("bigint").alias("word_2")
    )


@query(
    "overlay_same_unit",
    f"""WITH {PTS}, e AS (SELECT rec, pid, min(unit) AS unit, arg_max(t, (seq, occ)) AS end_t FROM pts GROUP BY ALL)
    SELECT e.rec AS recording_id, e.pid AS param_id, e.unit, e.end_t, max(e.end_t) OVER (PARTITION BY e.rec) AS common_end
    FROM e JOIN e c ON c.rec = e.rec AND c.pid = 'S10' AND e.unit IS NOT DISTINCT FROM c.unit""",
)
def overlay_same_unit(spark, sf_dir):
    return series.overlay(points(spark, sf_dir, scans=3), "S10")


@query(
    "sample_search",
    f"""WITH {SMP} SELECT {SAMPLE_SQL} FROM smp WHERE contains(lower(name || ' ' || descr), 'temperature')""",
)
def sample_search(spark, sf_dir):
    found = series.search(samples(spark, sf_dir, keep=("description",)), "TEMPERATURE")
    return sample_columns(found)


@query(
    "sample_filter",
    f"""WITH {SMP} SELECT {SAMPLE_SQL} FROM smp WHERE ptype = 'analog_signed' AND status = 'VALID' AND sf = 3""",
)
def sample_filter(spark, sf_dir):
    return sample_columns(
        series.select_samples(samples(spark, sf_dir, keep=("ptype",)), "analog_signed", "VALID", 3)
    )


@query(
    "numeric_parameters",
    f"""WITH {PTS} SELECT pid AS param_id, name, unit FROM par WHERE ptype <> 'unknown'
    UNION SELECT pid, min(name), min(unit) FROM pts WHERE pid NOT IN (SELECT pid FROM par WHERE ptype <> 'unknown') GROUP BY pid""",
)
def numeric_parameters(spark, sf_dir):
    _, pars, _ = bridge.literal_mapping(spark)
    return series.numeric_parameters(pars, points(spark, sf_dir))


@query(
    "sample_order",
    f"""WITH {SMP}, l AS (SELECT * FROM smp QUALIFY row_number() OVER (PARTITION BY rec, pid, occ, sf ORDER BY seq DESC) = 1)
    SELECT rec AS recording_id, pid AS param_id, occ::BIGINT AS occ, sf::BIGINT AS subframe, status FROM l""",
)
def sample_order(spark, sf_dir):
    """Latest samples in canonical order (SRT-01)."""
    return series.canonical_order(series.latest(latest_samples(spark, sf_dir))).select(
        "recording_id", "param_id", long("occ"), long("subframe"), "status"
    )


@query(
    "sample_keys_changed",
    f"""WITH {SMP}, a AS (SELECT DISTINCT pid, occ, sf FROM smp WHERE rec = '0'),
    b AS (SELECT DISTINCT pid, occ, sf FROM smp WHERE rec <> '0' AND status <> 'INVALID_MAPPING')
    SELECT 'removed' AS change, pid AS param_id, occ::BIGINT AS occ, sf::BIGINT AS subframe FROM (FROM a EXCEPT FROM b)
    UNION ALL SELECT 'added', pid, occ::BIGINT, sf::BIGINT FROM (FROM b EXCEPT FROM a)""",
)
def sample_keys_changed(spark, sf_dir):
    """Keys lost when unusable mappings are dropped (SET-04)."""
    s = samples(spark, sf_dir)
    changed = series.sample_keys_changed(
        s.filter("recording_id = '0'"), s.filter("recording_id <> '0' AND status <> 'INVALID_MAPPING'")
    )
    return changed.select("change", "param_id", long("occ"), long("subframe"))


# -- word-level views ------------------------------------------------------

@query(
    "word_inspector",
    f"""WITH {SMP}, cell AS (SELECT g.*, u.sf, o.err, o.bad_seq FROM seg g JOIN occx o ON o.pid = g.pid AND o.occ = g.occ,
       unnest(g.sfs) u(sf) WHERE g.seq IS NOT NULL)
    SELECT s.rec AS recording_id, s.seq, s.sf::BIGINT AS subframe, c.word::BIGINT AS word, c.pid AS param_id,
           c.occ::BIGINT AS occ, c.seq::BIGINT AS segment, m.decoded, m.eng AS eng_value, m.label AS eng_label, m.status
    FROM sub s JOIN cell c ON c.sf = s.sf
    LEFT JOIN smp m ON m.rec = s.rec AND m.seq = s.seq AND m.pid = c.pid AND m.occ = c.occ AND m.sf = s.sf""",
)
def word_inspector(spark, sf_dir):
    """Every mapped cell with its sample (JON-02)."""
    _, pars, segs = bridge.literal_mapping(spark)
    return inspect.word_inspector(bridge.subframes(spark, sf_dir), plans(spark), inspect.cells(pars, segs)).select(
        "recording_id", "seq", long("subframe"), long("word"), "param_id", long("occ"), long("segment"),
        "decoded", "eng_value", "eng_label", "status",
    )


@query(
    "touching_word",
    f"""WITH {SMP} SELECT {SAMPLE_SQL} FROM smp WHERE sf = 2 AND (pid, occ) IN (SELECT (pid, occ) FROM segx WHERE word = {bridge.word_at('D1')})""",
)
def touching_word(spark, sf_dir):
    return sample_columns(series.touching_word(samples(spark, sf_dir, trace=True), 2, bridge.word_at("D1")))


@query(
    "parameter_bits",
    f"""WITH {SMP}, w AS (
      SELECT m.rec, m.seq, m.pid, m.occ, g.seq AS gseq, g.word, g.lo_, g.width,
             {word_of('g.word', 's.c', 's.sf')} AS wv
      FROM smp m JOIN sub s ON s.rec = m.rec AND s.seq = m.seq JOIN segs g ON g.pid = m.pid AND g.occ = m.occ
      WHERE m.pid = 'S21')
    SELECT rec AS recording_id, seq, pid AS param_id, occ::BIGINT AS occ, gseq::BIGINT AS segment, word::BIGINT AS word,
           b::BIGINT AS bit, ((wv >> (b - 1)) & 1)::BIGINT AS is_set, (b BETWEEN lo_ AND lo_ + width - 1) AS mapped
    FROM w, range(1, 13) r(b)""",
)
def parameter_bits(spark, sf_dir):
    """Bits behind every sample of a two-word parameter (JON-03)."""
    s = series.for_parameter(samples(spark, sf_dir, trace=True), "S21")
    return inspect.parameter_bits(s).select(
        "recording_id", "seq", "param_id", long("occ"), long("segment"), long("word"), long("bit"), "is_set", "mapped"
    )


@query(
    "sample_view",
    f"""WITH {SMP}
    SELECT m.rec AS recording_id, m.seq, m.name AS mnemonic, p.descr AS description, p.ptype, m.occ::BIGINT AS occ,
           m.sf::BIGINT AS subframe, m.bits AS raw_bits, m.decoded,
           CASE WHEN p.ptype IN ('analog_signed', 'analog_unsigned', 'bcd') THEN p.res END AS resolution,
           CASE WHEN p.ptype IN ('analog_signed', 'analog_unsigned', 'bcd') THEN p.off_ END AS "offset",
           m.eng AS eng_value, m.label AS eng_label, m.unit, m.status
    FROM smp m JOIN par p ON p.pid = m.pid""",
)
def sample_view(spark, sf_dir):
    """The sample table a viewer shows (JON-04)."""
    _, pars, _ = bridge.literal_mapping(spark)
    view = inspect.sample_view(samples(spark, sf_dir), pars)
    return view.drop("source_type").withColumn("occ", F.col("occ").cast("bigint")).withColumn(
        "subframe", F.col("subframe").cast("bigint")
    )


# Six words of three digits each; every fifth subframe holds a word that is no number.
WIDE_WORD = "CASE WHEN c % 5 = 0 AND {i} = 3 THEN 4095 ELSE (((c + {i} * 7) % 1000) // 100) * 256 + (((c + {i} * 7) % 1000) // 10 % 10) * 16 + (c + {i} * 7) % 10 END"


def _wide_mapping(spark):
    """A document with fields of 72 bits: digits, a flag, a number with and without sign."""
    segs = [[(bridge.ALL, w, 1, 12, None) for w in range(2, 8)]]
    kinds = [("W1", "bcd"), ("W2", "discrete"), ("W3", "raw"), ("W4", "analog_signed")]
    docs = bridge.literal_documents(spark)
    pars = bridge.literal_parameters(spark).limit(0)
    rows = [(bridge.DOCUMENT_ID, i, pid, pid, "", None, kind, None, None, None, 1.0, 0.0, "linear", None, "SET", "CLEAR", [], None)
            for i, (pid, kind) in enumerate(kinds, 1)]
    pars = spark.createDataFrame(rows, pars.schema)
    cells = [(bridge.DOCUMENT_ID, pid, 1, k, list(sfs), w, lsb, msb, wt) for pid, _ in kinds for k, (sfs, w, lsb, msb, wt) in enumerate(segs[0], 1)]
    return docs, pars, spark.createDataFrame(cells, bridge.literal_segments(spark).schema)


@query(
    "decode_wide",
    f"""WITH {SUB}, w AS (
      SELECT rec, seq, c, c % 5 = 0 AS odd, c % 7 = 0 AS blank, [{", ".join(WIDE_WORD.format(i=i) for i in range(1, 7))}] AS v0
      FROM sub WHERE state = 'RECEIVED'),
    x AS (SELECT *, CASE WHEN blank THEN [0, 0, 0, 0, 0, 0] ELSE v0 END AS v FROM w),
    b AS (SELECT *, array_to_string(list_transform(v, lambda y: lpad(bin(y::INT), 12, '0')), '') AS bits,
          list_sum([v[i]::HUGEINT * (4096::HUGEINT ** (6 - i))::HUGEINT for i in range(1, 7)])::HUGEINT AS n FROM x),
    d AS (SELECT *, array_to_string(list_transform(v, lambda y: lpad(lower(hex(y::INT)), 3, '0')), '') AS hexed FROM b)
    SELECT rec AS recording_id, seq, p AS param_id, bits AS raw_bits,
      CASE p WHEN 'W1' THEN CASE WHEN blank OR NOT odd THEN CAST(right(hexed, 18) AS DOUBLE) END
             WHEN 'W4' THEN (CASE WHEN v[1] >= 2048 THEN n - 4722366482869645213696::HUGEINT ELSE n END)::VARCHAR::DOUBLE
             ELSE n::VARCHAR::DOUBLE END AS decoded,
      CASE WHEN p = 'W2' THEN CASE WHEN blank THEN 'CLEAR' ELSE 'SET' END END AS eng_label,
      CASE WHEN p = 'W1' AND odd AND NOT blank THEN 'INVALID_BCD' ELSE 'VALID' END AS status
    FROM d, (VALUES ('W1'), ('W2'), ('W3'), ('W4')) q(p)""",
)
def decode_wide(spark, sf_dir):
    """Fields of 72 bits: digits, labels and numbers hold at any width (DEC-06, 09, 11)."""
    h = bridge.subframe_headers(spark, sf_dir)
    digit = lambda i: (F.col("c") + i * 7) % 1000
    packed = lambda i: F.floor(digit(i) / 100) * 256 + F.floor(digit(i) / 10) % 10 * 16 + digit(i) % 10
    word = lambda i: F.when(F.col("c") % 7 == 0, 0).when((F.col("c") % 5 == 0) & (F.lit(i) == 3), 4095).otherwise(packed(i)).cast("int")
    words = F.concat(F.array(F.lit(0)), F.array(*[word(i) for i in range(1, 7)]), F.array_repeat(F.lit(0), bridge.WPS - 7))
    rows = mapping.sample_plans(*_wide_mapping(spark))
    out = dec.decode(dec.decodable(h.withColumn("words", words)), rows)
    return out.select("recording_id", "seq", "param_id", "raw_bits", "decoded", "eng_label", "status")
