"""Cell text, document rows and reports over text derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells, numbers, words
from ..operators import normalize, pages, series
from ..session import materialize
from . import bridge

from .registry import query
from .sqltext import SUB, word_of


def _number_cell():
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, q).when(n == 2, F.concat(F.lit("1/"), q)).when(n == 3, F.concat(F.lit("2^-"), q)).when(n == 4, F.concat(F.lit("−"), q))
        .when(n == 5, F.concat(F.lit("1,"), F.lpad(q, 3, "0"), F.lit(".5"))).when(n == 6, F.concat(q, F.lit(",5"))).otherwise(F.concat(q, F.lit("e-2")))
    )


@query(
    "normalize_numbers",
    """WITH c AS (SELECT l_linenumber::BIGINT AS form, CAST(l_quantity AS INT) AS q FROM lineitem)
    SELECT form, q::BIGINT AS quantity, CASE form WHEN 1 THEN q::DOUBLE WHEN 2 THEN 1.0::DOUBLE / q WHEN 3 THEN pow(2.0::DOUBLE, -q)
      WHEN 4 THEN -q::DOUBLE WHEN 5 THEN 1000.5::DOUBLE + q WHEN 6 THEN NULL ELSE CAST(q || 'e-2' AS DOUBLE) END AS value, count(*) AS n
    FROM c GROUP BY ALL""",
)
def normalize_numbers(spark, sf_dir):
    """Numbers in every spelling (SCL-20)."""
    c = bridge.table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("form"), F.col("l_quantity").cast("bigint").alias("quantity"), _number_cell().alias("cell"))
    return c.groupBy("form", "quantity", numbers.parse_number(F.col("cell")).alias("value")).agg(F.count("*").alias("n"))


@query(
    "word_groups",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN (p_size + 2) || ',' || (p_size + 1) || ',' || p_size
      ELSE p_size || ',' || (p_size + 1) || ';' || (p_size + 64) END AS words FROM part""",
)
def word_groups(spark, sf_dir):
    """Word cells to groups in written order (SCL-18)."""
    s = F.col("p_size")
    t = F.when(F.col("p_type") == "PROMO", F.concat_ws(" thru ", s + 2, s)).otherwise(F.concat(F.concat_ws("–", s, s + 1), F.lit(" & "), (s + 64).cast("string")))
    p = bridge.table(spark, sf_dir, "part").select("p_partkey", cells.word_groups(t).alias("g"))
    return p.select("p_partkey", F.array_join(F.transform("g", lambda g: F.array_join(g.cast("array<string>"), ",")), ";").alias("words"))


@query(
    "bit_tokens",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size + 3) || '-' || p_size ELSE p_size || '-' || p_size || ';' || (p_size + 1) || '-' || (p_size + 1) END AS bits
    FROM part""",
)
def bit_tokens(spark, sf_dir):
    """Bit cells to (high, low) fields (SCL-19)."""
    s = F.col("p_size")
    t = F.when(s % 2 == 0, F.concat_ws("..", s, s + 3)).otherwise(F.concat_ws("/", s, s + 1))
    p = bridge.table(spark, sf_dir, "part").select("p_partkey", cells.bit_tokens(t).alias("b"))
    return p.select("p_partkey", F.array_join(F.transform("b", lambda b: F.concat_ws("-", b["high"], b["low"])), ";").alias("bits"))


@query(
    "selector_codec",
    """WITH s AS (SELECT p_partkey, p_size::VARCHAR AS t FROM part)
    SELECT p_partkey, CASE WHEN regexp_full_match(t, '[1-4]+') THEN
      CASE WHEN len(t) = 1 OR t[1] = t[2] THEN t[1] WHEN t[1] < t[2] THEN t ELSE t[2] || t[1] END END AS selector FROM s""",
)
def selector_codec(spark, sf_dir):
    """Subframe selectors decoded and encoded again (SCL-04)."""
    d = words.decode_selector(F.col("p_size").cast("string"))
    return bridge.table(spark, sf_dir, "part").select("p_partkey", words.encode_selector(d).alias("selector"))


@query(
    "word_formats",
    f"""WITH {SUB} SELECT rec AS recording_id, seq, lpad(bin(w), 12, '0') AS bin, format('{{:04o}}', w) AS oct, lpad(upper(hex(w)), 3, '0') AS hex
    FROM (SELECT rec, seq, {word_of('2')} AS w FROM sub)""",
)
def word_formats(spark, sf_dir):
    """Display formats of a word of every subframe (SCL-01)."""
    s = bridge.subframes(spark, sf_dir).select("recording_id", "seq", F.get("words", F.lit(1)).alias("w"))
    w = F.col("w")
    return s.select("recording_id", "seq", words.word_bin(w).alias("bin"), words.word_oct(w).alias("oct"), words.word_hex(w).alias("hex"))


@query(
    "hex_words_roundtrip",
    f"""WITH {SUB} SELECT rec AS recording_id, seq, string_agg(lpad(hex({word_of('k')}), 3, '0'), '' ORDER BY k) AS hex, true AS same
    FROM sub, range(1, 65) r(k) GROUP BY rec, seq""",
)
def hex_words_roundtrip(spark, sf_dir):
    """Words to a hex string and back (SCL-03)."""
    s = bridge.subframes(spark, sf_dir).select("recording_id", "seq", "words", words.words_to_hex(F.col("words")).alias("hex"))
    return s.select("recording_id", "seq", "hex", (words.hex_to_words(F.col("hex")) == F.col("words")).alias("same"))


@query(
    "frequency_evidence",
    """WITH r AS (SELECT p_brand AS document_id, p_size % 8 + 1 AS f, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 2 END AS n,
                   CASE WHEN p_type = 'LARGE' THEN 1 ELSE 4 END AS sfs FROM part),
    e AS (SELECT *, f * 4.0::DOUBLE / sfs AS hz, CASE WHEN 1.0::DOUBLE / f * 4 >= 1 THEN 1.0::DOUBLE / f * 4 / sfs END AS sec FROM r)
    SELECT document_id, count(*) FILTER (CASE WHEN n = 1 THEN hz = 1 ELSE hz IN (1, 2) END) AS hz_ok,
      count(*) FILTER (CASE WHEN n = 1 THEN sec = 1 ELSE sec IN (1, 2) END) AS seconds_ok, count(*) AS usable FROM e GROUP BY 1""",
)
def frequency_evidence(spark, sf_dir):
    """Whether a document's rates read as Hz or as seconds (AGG-08)."""
    s = F.col("p_size")
    p = bridge.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("document_id"), (s % 8 + 1).cast("string").alias("frequency"),
        F.when(F.col("p_type") == "PROMO", s.cast("string")).otherwise(F.concat_ws(", ", s, s + 100)).alias("word_location"),
        F.when(F.col("p_type") == "LARGE", "SF 2").otherwise("all").alias("subframe"),
    )
    return normalize.frequency_evidence(p)


@query(
    "duplicate_names",
    """WITH d AS (SELECT p_type AS document_id, p_partkey AS row_no, p_name AS m, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS descr FROM part),
    n AS (SELECT *, count(*) OVER (PARTITION BY document_id, upper(m)) AS times, row_number() OVER (PARTITION BY document_id, upper(m) ORDER BY row_no) AS nth FROM d)
    SELECT document_id, row_no, CASE WHEN times = 1 THEN m WHEN descr <> '' THEN m || ': ' || descr ELSE m || ' #' || nth END AS mnemonic FROM n""",
)
def duplicate_names(spark, sf_dir):
    """Repeated mnemonics made unique (NRM-11)."""
    p = bridge.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("document_id"), F.col("p_partkey").alias("row_no"), F.col("p_name").alias("mnemonic"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("description"), F.lit(None).cast("string").alias("failure"),
        F.array().cast("array<struct<severity:string,rule:string,field:string>>").alias("issues"),
    )
    return normalize.qualify_duplicates(p).select("document_id", "row_no", "mnemonic")


@query(
    "cell_accuracy",
    """WITH c AS (SELECT c_mktsegment AS column_name, c_name AS t, translate(c_name, '0l', 'O1') AS r FROM customer)
    SELECT column_name, count(*) AS cells, count(*) FILTER (t = r) AS exact, count(*) FILTER (t = r) AS loose,
      sum(levenshtein(t, r))::BIGINT AS edits, round(avg(levenshtein(t, r) / greatest(length(t), 1)::DOUBLE) + 3e-8, 6) AS mean_cer FROM c GROUP BY 1""",
)
def cell_accuracy(spark, sf_dir):
    """Read cells against the truth (AGG-12); read text has misread digits."""
    c = bridge.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("column_name"), F.col("c_name").alias("truth"), F.translate("c_name", "0l", "O1").alias("read"))
    return pages.accuracy(c, "column_name").withColumn("mean_cer", F.round(F.col("mean_cer") + 3e-8, 6))


@query(
    "stated_wps",
    """SELECT o_custkey AS document_id, CASE WHEN count(DISTINCT o_orderstatus = 'O') = 1 THEN CASE WHEN bool_or(o_orderstatus = 'O') THEN 128 ELSE 64 END END::BIGINT AS wps
    FROM orders GROUP BY 1""",
)
def stated_wps(spark, sf_dir):
    """Word rate a document states exactly once (AGG-11)."""
    rate = F.when(F.col("o_orderstatus") == "O", "recorded at 128 WPS").otherwise("64 words per second")
    p = bridge.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), rate.alias("text"))
    return pages.stated_wps(p).withColumn("wps", F.col("wps").cast("bigint"))


def document_rows(spark, sf_dir):
    s = F.col("p_size")
    return bridge.table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 64").cast("string").alias("document_id"), F.col("p_partkey").alias("row_no"), F.col("p_name").alias("parameter_name"),
        F.when(F.col("p_type") == "PROMO", "Discrete").when(F.col("p_type") == "SMALL", "BCD").when(s == 9, "odd").otherwise("BNR").alias("parameter_type"),
        F.when(s % 2 == 0, F.concat_ws(", ", s, s + 128)).otherwise(s.cast("string")).alias("word_location"), F.when(s > 40, "").otherwise("all").alias("subframe"),
        F.when(s == 33, "x").otherwise("12").alias("msb"), F.lit("3").alias("lsb"), F.when(s % 2 == 0, "2").otherwise("1").alias("frequency"),
        F.when(s != 11, (s / 8).cast("string")).alias("resolution"),
        *[F.lit(None).cast("string").alias(f) for f in ("mnemonic_and_name", "description", "sign", "bits", "units", "offset", "minimum", "maximum",
                                                          "true_state", "false_state", "notes")],
    )


@query(
    "layout_decision",
    """SELECT (p_partkey // 64)::VARCHAR AS document_id, p_partkey AS row_no, CASE WHEN p_size <> 33 THEN 'occurrences' END AS meaning,
      CASE WHEN p_size = 33 THEN NULL WHEN p_size % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS segments, CASE WHEN p_size = 33 THEN 'normalize.bits' END AS failure,
      CASE WHEN p_type IN ('PROMO') THEN 'discrete' WHEN p_type = 'SMALL' THEN 'bcd' WHEN p_size = 9 THEN 'unknown' ELSE 'analog_unsigned' END AS ptype
    FROM part""",
)
def layout_decision(spark, sf_dir):
    """Document rows normalized: type, layout, number of segments (NRM-03…06)."""
    n = normalize.normalize(document_rows(spark, sf_dir))
    count = F.when(F.col("segments").isNotNull(), F.size("segments"))
    return n.select("document_id", "row_no", "meaning", count.cast("bigint").alias("segments"), "failure", "ptype")


@query(
    "row_issues",
    """WITH r AS (SELECT p_size AS s, p_type, CASE WHEN p_type = 'PROMO' THEN 'd' WHEN p_type = 'SMALL' THEN 'b' WHEN p_size = 9 THEN 'u' ELSE 'a' END AS k FROM part)
    SELECT rule, count(*) AS n FROM (
      SELECT 'normalize.type' AS rule FROM r WHERE k = 'u' UNION ALL SELECT 'normalize.bits' FROM r WHERE s = 33
      UNION ALL SELECT 'normalize.subframe_blank' FROM r WHERE s > 40 UNION ALL SELECT 'normalize.resolution' FROM r WHERE s = 11 AND k = 'a'
      UNION ALL SELECT 'normalize.resolution_default' FROM r WHERE s = 11 AND k = 'b' UNION ALL SELECT 'normalize.discrete_width' FROM r WHERE k = 'd' AND s <> 33)
    GROUP BY 1""",
)
def row_issues(spark, sf_dir):
    """Normalization issues per rule (NRM-01…09)."""
    # Written once: exploding the issues would otherwise fold every rule into one expression.
    n = materialize(normalize.normalize(document_rows(spark, sf_dir))).select(F.explode("issues").alias("i"))
    return n.groupBy(F.col("i.rule").alias("rule")).agg(F.count("*").alias("n"))


__all__ = ["document_rows"]
