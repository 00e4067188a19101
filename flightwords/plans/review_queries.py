"""Review of normalized rows and page reports, over items made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words
from ..operators import pages, review, series
from . import bridge
from .decode_queries import samples
from .registry import query
from .sqltext import SMP, SUB, word_of

# One item per part: every state, with failures, issues of both layers and exclusions.
# item(doc, pid, state, excluded, failure, sev, v_err, v_all, errors)
ITEM = """
item AS (
  SELECT 'R' || CAST(p_partkey // 8 AS VARCHAR) AS doc, 'p' || p_partkey AS pid,
         ['EXTRACTED', 'NORMALIZED', 'REVIEW_REQUIRED', 'VALIDATED', 'APPROVED', 'PUBLISHED'][p_size % 6 + 1] AS state,
         p_partkey % 11 = 0 AS excluded, CASE WHEN p_size % 13 = 0 THEN 'no words' END AS failure,
         CASE p_size % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' END AS sev,
         CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS v_err, CASE WHEN p_size % 7 IN (0, 3) THEN 2 ELSE 0 END AS v_all
  FROM part),
counted AS (SELECT *, v_err + (CASE WHEN sev = 'error' THEN 1 ELSE 0 END) AS errors FROM item),
settled AS (
  SELECT * REPLACE (CASE WHEN excluded OR state IN ('EXTRACTED', 'PUBLISHED') THEN state
    WHEN state = 'APPROVED' THEN CASE WHEN v_err > 0 THEN 'REVIEW_REQUIRED' ELSE state END
    WHEN failure IS NOT NULL OR sev IN ('error', 'warning') OR v_err > 0 THEN 'REVIEW_REQUIRED' ELSE 'VALIDATED' END AS state) FROM counted),
approved AS (
  SELECT * REPLACE (CASE WHEN state = 'VALIDATED' AND NOT excluded AND failure IS NULL AND coalesce(sev, '') NOT IN ('error', 'warning') AND v_all = 0
    THEN 'APPROVED' ELSE state END AS state) FROM settled)
"""


def _items(spark, sf_dir) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    states = F.array(*[F.lit(x) for x in ("EXTRACTED", "NORMALIZED", "REVIEW_REQUIRED", "VALIDATED", "APPROVED", "PUBLISHED")])
    severity = F.when(s % 5 == 0, "error").when(s % 5 == 1, "warning").when(s % 5 == 2, "info")
    issue = F.struct(severity.alias("severity"), F.lit("rule").alias("rule"), F.lit("field").alias("field"))
    none = F.array().cast("array<struct<severity:string,rule:string,field:string>>")
    v_err, v_all = F.when(s % 7 == 0, 1).otherwise(0), F.when((s % 7).isin(0, 3), 2).otherwise(0)
    return bridge.table(spark, sf_dir, "part").select(
        F.concat(F.lit("R"), F.expr("p_partkey div 8").cast("string")).alias("document_id"), F.concat(F.lit("p"), k.cast("string")).alias("param_id"),
        F.get(states, s % 6).alias("state"), (k % 11 == 0).alias("excluded"), F.when(s % 13 == 0, "no words").alias("failure"),
        F.when(severity.isNotNull(), F.array(issue)).otherwise(none).alias("issues"), v_err.alias("validation_errors"), v_all.alias("validation_issues"),
        (v_err + F.when(s % 5 == 0, 1).otherwise(0)).alias("errors"),
    )


@query("review_settled", f"WITH {ITEM} SELECT doc AS document_id, pid AS param_id, state FROM settled")
def review_settled(spark, sf_dir):
    """States after a validation (REV-01)."""
    return review.settle(_items(spark, sf_dir)).select("document_id", "param_id", "state")


@query(
    "review_states",
    f"""WITH {ITEM}, shown AS (SELECT doc, CASE WHEN excluded THEN 'EXCLUDED' ELSE state END AS state FROM approved)
    SELECT d.doc AS document_id, s.state, count(x.state) AS n
    FROM (SELECT DISTINCT doc FROM shown) d CROSS JOIN (VALUES ('EXTRACTED'), ('NORMALIZED'), ('REVIEW_REQUIRED'), ('VALIDATED'), ('APPROVED'), ('PUBLISHED'), ('EXCLUDED')) s(state)
    LEFT JOIN shown x ON x.doc = d.doc AND x.state = s.state GROUP BY ALL""",
)
def review_states(spark, sf_dir):
    """Rows per document and state after automatic approval (AGG-06, REV-02)."""
    return review.state_counts(review.auto_approve(review.settle(_items(spark, sf_dir)))).select("document_id", "state", "n")


@query(
    "review_publishable",
    f"""WITH {ITEM}, g AS (SELECT doc, count(*) FILTER (NOT excluded AND state NOT IN ('APPROVED', 'PUBLISHED')) AS pending,
      count(*) FILTER (NOT excluded AND state = 'APPROVED') AS approved FROM approved GROUP BY doc)
    SELECT doc AS document_id, pending, approved,
      CASE WHEN pending > 0 THEN 'rows still need review' WHEN approved = 0 THEN 'nothing to publish' END AS problem FROM g""",
)
def review_publishable(spark, sf_dir):
    """What keeps a document from being published (REV-04)."""
    return review.publishable(review.auto_approve(review.settle(_items(spark, sf_dir))))


# Every third item gets a decision, some of them two; the later one holds.
DECISION = "CASE k % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'exclude' WHEN 2 THEN 'include' ELSE 'edit' END"
DECIDED = f"""{ITEM},
dc AS (SELECT *, CAST(substr(pid, 2) AS BIGINT) AS k FROM settled),
dec AS (SELECT *, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 5 = 0 THEN 'approve' ELSE {DECISION} END END AS action FROM dc),
why AS (SELECT *, CASE WHEN action IS NULL THEN NULL WHEN state = 'PUBLISHED' THEN 'already published'
  WHEN action = 'approve' AND excluded THEN 'excluded rows cannot be approved'
  WHEN action = 'approve' AND failure IS NOT NULL THEN 'no parameter could be built'
  WHEN action = 'approve' AND errors > 0 THEN 'errors must be fixed before approval' END AS problem FROM dec)
"""


def _decided(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    items = review.settle(_items(spark, sf_dir)).drop("previous")
    k = F.substr("param_id", F.lit(2)).cast("bigint")
    kinds = F.array(*[F.lit(x) for x in (review.APPROVE, review.EXCLUDE, review.INCLUDE, review.EDIT)])
    rows = items.filter(k % 3 == 0).select("document_id", "param_id", k.alias("k"))
    first = rows.select("document_id", "param_id", F.get(kinds, (F.col("k") % 4).cast("int")).alias("action"), F.lit(1).alias("at"))
    later = rows.filter("k % 5 = 0").select("document_id", "param_id", F.lit(review.APPROVE).alias("action"), F.lit(2).alias("at"))
    return review.decide(items, first.unionByName(later))


@query(
    "review_decided",
    f"""WITH {DECIDED} SELECT doc AS document_id, pid AS param_id,
      CASE WHEN action = 'approve' AND problem IS NULL THEN 'APPROVED' ELSE state END AS state,
      CASE WHEN problem IS NULL AND action = 'exclude' THEN true WHEN problem IS NULL AND action IN ('include', 'edit') THEN false ELSE excluded END AS excluded FROM why""",
)
def review_decided(spark, sf_dir):
    """Items after the latest decision on each (REV-02, REV-03)."""
    return _decided(spark, sf_dir)[0].select("document_id", "param_id", "state", "excluded")


@query("review_refused", f"WITH {DECIDED} SELECT doc AS document_id, pid AS param_id, action, problem FROM why WHERE problem IS NOT NULL")
def review_refused(spark, sf_dir):
    return _decided(spark, sf_dir)[1]


@query(
    "scan_summary",
    """SELECT o_custkey AS document_id, count(*) AS pages, count(*) FILTER (o_orderkey % 10 >= 8) AS scanned,
      count(*) FILTER (o_orderkey % 10 >= 8 AND o_orderpriority = '1-URGENT') AS with_text_layer FROM orders GROUP BY 1""",
)
def scan_summary(spark, sf_dir):
    """Scanned pages of each document (AGG-13)."""
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "text").when(F.col("o_orderpriority") == "5-LOW", " ")
    p = bridge.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), ((F.col("o_orderkey") % 10) / 10).alias("image_coverage"), text.alias("text"))
    return pages.scan_summary(p)


@query("row_confidence", "SELECT l_orderkey AS document_id, l_suppkey AS row_no, min(l_discount) AS confidence FROM lineitem GROUP BY 1, 2")
def row_confidence(spark, sf_dir):
    """The weakest cell of every row (AGG-14)."""
    c = bridge.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.col("l_suppkey").alias("row_no"),
        F.col("l_discount").alias("confidence"))
    return pages.row_confidence(c).select("document_id", "row_no", "confidence")


@query(
    "character_error_rate",
    """SELECT c_custkey, levenshtein(CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END, translate(c_name, '0', 'O'))
      / greatest(length(CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END), 1)::DOUBLE AS cer FROM customer""",
)
def character_error_rate(spark, sf_dir):
    """Character error rate of misread names; a placeholder counts as empty (SCL-33)."""
    truth = F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.col("c_name"))
    return bridge.table(spark, sf_dir, "customer").select(
        "c_custkey", pages.character_error_rate(truth, F.translate("c_name", "0", "O")).alias("cer"))


@query(
    "word_texts",
    f"""WITH {SUB} SELECT rec AS recording_id, seq, {word_of('3')}::BIGINT AS from_hex, {word_of('3')}::BIGINT AS from_octal,
      CASE WHEN c % 7 = 0 THEN NULL ELSE {word_of('3')} END::BIGINT AS from_decimal, (c % 65536) < 4096 AS container_valid FROM sub""",
)
def word_texts(spark, sf_dir):
    """Words written and read back, some out of range, and 16-bit containers (SCL-01, SCL-34)."""
    s = bridge.subframe_headers(spark, sf_dir)
    w = bridge.word_values(F.col("c"), F.col("subframe"))[2]
    decimal = F.when(F.col("c") % 7 == 0, (w + 4096).cast("string")).otherwise(words.word_dec(w))
    return s.select(
        "recording_id", "seq", words.parse_word(F.concat(F.lit("0x"), words.word_hex(w)), 16).cast("bigint").alias("from_hex"),
        words.parse_word(words.word_oct(w), 8).cast("bigint").alias("from_octal"), words.parse_word(decimal, 10).cast("bigint").alias("from_decimal"),
        words.container_valid((F.col("c") % 65536).cast("int")).alias("container_valid"),
    )


@query(
    "status_matrix",
    f"""WITH {SMP} SELECT rec AS recording_id, pid AS param_id, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'OUT_OF_RANGE') AS out_of_range,
      count(*) FILTER (status = 'INVALID_BCD') AS invalid_bcd, count(*) FILTER (status = 'INVALID_MAPPING') AS invalid_mapping,
      count(*) FILTER (status = 'UNSUPPORTED_TYPE') AS unsupported_type FROM smp GROUP BY ALL""",
)
def status_matrix(spark, sf_dir):
    """One column per status (AGG-01)."""
    m = series.status_matrix(samples(spark, sf_dir), "recording_id", "param_id")
    return m.select("recording_id", "param_id", "valid", "out_of_range", "invalid_bcd", "invalid_mapping", "unsupported_type")


@query(
    "rate_at",
    f"""WITH {SUB}, a AS (SELECT rec, t_end AS t FROM sub WHERE state <> 'MISSING'),
    n AS (SELECT rec, t_end + 1.5 AS now FROM sub WHERE seq % 7 = 0 UNION SELECT rec, t_end + 100000 FROM sub WHERE seq % 11 = 0)
    SELECT n.rec AS recording_id, n.now, coalesce(count(a.t) * 64 / greatest(n.now - min(a.t), 0.25), 0)::DOUBLE AS word_rate
    FROM n LEFT JOIN a ON a.rec = n.rec AND a.t BETWEEN n.now - 2 AND n.now GROUP BY n.rec, n.now""",
)
def rate_at(spark, sf_dir):
    """Word rate at given instants, some long after the last arrival (STR-08)."""
    h = bridge.subframe_headers(spark, sf_dir)
    arrivals = h.filter("state <> 'MISSING'").select("recording_id", F.col("t_end").alias("t"), F.lit(64).alias("n_words"))
    soon = h.filter("seq % 7 = 0").select("recording_id", (F.col("t_end") + 1.5).alias("now"))
    late = h.filter("seq % 11 = 0").select("recording_id", (F.col("t_end") + 100000).alias("now"))
    return series.rate_at(arrivals, soon.union(late).distinct())
