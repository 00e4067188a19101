"""Table cells to document rows, over tables made of the part table.

Sixteen parts make a document with one part per table row; every third part
continues on the next row, and the second half of a document is a table of its
own that has no header and inherits the first one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import normalize
from ..session import materialize
from . import bridge
from .registry import query

HEADER = ("Name", " Word  No. ", "Sub-Frame", "MSB", "Lsb.", "Descripti0n")


def _cells(spark, sf_dir) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    part = bridge.table(spark, sf_dir, "part").select(
        F.concat(F.lit("T"), F.expr("p_partkey div 16").cast("string")).alias("document_id"), (k % 16).cast("int").alias("i"), k.alias("k"), s.alias("s"))
    half = F.floor(F.col("i") / 8).cast("int")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    row = F.array(F.concat(F.lit("N"), text("k")), text("s"), F.lit("all"), F.lit("12"), F.lit("3"), F.concat(F.lit("first  "), text("k")))
    tail = F.array(*[F.lit("")] * 5, F.concat(F.lit("more "), text("k")))
    at = F.col("i") % 8 * 2 + 2
    place = lambda no, texts: F.struct(no.alias("row_no"), texts.alias("texts"))
    rows = part.select(
        "document_id", (half + 1).alias("table_no"), (half + 1).alias("page"),
        F.explode(F.when(F.col("s") % 3 == 0, F.array(place(at, row), place(at + 1, tail))).otherwise(F.array(place(at, row)))).alias("r"))
    heads = part.select("document_id").distinct().select(
        "document_id", F.lit(1).alias("table_no"), F.lit(1).alias("page"), F.explode(F.array(F.lit(1), F.lit(20))).alias("row_no"),
        F.array(*[F.lit(x) for x in HEADER]).alias("texts"))
    odd = part.select("document_id").distinct().select(
        "document_id", F.lit(9).alias("table_no"), F.lit(3).alias("page"), F.lit(1).alias("row_no"), F.array(F.lit("a"), F.lit("b")).alias("texts"))
    every = rows.select("document_id", "table_no", "page", "r.row_no", "r.texts").unionByName(heads).unionByName(odd)
    return every.select(
        "document_id", "page", "table_no", "row_no", F.posexplode("texts").alias("c", "text"),
    ).select(
        "document_id", "page", "table_no", "row_no", (F.col("c") + 1).alias("col_no"), "text", F.lit(0.9).alias("confidence"), F.lit("ocr").alias("source"),
        F.lit(None).cast("string").alias("note"))


@query(
    "rows_from_cells",
    """SELECT 'T' || CAST(p_partkey // 16 AS VARCHAR) AS document_id, 'N' || p_partkey AS parameter_name, p_size::VARCHAR AS word_location, 'all' AS subframe,
      '12' AS msb, '3' AS lsb, 'first ' || p_partkey || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'more ' || p_partkey ELSE '' END AS description,
      p_size % 3 = 0 AS continued FROM part""",
)
def rows_from_cells(spark, sf_dir):
    """Cells to rows: damaged headers, an inherited one, continuation rows (NRM-01, WIN-07, WIN-08, SCL-12 to SCL-16)."""
    rows, _ = normalize.rows_from_cells(materialize(_cells(spark, sf_dir)))
    return rows.select("document_id", "parameter_name", "word_location", "subframe", "msb", "lsb", "description", "continued")


@query("skipped_tables", "SELECT DISTINCT 'T' || CAST(p_partkey // 16 AS VARCHAR) AS document_id, 9::BIGINT AS table_no, 'PDF_TABLE_SKIPPED' AS code FROM part")
def skipped_tables(spark, sf_dir):
    _, skipped = normalize.rows_from_cells(materialize(_cells(spark, sf_dir)))
    return skipped.select("document_id", F.col("table_no").cast("bigint").alias("table_no"), "code")


# Header as printed, its normal form, the field it means and how it was found.
PRINTED = (
    (" Word  No. ", "WORD NO", "word_location", 1), ("Sub-Frame", "SUB FRAME", "subframe", 1), ("Parameter(s)", "PARAMETERS", "parameter_name", 2),
    ("Resolutlon", "RESOLUTLON", "resolution", 2), ("1 =", "1 =", "true_state", 1), ("xyzzy plugh", "XYZZY PLUGH", None, 2), ("", "", None, 2),
    ("our own", "OUR OWN", "notes", 0), ("Freq. (Hz)", "FREQ HZ", "frequency", 1),
)


@query(
    "header_mapping",
    "SELECT p_partkey, h.key, h.field, h.rank::BIGINT AS rank FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{k}', {'NULL' if f is None else repr(f)}, {r})" for i, (_, k, f, r) in enumerate(PRINTED))
    + f") h(i, key, field, rank) ON p_partkey % {len(PRINTED)} = h.i",
)
def header_mapping(spark, sf_dir):
    """Printed headers to fields: own choice, exact, similar, unknown (SCL-12, SCL-13)."""
    printed = F.get(F.array(*[F.lit(p[0]) for p in PRINTED]), (F.col("p_partkey") % len(PRINTED)).cast("int"))
    p = bridge.table(spark, sf_dir, "part").select("p_partkey", cells.normalize_header(printed).alias("key"))
    p = p.withColumn("h", cells.header_field(F.col("key"), {"OUR OWN": "notes"}))
    return p.select("p_partkey", "key", F.col("h.field").alias("field"), F.col("h.rank").cast("bigint").alias("rank"))


@query(
    "cell_repairs",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN '' ELSE p_size::VARCHAR END AS value, p_partkey % 6 IN (1, 2, 3) AS fixed,
      CASE WHEN p_partkey % 2 = 0 THEN 'UP ' || p_size END AS one, CASE WHEN p_partkey % 2 = 0 THEN 'DOWN' END AS zero FROM part""",
)
def cell_repairs(spark, sf_dir):
    """Placeholders, misread digits, scan dirt, states in text (SCL-16, SCL-24 to SCL-27)."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    misread = F.translate(n, "018", "OlB")
    cell = F.when(k % 6 == 5, " N/A ").when(k % 6 == 1, F.concat(F.lit("~ "), n)).when(k % 6 == 2, F.concat(F.lit("0"), misread, F.lit("O0"))).when(
        k % 6 == 3, F.concat(F.lit(". "), n, F.lit(" '"))).otherwise(n)
    # a leading zero and two trailing ones make sure that the third kind is always damaged
    read = cells.repaired(cells.cell_value(cell), lambda t: F.when(t.rlike("^[0-9]+$"), t))
    value = F.when(k % 6 == 2, (F.expr("try_cast(v.value as bigint) div 100")).cast("string")).otherwise(F.coalesce("v.value", F.lit("")))
    state = cells.states_from_text(F.when(k % 2 == 0, F.concat(F.lit("1 = UP "), n, F.lit("; 0: DOWN"))).otherwise("no states"))
    p = bridge.table(spark, sf_dir, "part").select("p_partkey", read.alias("v"), state.alias("s"))
    return p.select("p_partkey", value.alias("value"), "v.fixed", "s.one", "s.zero")
