"""Extracted document cells, and the catalog of mapping documents as tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENTS, PARAMETERS, RAW_CELLS, SEGMENTS
from ..session import broadcast_if_small

# The tables of a catalog, each a Parquet folder under one root.
CATALOG = {
    "dataframe_documents": DOCUMENTS,
    "parameters": PARAMETERS,
    "parameter_segments": SEGMENTS,
    "parameter_occurrences": "document_id STRING, param_id STRING, occ INT",
    "source_fields": "document_id STRING, param_id STRING, field_name STRING, raw_text STRING, normalized_value STRING, "
                     "page_number INT, confidence DOUBLE, reviewed BOOLEAN",
    "validation_issues": "document_id STRING, severity STRING, rule STRING, param_id STRING, related_id STRING, message STRING",
    "review_history": "document_id STRING, param_id STRING, from_state STRING, to_state STRING, timestamp TIMESTAMP, note STRING",
    "adb_legacy_fields": "document_id STRING, param_id STRING, scope STRING, position INT, value STRING",
}


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Already extracted table cells (SRC-09)."""
    reader = spark.read.schema(RAW_CELLS)
    return reader.csv(path, header=True, multiLine=True) if fmt == "csv" else reader.format(fmt).load(path)


MANIFEST = "document_id STRING, version BIGINT"


def save(tables: dict[str, DataFrame], root: str) -> int:
    """Save documents in the catalog (SNK-05); those saved before are replaced. Returns the version.

    Rows of all tables are appended under a new version, and the manifest, which
    says whose documents' version this is, comes last: readers see a document
    whole, as it was before or as it is after, and nothing is rewritten.  Other
    documents keep the version they have.
    """
    spark = tables["dataframe_documents"].sparkSession
    version = (_manifest(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    for name, df in tables.items():
        columns = [c.split()[0] for c in _fields(CATALOG[name])]
        df.select(*columns, F.lit(version).cast("bigint").alias("version")).write.mode("append").parquet(f"{root}/{name}")
    saved = spark.read.schema(f"{CATALOG['dataframe_documents']}, version BIGINT").parquet(f"{root}/dataframe_documents")
    saved.filter(F.col("version") == version).select("document_id", "version").distinct().write.mode("append").parquet(f"{root}/manifest")
    return version


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the catalog; empty where nothing was saved."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/manifest", MANIFEST)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that counts of every document."""
    return _manifest(spark, root).groupBy("document_id").agg(F.max("version").alias("version"))


def _fields(ddl: str) -> list[str]:
    depth, out, cur = 0, [], ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def load(spark: SparkSession, root: str, name: str, document_id: str | None = None) -> DataFrame:
    """Rows of the documents as they were saved last."""
    df = _read(spark, f"{root}/{name}", f"{CATALOG[name]}, version BIGINT")
    now = current(spark, root)
    if document_id is not None:
        df, now = (x.filter(F.col("document_id") == document_id) for x in (df, now))
    return df.join(broadcast_if_small(now), ["document_id", "version"]).drop("version")


def list_documents(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "dataframe_documents")
    n = load(spark, root, "parameters").groupBy("document_id").agg(F.count("*").alias("parameters"))
    return docs.join(n, "document_id", "left").select(
        "document_id", "name", "aircraft_type", "revision", "wps", "source_type", "status", F.coalesce("parameters", F.lit(0)).alias("parameters")
    )


def legacy_fields(documents: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Raw fields to preserve: settings of a document, records of its parameters."""
    out = documents.filter("settings_raw IS NOT NULL").select(
        "document_id", F.lit(None).cast("string").alias("param_id"), F.lit("settings").alias("scope"), F.posexplode("settings_raw").alias("position", "value")
    )
    if records is not None:
        rows = records.select("document_id", "param_id", F.posexplode("fields").alias("position", "value"))
        out = out.unionByName(rows.withColumn("scope", F.when(F.col("position") < 238, "parameter_record").otherwise("parameter_trailing")))
    return out
