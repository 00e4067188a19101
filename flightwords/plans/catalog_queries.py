"""The catalog of mapping documents: saved, saved again, listed."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import tables
from .bridge import part_mapping
from .decode_queries import long
from .registry import query
from .sqltext import PART


def _whole(df: DataFrame, ddl: str) -> DataFrame:
    """All columns of a table; those that ``df`` lacks are null."""
    kinds = dict(c.split(None, 1) for c in tables._fields(ddl))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def _saved(spark, sf_dir) -> str:
    """All part documents, then every third of them again: fewer parameters, a revision, raw settings."""
    docs, pars, segs = part_mapping(spark, sf_dir)
    root = os.path.join(checkpoint_dir(spark), f"catalog-{uuid.uuid4().hex}")
    number = F.substr("document_id", F.lit(2)).cast("bigint")
    again = docs.filter(number % 3 == 0).withColumn("revision", F.lit("B")).withColumn("settings_raw", F.array(F.lit("Setting"), F.lit("1"), "name"))
    for d, p, s in ((docs, pars, segs), (again, pars.filter((number % 3 == 0) & (F.col("param_ord") <= 40)), segs.filter(number % 3 == 0))):
        s = s.join(p.select("document_id", "param_id"), ["document_id", "param_id"], "left_semi")
        d = _whole(d, tables.CATALOG["dataframe_documents"])
        tables.save({
            "dataframe_documents": d, "parameters": _whole(p, tables.CATALOG["parameters"]), "parameter_segments": _whole(s, tables.CATALOG["parameter_segments"]),
            "adb_legacy_fields": tables.legacy_fields(d),
        }, root)
    return root


@query(
    "catalog_documents",
    f"""WITH {PART}, own AS (SELECT doc, count(*) FILTER (substr(doc, 2)::BIGINT % 3 <> 0 OR ord <= 40) AS n FROM ppar GROUP BY doc)
    SELECT doc AS document_id, CASE WHEN substr(doc, 2)::BIGINT % 3 = 0 THEN 'B' END AS revision, wps::BIGINT AS wps, n AS parameters FROM pdoc JOIN own USING (doc)""",
)
def catalog_documents(spark, sf_dir):
    """The documents of a catalog in which some were replaced (SNK-05)."""
    return tables.list_documents(spark, _saved(spark, sf_dir)).select("document_id", "revision", long("wps"), "parameters")


@query(
    "catalog_roundtrip",
    f"""WITH {PART}, seg AS (SELECT s.doc, s.pid, s.seq, s.word FROM pseg s JOIN ppar p USING (pid) WHERE substr(s.doc, 2)::BIGINT % 3 <> 0 OR p.ord <= 40),
    old AS (SELECT doc FROM pdoc WHERE substr(doc, 2)::BIGINT % 3 = 0)
    SELECT doc AS document_id, 'segment' AS kind, pid || ':' || word AS item, seq::BIGINT AS place FROM seg
    UNION ALL SELECT doc, 'settings', v, i - 1 FROM (SELECT doc, unnest(['Setting', '1', doc]) AS v, generate_subscripts(['Setting', '1', doc], 1) AS i FROM old)""",
)
def catalog_roundtrip(spark, sf_dir):
    """Segments and raw fields as the catalog gives them back (SNK-05)."""
    root = _saved(spark, sf_dir)
    segments = tables.load(spark, root, "parameter_segments")
    raw = tables.load(spark, root, "adb_legacy_fields").filter("scope = 'settings'")
    return segments.select("document_id", F.lit("segment").alias("kind"), F.concat_ws(":", "param_id", "word").alias("item"), long("seq").alias("place")).unionByName(
        raw.select("document_id", F.lit("settings").alias("kind"), F.col("value").alias("item"), F.col("position").cast("bigint").alias("place")))
