"""Small tables for the tests, with columns whose names clash with the operators' own."""

from __future__ import annotations

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
CLASHING = {"row": "r", "size": 7, "kept": True, "tie": 1, "fp": 2, "score": 0.5, "copies": 9, "digest": "x", "part": 3}


def documents(spark, rows, extra=CLASHING):
    """doc_id, text, lang, source and the clashing columns."""
    names = ["doc_id", "text", "lang", "source", *extra]
    kinds = {str: "string", int: "long", bool: "boolean", float: "double"}
    schema = "doc_id long, text string, lang string, source string" + "".join(f", {k} {kinds[type(v)]}" for k, v in extra.items())
    full = [tuple(r) + (None,) * (4 - len(r)) + tuple(extra.values()) for r in rows]
    df = spark.createDataFrame(full, schema)
    assert df.columns == names
    return df


def texts(sf=SF):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["lang"], t["source"]))


def records(df):
    return [r.asDict() for r in df.collect()]
