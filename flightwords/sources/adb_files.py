"""ADB mapping files: many small CSV documents in and out."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The code points windows-1252 places in 0x80..0x9F, in byte order
# (five bytes are undefined and keep their control character).
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
C1 = "".join(chr(c) for c in range(0x80, 0xA0))

# Records that a worker holds before it hands them on.
HELD = 512

RECORDS = "document_id string, source_hash string, record_index int, fields array<string>"


def file_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8 (BOM dropped), else windows-1252."""
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    latin = F.translate(F.decode(content, "ISO-8859-1"), C1, CP1252)
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(latin)


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records as the ``csv`` module reads them: the model that ``records_of`` is tested against."""
    names = ["document_id", "source_hash", "record_index", "fields"]
    for pdf in batches:
        out = []
        for doc, digest, text in zip(pdf["document_id"], pdf["source_hash"], pdf["text"]):
            records = (r for r in csv.reader(io.StringIO(text, newline="")) if any(f.strip() for f in r))
            for i, r in enumerate(records):
                out.append((doc, digest, i, r))
                if len(out) >= HELD:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)


# One CSV field: quoted up to the closing quote (or the end of the text), then whatever
# stands before the next delimiter.  Nothing is tried twice, so no text is too long.
QUOTED = r'(?:"([^"]*+(?:""[^"]*+)*+)(?:"|\z))'
REST = r"[^,\r\n]*+"
FIELD = QUOTED.replace('([^"]*', '(?:[^"]*') + "?+" + REST
RECORD = f"((?:{FIELD})(?:,{FIELD})*+)(?:\r\n|\r|\n|\\z)"
# White space as ``str.strip`` takes it.
BLANK = r"^[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\z"


def _fields(record: Column) -> Column:
    """The fields of one record without its line end."""
    def one(field: Column) -> Column:
        inner = F.replace(F.regexp_extract(field, QUOTED, 1), F.lit('""'), F.lit('"'))
        rest = F.regexp_extract(field, f"^{QUOTED}({REST})", 2)
        return F.when(F.startswith(field, F.lit('"')), F.concat(inner, rest)).otherwise(field)

    # a delimiter before each field, so that none of them is empty to the search
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({FIELD})"), F.lit(1)), one)


def records_of(files: DataFrame) -> DataFrame:
    """(document_id, content) → one row per CSV record (SRC-06), numbered from 0
    without blank ones.  Only expressions: no worker holds batches of whole files."""
    texts = files.select("document_id", F.sha2("content", 256).alias("source_hash"), file_text(F.col("content")).alias("text"))
    every = F.transform(F.regexp_extract_all("text", F.lit(RECORD), F.lit(1)), _fields)
    filled = F.filter(every, lambda fields: F.exists(fields, lambda f: ~F.rlike(f, F.lit(BLANK))))
    return texts.select("document_id", "source_hash", F.posexplode(filled).alias("record_index", "fields"))


def read_adb(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, or documents that ``write_adb`` wrote."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    written = F.url_decode(F.nullif(F.regexp_extract("path", r"/document_id=([^/]+)/[^/]*$", 1), F.lit("")))
    named = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return records_of(files.select(F.coalesce(written, named).alias("document_id"), "content"))


def csv_line(fields: Column) -> Column:
    """One CSV record, quoted only where needed."""
    return F.array_join(
        F.transform(fields, lambda f: F.when(f.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f)),
        ",",
    )


def contents(records: DataFrame) -> DataFrame:
    """Records back to file bytes: CRLF lines, windows-1252 (SNK-04)."""
    line = F.struct("record_index", csv_line(F.col("fields")).alias("line"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\r\n"), F.lit("\r\n"))
    d = records.groupBy("document_id").agg(text.alias("text"))
    unmapped = F.regexp_replace(F.translate("text", CP1252, C1), r"[^\x{0}-\x{ff}]", "?")
    return d.select("document_id", F.encode(unmapped, "ISO-8859-1").alias("content"))


def write_adb(files: DataFrame, folder: str) -> None:
    """Write each document's bytes under its own folder, through Spark's writer.

    A text is written as the bytes it holds; the writer adds the last line end.
    """
    end = F.octet_length("content") - 2
    text = F.substring(F.col("content"), F.lit(1), end).cast("string")
    rows = files.select("document_id", text.alias("value")).repartition("document_id")
    rows.write.partitionBy("document_id").option("lineSep", "\r\n").text(folder)
