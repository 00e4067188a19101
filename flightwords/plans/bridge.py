"""Recorder tables derived from the given relational tables.

The given tables hold no recordings, so every order is read as one recorded
subframe (its words follow from its price), every part as one mapped parameter
and so on.  Each derivation exists twice: as DataFrames here and as SQL text in
``oracles`` for the result check.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import apart
from ..schemas import DOCUMENTS, INVALID, MISSING, PARAMETERS, RECEIVED, SEGMENTS, SYNC_WORDS

WPS = 64
DOCUMENT_ID = "DOC-64"
EPOCH = 1.7e9
#: Rows of a source that one task turns into subframes and samples, about.
TASK_ROWS = 65_536

ALL = (1, 2, 3, 4)


def _mapping() -> list[dict]:
    """One mapping document that covers every type, shape and status.

    A rule, not a table: each kind of field comes in several widths, named by its
    letter and its bits (or digits), and words are handed out in order.  The
    faults come last.  A segment is (subframes, word, lsb, msb, weight).
    """
    word = itertools.count(3)
    turns = itertools.cycle([(1, 2), (2, 3, 4), (3,), ALL, (1, 4)])
    rows = []

    def add(pid, ptype, occs, unit=None, lo=None, hi=None, res=1.0, off=0.0, formula="linear", true=None, false=None, states=(), about=""):
        rows.append(dict(pid=pid, name=f"FIELD {pid}", ptype=ptype, occs=occs, unit=unit, lo=lo, hi=hi, res=res, off=off,
                         formula=formula, true=true, false=false, states=states, description=about or f"A field of kind {pid}"))

    def field(width, sfs, lsb=1):
        return [(sfs, next(word), lsb, lsb + width - 1, None)]

    for digits in (3, 2):  # packed decimal digits, without and with weights
        add(f"B{digits}", "bcd", [field(4 * digits, next(turns))], "C" if digits == 3 else None, 0.0, 65.0 * 10 ** (digits - 2))
    for digits in (2, 3):
        w, sfs = next(word), next(turns)
        parts = [(sfs, w, 9 - 4 * k, 12 - 4 * k, 10.0 ** (digits - 1 - k)) for k in range(digits)]
        add(f"W{digits}", "bcd", [parts], "l", 0.0, 450.0)
    for width, sfs in ((24, (2, 4)), (12, (1, 3))):  # bits as they are
        add(f"R{width}", "raw", [field(12, sfs) + (field(12, sfs) if width > 12 else [])], "C")
    for width in (12, 11):
        add(f"U{width}", "analog_unsigned", [field(width, next(turns))], "C", 2.0, 900.0, width / 48, about=f"Unsigned temperature of {width} bits")
    w = next(word)  # written from high to low, with a falling scale
    add("U8", "analog_unsigned", [[((1, 2, 4), w, 10, 3, None)]], "pct", -30.0, 35.0, -0.25, 30.0)
    shared = next(word)  # a word of single flags
    add("D2", "discrete", [[((2, 4), shared, 5, 6, None)]], states=((0, "NONE"), (1, "LEFT"), (2, "")), true="BOTH")
    add("D1", "discrete", [[(ALL, shared, 9, 9, None)]], "none", true="OPEN", false="SHUT")
    for width, times, res in ((5, 1, 2.0), (10, 2, 0.3), (12, 1, 0.125)):  # also several samples a subframe
        add(f"S{width}", "analog_signed", [field(width, (1, 3) if times > 1 else (2, 3), lsb=13 - width) for _ in range(times)], "C", -60.0, 120.0, res,
            about=f"Signed temperature of {width} bits")
    for name, widths, res in (("S21", (9, 12), 0.5), ("S30", (10, 12, 8), 0.00125)):  # several words a value, highest first
        add(name, "analog_signed", [[(ALL, next(word), 1, w, None) for w in widths]], "kg", -1000.0 if name == "S21" else None, 300000.0 if name == "S21" else None, res)
    add("X12", "unknown", [field(12, (4,))])
    add("FTABLE", "analog_signed", [field(12, (3,))], formula="table")
    add("FNONE", "analog_signed", [])
    add("FEMPTY", "analog_unsigned", [[]])
    add("FWORD", "analog_unsigned", [[((2, 3), WPS + 6, 1, 12, None)]])
    w = next(word)
    add("FBIT", "bcd", [[((1, 4), w, 1, 8, None), ((1, 4), w, 9, 13, None)]])
    w = next(word)
    add("FSPLIT", "analog_signed", [[((3,), w, 1, 12, None), ((4,), w, 1, 12, None)]], "C")
    add("FSLOT", "raw", [[((2, 7), next(word), 1, 12, None)]])
    return rows


MAPPING = _mapping()


def word_at(pid: str, occ: int = 1, segment: int = 1) -> int:
    """The word of a segment of the mapping."""
    return next(p for p in MAPPING if p["pid"] == pid)["occs"][occ - 1][segment - 1][1]


def literal_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(DOCUMENT_ID, "demo", WPS, list(SYNC_WORDS), None, None, None, False, "manual", None, None, None, "DRAFT")],
        DOCUMENTS,
    ).coalesce(1)


def literal_parameters(spark: SparkSession) -> DataFrame:
    rows = [
        (DOCUMENT_ID, i, p["pid"], p["name"], p["description"], None, p["ptype"], p["unit"], p["lo"], p["hi"], p["res"],
         p["off"], p["formula"], None, p["true"], p["false"], [tuple(s) for s in p["states"]], None)
        for i, p in enumerate(MAPPING, start=1)
    ]
    return spark.createDataFrame(rows, PARAMETERS).coalesce(1)


def literal_segments(spark: SparkSession) -> DataFrame:
    rows = []
    for p in MAPPING:
        for occ, segs in enumerate(p["occs"], start=1):
            if not segs:
                rows.append((DOCUMENT_ID, p["pid"], occ, None, None, None, None, None, None))
            for seq, (sfs, word, lsb, msb, weight) in enumerate(segs, start=1):
                rows.append((DOCUMENT_ID, p["pid"], occ, seq, list(sfs), word, lsb, msb, weight))
    return spark.createDataFrame(rows, SEGMENTS).coalesce(1)


def literal_mapping(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return literal_documents(spark), literal_parameters(spark), literal_segments(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """About ``rows`` rows a task, and work for every core.

    Splits are cut by bytes, but a row group goes to one of them whole: of a file
    with large row groups most splits are empty, however many there are.
    """
    cores, total = df.sparkSession.sparkContext.defaultParallelism, df.count()  # footers alone
    enough = total <= rows and df.rdd.getNumPartitions() >= cores
    return df if enough else df.repartition(max(cores, -(-total // rows)))


def price_cents() -> F.Column:
    return F.floor(F.col("o_totalprice") * 100).cast("bigint")


def subframe_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recorded subframe per order, without its words."""
    return headers_of(table(spark, sf_dir, "orders"))


def headers_of(o: DataFrame) -> DataFrame:
    p = F.col("o_orderstatus") == "P"
    state = (
        F.when(p & (F.col("o_orderpriority") == "5-LOW"), MISSING)
        .when(p & (F.col("o_orderpriority") == "1-URGENT"), INVALID)
        .otherwise(RECEIVED)
    )
    return o.select(
        F.expr("o_orderkey div 512").cast("string").alias("recording_id"),
        F.lit(DOCUMENT_ID).alias("document_id"),
        F.col("o_orderkey").alias("seq"),
        F.expr("o_orderkey div 4").alias("frame_index"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("subframe"),
        state.alias("state"),
        (F.lit(EPOCH) + F.col("o_orderkey")).alias("t_end"),
        price_cents().alias("c"),
    )


def word_values(c: F.Column, subframe: F.Column) -> list[F.Column]:
    sync = F.element_at(F.array(*[F.lit(s) for s in SYNC_WORDS]), subframe)
    return [sync] + [((c + w * 131) % 4096).cast("int") for w in range(2, WPS + 1)]


def subframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers with their 64 words as one array."""
    return subframes_of(table(spark, sf_dir, "orders"))


def subframes_of(orders: DataFrame) -> DataFrame:
    h = headers_of(orders)
    return h.withColumn("words", apart(F.array(*word_values(F.col("c"), F.col("subframe"))))).drop("c")


def part_mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mapping documents of 64 parameters each, one parameter per part."""
    p = table(spark, sf_dir, "part")
    doc = F.concat(F.lit("D"), F.expr("p_partkey div 64").cast("string"))
    k = F.col("p_partkey")
    cents = F.floor(F.col("p_retailprice") * 100).cast("bigint")
    pid = F.concat(F.lit("part-"), k.cast("string"))
    ptype = F.element_at(
        F.create_map(*[F.lit(x) for kv in PART_TYPES.items() for x in kv]), F.col("p_type")
    )
    parameters = p.select(
        doc.alias("document_id"), (k % 64 + 1).cast("int").alias("param_ord"), pid.alias("param_id"),
        F.upper("p_name").alias("mnemonic"), F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.col("p_type").alias("source_type"), F.coalesce(ptype, F.lit("odd")).alias("ptype"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("unit"),
        (F.col("p_size") - 10).cast("double").alias("minimum"),
        F.when(F.col("p_size") != 50, (F.lit(40) - F.col("p_size")).cast("double")).alias("maximum"),
        F.when(F.col("p_size") == 13, 0.0).otherwise(F.col("p_size") / 8.0).alias("resolution"),
        (F.col("p_size") - 25).cast("double").alias("offset"),
        F.when(F.col("p_size") == 7, "table").otherwise("linear").alias("formula_type"),
        F.lit(None).cast("int").alias("decimals"),
        F.when(F.col("p_size") > 30, "ON").alias("true_state"), F.lit(None).cast("string").alias("false_state"),
        F.lit(None).cast("array<struct<value:bigint,label:string>>").alias("states"),
        F.lit(None).cast("string").alias("notes"),
    )
    lsb = (cents % 13).cast("int")
    seg1 = F.struct(
        F.lit(1).alias("occ"), F.lit(1).alias("seq"), F.array((k % 4 + 1).cast("int")).alias("subframes"),
        F.col("p_size").alias("word"), lsb.alias("lsb"), F.least(lsb + 3, F.lit(12)).alias("msb"),
    )
    seg2 = F.struct(
        F.lit(1).alias("occ"), F.when(F.col("p_size") > 45, 1).otherwise(2).alias("seq"),
        F.array(((k + F.when(F.col("p_size") > 40, 1).otherwise(0)) % 4 + 1).cast("int")).alias("subframes"),
        (F.col("p_size") + 3).alias("word"), F.lit(1).alias("lsb"), F.lit(8).alias("msb"),
    )
    segments = (
        p.filter(F.col("p_size") != 3)
        .select(doc.alias("document_id"), pid.alias("param_id"),
                F.inline(F.when(F.col("p_size") > 20, F.array(seg1, seg2)).otherwise(F.array(seg1))))
        .withColumn("bcd_weight", F.lit(None).cast("double"))
    )
    documents = p.groupBy(doc.alias("document_id")).agg(
        F.count("*").alias("n"),
        # Oddities come from the parts themselves: a rate no recorder has, a lost sync word.
        F.max("p_size").alias("size_max"),
    ).select(
        "document_id", F.col("document_id").alias("name"),
        F.when(F.col("size_max") < 50, 0).otherwise(48).cast("int").alias("wps"),
        F.when(F.col("n") == 64, F.array(*[F.lit(s) for s in SYNC_WORDS]))
        .otherwise(F.array(F.lit(583), F.lit(5000), F.lit(2631))).alias("sync_words"),
    )
    return documents, parameters, segments


# The type words of the part table read as parameter types.
PART_TYPES = {
    "ECONOMY": "analog_signed", "LARGE": "analog_unsigned", "MEDIUM": "bcd", "PROMO": "discrete",
    "STANDARD": "raw", "SMALL": "unknown",
}
