"""Values beyond what a field, a type or a document holds give rows, not failed jobs."""

from pyspark.sql import functions as F

from flightwords.functions import cells, numbers, words
from flightwords.operators import capture
from flightwords.plans import bridge, stream_queries
from flightwords.sources import adb_files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_plain_decimal_of_any_size(spark):
    want = {1e21: "1000000000000000000000", 1e-20: "0.00000000000000000001", -12.5: "-12.5", 0.0: "0", 100.0: "100", 0.176: "0.176", 1e30: "1" + "0" * 30}
    assert {v: one(spark, numbers.plain_decimal(F.lit(v))) for v in want} == want
    assert one(spark, numbers.plain_decimal(F.lit(None).cast("double"))) == ""


def test_cells_without_digit_limits(spark):
    assert one(spark, cells.word_groups(F.lit("3, 5-7, 9-8"))) == [[3], [5, 6, 7], [9, 8]]
    # what is no list of words stays text, and is reported as unreadable
    assert one(spark, cells.word_groups(F.lit("12345678901234567890"))) is None
    assert one(spark, cells.word_groups(F.lit("1-999999999"))) is None
    assert len(one(spark, cells.word_groups(F.lit("1-65536")))[0]) == 65_536
    assert one(spark, cells.user_subframes(F.lit("1-99999999999"))) is None


def test_own_number_grammar(spark):
    want = {"1/16": 0.0625, "-3 / 4": -0.75, "2^-4": 0.0625, "2 ^ (3)": 8.0, "1/-2": None, "1/2/3": None, ".5": 0.5, "1,5": None, "1e3": 1000.0, "x": None, "-": None, "5.": 5.0}
    assert {t: one(spark, numbers.parse_number(F.lit(t))) for t in want} == want
    pair = one(spark, numbers.split_number_pair(F.lit("-10 , 2.5e3")))
    assert (pair["first"], pair["second"]) == ("-10", "2.5e3") and one(spark, numbers.split_number_pair(F.lit("1 2 3"))) is None


def test_own_cell_grammar(spark):
    want = {"1 to 3, 5; 7 and 9..11": [[1, 2, 3], [5], [7], [9, 10, 11]], "2.4": [[2, 3, 4]], "2 . 4": None, "1-2-3": None, "-5": None, "6-": None,
            " ,4;; 8 ": [[4], [8]], "1and2": None, "3 thru 1": [[3, 2, 1]], "x": None, "": None}
    assert {t: one(spark, cells.word_groups(F.lit(t))) for t in want} == want
    assert one(spark, cells.without_remarks(F.lit("a(b)c[d]e(f"))) == "ace"
    assert one(spark, cells.states_from_text(F.lit("0=OFF 1 = ON/x")))["one"] == "ON"
    assert one(spark, cells.junk_strip(F.lit("~ A - B ''"))) == "A B"
    state = one(spark, cells.states_from_text(F.lit("1 = UP, 0: DOWN (x)")))
    assert (state["one"], state["zero"]) == ("UP", "DOWN (x")
    assert one(spark, cells.subframe_field(F.lit("SF 2 (odd")))["subframes"] == [2]


def test_bcd_capacity_of_wide_fields(spark):
    assert [one(spark, words.bcd_capacity(F.lit(w))) for w in (12, 10, 76, 200)] == [999, 399, 2**63 - 1, 2**63 - 1]


def test_order_stream_of_a_file_and_of_a_folder(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{source}/orders.parquet")
    orders.repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    for k, folder in enumerate((source, str(tmp_path))):
        name = f"orders_{k}"
        q = stream_queries.order_stream(spark, folder).select("o_orderkey").writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == orders.count()


def test_windows_store_no_points_and_sort_no_series(spark, monkeypatch):
    from flightwords.operators import series
    from flightwords.plans import QUERIES

    written = []
    monkeypatch.setattr(series, "materialize", lambda df: written.append(df.columns) or df)
    for name in ("series_stats_30s", "series_stats_all", "trailing_window"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan or name == "trailing_window" and "SortAggregate" not in plan
    # a row per series at most, never its points
    assert written and all("value" not in columns for columns in written)


def test_window_statistics_of_unordered_points(spark):
    import random

    from flightwords.operators import series

    rng = random.Random(6)
    rows = [("r", f"p{k % 4}", "n", "u", k, 1, float(k if k % 4 < 2 else k + rng.choice((-30, 0, 30))), float(rng.randrange(100))) for k in range(400)]
    points = spark.createDataFrame(rows, "recording_id string, param_id string, param_name string, unit string, seq bigint, occ int, t double, value double")
    names = ["recording_id", "param_id", "n", "current", "minimum", "maximum", "average"]
    got = series.recent_stats(points, lambda s: s, 60.0).select(*names).orderBy("param_id").collect()
    assert got == series.series_stats(points, 60.0).select(*names).orderBy("param_id").collect()
    assert len({r.n for r in got}) > 1


def test_window_statistics_decode_the_window_alone(spark):
    """Subframes before the earliest cut are decoded once, and again only where they come late."""
    from flightwords.operators import series

    def subframes(late):
        rows = [("r", k, float(k) if k not in late else 5.0 + k / 1000) for k in range(400)] + [("q", k, float(k)) for k in range(50)]
        return spark.createDataFrame(rows, "recording_id string, seq bigint, t_end double")

    def points_of(s):
        decoded.append(s)
        return s.select("recording_id", F.expr("'p' || seq % 3").alias("param_id"), F.lit("n").alias("param_name"), F.lit("u").alias("unit"), "seq",
                        F.lit(1).alias("occ"), (F.col("t_end") - 0.5).alias("t"), F.expr("seq % 7 * 1.5").cast("double").alias("value"))

    names = ["recording_id", "param_id", "n", "current", "minimum", "maximum", "average"]
    for late in ((), (370, 371, 390)):
        s, decoded = subframes(late), []
        got = series.recent_stats(s, points_of, 60.0).select(*names).orderBy(*names[:2]).collect()
        assert decoded[1].count() < 120
        assert len(decoded) == (4 if late else 2)
        assert got == series.series_stats(points_of(s), 60.0).select(*names).orderBy(*names[:2]).collect()


def test_tasks_have_rows_however_a_file_is_split(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(60_000).selectExpr("id", "md5(string(id)) as x").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # many splits of one row group
    try:
        rows = bridge.spread(spark.read.parquet(path), 5_000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(r["count"] for r in rows) == 60_000 and max(r["count"] for r in rows) < 10_000


def test_damaged_packets_hold_no_second_start(spark):
    """Counts and checksums that read as a packet start do not count as more bad packets."""
    seqs = [0x4153, 0x1_4153, 0x53_0000, 0x5300, 4 * 0x4153, 4 * 0x4153_00 + 1, *range(7000)]  # "SA" in the count, over its end, in the frame
    head = spark.createDataFrame([(i,) for i in seqs], "seq bigint").select(
        F.lit("r").alias("recording_id"), "seq", F.expr("seq div 4").alias("frame_index"), (F.col("seq") % 4 + 1).cast("int").alias("subframe"),
        F.lit("INVALID").alias("state"), F.col("seq").cast("double").alias("t_end"), F.col("seq").alias("c"))
    subframes = head.withColumn("words", F.array(*bridge.word_values(F.col("c"), F.col("subframe")))).drop("c").dropDuplicates(["seq"])
    _, counters = capture.packets(capture.candidates(stream_queries.packet_chunks_of(subframes)))
    row = counters.first()
    assert (row.bad_packets, row.packets, row.packet_bytes) == (subframes.count(), 0, 0)


def test_judged_packets_are_handed_on_in_parts(spark):
    import pandas as pd

    data = stream_queries.packet_chunks_of(bridge.subframes(spark, "/root/testdata/sf0.001").filter("state <> 'INVALID'")).limit(300).collect()
    buf = b"".join(bytes(r.data) for r in data) * 40
    rows = pd.DataFrame({"recording_id": ["r"], "segment": [0], "ps": [[{"piece": buf}]], "capture_bytes": [len(buf)]})
    parts = [len(p) for p in capture._candidates(len(buf))(iter([rows]))]
    assert sum(parts) == 12_000 and max(parts) <= capture.HELD


def test_records_are_handed_on_in_parts():
    import pandas as pd

    rows = pd.DataFrame({"document_id": ["a", "b"], "source_hash": ["x", "y"], "text": ["1,2\r\n" * 2000, "3\r\n , \r\n4,\"5\r\n6\"\r\n"]})
    parts = list(adb_files._split(iter([rows])))
    assert max(len(p) for p in parts) <= adb_files.HELD
    every = [tuple(r) for p in parts for r in p.itertuples(index=False)]
    assert [r[2] for r in every] == [*range(2000), 0, 1] and every[-1] == ("b", "y", 1, ["4", "5\r\n6"])
