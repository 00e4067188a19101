"""Stream queries against their SQL where words equal sync words by chance, or gaps bring sync words to other distances."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from flightwords.operators import blocks, sync
from flightwords.plans import ORACLES, QUERIES
from flightwords.session import materialize
from tests import oracle_check

AT = 5  # the word that holds a chance sync word


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Recording 0 begins with a chance pair in a search, and another after a loss in word 2; 1 has a chance pair 128 words
    apart; 2 has true sync words 128 words apart in a stretch that a lock ends."""
    lost = {1, 3, 20, 22, 24, 1024 + 8, 1024 + 10, 1024 + 12, 1024 + 14, 1024 + 15, 1024 + 17}
    price = {0: 583 - 131 * AT, 2: 1464 - 131 * AT, 21: 583 - 131 * 2, 23: 1464 - 131 * 2, 512 + 10: 2631 - 131 * AT, 512 + 12: 3512 - 131 * AT}
    rows = []
    for base in (0, 512, 1024):
        for k in range(base, base + 40):
            cents = price.get(k, 100 + k * 7) % 4096
            rows.append((k, 1, "P" if k in lost else "O", (cents + 0.5) / 100, datetime.datetime(1998, 1, 1), "5-LOW" if k in lost else "2-HIGH"))
    path = tmp_path_factory.mktemp("chance")
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(
        1).write.parquet(f"{path}/spark")
    (part,) = path.glob("spark/part-*.parquet")
    part.rename(path / "orders.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["wrong_rate", "sync_lock", "stream_diagnostics_all", "stream_events_all", "live_sync"])
def test_chance_sync_words(spark, orders, name):
    ok, detail, _ = oracle_check.compare(spark, oracle_check.duck(orders), name, QUERIES[name], ORACLES[name], orders)
    assert ok, detail


def test_places_are_not_broadcast(spark):
    """Millions of places make files of a few MB; no join broadcasts them by that size."""
    rows = spark.range(1000).select(F.lit("r").alias("recording_id"), (F.col("id") * 64).alias("pos"), (F.col("id") % 4 + 1).cast("int").alias("idx"))
    cand = materialize(rows)
    carried = blocks.carry_last(cand, ["recording_id"], blocks.block_of(F.col("pos"), 4096), [F.col("pos")], F.col("idx"), "before", inclusive=False)
    summed = blocks.running_sum(cand, ["recording_id"], blocks.block_of(F.col("pos"), 4096), [F.col("pos")], F.col("idx"), "sum")
    for df in (sync._pairs(cand, 64), carried, summed):
        outer = re.search(r"(\w+)Join", df._jdf.queryExecution().executedPlan().toString())
        assert outer[1] == "SortMerge"
        assert df.filter("pos >= 0").count() >= 999
