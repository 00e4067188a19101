"""Round 4: what joins of words carry, and lock decisions and captures in whole batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from flightwords.operators import assemble, capture, sync
from flightwords.plans import ORACLES, QUERIES, stream_queries
from flightwords.schemas import SYNC_WORDS
from flightwords.session import materialize
from tests import oracle_check
from tests.test_streams import assemble_random


def test_no_subframe_carries_a_block_of_words(spark):
    """blocks of words meet lists of subframes; nothing is put together above that join."""
    words = spark.range(64).select(F.lit("r").alias("recording_id"), (F.col("id") * 64).alias("start"), F.array_repeat(F.lit(7), 64).alias("words"))
    starts = spark.range(1, 60).select(F.lit("r").alias("recording_id"), (F.col("id") * 64 + 3).alias("pos"), F.lit(1).alias("subframe"), F.lit(True).alias("valid"))
    got = sync.with_words(starts, words, 64, size=1024)
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in above
    assert got.count() == 59 and got.filter(F.size("words") == 64).count() == 59


def test_captures_are_written_by_batches(spark):
    """bytes of a capture come from whole batches; a damaged subframe has a stray byte, chance sync words are raised."""
    rows = [("r", k, "INVALID" if k == 1 else "RECEIVED", float(k), [583, 583, 4095, 3512] if k else [1464, 1, 2, 3]) for k in range(3)]
    s = spark.createDataFrame(rows, "recording_id string, seq bigint, state string, t_end double, words array<int>")
    got = {r.chunk_no: bytes(r.data) for r in stream_queries.captures_of(s, marks_only=True).collect()}
    whole = b"".join(w.to_bytes(2, "little") for w in (583, 584, 4095, 3513))
    assert got == {0: b"".join(w.to_bytes(2, "little") for w in (1464, 1, 2, 3)), 1: b"\xf7" + whole, 2: whole}
    assert bytes(stream_queries.captures_of(s).filter("chunk_no = 2").first().data)[2:4] == (583).to_bytes(2, "little")
    assert "MapInArrow" in stream_queries.captures_of(s)._jdf.queryExecution().executedPlan().toString()


def test_runs_go_over_batches(spark):
    """assembly reads sorted rows batch by batch, no Python group a run; arrivals stay those of the model."""
    outcomes = spark.createDataFrame([("r", 0, [0] * len(assemble.STATES))], "recording_id string, run bigint, after array<int>")
    assert "FlatMapGroups" not in assemble.run_entries(outcomes)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assemble_random(spark, True, 8)
        assemble_random(spark, False, 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_marks_equal_those_of_the_words(spark):
    """only sync words of a capture are kept, at the places they have among all words."""
    data = [b"\x47\x02\x00", b"\x01\xb8\x05\xf7", b"\x47", b"", b"\x02\x47\x02"]
    chunks = spark.createDataFrame([("r", k, float(k), bytearray(b)) for k, b in enumerate(data)], "recording_id string, chunk_no bigint, t double, data binary")
    kept = sync.sync_candidates(capture.words_of(chunks, SYNC_WORDS)).select("recording_id", "pos", "idx")
    assert sorted(kept.collect()) == sorted(sync.sync_candidates(capture.words_of(chunks)).select("recording_id", "pos", "idx").collect())
    assert [(r.pos, r.idx) for r in kept.orderBy("pos").collect()] == [(0, 1), (2, 2), (3, 1), (4, 1)]


@pytest.fixture(scope="module")
def gaps(spark, tmp_path_factory):
    """Recording 0 ends in a search, gaps in it bring true sync words 128 words apart; 1 ends the same way right behind
    its loss; 2 is never locked, with such a pair; 3 is one subframe; 4 stays locked."""
    keys = [*range(10), 11, 13, 15, 18, *range(512, 522), 523, 525, 528, 1024, 1026, 1029, 1536, *range(2048, 2060)]
    rows = [(k, 1, "O", (k * 7 % 4096 + 0.5) / 100, datetime.datetime(1998, 1, 1), "2-HIGH") for k in keys]
    path = tmp_path_factory.mktemp("gaps")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/spark")
    (part,) = path.glob("spark/part-*.parquet")
    part.rename(path / "orders.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["stream_diagnostics_all", "stream_events_all"])
def test_gaps_are_no_rate(spark, gaps, name):
    """true sync words that lost subframes bring to another distance are seconds apart and tell no rate."""
    ok, detail, _ = oracle_check.compare(spark, oracle_check.duck(gaps), name, QUERIES[name], ORACLES[name], gaps)
    assert ok, detail


def test_a_rate_in_time_is_told(spark):
    """sync words 128 words and a second apart do tell that rate."""
    words = [w for k in range(8) for w in (SYNC_WORDS[k % 4], *[5] * 127)]
    data = [bytearray(b"".join(w.to_bytes(2, "little") for w in words[at: at + 128])) for at in range(0, len(words), 128)]
    for step, want in ((1.0, [("r", 128)]), (5.0, [])):
        chunks = spark.createDataFrame([("r", k, k * step, b) for k, b in enumerate(data)], "recording_id string, chunk_no bigint, t double, data binary")
        heard = materialize(capture.words_of(chunks, SYNC_WORDS))
        cand = sync.sync_candidates(heard)
        got = sync.wrong_rate(cand, sync.locks(heard, cand, 64), 64).collect()
        assert [(r.recording_id, r.detected_wps) for r in got] == want
