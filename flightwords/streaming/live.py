"""Structured Streaming: the batch functions on unbounded subframes.

Decoding is stateless and is the batch function itself.  Assembly keeps one
small state per recording; the words ride along untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import assemble
from ..operators.decode import decodable, decode, numeric_value
from ..operators.series import RATE_MIN_SPAN
from ..schemas import INVALID, LATE, MISSING, PENDING, RECEIVED, SUBFRAME_COUNT, SUBFRAMES


def subframe_stream(spark: SparkSession, path: str, schema: str = SUBFRAMES, **options) -> DataFrame:
    """Subframe rows arriving as Parquet files."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def live_samples(subframes: DataFrame, plans: DataFrame, profile: dict | None = None) -> DataFrame:
    """Samples of RECEIVED and LATE subframes as they arrive (STR-06)."""
    return decode(decodable(subframes), plans, profile=profile)


def with_event_time(samples: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return samples.withColumn("event_time", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint"))).withWatermark(
        "event_time", delay
    )


def latest_values(samples: DataFrame) -> DataFrame:
    """Latest value table (STR-07); run in complete or update mode."""
    keys = ["recording_id", "param_id", "occ", "subframe"]
    return samples.groupBy(*keys).agg(F.max_by(F.struct("seq", "t", "eng_value", "eng_label", "status"), "seq").alias("latest"))


def window_stats(samples: DataFrame, length: str = "30 seconds", slide: str | None = None) -> DataFrame:
    """count / min / max / mean per sliding event-time window (STR-09); needs
    ``with_event_time``."""
    window = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    value = numeric_value()
    return samples.groupBy(window, "recording_id", "param_id").agg(
        F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("average")
    )


def word_rate(arrivals: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """Words per second over sliding 2 s windows (STR-08)."""
    timed = arrivals.withColumn("event_time", F.timestamp_micros((F.col("t_end") * 1_000_000).cast("bigint"))).withWatermark(
        "event_time", delay
    )
    span = F.greatest(F.max("t_end") - F.min("t_end"), F.lit(RATE_MIN_SPAN))
    return timed.groupBy(F.window("event_time", "2 seconds", "500 milliseconds"), "recording_id").agg(
        (F.sum(F.size("words")) / span).alias("word_rate")
    )


ARRIVALS = (
    "recording_id string, seq bigint, part int, frame_index bigint, frame_no bigint, subframe int, state string, t_end double, "
    "slot_states array<string>, frame_completed boolean, words array<int>"
)
_STATE = "expected int, missing int, ahead int, last_id bigint, frame_no bigint, frame_index bigint, slots array<string>"


def _assemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.exists:
        expected, missing, ahead, last_id, number, index, slots = state.get
        slots = list(slots)
    else:
        expected, missing, ahead, last_id, number, index, slots = 1, 0, 0, None, 0, 0, [PENDING] * 4
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for r in rows.itertuples(index=False):
        fid = None if pd.isna(r.frame_id) else int(r.frame_id)
        gap = None if fid is None else (0 if last_id is None else fid - last_id)
        (expected, missing, ahead), closes, late, skipped, completes, lead = assemble.step(
            (expected, missing, ahead), int(r.subframe), gap
        )
        if closes:
            closed = [MISSING if s == PENDING else s for s in slots]
            out.append((key[0], r.seq, 0, index, number, 0, MISSING, r.t_end, closed, True, []))
            number, slots = number + 1, [PENDING] * 4
        index = number if fid is None else fid + lead
        for k in range(4):
            if skipped >> k & 1:
                slots[k] = MISSING
        now = INVALID if not r.valid else LATE if late else RECEIVED
        slots[int(r.subframe) - 1] = now
        out.append((key[0], r.seq, 1, index, number, r.subframe, now, r.t_end, list(slots), bool(completes), r.words))
        if completes:
            number, slots = number + 1, [PENDING] * 4
            index = number
        last_id = fid
    state.update((expected, missing, ahead, last_id, number, index, slots))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in ARRIVALS.split(", ")])


def arriving(subframes: DataFrame, wps: int, frame_id: str | None = None) -> DataFrame:
    """Rows for ``assemble_stream`` by the rules of batch: subframes of a wrong length or
    with words beyond 12 bits are invalid, and words are cut or filled to ``wps`` (STR-05)."""
    fid = F.col(frame_id) if frame_id else F.lit(None)
    return subframes.select(
        "recording_id", "seq", "subframe", assemble.validity(subframes, wps).alias("valid"), fid.cast("bigint").alias("frame_id"), "t_end",
        assemble.fixed_words(subframes, wps).alias("words"),
    )


def assemble_stream(rows: DataFrame) -> DataFrame:
    """Arrivals of a stream of (recording_id, seq, subframe, valid, frame_id, t_end,
    words) rows, in order within a recording (STR-04, STR-05)."""
    # as in batch: a row that belongs to no subframe takes no part
    placed = rows.filter(F.col("subframe").between(1, SUBFRAME_COUNT))
    return placed.groupBy("recording_id").applyInPandasWithState(
        _assemble, ARRIVALS, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def run_available(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> DataFrame:
    """Process everything available, exactly once, into a Parquet table; returns the table."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand every micro-batch to ``sink(df, batch_id)`` until the input is drained."""
    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_complete(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available into aggregates; returns their last state.

    Every batch writes its whole result under its own number, so a batch that is
    run again replaces what it had written.
    """
    done = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(number)

    each_batch(df, save, checkpoint, "complete")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{max(done)}")
