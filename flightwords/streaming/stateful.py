"""Keyed state over micro-batches: sync lock of byte streams, bounded histories.

Both processors keep a state of bounded size per key and continue from it in the
next batch, or after a restart from the checkpoint.  Rows of one key may come in
any order within a batch; over batches they come in order, as from a device.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.capture import parse_containers, pending_byte
from ..operators.series import MAX_SAMPLES, MAX_SECONDS
from ..schemas import SUBFRAME_COUNT, SYNC_WORDS, WORD_MAX

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Maps and timers need the state store that keeps its data outside the heap."""
    spark.conf.set(STATE_STORE, ROCKS)


SUBFRAMES_FOUND = "recording_id string, pos bigint, subframe int, valid boolean, words array<int>"


class Synchronizer(StatefulProcessor):
    """Bytes to locked subframes (SRC-07, STR-01, STR-02).

    Kept per recording: the low byte that waits for its high byte, the words not
    yet decided (fewer than a subframe and those of the batch), the position of
    the first of them, and the subframe expected there while locked.
    """

    def __init__(self, wps: int, sync_words: Iterable[int] = SYNC_WORDS):
        self.wps = wps
        self.number = np.zeros(WORD_MAX + 1, np.int64)
        self.number[list(sync_words)] = range(1, SUBFRAME_COUNT + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "pending int, base bigint, expected int, words binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending, base, expected, raw = self.held.get() if self.held.exists() else (None, 0, None, b"")
        chunks = pd.concat(list(rows)).sort_values("chunk_no")
        data = b"".join([b"" if pending is None else bytes([pending]), *map(bytes, chunks["data"])])
        data = np.frombuffer(data, np.uint8)
        words = np.concatenate([np.frombuffer(bytes(raw), "<u2").astype(np.int32), parse_containers(data)[0]])
        found, at, expected = self.decide(words, expected)
        self.held.update((pending_byte(data), base + at, expected, words[at:].astype("<u2").tobytes()))
        if found:
            yield pd.DataFrame({
                "recording_id": key[0], "pos": [base + i for i, _, _ in found], "subframe": pd.array([n for _, n, _ in found], "int32"),
                "valid": [ok for _, _, ok in found], "words": [words[i : i + self.wps] for i, _, _ in found],
            })

    def decide(self, words: np.ndarray, expected: int | None) -> tuple[list[tuple[int, int, bool]], int, int | None]:
        """(place, number, valid) of the subframes that are complete; the place to go on from; what is expected there."""
        number, found, at = self.number[words], [], 0
        while True:
            if expected is None:  # two sync words at the right distance give a lock
                here, there = number[at : max(at, len(words) - self.wps)], number[at + self.wps :]
                pairs = np.flatnonzero((here > 0) & (there == here % SUBFRAME_COUNT + 1))
                if not len(pairs):
                    return found, max(at, len(words) - self.wps), None
                at += int(pairs[0])
                expected = int(number[at])
            if at + self.wps > len(words):
                return found, at, expected
            valid = number[at] == expected
            found.append((at, expected, bool(valid)))
            at, expected = (at + self.wps, expected % SUBFRAME_COUNT + 1) if valid else (at + 1, None)

    def close(self) -> None:
        pass


def live_sync(chunks: DataFrame, wps: int, sync_words: Iterable[int] = SYNC_WORDS) -> DataFrame:
    """Subframes of a stream of (recording_id, chunk_no, data), as ``sync.synchronize`` finds them in batch."""
    use_keyed_state(chunks.sparkSession)
    keyed = chunks.filter("data is not null").groupBy("recording_id")
    return keyed.transformWithStateInPandas(Synchronizer(wps, sync_words), SUBFRAMES_FOUND, "Append", "None")


RING = (
    "recording_id string, param_id string, seq bigint, n bigint, oldest_t double, newest_t double, "
    "minimum double, maximum double, total double, current double"
)
RING_BLOCK = 512


class Ring(StatefulProcessor):
    """The last points of a series, bounded in number and in time (STR-09).

    Points lie in append order in numbered blocks of a map, so a batch touches
    the blocks it fills and those it empties.  A series without points for
    ``idle`` seconds gives its state back.
    """

    def __init__(self, most: int = MAX_SAMPLES, seconds: float = MAX_SECONDS, idle: float | None = None):
        self.most, self.seconds, self.idle = most, seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "first bigint, after bigint, newest double")
        self.blocks = handle.getMapState("blocks", "block bigint", "points binary")

    def _block(self, k: int) -> np.ndarray:
        return np.frombuffer(bytes(self.blocks.getValue((k,))[0]), "<f8").reshape(-1, 2)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, after, newest = self.place.get() if self.place.exists() else (0, 0, float("-inf"))
        came = pd.concat(list(rows)).sort_values(["seq", "occ"])
        points = came[["t", "value"]].to_numpy(np.float64)
        newest = max(newest, float(points[:, 0].max()))
        k = after // RING_BLOCK
        if after % RING_BLOCK and after > first:
            points = np.concatenate([self._block(k), points])
        for at in range(0, len(points), RING_BLOCK):
            self.blocks.updateValue((k + at // RING_BLOCK,), (points[at : at + RING_BLOCK].astype("<f8").tobytes(),))
        after = k * RING_BLOCK + len(points)
        first = self._trimmed(first, after, newest)
        self.place.update((first, after, newest))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle))
        own = self._from(first, after)
        value = own[:, 1]
        yield pd.DataFrame({
            "recording_id": [key[0]], "param_id": [key[1]], "seq": [int(came["seq"].iloc[-1])], "n": [len(own)], "oldest_t": [own[0, 0]], "newest_t": [newest],
            "minimum": [value.min()], "maximum": [value.max()], "total": [value.sum()], "current": [value[-1]],
        })

    def _from(self, first: int, after: int) -> np.ndarray:
        k = first // RING_BLOCK
        every = np.concatenate([self._block(b) for b in range(k, -(-after // RING_BLOCK))])
        return every[first - k * RING_BLOCK :]

    def _trimmed(self, first: int, after: int, newest: float) -> int:
        """The new first point; blocks before it are dropped."""
        start, old = max(first, after - self.most), first // RING_BLOCK
        while True:
            k = start // RING_BLOCK
            late = np.flatnonzero(self._block(k)[start - k * RING_BLOCK :, 0] >= newest - self.seconds)
            if len(late):
                start += int(late[0])
                break
            start = (k + 1) * RING_BLOCK  # the newest point itself is never too old
        for k in range(old, start // RING_BLOCK):
            self.blocks.removeKey((k,))
        return start

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.place.clear()
        self.blocks.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_ring(points: DataFrame, most: int = MAX_SAMPLES, seconds: float = MAX_SECONDS, idle: float | None = None) -> DataFrame:
    """State of every series' bounded history after each batch that added to it.

    ``points`` is a stream of (recording_id, param_id, seq, occ, t, value).
    """
    use_keyed_state(points.sparkSession)
    own = points.select("recording_id", "param_id", "seq", "occ", "t", "value")
    mode = "None" if idle is None else "ProcessingTime"
    return own.groupBy("recording_id", "param_id").transformWithStateInPandas(Ring(most, seconds, idle), RING, "Append", mode)
