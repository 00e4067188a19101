"""Subframes to frames: slot states, frame numbers, missing, late and closing rows.

The rule is a small state machine per recording.  In batch a recording is cut
into runs of rows; each run is first reduced to "state before → state after",
the runs are chained, and every run is then replayed from its known state.  A
recording of any length is therefore spread over many tasks.  A stream keeps
the same state between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import INVALID, LATE, MISSING, PENDING, RECEIVED, SUBFRAME_COUNT, WORD_MAX
from ..session import materialize
from . import blocks

RUN = 16_384
GROUP = 1024

# State between rows: expected subframe 1..4, bit mask of the slots below it
# known missing, and how far the frame number is ahead of the last frame id.
STATES = [(e, m, d) for e in range(1, 5) for m in range(1 << (e - 1)) for d in ((0, 1) if e > 1 else (0,))]
INDEX = {s: i for i, s in enumerate(STATES)}
START = INDEX[(1, 0, 0)]


def headers(subframes: DataFrame, wps: int, frame_id: str | None = None) -> DataFrame:
    """What the state machine needs of a subframe row: no words.

    A row is invalid when flagged so, of the wrong length, or holding a word
    beyond 12 bits (STR-05).
    """
    fid = F.col(frame_id) if frame_id else F.lit(None)
    t = F.col("t") if "t" in subframes.columns else F.col("t_end")
    return subframes.filter(F.col("subframe").between(1, SUBFRAME_COUNT)).select(
        "recording_id", "seq", "subframe", validity(subframes, wps).alias("valid"), fid.cast("bigint").alias("frame_id"),
        t.alias("t"),
    )


def validity(subframes: DataFrame, wps: int) -> Column:
    """Whether a row's subframe is whole: not flagged, of ``wps`` words, all of 12 bits."""
    flagged = F.coalesce(F.col("valid"), F.lit(True)) if "valid" in subframes.columns else (F.col("state") != INVALID)
    return flagged & (F.size("words") == wps) & ~F.exists("words", lambda w: (w < 0) | (w > WORD_MAX))


def fixed_words(subframes: DataFrame, wps: int) -> Column:
    """Words padded or cut to ``wps`` and masked to 12 bits."""
    padded = F.slice(F.concat("words", F.array_repeat(F.lit(0), wps)), F.lit(1), F.lit(wps))
    return F.transform(padded, lambda w: w.bitwiseAND(WORD_MAX))


def invalid_cells() -> Column:
    """(subframe, word) of every word beyond 12 bits."""
    return F.filter(
        F.transform("words", lambda w, i: F.when((w < 0) | (w > WORD_MAX), F.struct(F.col("subframe").alias("subframe"), (i + 1).alias("word")))),
        lambda c: c.isNotNull(),
    )


def step(state: tuple[int, int, int], subframe: int, gap: int | None):
    """One row → (next state, closes a frame, late, newly missing mask, completes, ahead).

    ``gap`` is the frame id minus the previous one, None when the source gives
    no frame ids.
    """
    expected, missing, ahead = state
    closes, bit = 0, 1 << (subframe - 1)
    if gap is not None and expected != 1 and gap != ahead:
        closes, expected, missing = 1, 1, 0
    if subframe < expected and missing & bit:
        return (expected, missing & ~bit, 0), closes, 1, 0, 0, 0
    ahead = 0
    if subframe < expected:  # the device began a new frame; slots below stay pending
        closes, missing, ahead, skipped = 1, 0, 1, 0
    else:
        skipped = sum(1 << (k - 1) for k in range(expected, subframe))
    if subframe == SUBFRAME_COUNT:
        return (1, 0, 0), closes, 0, skipped, 1, ahead
    return (subframe + 1, missing | skipped, ahead), closes, 0, skipped, 0, ahead


# Every transition once: a move is a subframe and the class of its gap.
_GAPS = (None, 0, 1, 2)
MOVES = [(sf, gap) for sf in range(1, SUBFRAME_COUNT + 1) for gap in _GAPS]
_TABLE = [[step(s, *move) for move in MOVES] for s in STATES]
NEXT = np.array([[INDEX[out[0]] for out in row] for row in _TABLE], np.int32)
TOLD = {name: np.array([[out[i] for out in row] for row in _TABLE], np.int32).ravel()
        for i, name in enumerate(("closes", "late", "skipped", "completes", "ahead"), 1)}
TOLD["missing"] = np.array([STATES[s][1] for s in NEXT.ravel()], np.int32)


def move(gap: Column) -> Column:
    """A row's place in ``MOVES``."""
    kind = F.when(gap.isNull(), 0).when(gap == 0, 1).when(gap == 1, 2).otherwise(3)
    return ((F.col("subframe") - 1) * len(_GAPS) + kind).cast("int")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(recording, run) and the rows of each stretch of a sorted batch."""
    rec, run = batch.column("recording_id"), batch.column("run").to_numpy()
    apart = (run[1:] != run[:-1]) | pc.not_equal(rec[1:], rec[:-1]).to_numpy(zero_copy_only=False)
    at = [0, *(np.flatnonzero(apart) + 1).tolist(), len(run)]
    for lo, hi in zip(at[:-1], at[1:]):
        yield (rec[lo].as_py(), int(run[lo])), lo, hi


_AFTER = "recording_id string, run bigint, after array<int>"
_ENTRY = "recording_id string, run bigint, entry int"


def _outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State after each run for each possible state before it; rows come sorted, a run may go over batches."""
    def told(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in out], pa.string()), pa.array([k[1] for k, _ in out], pa.int64()),
             pa.array([a.tolist() for _, a in out], pa.list_(pa.int32()))], names=["recording_id", "run", "after"])

    key = after = None
    for batch in batches:
        if not batch.num_rows:
            continue
        moves, out = batch.column("move").to_numpy(), []
        for run, lo, hi in _parts(batch):
            if run != key:
                if key is not None:
                    out.append((key, after))
                key, after = run, np.arange(len(STATES), dtype=np.int32)
            here = moves[lo:hi]
            full = np.flatnonzero(here >= (SUBFRAME_COUNT - 1) * len(_GAPS))  # every state is the same behind the last subframe
            for m in here[full[-1] if len(full) else 0:].tolist():
                after = NEXT[after, m]
        yield told(out)
    if key is not None:
        yield told([(key, after)])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of runs as one."""
    for batch in batches:
        out = []
        for rec, grp, runs in zip(*(batch.column(c) for c in ("recording_id", "grp", "runs"))):
            after = np.arange(len(STATES))
            for r in runs.as_py():
                after = np.array(r["after"])[after]
            out.append({"recording_id": rec.as_py(), "run": grp.as_py(), "after": after.tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("recording_id", pa.string()), ("run", pa.int64()), ("after", pa.list_(pa.int32()))]))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State before every member, from the state before the first."""
    for batch in batches:
        out = []
        for rec, entry, runs in zip(*(batch.column(c) for c in ("recording_id", "entry", "runs"))):
            rec, state = rec.as_py(), entry.as_py()
            for r in runs.as_py():
                out.append({"recording_id": rec, "run": r["run"], "entry": state})
                state = r["after"][state]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("recording_id", pa.string()), ("run", pa.int64()), ("entry", pa.int32())]))


def run_entries(outcomes: DataFrame, group: int = GROUP) -> DataFrame:
    """State before every run: runs are chained in groups of ``group``, the groups
    of a recording once more, so no task sees more than a sliver of a recording."""
    runs = F.array_sort(F.collect_list(F.struct("run", "after"))).alias("runs")
    grouped = outcomes.groupBy("recording_id", blocks.block_of(F.col("run"), group).alias("grp")).agg(runs)
    tops = grouped.mapInArrow(_chain, _AFTER).groupBy("recording_id").agg(runs).withColumn("entry", F.lit(START))
    first = tops.mapInArrow(_entries, _ENTRY).withColumnRenamed("run", "grp")
    return grouped.join(first, ["recording_id", "grp"]).select("recording_id", "runs", "entry").mapInArrow(_entries, _ENTRY)


_HEADER = ("recording_id", "seq", "subframe", "valid", "frame_id", "t")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the state machine did at each row; rows come sorted, a run may go over batches."""
    width = len(MOVES)
    after = (NEXT * width).ravel().tolist()
    key, state = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        moves, entry, at = batch.column("move").to_pylist(), batch.column("entry"), []
        for run, lo, hi in _parts(batch):
            if run != key:
                key, state = run, entry[lo].as_py() * width
            for m in moves[lo:hi]:
                at.append(state + m)
                state = after[state + m]
        yield pa.RecordBatch.from_arrays(
            [pa.array(told[at]) for told in TOLD.values()] + [batch.column(c) for c in _HEADER], names=[*TOLD, *_HEADER])


_REPLAYED = (
    "closes int, late int, skipped int, completes int, ahead int, missing int, "
    "recording_id string, seq bigint, subframe int, valid boolean, frame_id bigint, t double"
)


def replay(rows: DataFrame, run: int = RUN, group: int = GROUP) -> DataFrame:
    """Header rows with what the state machine did at each of them.

    Python reads sorted partitions, which hold whole runs, batch by batch; a group of its own for every
    run would cost more than its rows, and few of them would share a task.
    """
    block = blocks.block_of(F.col("seq"), run)
    d = blocks.carry_last(rows, ["recording_id"], block, [F.col("seq")], F.col("frame_id"), "_prev", inclusive=False)
    d = d.select(
        "recording_id", F.col("seq").cast("bigint").alias("seq"), F.col("subframe").cast("int").alias("subframe"), "valid", "frame_id",
        F.col("t").cast("double").alias("t"), move(F.col("frame_id") - F.coalesce("_prev", F.col("frame_id"))).alias("move"), block.alias("run"))
    d = materialize(d)
    keys = ["recording_id", "run"]
    outcomes = materialize(d.select(*keys, "seq", "move").repartition(*keys).sortWithinPartitions(*keys, "seq").select(*keys, "move").mapInArrow(_outcome, _AFTER))
    entries = run_entries(outcomes, group)
    known = d.join(entries.hint("merge"), keys).sortWithinPartitions(*keys, "seq")
    return materialize(known.select(*_HEADER, "run", "move", "entry").mapInArrow(_replay, _REPLAYED))


def _popcount(c: Column) -> Column:
    return F.bit_count(c)


def arrivals(rows: DataFrame, run: int = RUN, group: int = GROUP) -> DataFrame:
    """One row per arrival (STR-04): stored subframes and, with subframe 0, the
    closing of frames that ended incomplete.

    Columns: recording_id, seq, part, frame_index, frame_no, subframe, state, t,
    slot_states, frame_completed, plus late / newly_missing for the counters.
    """
    r = replay(rows, run, group)
    r = blocks.running_sum(r, ["recording_id"], blocks.block_of(F.col("seq"), run), [F.col("seq")],
                           F.col("closes") + F.col("completes"), "_ended", inclusive=False)
    r = r.withColumn("frame_no", F.col("_ended") + F.col("closes")).drop("_ended")
    r = r.withColumn("frame_index", F.when(F.col("frame_id").isNotNull(), F.col("frame_id") + F.col("ahead")).otherwise(F.col("frame_no")))
    r = r.withColumn("state", F.when(~F.col("valid"), INVALID).when(F.col("late") == 1, LATE).otherwise(RECEIVED))
    frame = Window.partitionBy("recording_id", "frame_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def slot(k: int) -> Column:
        held = F.last(F.when(F.col("subframe") == k, F.col("state")), ignorenulls=True).over(frame)
        gone = F.col("missing").bitwiseAND(1 << (k - 1)) != 0
        marked = (F.col("skipped").bitwiseAND(1 << (k - 1)) != 0) | gone
        return F.coalesce(held, F.when(marked, MISSING).otherwise(PENDING))

    # A completed frame's state is already reset, so its skips come from the frame's rows.
    r = r.withColumn("_skips", F.bit_or("skipped").over(frame))
    r = r.withColumn("missing", F.when(F.col("completes") == 1, F.col("_skips")).otherwise(F.col("missing")))
    stored = r.withColumn("slot_states", F.array(*[slot(k) for k in range(1, 5)]))
    stored = stored.select(
        "recording_id", "seq", F.lit(1).alias("part"), "frame_index", "frame_no", "subframe", "state", "t", "slot_states",
        (F.col("completes") == 1).alias("frame_completed"), F.col("late"), _popcount(F.col("skipped")).cast("bigint").alias("newly_missing"),
        "closes",
    )
    last = stored.groupBy("recording_id", "frame_no").agg(
        F.max_by(F.struct("slot_states", "frame_index"), "seq").alias("f")
    )
    pending = F.size(F.filter("f.slot_states", lambda s: s == PENDING)).cast("bigint")
    closing = (
        stored.filter("closes = 1").select("recording_id", "seq", "t", (F.col("frame_no") - 1).alias("frame_no"))
        .join(last, ["recording_id", "frame_no"])
        .select(
            "recording_id", "seq", F.lit(0).alias("part"), F.col("f.frame_index").alias("frame_index"), "frame_no",
            F.lit(0).alias("subframe"), F.lit(MISSING).alias("state"), "t",
            F.transform("f.slot_states", lambda s: F.when(s == PENDING, MISSING).otherwise(s)).alias("slot_states"),
            F.lit(True).alias("frame_completed"), F.lit(0).alias("late"), pending.alias("newly_missing"),
        )
    )
    return materialize(stored.drop("closes").unionByName(closing))


def stats(a: DataFrame) -> DataFrame:
    """Assembler counters per recording (AGG-04)."""
    real = F.col("subframe") != 0
    return a.groupBy("recording_id").agg(
        F.count_if(real).alias("subframes"),
        F.count_if("frame_completed").alias("frames"),
        (F.sum("newly_missing") - F.sum("late")).alias("missing_subframes"),
        F.count_if(real & (F.col("state") == INVALID)).alias("invalid_subframes"),
        F.sum("late").cast("bigint").alias("out_of_order"),
        F.count_if(~real).alias("incomplete_frames"),
    )


def diagnostics(a: DataFrame) -> DataFrame:
    """Counters a live view shows (AGG-05, assembly part); dropped slots count only
    when their frame ends."""
    real = F.col("subframe") != 0
    dropped = F.size(F.filter("slot_states", lambda s: s == MISSING))
    return a.groupBy("recording_id").agg(
        F.count_if(real).alias("subframes_received"),
        F.count_if("frame_completed").alias("frames_received"),
        F.count_if(F.col("state") == INVALID).alias("invalid_subframes"),
        F.count_if(F.col("state") == LATE).alias("out_of_order_subframes"),
        F.coalesce(F.sum(F.when(F.col("frame_completed"), dropped)), F.lit(0)).cast("bigint").alias("dropped_subframes"),
    )


def stream_diagnostics(a: DataFrame, parsed: DataFrame, locked: DataFrame, starts: DataFrame, rates: DataFrame) -> DataFrame:
    """All counters of a byte-stream recording: bytes, words, losses and assembly (AGG-05)."""
    out = parsed.groupBy("recording_id").agg(
        F.sum("n_bytes").alias("bytes_received"), F.sum("n_words").alias("words_received"), F.sum("invalid_words").alias("invalid_words"),
        F.sum("invalid_words").alias("discarded_bytes"),
    )
    losses = starts.groupBy("recording_id").agg(F.count_if(~F.col("valid")).alias("sync_losses"))
    final = starts.groupBy("recording_id").agg(F.max_by("valid", "pos").alias("ends_locked"))
    rate = rates.groupBy("recording_id").agg(F.max_by("detected_wps", "since").alias("detected_wps"))
    out = out.join(diagnostics(a), "recording_id", "left").join(losses, "recording_id", "left")
    out = out.join(final, "recording_id", "left").join(rate, "recording_id", "left")
    zero = [c for c in out.columns if c not in ("recording_id", "ends_locked", "detected_wps")]
    return out.fillna(0, zero).withColumn(
        "sync_state", F.when(F.col("ends_locked"), "LOCKED").otherwise("SEARCHING")
    ).drop("ends_locked")


def stream_events(a: DataFrame, locks: DataFrame, rates: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """All events of byte streams in one table (STR-12): recording_id, seq, t, kind, message.

    ``a`` are arrivals whose ``seq`` is the word position, ``locks`` the events of
    ``sync.lock_events`` with ``t``, ``rates`` (recording_id, since, detected_wps, t),
    ``packets`` (recording_id, bad_packets, t) of framed streams.
    """
    out = events(a).unionByName(locks.select("recording_id", F.col("pos").alias("seq"), "t", "kind", "message"))
    told = F.concat(F.lit("sync words repeat every "), F.col("detected_wps"), F.lit(" words"))
    out = out.unionByName(rates.select("recording_id", F.col("since").alias("seq"), "t", F.lit("RATE_MISMATCH").alias("kind"), told.alias("message")))
    if packets is not None:
        bad = F.concat(F.col("bad_packets"), F.lit(" bad packet(s)"))
        out = out.unionByName(packets.filter("bad_packets > 0").select(
            "recording_id", F.lit(None).cast("bigint").alias("seq"), "t", F.lit("INVALID_PROTOCOL").alias("kind"), bad.alias("message")))
    return out


def events(a: DataFrame) -> DataFrame:
    """Stream events of arrivals (STR-12)."""
    kind = (
        F.when(F.col("subframe") == 0, "FRAME_INCOMPLETE").when(F.col("state") == INVALID, "SUBFRAME_INCOMPLETE").otherwise("SUBFRAME")
    )
    kinds = F.when(F.col("frame_completed"), F.array(kind, F.lit("FRAME"))).otherwise(F.array(kind))
    return a.select("recording_id", "seq", "t", "state", F.explode(kinds).alias("kind")).select(
        "recording_id", "seq", "t", "kind", F.when(F.col("kind") != "FRAME", F.col("state")).otherwise("").alias("message")
    )
