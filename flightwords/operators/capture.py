"""Byte captures: 16-bit word containers and framed packets.

Input is a table of chunks (recording_id, chunk_no, t, data).  A capture of any
size is parsed in parallel: chunks are summarized, the summaries of a recording
are scanned, and every chunk is then parsed on its own from a known state.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SUBFRAME_COUNT
from ..session import materialize
from . import blocks

KEY = ["recording_id"]
CHUNK_BLOCK = 4096


# -- continuous word stream (SRC-07) ---------------------------------------

def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end, and where its rows begin; the last place is the end."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]: offsets[-1]] if held else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _scan(data: np.ndarray, at: np.ndarray, waiting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marked bytes, bytes that complete a word, bytes whose byte before waits) of chunks laid end to end.

    The rule of ``parse_containers`` for all of them at once: ``waiting`` says which
    begin behind a low byte, their first byte is an odd number of bytes behind it.
    """
    place = np.arange(len(data), dtype=np.int32)
    marked = data > 15
    filled = at[1:] > at[:-1]
    first, behind = at[:-1][filled], waiting[filled].astype(np.int32)
    low = np.where(marked, place, np.int32(-1))
    low[first] = np.where(marked[first], first, first - behind)
    low = np.maximum.accumulate(low) if len(data) else low
    before = np.concatenate((low[:1], low[:-1]))
    before[first] = first - behind
    return marked, ((place - low) & 1).astype(bool), ((place - before) & 1).astype(bool)


def _by_chunk(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the flags lie in each chunk."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: length, last byte, the bytes after its last byte whose high nibble is set (that byte always
    becomes a pending low byte), its words if it begins with a container, and how many more if it does not."""
    for batch in batches:
        data, at = _flat(batch.column("data"))
        n = np.diff(at)
        marked, done, _ = _scan(data, at, np.zeros(len(n), bool))
        marks = np.concatenate((np.flatnonzero(marked), [-1]))
        held = _by_chunk(marked, at)
        upto = np.concatenate(([0], np.cumsum(held)))
        plain = np.where(held > 0, marks[np.minimum(upto[:-1], len(marks) - 1)] - at[:-1], n)
        tail = at[1:] - 1 - marks[upto[1:] - 1]
        yield pa.RecordBatch.from_arrays([
            batch.column("recording_id"), batch.column("chunk_no"), pa.array(n),
            pa.array(data[np.maximum(at[1:] - 1, 0)].astype(np.int64) if len(data) else np.zeros(len(n), np.int64), mask=n == 0),
            pa.array(tail, mask=held == 0), pa.array(_by_chunk(done, at)), pa.array(plain % 2),
        ], names=["recording_id", "chunk_no", "n", "last", "tail", "words", "more"])


def chunk_states(chunks: DataFrame) -> DataFrame:
    """Entry state of every chunk: ``pending`` is the low byte awaiting its high
    byte, NULL when a container starts with the chunk; ``start`` is the place of its first word."""
    s = chunks.select("recording_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "data").mapInArrow(
        _summaries, "recording_id string, chunk_no bigint, n bigint, last bigint, tail bigint, words bigint, more bigint"
    )
    s = materialize(s.withColumn("_block", blocks.block_of(F.col("chunk_no"), CHUNK_BLOCK)))
    # Without a marked byte a chunk only flips the state once per byte, so the state follows from the last
    # marked byte and the bytes since. Places are counted from the block's beginning first.
    earlier = Window.partitionBy(*KEY, "_block").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    d = s.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    d = d.withColumn("_mark", F.col("_before") + F.col("n") - F.col("tail"))
    held = d.groupBy(*KEY, "_block").agg(
        F.sum("n").alias("_n"), F.max("_mark").alias("_m"), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("chunk_no"))).alias("_l"))
    above = Window.partitionBy(*KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_at", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    held = held.withColumn("_since", F.max(F.col("_at") + F.col("_m")).over(above)).withColumn(
        "_previous", F.last("_l", ignorenulls=True).over(above)).drop("_n", "_m", "_l")
    local = d.withColumn("_local", F.max("_mark").over(earlier)).withColumn("_last", F.last("last", ignorenulls=True).over(earlier))
    d = local.join(held.hint("merge"), [*KEY, "_block"])
    before, since = F.col("_at") + F.col("_before"), F.coalesce(F.col("_at") + F.col("_local"), "_since")
    waiting = F.when(since.isNull(), before % 2 == 1).otherwise((before - since) % 2 == 0)
    d = materialize(d.select(
        "recording_id", "chunk_no", before.alias("byte_offset"), F.when(waiting, F.coalesce("_last", "_previous")).alias("pending"),
        (F.col("words") + F.when(waiting, F.col("more")).otherwise(0)).alias("n_words"),
    ))
    block, order = blocks.block_of(F.col("chunk_no"), CHUNK_BLOCK), [F.col("chunk_no")]
    return blocks.running_sum(d, KEY, block, order, F.col("n_words"), "start", inclusive=False).drop("n_words")


def parse_containers(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Words of bytes that begin with a container start, and the dropped bytes."""
    marked = np.where(data & 0xF0, np.arange(len(data)), -1)
    marked[:1] = -1  # the first byte never completes a container
    last = np.maximum.accumulate(marked) if len(data) else marked
    at = np.arange(len(data))
    # A byte completes a container when its high nibble is clear and an odd
    # number of bytes follow the pending one.
    since = at - np.where(last < 0, 0, last)
    done = (marked < 0) & (since % 2 == 1)
    high = at[done]
    words = data[high].astype(np.int32) * 256 + data[high - 1]
    # A marked byte in completing position drops the byte before it.
    before = np.concatenate(([-1], last[:-1])) if len(data) else last
    waiting = (at - np.where(before < 0, 0, before)) % 2 == 1
    return words, int(np.count_nonzero((marked >= 0) & waiting))


def pending_byte(data: np.ndarray) -> int | None:
    """The low byte left waiting at the end of bytes that begin with a container start."""
    if not len(data):
        return None
    marked = np.flatnonzero(data & 0xF0)
    since = len(data) - 1 - (int(marked[-1]) if len(marked) else 0)
    return int(data[-1]) if since % 2 == 0 else None


def _parse(values: tuple[int, ...] | None):
    """Words of each chunk, or the places of those that are one of ``values``."""
    wanted = np.zeros(4096, bool)
    wanted[list(values or ())] = True

    def lists(n: np.ndarray, items: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), items)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _flat(batch.column("data"))
            pending = batch.column("pending")
            waiting = ~pending.is_null().to_numpy(zero_copy_only=False)
            marked, done, held = _scan(data, at, waiting)
            low = np.concatenate((data[:1], data[:-1])).astype(np.int32)
            begun = waiting & (at[1:] > at[:-1])
            low[at[:-1][begun]] = pending.fill_null(0).to_numpy(zero_copy_only=False)[begun]
            words, n, start = data[done].astype(np.int32) * 256 + low[done], _by_chunk(done, at), batch.column("start").to_numpy()
            if values is None:
                found = lists(n, pa.array(words))
            else:
                ends = np.concatenate(([0], np.cumsum(n)))
                where = np.flatnonzero(wanted[words])
                chunk = np.searchsorted(ends, where, "right") - 1
                places = pa.StructArray.from_arrays([pa.array(start[chunk] + where - ends[chunk]), pa.array(words[where])], names=["pos", "w"])
                found = lists(np.bincount(chunk, minlength=len(n)), places)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("recording_id", "chunk_no", "t")]
                + [found, pa.array(_by_chunk(marked & held, at)), pa.array(n), batch.column("start"), pa.array(np.diff(at))],
                names=["recording_id", "chunk_no", "t", "words" if values is None else "hits", "invalid_words", "n_words", "start", "n_bytes"])

    return parse


def words_of(chunks: DataFrame, values: Iterable[int] | None = None) -> DataFrame:
    """Words of each chunk with the position of its first word.

    Columns: recording_id, chunk_no, t, words, invalid_words, n_words, start, n_bytes.
    ``invalid_words`` equals the discarded bytes.  Where words begin follows from the
    summaries, so the bytes travel and are parsed once.  With ``values`` the column
    ``hits`` (pos, w) of the words that are one of them stands for ``words``.
    """
    known = chunks.select("recording_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("t").cast("double").alias("t"), "data")
    states = chunk_states(chunks).select("recording_id", "chunk_no", "pending", "start")
    column = "words array<int>" if values is None else "hits array<struct<pos: bigint, w: int>>"
    return known.join(states.hint("merge"), ["recording_id", "chunk_no"]).mapInArrow(
        _parse(None if values is None else tuple(values)),
        f"recording_id string, chunk_no bigint, t double, {column}, invalid_words bigint, n_words bigint, start bigint, n_bytes bigint"
    )


# -- framed packets (SRC-08) -----------------------------------------------

# Packet layout.
MAGIC = b"SA"
HEADER = np.dtype([("magic", "S2"), ("version", "u1"), ("kind", "u1"), ("seq", "<u2"), ("frame", "<u4"),
                   ("subframe", "u1"), ("wps", "<u2"), ("length", "<u2")])
HEADER_BYTES, CRC_BYTES, MAX_PAYLOAD = 15, 4, 4096
PACKET_VERSION = 1
KIND_SUBFRAME = 1
LONGEST = HEADER_BYTES + MAX_PAYLOAD + CRC_BYTES
SEGMENT = 65_536
# Judged candidates that a worker holds before it hands them on.
HELD = 4096

OK, BAD, OPEN = "ok", "bad", "open"
_CANDIDATE = (
    "recording_id string, pos bigint, verdict string, total bigint, kind int, sequence int, frame_id bigint, "
    "subframe int, wps int, words array<int>"
)


def byte_segments(chunks: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Capture bytes cut into aligned segments, each followed by enough of the
    next bytes to hold a packet that starts in it."""
    sized = chunks.select("recording_id", "chunk_no", F.length("data").cast("bigint").alias("n"))
    offsets = materialize(blocks.running_sum(
        sized, KEY, blocks.block_of(F.col("chunk_no"), CHUNK_BLOCK), [F.col("chunk_no")], F.col("n"), "at", inclusive=False
    ))
    ends = offsets.groupBy("recording_id").agg(F.max(F.col("at") + F.col("n")).alias("capture_bytes"))
    d = chunks.join(offsets, ["recording_id", "chunk_no"]).filter("n > 0")
    first = F.greatest(F.floor((F.col("at") - LONGEST) / size), F.lit(0))
    pieces = d.withColumn("segment", F.explode(F.sequence(first, F.floor((F.col("at") + F.col("n") - 1) / size))))
    lo = F.greatest(F.col("at"), F.col("segment") * size)
    hi = F.least(F.col("at") + F.col("n"), (F.col("segment") + 1) * size + LONGEST)
    pieces = pieces.select("recording_id", "segment", lo.alias("lo"), hi.alias("hi"), "at", "data").filter("hi > lo")
    piece = F.struct("lo", F.expr("substring(data, cast(lo - at as int) + 1, cast(hi - lo as int))").alias("piece"))
    return (
        pieces.select("recording_id", "segment", piece.alias("p")).groupBy("recording_id", "segment")
        .agg(F.array_sort(F.collect_list("p")).alias("ps"))
        .join(ends, "recording_id")
    )


def _candidates(size: int):
    names = [c.split()[0] for c in _CANDIDATE.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec, segment, ps, total_bytes in zip(pdf["recording_id"], pdf["segment"], pdf["ps"], pdf["capture_bytes"]):
                buf = b"".join(bytes(p["piece"]) for p in ps)
                base = int(segment) * size
                at = buf.find(MAGIC)
                while 0 <= at < size:
                    out.append((rec, base + at, *_judge(buf[at: at + LONGEST], base + at, int(total_bytes))))
                    at = buf.find(MAGIC, at + 1)
                    if len(out) >= HELD:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    return scan


def _judge(view: bytes, pos: int, capture_bytes: int) -> tuple:
    """Verdict on one possible packet start, with its fields when it is one."""
    nothing = (None, None, None, None, None, None)
    if pos + HEADER_BYTES > capture_bytes:
        return (OPEN, 0, *nothing)
    head = np.frombuffer(view, dtype=HEADER, count=1)[0]
    length = int(head["length"])
    if head["version"] != PACKET_VERSION or length > MAX_PAYLOAD:
        return (BAD, 1, *nothing)
    total = HEADER_BYTES + length + CRC_BYTES
    if pos + total > capture_bytes:
        return (OPEN, total, *nothing)
    body, crc = view[: total - CRC_BYTES], int.from_bytes(view[total - CRC_BYTES: total], "little")
    kind = int(head["kind"])
    if crc != zlib.crc32(body) or (kind == KIND_SUBFRAME and length % 2):
        return (BAD, 1, *nothing)
    payload = body[HEADER_BYTES:]
    words = (np.frombuffer(payload, dtype="<u2") & 0x0FFF).astype(np.int32) if kind == KIND_SUBFRAME else np.frombuffer(payload, dtype=np.uint8).astype(np.int32)
    return (OK, total, kind, int(head["seq"]), int(head["frame"]), int(head["subframe"]), int(head["wps"]), words)


def candidates(chunks: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Every place a packet could start, judged; the packets themselves included."""
    return materialize(byte_segments(chunks, size).mapInPandas(_candidates(size), _CANDIDATE))


def _leftmost(pdf: pd.DataFrame) -> pd.DataFrame:
    """Non-overlapping packets of one overlap group, leftmost first."""
    pdf, keep, cursor = pdf.sort_values("pos"), [], -1
    for pos, total in zip(pdf["pos"], pdf["total"]):
        keep.append(pos >= cursor)
        cursor = pos + total if keep[-1] else cursor
    return pdf[keep][["recording_id", "pos"]]


def packets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets delivered, counters per recording) from judged candidates.

    A candidate inside an accepted packet is never looked at; one whose packet
    is incomplete at the end of the capture stops the parser there.  Places compress
    to small files, so the joins are told not to broadcast them.
    """
    ends = F.col("pos") + F.col("total")
    good = found.filter(F.col("verdict") == OK).select("recording_id", "pos", "total")
    grouped = materialize(blocks.interval_clusters(good, KEY, "pos", ends, "_group"))
    members = Window.partitionBy("recording_id", "_group")
    grouped = grouped.withColumn("_n", F.count("*").over(members))
    contested = grouped.filter("_n > 1").groupBy("recording_id", "_group").applyInPandas(
        _leftmost, "recording_id string, pos bigint"
    )
    accepted = grouped.filter("_n = 1").select("recording_id", "pos").unionByName(contested).withColumn("accepted", F.lit(True))
    marked = found.join(accepted.hint("merge"), ["recording_id", "pos"], "left").withColumn(
        "_end", F.when(F.col("accepted"), ends)
    )
    covered = materialize(blocks.carry_last(
        marked.select("recording_id", "pos", "verdict", "total", "_end", "accepted"), KEY,
        blocks.block_of(F.col("pos"), 1 << 20), [F.col("pos")], F.col("_end"), "_cover", inclusive=False,
    ).filter(F.coalesce(F.col("_cover") <= F.col("pos"), F.lit(True))))
    stop = covered.filter(F.col("verdict") == OPEN).groupBy("recording_id").agg(F.min("pos").alias("stop"))
    reached = covered.join(stop, "recording_id", "left").filter("stop IS NULL OR pos < stop")
    counters = reached.groupBy("recording_id").agg(
        F.count_if(F.col("verdict") == BAD).alias("bad_packets"),
        F.count_if("accepted").alias("packets"),
        F.sum(F.when(F.col("accepted"), F.col("total")).otherwise(0)).alias("packet_bytes"),
    )
    delivered = found.join(reached.filter("accepted").select("recording_id", "pos").hint("merge"), ["recording_id", "pos"], "left_semi")
    return delivered, counters


def check_packets(delivered: DataFrame, wps: int, sync_words) -> DataFrame:
    """Subframe packets with their validity (STR-10).

    ``deliver`` is False for a subframe number outside 1..4, which only counts
    as an invalid subframe.
    """
    sync = F.get(F.array(*[F.lit(s) for s in sync_words]), F.col("subframe") - 1)
    known = F.col("subframe").between(1, SUBFRAME_COUNT)
    valid = (F.col("wps") == wps) & known & (F.size("words") == wps) & (F.get("words", F.lit(0)) == sync)
    return (
        delivered.filter(F.col("kind") == KIND_SUBFRAME)
        .withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("deliver", known)
        .withColumn("rate_mismatch", F.col("wps") != wps)
    )
