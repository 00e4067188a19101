"""Removal of repeated substrings by suffix order and previous-factor lengths.

Every byte is removed that is covered by a string of ``length`` bytes which
also starts in a document with a smaller doc_id; strings never cross documents
and are judged on the input.

A suffix order of the whole corpus would sit in one task, so strings are first
dealt out by content.  The anchor of a string is its leftmost GRAM-byte piece
of least hash: equal strings have equal anchors at equal places, and
neighbouring strings share theirs, about one for 15 bytes.

1. Anchors that occur in one document only are put aside.  Four bytes of every
   document's anchor hashes meet by shard; a bitmap of bounded size, broadcast,
   holds those seen in several documents (false hits cost work, no result).
2. An anchor that was seen again goes out with its context, the bytes of all
   strings that it stands for.  Equal contexts of an Arrow batch meet first:
   all but those of the smallest document are decided on the spot.  Anchors of
   more than HOT documents go out string by string, dealt by the string, so
   that no shard holds all surroundings of a common passage.
3. A shard sorts its contexts, decides equal ones, and puts the strings of the
   others into suffix order (of ``length`` bytes: longer common prefixes decide
   nothing).  Common prefixes of neighbours and two stack passes, to the previous
   and to the next entry of smaller document, give the longest previous factors;
   strings whose factor is ``length`` bytes long are covered.
4. Covered stretches go back to their documents, are joined, and cut out.

Defined results: null text is empty; null doc_ids come after all others; rows
of one doc_id don't count as earlier to each other; an empty table gives an
empty table; further columns are carried along untouched by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwords.llm.common import partitions, pick
from flightwords.session import materialize

LENGTH = 50
GRAM = 20
HOT = 4096
#: Bytes of text per shard; bits of the bitmap, at least and most.
SHARD_BYTES = 8 << 20
LEAST_BITS, MOST_BITS = 20, 30
BLOCK = 1 << 17
#: Bytes of text whose contexts are held at a time, and strings put into order at a time.
SLICE = 12 << 20
STRINGS = 200_000
NO_ID = np.iinfo(np.int64).max
#: Bits of the filter of documents that have stretches.
FLAGS = 1 << 26

MULTIPLIER, FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
REPLY = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("end", "<u4")])


def _record(length: int) -> np.dtype:
    """An anchor with its context; ``key`` is what makes two contexts equal."""
    reach = 2 * length - GRAM
    return np.dtype([("hash", "<u8"), ("mark", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("count", "u1"), ("text", f"V{reach}")])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    y = a * MULTIPLIER
    y += b
    y ^= y >> FOLD
    return y


def _hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position on."""
    h1 = b.astype(np.uint64)
    h2 = _mixed(h1[:-1], h1[1:])
    h4 = _mixed(h2[:-2], h2[2:])
    h8 = _mixed(h4[:-4], h4[4:])
    h16 = _mixed(h8[:-8], h8[8:])
    return _mixed(_mixed(h16[:-4], h4[16:]), h4[16:])


def _slide(x: np.ndarray, width: int, pick_) -> np.ndarray:
    """pick_ over every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick_(x[:-step], x[step:])
        done += step
    return x


def _anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every position, least hash of every string, positions that are least in some string)."""
    width = length - GRAM + 1
    h = _hashes(b)
    least = _slide(h, width, np.minimum)
    # a position is least somewhere if the largest of the minima around it is its own hash
    edge = np.zeros(width - 1, np.uint64)
    around = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    return h, least, np.flatnonzero(around == h)


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of some BLOCK bytes together: (bytes, number of each text, where each begins)."""
    held, which, size = [], [], 0
    for i, t in enumerate(texts):
        if len(t):
            held.append(t)
            which.append(i)
            size += len(t)
        if held and (size >= BLOCK or i == len(texts) - 1):
            begins = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            yield np.frombuffer(b"".join(held), np.uint8), np.array(which), begins
            held, which, size = [], [], 0
    if held:
        begins = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        yield np.frombuffer(b"".join(held), np.uint8), np.array(which), begins


class Plan:
    """Numbers that the passes share."""

    def __init__(self, length: int, total: int, least_shards: int):
        self.length = length
        self.bits = int(np.clip(np.ceil(np.log2(max(total / 4, 2))), LEAST_BITS, MOST_BITS))
        self.shard_bits = int(np.clip(np.ceil(np.log2(max(total / SHARD_BYTES, least_shards, 2))), 1, self.bits - 3))
        self.shards = 1 << self.shard_bits

        self.slice_bits = self.bits - self.shard_bits

    def shard(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) & np.uint64(self.shards - 1)).astype(np.int64)

    def bit(self, h: np.ndarray) -> np.ndarray:
        """A shard's bits lie together; the lower half of a hash tells its anchors apart and has their bits."""
        return (self.shard(h).astype(np.uint64) << np.uint64(self.slice_bits)) | (h & np.uint64((1 << self.slice_bits) - 1))


def _dealt(shard: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    shard, rows = shard[order], rows[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(shard[a]), rows[a:b]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some SLICE bytes of text; a longer text is one of its own."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
        ends = np.concatenate([np.flatnonzero(np.diff(size)) + 1, [batch.num_rows]])
        for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def _packed(parts: list[tuple[int, bytes]], names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], list(names))


def _repeated(docs: DataFrame, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of anchors that several documents hold, sorted bits of hot ones)."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found, owner = [], []
            for b, which, begins in _blocks([t.as_py() or b"" for t in batch.column("text")]):
                if len(b) < plan.length:
                    continue
                h, _, at = _anchors(b, plan.length)
                found.append(h[at])
                owner.append(which[np.searchsorted(begins, at, side="right") - 1])
            if not found:
                continue
            h, doc = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])  # once a document
            h = h[once]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            own, n = h[first], np.diff(np.concatenate([first, [len(h)]]))
            parts = []
            for s, k in _dealt(plan.shard(own), np.arange(len(own))):
                many = np.flatnonzero(n[k] > 1)
                head = np.array([len(k), len(many)], "<u4").tobytes()
                low = (own[k] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
                parts.append((s, head + low + np.concatenate([many, n[k][many]]).astype("<u4").tobytes()))
            yield _packed(parts, ("shard", "blob"))

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        low, count = [], []
        for blob in rows["blob"]:
            x = np.frombuffer(blob, "<u4")
            n, many = int(x[0]), int(x[1])
            low.append(x[2 : 2 + n])
            c = np.ones(n, np.int64)
            c[x[2 + n : 2 + n + many]] = x[2 + n + many : 2 + n + 2 * many]
            count.append(c)
        own, at = np.unique(np.concatenate(low), return_inverse=True)
        docs_of = np.bincount(at, np.concatenate(count))
        place = (own & np.uint32((1 << plan.slice_bits) - 1)).astype(np.int64)
        bits = np.zeros(1 << plan.slice_bits, bool)
        bits[place[docs_of > 1]] = True
        hot = np.unique(place[docs_of > HOT] + (int(rows["shard"].iloc[0]) << plan.slice_bits)).astype("<u8")
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()], "hot": [hot.tobytes()]})

    slices = docs.mapInArrow(seen, "shard int, blob binary").groupBy("shard").applyInPandas(counted, "shard int, bits binary, hot binary")
    bitmap, hot, width = np.zeros(1 << (plan.bits - 3), np.uint8), [np.zeros(0, np.uint64)], 1 << (plan.slice_bits - 3)
    for r in slices.toLocalIterator():  # 2 ** (MOST_BITS - 3) bytes at most, and hot ones by the thousands
        bitmap[r["shard"] * width : (r["shard"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
        hot.append(np.frombuffer(r["hot"], "<u8"))
    return bitmap, np.unique(np.concatenate(hot))


def _contexts(texts: list[bytes], docs: np.ndarray, ties: np.ndarray, plan: Plan, bitmap: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records of repeated anchors, their shards)."""
    length, kind = plan.length, _record(plan.length)
    reach = kind["text"].itemsize
    out, shards = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for b, which, begins in _blocks(texts):
        if len(b) < length:
            continue
        h, least, at = _anchors(b, length)
        bit = plan.bit(h[at])
        again = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
        if not again.any():
            continue
        # the strings that lie in one text, and the anchor of each: the first of its least hash
        start = np.arange(len(least))
        text = np.searchsorted(begins, start, side="right")
        start = start[start + length <= begins[text]]
        before = np.zeros(len(h) + 1, np.int64)
        before[at + 1] = 1
        anchor = np.cumsum(before)[start]
        wrong = np.flatnonzero(h[at[anchor]] != least[start])
        while len(wrong):
            anchor[wrong] += 1
            wrong = wrong[h[at[anchor[wrong]]] != least[start[wrong]]]
        keep = again[anchor] == 1
        start, anchor = start[keep], anchor[keep]
        if not len(start):
            continue
        first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1)]))
        count = np.diff(np.concatenate([first, [len(start)]]))
        begin, anchor = start[first], anchor[first]
        if len(hot):  # string by string
            burns = np.isin(bit[anchor], hot)
            if burns.any():
                n = np.where(burns, count, 1)
                begin = np.repeat(begin, n) + np.concatenate([np.arange(x) for x in n])
                anchor, count, burns = np.repeat(anchor, n), np.repeat(np.where(burns, 1, count), n), np.repeat(burns, n)
        else:
            burns = np.zeros(len(begin), bool)
        r = np.zeros(len(begin), kind)
        of = np.searchsorted(begins, begin, side="right") - 1
        r["hash"], r["doc"], r["tie"] = h[at[anchor]], docs[which[of]], ties[which[of]]
        r["start"], r["count"] = begin - begins[of], count
        padded = np.concatenate([b, np.zeros(reach, np.uint8)])
        grid = padded[begin[:, None] + np.arange(reach)]
        grid[np.arange(reach) >= (count + length - 1)[:, None]] = 0
        r["text"] = np.ascontiguousarray(grid).view(f"V{reach}").ravel()
        r["mark"] = _marks(grid)
        out.append(r)
        shards.append(np.where(burns, plan.shard(r["mark"]), plan.shard(r["hash"])))
    return np.concatenate(out), np.concatenate(shards)


def _marks(grid: np.ndarray) -> np.ndarray:
    """A hash of every row of bytes; rows of equal marks are still compared."""
    n, width = grid.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = grid
    out = np.zeros(n, np.uint64)
    for k in range(words.shape[1] // 8):
        out = _mixed(out, np.ascontiguousarray(words[:, k * 8 : k * 8 + 8]).view("<u8").ravel())
    return out * MULTIPLIER


SENT = ("hash", "doc", "tie", "start", "count", "text")


def _shrunk(r: np.ndarray) -> bytes:
    """Records column by column, compressed; marks are made again on arrival."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(r)], "<u8").tobytes(), *[np.ascontiguousarray(r[c]).tobytes() for c in SENT]]))


def _restored(blob: bytes, kind: np.dtype) -> np.ndarray:
    raw, at = zstandard.ZstdDecompressor().decompress(blob), 8
    r = np.zeros(int(np.frombuffer(raw, "<u8", 1)[0]), kind)
    for c in SENT:
        r[c] = np.frombuffer(raw, kind[c], len(r), at)
        at += len(r) * kind[c].itemsize
    return r


def _equal_runs(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by anchor, context, document; number of the run of equal contexts of each entry in that order)."""
    order = np.lexsort((r["start"], r["tie"], r["doc"], r["count"], r["mark"], r["hash"]))
    s = r[order]
    new = (s["hash"][1:] != s["hash"][:-1]) | (s["mark"][1:] != s["mark"][:-1]) | (s["count"][1:] != s["count"][:-1]) | (s["text"][1:] != s["text"][:-1])
    return order, np.concatenate([[0], np.cumsum(new)])


def _decided(r: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which records may still be first of their context, stretches of those that are not)."""
    if not len(r):
        return np.zeros(0, np.int64), np.zeros(0, REPLY)
    order, run = _equal_runs(r)
    doc = r["doc"][order]
    later = doc > doc[np.searchsorted(run, np.arange(run[-1] + 1))][run]
    s = r[order[later]]
    return order[~later], _joined(_stretches(s, s["start"], s["start"] + s["count"] + length - 1))


def _stretches(r: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r), REPLY)
    out["doc"], out["tie"], out["start"], out["end"] = r["doc"], r["tie"], start, end
    return out


def _previous(r: np.ndarray, length: int) -> np.ndarray:
    """Stretches covered by strings that a smaller document holds, among contexts of shared anchors."""
    hashes, n = np.unique(r["hash"], return_counts=True)
    r = r[n[np.searchsorted(hashes, r["hash"])] > 1]
    if not len(r):
        return np.zeros(0, REPLY)
    # whole anchors at a time, so many that their strings stay within some MB
    r = r[np.argsort(r["hash"], kind="stable")]
    size = np.cumsum(r["count"].astype(np.int64)) // STRINGS
    ends = np.flatnonzero(np.concatenate([r["hash"][1:] != r["hash"][:-1], [True]])) + 1
    ends = ends[np.concatenate([np.diff(size[ends - 1]) != 0, [True]])]
    return np.concatenate([_ordered(r[x:y], length) for x, y in zip(np.concatenate([[0], ends[:-1]]), ends)])


def _ordered(r: np.ndarray, length: int) -> np.ndarray:
    """The suffixes at which strings begin, in order of their first ``length`` bytes, then document."""
    count = r["count"].astype(np.int64)
    of = np.repeat(np.arange(len(r)), count)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    grid = np.ascontiguousarray(r["text"]).view(np.uint8).reshape(len(r), -1)
    strings = np.empty((len(of), length), np.uint8)
    for k in range(int(count.max())):
        at = shift == k
        strings[at] = grid[of[at], k : k + length]
    strings = strings.view(f"S{length}").ravel()
    doc = r["doc"][of]
    order = np.lexsort((doc, strings))
    covered = np.zeros(len(of), bool)
    covered[order] = previous_factors(strings[order], doc[order]) >= length
    at = np.flatnonzero(covered)
    begin = r["start"][of[at]].astype(np.int64) + shift[at]
    return _joined(_stretches(r[of[at]], begin, begin + length))


def common_prefixes(strings: np.ndarray) -> np.ndarray:
    """Bytes that each of the sorted strings shares with the one before; 0 for the first."""
    bytes_ = np.ascontiguousarray(strings).view(np.uint8).reshape(len(strings), -1)
    differ = bytes_[1:] != bytes_[:-1]
    return np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), bytes_.shape[1])])


def previous_factors(strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest previous factors in suffix order: bytes, as far as the strings go, that an entry shares with one of a smaller document.

    The nearest entries of smaller document before and after share most; the
    common prefix with them is the least of those on the way.  A stack pass
    each way keeps the entries that can still be someone's nearest.
    """
    near, owner = common_prefixes(strings), doc.tolist()
    before = _to_smaller(owner, near.tolist())
    after = _to_smaller(owner[::-1], np.concatenate([[0], near[:0:-1]]).tolist() if len(near) else [])
    return np.maximum(before, after[::-1])


def _to_smaller(doc: list[int], near: list[int]) -> np.ndarray:
    """Common prefix with the last entry before that belongs to a smaller document; 0 where there is none."""
    out, docs, shared = [0] * len(doc), [], []
    for i, (d, common) in enumerate(zip(doc, near)):
        while docs and docs[-1] >= d:
            docs.pop()
            common = min(common, shared.pop())
        if docs:
            out[i] = common
        docs.append(d)
        shared.append(common)
    return np.array(out, np.int64)


def _joined(x: np.ndarray) -> np.ndarray:
    """Stretches of each document, overlapping and touching ones joined."""
    if not len(x):
        return x
    x = x[np.lexsort((x["start"], x["tie"], x["doc"]))]
    same = (x["doc"][1:] == x["doc"][:-1]) & (x["tie"][1:] == x["tie"][:-1])
    group = np.concatenate([[0], np.cumsum(~same)]).astype(np.int64)
    # ends never sink within a document once documents are set apart
    far = np.int64(1) << np.int64(32)
    end = np.maximum.accumulate(x["end"].astype(np.int64) + group * far) - group * far
    new = np.concatenate([[True], ~same | (x["start"][1:] > end[:-1])])
    first = np.flatnonzero(new)
    out = x[first]
    out["end"] = end[np.concatenate([first[1:], [len(x)]]) - 1]
    return out


def stretches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, tie, spans): removed stretches of every document that has some; spans are pairs of 4-byte offsets."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    plan = Plan(length, total, partitions(spark))
    bitmap, hot = _repeated(docs, plan)
    shared = spark.sparkContext.broadcast((bitmap, hot))
    kind = _record(length)

    def replies(x: np.ndarray) -> list[tuple[int, bytes]]:
        x = _joined(x)
        bucket = ((x["doc"].astype(np.uint64) * MULTIPLIER) >> np.uint64(40)).astype(np.int64) % plan.shards
        return [(s, rows.tobytes()) for s, rows in _dealt(bucket, x)]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts = [t.as_py() or b"" for t in batch.column("text")]
            doc, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
            r, shard = _contexts(texts, doc, tie, plan, *shared.value)
            rest, known = _decided(r, length)
            rows = [(s, _shrunk(r[k]), b"") for s, k in _dealt(shard[rest], rest)] + [(s, b"", blob) for s, blob in replies(known)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int32()), *[pa.array([x[i] for x in rows], pa.binary()) for i in (1, 2)]], ["shard", "contexts", "known"]
            )

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        r = np.concatenate([np.zeros(0, kind)] + [_restored(x, kind) for x in rows["contexts"] if x])
        r["mark"] = _marks(np.ascontiguousarray(r["text"]).view(np.uint8).reshape(len(r), -1)) if len(r) else 0
        rest, late = _decided(r, length)
        known = np.frombuffer(b"".join(rows["known"]), REPLY)
        parts = replies(np.concatenate([known, late, _previous(r[rest], length)]))
        return pd.DataFrame({"bucket": [p[0] for p in parts], "blob": [p[1] for p in parts]}).astype({"bucket": "int32"})

    def gathered(rows: pd.DataFrame) -> pd.DataFrame:
        x = _joined(np.frombuffer(b"".join(rows["blob"]), REPLY))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(x["doc"]) != 0) | (np.diff(x["tie"]) != 0)]))
        spans = np.stack([x["start"], x["end"]], axis=1).astype("<u4")
        ends = np.concatenate([first[1:], [len(x)]])
        return pd.DataFrame({"doc": x["doc"][first], "tie": x["tie"][first], "spans": [spans[a:b].tobytes() for a, b in zip(first, ends)]})

    told = docs.mapInArrow(sent, "shard int, contexts binary, known binary").groupBy("shard").applyInPandas(judged, "bucket int, blob binary")
    return told.groupBy("bucket").applyInPandas(gathered, "doc long, tie long, spans binary")


def cut(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, stretches removed)."""
    if not spans:
        return text, 0, 0
    pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()
    kept, at = [], 0
    for a, b in pairs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), len(pairs)


def remove(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the ``kept`` bytes if ``texts``."""
    d = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))
    found = materialize(stretches(d.select("doc", "tie", "text"), length))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [cut(t.as_py(), s.as_py()) for t, s in zip(batch.column("text"), batch.column("spans"))]
            columns = [
                batch.column("doc_id"), pa.array([len(c[0]) + c[1] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()),
                pa.array([c[2] for c in cuts], pa.int64()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cuts], pa.string()),
            ] + ([pa.array([c[0] for c in cuts], pa.binary())] if texts else [])
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    # only texts that may have stretches are shuffled to meet them
    flagged = _flagged(d, found)
    whole = flagged.filter("not flagged").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").alias("kept")] if texts else []),
    )
    met = flagged.filter("flagged").join(found, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    return whole.unionByName(met.mapInArrow(cleaned, schema))


def _flagged(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``flagged``: false only for documents that ``found`` (doc, tie) doesn't hold.

    A filter of FLAGS bits, made and broadcast as rows of 4 kB, a few MB in all.
    """
    place = F.pmod(F.xxhash64("doc", "tie"), F.lit(FLAGS))
    bits = found.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    d = docs.withColumn("at", F.bitmap_bit_position(place)).withColumn("bucket", F.bitmap_bucket_number(place))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")).bitwiseAND(1) == 1
    return d.join(F.broadcast(bits), "bucket", "left").withColumn("flagged", F.coalesce(hit, F.lit(False))).drop("at", "bucket", "bits")
