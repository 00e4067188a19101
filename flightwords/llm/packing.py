"""Packing by concatenate and cut, in two passes.

All token streams (ids of a text, then one end id) stand one after another and
are cut into windows of ``window`` tokens; only the last window is padded.

Pass one tokenises every partition and writes its documents' ids to the shared
folder, each with its partition number and its offset in the partition.
Prefix sums over the partitions' token totals (one row per partition) give
every document its global offset.  Pass two reads the ids, cuts them at window
boundaries and returns a record per piece, by SQL functions: ids never go back to
Python.  Nothing but the totals is shuffled.

Texts are tokenised some at a time: their white-space separated chunks are
numbered, each different one is tokenised once, and the ids are gathered by
number; short chunks and their ids are remembered, MEMO bytes at most.  That is exact for a vocabulary file that splits at white space,
lower-cases, and splits between letters or digits and other signs; for any other
file texts are tokenised whole.  A worker's memory is bounded by LOT (or one
longer text) and MEMO.

Defined results: null text is empty and gives the end id alone; repeated rows
and null doc_ids are documents of their own; an empty table gives no piece;
further columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightwords.llm.common import in_small_batches, pick
from flightwords.session import broadcast_if_small, materialize

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are tokenised together, and chunks handed to the tokenizer at a time.
LOT = 2 << 20
CHUNKS = 16_384
#: Bytes of chunks (of at most LONGEST bytes) and their ids that a worker remembers.
MEMO = 8 << 20
LONGEST = 64
SIGNS = ".,;:!?"
#: Chunks that end in a digit or letter which neither normalising nor lower-casing turns into several signs.
STEADY = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]$"
# How a vocabulary file that may be read chunk by chunk normalises and splits.
LOWERING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTING = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True,
}


class Pool:
    """Id lists one after another: ``ids``, and where each begins and how long it is."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids, lengths
        self.starts = np.cumsum(lengths) - lengths

    @property
    def nbytes(self) -> int:
        return self.ids.nbytes + 2 * self.lengths.nbytes

    def take(self, which: np.ndarray) -> np.ndarray:
        """The ids of the lists ``which``, one list after another."""
        n = self.lengths[which]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Texts -> unsigned 32-bit ids."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # asked part by part: the whole description would hold the vocabulary once more
        normalizer, splitter = (json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        plain = all(t.content.startswith("<|") and not (t.single_word or t.lstrip or t.rstrip or t.normalized) for _, t in added)
        splits = (splitter.get("pretokenizers") or [None])[0]
        self.by_chunk = bool(added) and plain and normalizer.get("normalizers") == LOWERING and splits == SPLITTING
        #: an added token: it stands between chunks that are tokenised in one go
        self.between = (added[-1][1].content, added[-1][0]) if self.by_chunk else None
        self.known, self.memo = pa.array([], pa.string()), Pool(np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _ids(self, texts: list[str]) -> Pool:
        lists = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return Pool(np.concatenate([np.zeros(0, "<u4"), *lists]), np.array([len(x) for x in lists], np.int64))

    def _chunks(self, chunks: list[str]) -> Pool:
        """Ids of chunks none of which holds an added token."""
        sign, mark = self.between
        ids, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in range(0, len(chunks), CHUNKS):
            own = self._ids([sign.join(chunks[k : k + CHUNKS])]).ids
            cuts = np.flatnonzero(own == mark)
            ids.append(np.delete(own, cuts))
            lengths.append(np.diff(np.concatenate([[-1], cuts, [len(own)]])) - 1)
        return Pool(np.concatenate(ids), np.concatenate(lengths))

    def _known_or_new(self, chunks: pa.Array) -> tuple[Pool, np.ndarray]:
        """A pool that holds all (different) chunks, and each chunk's place in it; short ones are remembered."""
        at = pc.index_in(chunks, value_set=self.known)
        fresh = chunks.filter(at.is_null())
        own = self._chunks(fresh.to_numpy(zero_copy_only=False).tolist())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        every = Pool(np.concatenate([self.memo.ids, own.ids]), np.concatenate([self.memo.lengths, own.lengths]))
        short = np.flatnonzero(pc.binary_length(fresh).to_numpy() <= LONGEST)
        kept, own = fresh.take(pa.array(short)), Pool(own.take(short), own.lengths[short])
        if self.known.nbytes + kept.nbytes + self.memo.nbytes + own.nbytes <= MEMO:
            self.known = pa.concat_arrays([self.known, kept])
            self.memo = Pool(np.concatenate([self.memo.ids, own.ids]), np.concatenate([self.memo.lengths, own.lengths]))
        elif kept.nbytes + own.nbytes <= MEMO:  # what came last is likelier to come again
            self.known, self.memo = pa.concat_arrays([kept]), own
        return every, place

    def _pool(self, chunks: pa.Array) -> Pool:
        """Ids of all chunks.  Those that differ only in ASCII case and trailing signs share the work."""
        special = pc.match_substring(chunks, "<|")  # added tokens are matched before lower-casing
        low = pc.if_else(pc.string_is_ascii(chunks), pc.ascii_lower(chunks), chunks)
        stem = pc.ascii_rtrim(low, characters=SIGNS)
        ends_well = pc.match_substring_regex(stem, STEADY)
        stem = pc.if_else(ends_well, stem, low)
        tails = [a[len(b) :] for a, b in zip(*(x.to_numpy(zero_copy_only=False) for x in (low, stem)))]
        parts = pa.concat_arrays([stem, pa.array(tails, pa.string())]).dictionary_encode()
        which = parts.indices.to_numpy().reshape(2, -1)
        # chunks with added tokens are done whole below; their parts are not looked up
        held = pc.if_else(pc.match_substring(parts.dictionary, "<|"), "", parts.dictionary).dictionary_encode()
        shared, place = self._known_or_new(held.dictionary)
        odd = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        whole = self._ids([chunks[int(i)].as_py() for i in odd])
        pair = place[held.indices.to_numpy()][which.T]
        n = len(shared.lengths)
        pair[odd, 0], pair[odd, 1] = n + np.arange(len(odd)), n + len(odd)
        every = Pool(np.concatenate([shared.ids, whole.ids]), np.concatenate([shared.lengths, whole.lengths, [0]]))
        return Pool(every.take(pair.ravel()), every.lengths[pair].sum(1))

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (``end_id`` behind each text's) and their number per text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.by_chunk:
            split = pc.ascii_split_whitespace(texts)
            numbered = split.flatten().dictionary_encode()
            pool, which, ends = self._pool(numbered.dictionary), numbered.indices.to_numpy(), np.diff(split.offsets.to_numpy()).cumsum()
        else:
            pool, which, ends = self._ids(texts.to_pylist()), np.arange(len(texts)), np.arange(1, len(texts) + 1)
        if end_id is not None:
            pool = Pool(np.append(pool.ids, np.array([end_id], "<u4")), np.append(pool.lengths, 1))
            which = np.insert(which, ends, len(pool.lengths) - 1)
            ends = ends + np.arange(1, len(ends) + 1)
        reach = np.append(0, np.cumsum(pool.lengths[which]))
        return pool.take(which), np.diff(reach[np.append(0, ends)])

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of texts that are tokenised together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and held + n > LOT:
            yield first, k - first
            first, held = k, 0
        held += n
    if len(sizes) > first:
        yield first, len(sizes) - first


TOKENS = "doc_id long, part int, at long, tokens long, ids binary"


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, at (offset in the part), tokens, ids; written to the shared folder.

    ``path`` is the vocabulary file, found on each executor if not given.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(path or vocabulary()), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, n in _lots(batch.column("text")):
                ids, tokens = own.encode_all(batch.column("text").slice(first, n), end_id)
                ends = np.cumsum(tokens)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, ends * 4)), pa.py_buffer(ids)])
                columns = [
                    batch.column("doc_id").slice(first, n), pa.array(np.full(n, part, np.int32)), pa.array(at + ends - tokens), pa.array(tokens),
                    blobs.cast(pa.binary()),
                ]
                at += int(ends[-1])
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "tokens", "ids"])

    return in_small_batches(docs.sparkSession, lambda: materialize(pick(docs, "doc_id", "text").mapInArrow(encoded, TOKENS)))


def cut(tokens: DataFrame, window: int = WINDOW, ids: bool = True) -> DataFrame:
    """The pieces of ``tokenised`` documents; without ``ids`` their checksums only."""
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task of pass one
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(broadcast_if_small(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "ids")

    n = F.floor(F.octet_length("ids") / 4)
    own = placed.select("doc_id", n.alias("doc_tokens"), "at", "ids")
    held = F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("doc_tokens") - 1) / window))

    def piece(s):
        start = F.greatest(s * window - F.col("at"), F.lit(0))
        length = F.least((s + 1) * window - F.col("at"), F.col("doc_tokens")) - start
        blob = F.substring("ids", (4 * start + 1).cast("int"), (4 * length).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), s.alias("sequence_id"), blob.alias("ids"))

    # every document has a piece; outer, else Spark would make all pieces a first time to see that
    pieces = own.select("doc_id", "doc_tokens", "at", F.transform(held, piece).alias("pieces")).select("doc_id", "doc_tokens", "at", F.inline_outer("pieces"))
    offset = (F.col("at") + F.col("start") - F.col("sequence_id") * window).alias("offset")
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", offset, *["ids"] * ids
    )


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, ids: bool = True) -> DataFrame:
    return cut(tokenised(docs, path), window, ids)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (``window`` little-endian 32-bit ids, padded at the end), boundaries (offsets where a piece begins)."""
    one = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    s = pieces.groupBy("sequence_id").agg(one.alias("p"))
    joined = F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"])))
    pad = F.lit(np.array([pad_id], "<u4").tobytes().hex().upper() * window)
    padded = F.substring(F.concat(joined, pad), 1, window * 8)
    return s.select("sequence_id", F.unhex(padded).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("boundaries"))
