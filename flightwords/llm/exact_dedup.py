"""Exact deduplication over a sharded cuckoo-filter index of live digests.

Texts are equal when they are identical after every run of ASCII white space
became one space; null counts as empty.  Their SHA-256 digests are dealt over
shards by prefix.  A shard keeps a cuckoo filter (four 16-bit tags a bucket);
beside each tag it keeps the full digest and what is known of it.  A tag hit is
verified against those stored digests, so a filter collision never merges two
texts.  When an insertion finds no free slot the table is doubled and refilled
from the stored digests.

The index is a table (shard, digest, keep_id, live): ``build`` makes one,
``change`` applies insertions and deletions to one, shard by shard.  Copies
meet before the shuffle (one row per digest and Arrow batch), so a text that a
third of all rows share costs its shard one row per batch.

Defined results: null doc_ids come after all others; equal rows (same doc_id
and text) are one group of which one row stays; an empty table gives an empty
table; further columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwords.llm.common import SPACE, partitions, pick, unpack
from flightwords.session import materialize

SLOTS = 4
TAG_BITS = 16
MAX_KICKS = 200
#: Stands for a null doc_id: larger than every other.
NO_ID = np.iinfo(np.int64).max
SHARD_ROWS = 200_000
INDEX_SCHEMA = "shard int, digest binary, keep_id long, live long"


class CuckooIndex:
    """Digest -> [keep_id, live] with membership answered by a cuckoo filter."""

    def __init__(self, expected: int = 1024):
        self.digests: list[bytes | None] = []
        self.facts: list[list] = []
        self.free: list[int] = []
        size = SLOTS
        while size * SLOTS * 0.8 < expected:
            size *= 2
        self._clear(size)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [0] * (buckets * SLOTS)
        self.keys = [-1] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int:
        """The slot of a live digest, or -1; every tag hit is verified."""
        tag, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[slot] == tag and self.digests[self.keys[slot]] == digest:
                    return slot
        return -1

    def _put(self, digest: bytes, key: int) -> bool:
        tag, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.keys[slot] = tag, key
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            self.tags[slot], tag = tag, self.tags[slot]
            self.keys[slot], key = key, self.keys[slot]
            bucket = self._other(bucket, tag)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.keys[slot] = tag, key
                    return True
        return False

    def _grow(self) -> None:
        buckets = (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._put(d, k) for k, d in enumerate(self.digests) if d is not None):
                return
            buckets *= 2

    def insert(self, digest: bytes, doc_id: int, copies: int = 1) -> None:
        slot = self.find(digest)
        if slot >= 0:
            fact = self.facts[self.keys[slot]]
            fact[0] = min(fact[0], doc_id)
            fact[1] += copies
            return
        if self.free:
            key = self.free.pop()
            self.digests[key], self.facts[key] = digest, [doc_id, copies]
        else:
            key = len(self.digests)
            self.digests.append(digest)
            self.facts.append([doc_id, copies])
        if not self._put(digest, key):
            self._grow()

    def delete(self, digest: bytes, copies: int = 1) -> bool:
        """Take live copies of a digest away; False if it isn't live.  With the
        last one the digest leaves the filter; until then keep_id stays."""
        slot = self.find(digest)
        if slot < 0:
            return False
        key = self.keys[slot]
        self.facts[key][1] -= copies
        if self.facts[key][1] <= 0:
            self.tags[slot], self.keys[slot] = 0, -1
            self.digests[key] = None
            self.free.append(key)
        return True

    def frame(self, shard: int) -> pd.DataFrame:
        live = [(d, *f) for d, f in zip(self.digests, self.facts) if d is not None]
        return pd.DataFrame({
            "shard": np.full(len(live), shard, np.int32), "digest": [x[0] for x in live],
            "keep_id": np.array([x[1] for x in live], np.int64), "live": np.array([x[2] for x in live], np.int64),
        })


def digest(text):
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "), 256))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest of a batch: smallest doc_id and number of copies."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by("digest").aggregate([("doc_id", "min"), ("n", "sum")])
        t = t.select(["digest", "doc_id_min", "n_sum"]).rename_columns(["digest", "doc_id", "n"])
        yield from t.combine_chunks().to_batches()


def _dealt(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, digest, doc_id, n) of (digest, doc_id) rows, copies already met."""
    rows = keys.select("digest", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), F.lit(1).cast("long").alias("n"))
    met = rows.mapInArrow(_met, "digest binary, doc_id long, n long")
    prefix = F.conv(F.hex(F.substring("digest", 11, 4)), 16, 10).cast("long")
    return met.select((prefix % shards).cast("int").alias("shard"), "digest", "doc_id", "n")


def _filled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    index = CuckooIndex(len(rows))
    for d, i, n in zip(rows["digest"], rows["doc_id"].tolist(), rows["n"].tolist()):
        index.insert(bytes(d), i, n)
    return index.frame(int(key[0]))


def build(keys: DataFrame, shards: int) -> DataFrame:
    """The index of ``keys`` (digest, doc_id)."""
    return _dealt(keys, shards).groupBy("shard").applyInPandas(_filled, INDEX_SCHEMA)


def change(index: DataFrame, shards: int, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The index after deletions, then insertions of (digest, doc_id) rows.

    ``shards`` is the number the index was built with.
    """
    parts = [_dealt(df, shards).withColumn("sign", F.lit(s)) for df, s in ((deletes, -1), (inserts, 1)) if df is not None]
    changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def applied(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        filled = CuckooIndex(len(old) + len(new))
        for d, i, n in zip(old["digest"], old["keep_id"].tolist(), old["live"].tolist()):
            filled.insert(bytes(d), i, n)
        for d, n in zip(*[new.loc[new["sign"] < 0, c] for c in ("digest", "n")]):
            filled.delete(bytes(d), n)
        put = new[new["sign"] > 0]
        for d, i, n in zip(put["digest"], put["doc_id"].tolist(), put["n"].tolist()):
            filled.insert(bytes(d), i, n)
        return filled.frame(int(key[0]))

    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(applied, INDEX_SCHEMA)


def shards_for(df: DataFrame) -> int:
    """So many shards that one holds about SHARD_ROWS rows, and all cores have one."""
    return max(partitions(df.sparkSession), -(-df.count() // SHARD_ROWS))


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    The texts are read once; (doc_id, digest) rows are written to the shared
    folder and everything after works on those.  Joins are by digest; a digest
    with very many rows is split by Spark's skew handling.
    """
    d = pick(docs, "doc_id", "text")
    keys = materialize(d.select("doc_id", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("uid")))
    index = build(keys, shards_for(keys)).filter("live > 1").select("digest", "keep_id", "live")
    joined = keys.join(index, "digest", "left")
    null_id = F.lit(int(NO_ID))
    lone = F.col("live").isNull()
    first = F.coalesce("doc_id", null_id) == F.col("keep_id")
    # of rows that share the keeper's doc_id and text the first one stays; the groups are pre-aggregated
    again = (
        joined.filter(first).groupBy("digest").agg(F.count(F.lit(1)).alias("same"), F.min("uid").alias("keeper")).filter("same > 1")
        .select("digest", "keeper")
    )
    out = joined.join(again, "digest", "left")
    return out.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.nullif("keep_id", null_id)).alias("keep_id"),
        F.coalesce("live", F.lit(1).cast("long")).alias("group_size"),
        (lone | (first & F.coalesce(F.col("uid") == F.col("keeper"), F.lit(True)))).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without later copies; all columns as they are.

    The kept (doc_id, digest) pairs meet the rows again.  Only rows that repeat
    a kept pair outright go through a second, pre-aggregated step.
    """
    rows = pick(docs, "doc_id", "text", row=True).withColumn("digest", digest(F.col("text"))).drop("text")
    marks = materialize(groups(docs))
    kept = marks.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    pairs = (
        marks.filter("group_size > 1").groupBy("doc_id", "digest").count().filter("count > 1")
        .select(F.col("doc_id").alias("same_id"), F.col("digest").alias("same_digest"))
    )
    stay = rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows["digest"] == kept["kept_digest"]), "left_semi")
    same = stay["doc_id"].eqNullSafe(pairs["same_id"]) & (stay["digest"] == pairs["same_digest"])
    if pairs.isEmpty():
        return unpack(stay, docs.columns)
    single = stay.join(pairs, same, "left_anti").select("row")
    one = stay.join(pairs, same, "left_semi").groupBy("doc_id", "digest").agg(F.first("row").alias("row")).select("row")
    return unpack(single.unionByName(one), docs.columns)
