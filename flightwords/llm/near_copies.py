"""Near copies by SimHash, exact Jaccard similarity of word shingles and a join on rare shingles.

A text's set holds the hashes of its shingles of WIDTH words (A-Z lower-cased,
words separated by ASCII white space; a text of fewer words is one shingle, a
text without words has the empty set).  Texts are linked when the Jaccard
similarity of their sets is at least 4/5; of every component one stays.

Every linked pair is found.  A set of n shingles shares at least 4n/5 of them
with each partner, so it may hold n // 5 that no other text has:

1. Every other shingle hash (by one bit of itself) is dealt to a shard, which
   marks those of several texts in a bitmap.  It is broadcast, and of bounded
   size: false marks cost work, never results.
2. Texts with more than n // 5 unmarked hashes leave; the sets of the others
   are written with a SimHash fingerprint of their shingles.  Equal sets become
   one node.
3. Fingerprints within RADIUS bits, found by the tiled comparison of ``simhash``,
   give candidates; those with a similarity of 4/5 are links.  Similar sets may
   have fingerprints farther apart, so the join below finds the others.
4. Sets are ordered by rarity; linked sets have one of their first n // 5 + 1
   shingles in common.  Stars, around two nodes of a shingle's list (one of them
   that with the fewest shingles of its own, as an original has), settle large
   groups with few comparisons, in ROUNDS rounds; then those pairs of a list that no
   star has joined are compared whose sizes and positions let them be similar.

Defined results: null text counts as empty; null doc_ids come after all others;
of equal rows one stays; an empty table gives an empty table; further columns
are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwords.llm import simhash
from flightwords.llm.common import in_small_batches, partitions, pick, unpack
from flightwords.llm.components import components
from flightwords.llm.simhash import LOWER
from flightwords.session import broadcast_if_small, materialize

WIDTH = 5
SEED = 42
#: Bytes of text per shard; bits of the bitmap, at least and most.
SHARD_BYTES, LEAST_BITS, MOST_BITS = 64 << 20, 20, 30
#: Hashes that are handed on together, and words a worker remembers.
FLUSH, REMEMBERED = 1 << 18, 100_000
#: Hashes whose bits are counted together.
HASHED = 1 << 12
#: Bits by which fingerprints of candidates differ at most.
RADIUS = 12
#: Times that lists choose middles.
ROUNDS = 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Text -> sorted distinct shingle hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(WIDTH, len(words))
        out = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            out = (out ^ (out >> np.uint64(29))) * MULTIPLIER + h[k : k + len(out)]
        out = (out ^ (out >> np.uint64(32))) * MULTIPLIER
        return np.unique(out ^ (out >> np.uint64(29)))


class Plan:
    """Where a hash has its shard and its bit."""

    def __init__(self, total: int, least_shards: int):
        self.bits = int(np.clip(np.ceil(np.log2(max(total / 16, 2))), LEAST_BITS, MOST_BITS))
        self.shard_bits = int(np.clip(np.ceil(np.log2(max(total / SHARD_BYTES, least_shards, 2))), 1, 14))
        self.slice_bits = self.bits - self.shard_bits

    @staticmethod
    def sampled(h: np.ndarray) -> np.ndarray:
        return h[(h >> np.uint64(32)) & np.uint64(1) == 0]

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(40)) & np.uint64((1 << self.shard_bits) - 1)

    def bit(self, h: np.ndarray) -> np.ndarray:
        return (self.shard(h) << np.uint64(self.slice_bits)) | (h & np.uint64((1 << self.slice_bits) - 1))


def _shared(d: DataFrame, plan: Plan) -> np.ndarray:
    """Bitmap of the sampled hashes that several texts hold."""

    def dealt(found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        shard, low = plan.shard(h), (h & np.uint64(0xFFFFFFFF)).astype("<u4")
        order = np.argsort(shard, kind="stable")
        shard, low, many = shard[order], low[order], n[order] > 1
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        rows = [(int(shard[a]), low[a:b].tobytes(), low[a:b][many[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        kinds = (pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "once", "many"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, found, held = Shingler(), [], 0
        for batch in batches:
            for t in batch.column("text"):
                found.append(plan.sampled(shingles(t.as_py() or b"")))
                held += len(found[-1])
                if held > FLUSH:
                    yield dealt(found)
                    found, held = [], 0
        if held:
            yield dealt(found)

    def marked(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(np.frombuffer(b"".join(rows["once"]), "<u4"))
        twice = np.concatenate([own[1:][own[1:] == own[:-1]], np.frombuffer(b"".join(rows["many"]), "<u4")])
        bits = np.zeros(1 << plan.slice_bits, bool)
        bits[twice & np.uint32((1 << plan.slice_bits) - 1)] = True
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slices = d.mapInArrow(seen, "shard int, once binary, many binary").groupBy("shard").applyInPandas(marked, "shard int, bits binary")
    bitmap, width = np.zeros(1 << (plan.bits - 3), np.uint8), 1 << (plan.slice_bits - 3)
    for r in slices.toLocalIterator():  # MOST_BITS at most reach the driver
        bitmap[r["shard"] * width : (r["shard"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def _fingerprint(h: np.ndarray) -> int:
    """SimHash of shingle hashes: the bits that over half of them have."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), HASHED):
        total += np.unpackbits(h[k : k + HASHED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.int64)[0])


def suspects(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, node, fp, grams) of the texts that may have a partner; equal sets have equal nodes."""
    text = F.coalesce("text", F.lit(""))
    d = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    spark = docs.sparkSession
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(total, partitions(spark))
    shared = spark.sparkContext.broadcast(in_small_batches(spark, lambda: _shared(d, plan)))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, shingles = shared.value, Shingler()
        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("grams", pa.list_(pa.int64()))])
        for batch in batches:
            rows, held = [], 0
            for doc_id, tie, t in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text")):
                h = shingles(t.as_py())
                bit = plan.bit(plan.sampled(h))
                alone = np.count_nonzero((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 0)
                if alone <= len(h) // 5:
                    node = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64))
                    rows.append((doc_id, tie, node, _fingerprint(h), h.view(np.int64)))
                    held += len(h)
                if held > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    out = in_small_batches(spark, lambda: materialize(d.mapInArrow(left, "doc_id long, tie long, node long, fp long, grams array<long>")))
    shared.destroy()  # workers would keep it
    return out


def _postings(nodes: DataFrame) -> DataFrame:
    """(gram, node, n, alone, pos) of the first n // 5 + 1 grams of every set, rarest first."""
    grams = nodes.select("node", "n", F.explode("grams").alias("gram"))
    several = grams.groupBy("gram").count().filter("count > 1")
    own = grams.join(several, "gram").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "gram"))).alias("own"))
    own = own.withColumn("alone", F.col("n") - F.size("own")).filter("alone <= n div 5")
    first = own.withColumn("own", F.slice("own", F.lit(1), (F.expr("n div 5") + 1 - F.col("alone")).cast("int")))
    one = first.select("node", "n", "alone", F.posexplode("own").alias("at", "own"))
    return one.select("own.gram", "node", "n", "alone", (F.col("alone") + F.col("at")).alias("pos"))


def _similar(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those with a Jaccard similarity of 4/5 or more."""
    a = nodes.select(F.col("node").alias("u"), F.col("grams").alias("a"))
    b = nodes.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v")
    return both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _sized(m: str, n: str):
    return 5 * F.least(m, n) >= 4 * F.greatest(m, n)


def _placed(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of grams that several components hold, with the component."""
    p = postings.join(found.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = p.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("gram")
    return p.join(open_, "gram")


def _star_links(placed: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Similar pairs (u, v) of the nodes of each list with two middles of it, in other components than theirs.

    One middle is any node, the other shares most of what it holds, as the text does that others were copied from.
    """
    by_chance = F.xxhash64("node", "gram", F.lit(turn))
    middles = [F.min_by(F.struct("node", "n", "comp"), order) for order in (by_chance, F.struct(F.col("alone") / F.col("n"), by_chance))]
    middle = placed.groupBy("gram").agg(F.array_distinct(F.array(*middles)).alias("ms")).select("gram", F.explode("ms").alias("m"))
    stars = placed.join(middle, "gram").filter((F.col("comp") != F.col("m.comp")) & _sized("n", "m.n"))
    return _similar(stars.select(F.col("node").alias("u"), F.col("m.node").alias("v")).distinct(), nodes)


def _print_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Similar pairs (u, v) of nodes whose fingerprints are equal or linked; one node stands for its fingerprint."""
    of = materialize(nodes.groupBy("fp").agg(F.min("node").alias("v")))
    equal = nodes.join(of, "fp").filter("node <> v").select(F.col("node").alias("u"), "v")
    near = simhash.links(of, radius).withColumnsRenamed({"u": "fp", "v": "other"})
    near = near.join(of.withColumnRenamed("v", "u"), "fp").join(of.withColumnRenamed("fp", "other"), "other").select("u", "v")
    return _similar(equal.unionByName(near).distinct(), nodes)


def _partners(placed: DataFrame) -> DataFrame:
    """(u, v, m, n) of the nodes of different components that may be similar by sizes and positions.

    In the first gram that two sets share, both have in their rests all that they
    share; so a gram at ``pos`` leads to sets of at most ``reach`` grams.
    """
    p = placed.withColumn("reach", F.expr("9 * (n - pos) div 4 - n"))
    ends = p.groupBy("gram").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    p = p.join(ends, "gram").filter("reach >= least and n <= most").drop("least", "most")
    # the largest component of a list never meets itself
    held = p.groupBy("gram", "comp").count().groupBy("gram").agg(F.max_by("comp", F.struct("count", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
    p = materialize(p.join(held.filter("comps > 1"), "gram").select("gram", "node", "n", "pos", "reach", "comp", "top"))
    a = p.filter("comp <> top").select("gram", F.struct("node", "n", "pos", "reach", "comp", "top").alias("a"))
    b = p.select("gram", F.struct("node", "n", "pos", "reach", "comp").alias("b"))
    once = (F.col("b.comp") == F.col("a.top")) | (F.col("a.comp") < F.col("b.comp"))
    fit = (F.col("a.n") <= F.col("b.reach")) & (F.col("b.n") <= F.col("a.reach"))
    pairs = a.join(b, (a["gram"] == b["gram"]) & (F.col("a.comp") != F.col("b.comp")) & once & fit)
    least, most = F.least("a.node", "b.node"), F.greatest("a.node", "b.node")
    first = F.col("a.node") < F.col("b.node")
    of = lambda c, one: F.when(first == one, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    pairs = pairs.select(least.alias("u"), most.alias("v"), of("n", True).alias("m"), of("n", False).alias("n"), of("pos", True).alias("p"), of("pos", False).alias("q"))
    pairs = pairs.groupBy("u", "v", "m", "n").agg(F.count(F.lit(1)).alias("met"), F.max("p").alias("p"), F.max("q").alias("q"))
    # after the last of these grams no more than the shorter rest can be shared
    able = 9 * (F.col("met") + F.least(F.col("m") - F.col("p") - 1, F.col("n") - F.col("q") - 1)) >= 4 * (F.col("m") + F.col("n"))
    return pairs.filter(able).select("u", "v", "m", "n")


def linked(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes (node, fp, n, grams) that have a partner."""
    found = components(_print_links(nodes))
    postings = materialize(_postings(nodes))
    placed = materialize(_placed(postings, found))
    for turn in range(ROUNDS):
        # middles only meet nodes that nothing has joined to them
        new = materialize(_star_links(placed, nodes, turn))
        if new.isEmpty():
            break
        found = components(new.unionByName(found.toDF("u", "v")))
        placed = materialize(_placed(postings, found))
    last = materialize(_similar(_partners(placed), nodes))
    return found if last.isEmpty() else components(last.unionByName(found.toDF("u", "v")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of every component, that of smallest doc_id; columns as they are."""
    prints = suspects(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("first")
    nodes = prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("grams").alias("grams"))
    nodes = materialize(nodes.select("node", "fp", F.size("grams").alias("n"), "grams"))
    found = linked(nodes)
    members = prints.groupBy("node", "doc_id", "tie").count().join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = materialize(members)
    heads = members.groupBy("root").agg(first)
    placed = members.join(heads, "root")
    head = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    gone = materialize(placed.filter(~head).select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")))
    twice = materialize(placed.filter(head & (F.col("count") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")))
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text", row=True).withColumn("tie", F.xxhash64(text)).drop("text")
    of = lambda x: rows["doc_id"].eqNullSafe(x["gone_id"]) & (rows["tie"] == x["gone_tie"])
    if twice.isEmpty():
        gone = broadcast_if_small(gone)
        return unpack(rows.join(gone, of(gone), "left_anti"), docs.columns)
    every = broadcast_if_small(gone.unionByName(twice))
    kept = rows.join(every, of(every), "left_anti").select("row")
    again = broadcast_if_small(twice)
    once = rows.join(again, of(again), "left_semi").groupBy("doc_id", "tie").agg(F.first("row").alias("row"))
    return unpack(kept.unionByName(once.select("row")), docs.columns)
