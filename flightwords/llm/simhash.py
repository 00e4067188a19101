"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64
hashes (seed 42) of a text's shingles of ``width`` words, repeats included.
A-Z are lower-cased, words are separated by ASCII white space; a text of fewer
words is one shingle, a text without words has fingerprint zero.

Distinct fingerprints are laid out in tiles of one population count and at most
TILE entries.  Fingerprints within ``radius`` bits differ by no more than that
in population count, so only tile pairs that near are compared: numpy
exclusive-or and bit counts, block by block, each block again only against the
stretch whose counts over the upper and the lower half can be near enough.
A task returns a spanning forest of the links it found, never the links
themselves; components are contracted on Spark.

The comparison is exact and so grows with the square of the number of distinct
fingerprints; tiles of fixed size keep each task bounded.

Defined results: null text counts as empty; null doc_ids come after all others;
equal texts share a fingerprint and so a component; an empty table gives an
empty table; further columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightwords.llm.common import partitions, pick, unpack
from flightwords.llm.components import components
from flightwords.session import materialize

WIDTH = 4
RADIUS = 4
SEED = 42
TILE = 1 << 17
#: Rows and columns of one numpy comparison: a few MB, near the processor.
ROWS, COLS = 64, 4096
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
HASHED = 1 << 16


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < width:
        starts, ends = [0], [len(joined)]
    else:
        starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), HASHED):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + HASHED], ends[k : k + HASHED])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, tie, fp) of every document; ``tie`` tells texts of one doc_id apart."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(fps, pa.int64())], ["doc_id", "tie", "fp"])

    text = F.coalesce("text", F.lit(""))
    d = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    return d.mapInArrow(made, "doc_id long, tie long, fp long")


class _Forest:
    """Union of linked entries; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self._roots(a), self._roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def _roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                self.up[x] = r
                return r
            r = s


def _near(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of entries of two tiles within the radius; tiles are sorted by ``_halves``."""
    (ha, la), (hb, lb) = _halves(a), _halves(b)
    xor, bits = np.empty((ROWS, COLS), np.uint64), np.empty((ROWS, COLS), np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(ha)) + 1, [len(a)]])
    for top, bottom in zip(edges[:-1], edges[1:]):
        fit = np.flatnonzero(np.abs(hb - ha[top]) + np.abs(lb - la[top]) <= radius)
        if not len(fit):
            continue
        left, right = fit[0], fit[-1] + 1
        for i in range(top, bottom, ROWS):
            x = a[i : min(i + ROWS, bottom), None]
            for j in range(max(left, i) if same else left, right, COLS):
                y = b[None, j : min(j + COLS, right)]
                n, m = len(x), y.shape[1]
                np.bitwise_xor(x, y, out=xor[:n, :m])
                np.bitwise_count(xor[:n, :m], out=bits[:n, :m])
                p, q = np.nonzero(bits[:n, :m] <= radius)
                if len(p):
                    yield p + i, q + j


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bitwise_count(x >> np.uint64(32)).astype(np.int64), np.bitwise_count(x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _compared(radius: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        tiles = [np.array(x, np.int64).view(np.uint64) for x in rows["fps"]]
        tiles = [x[np.argsort(_halves(x)[0], kind="stable")] for x in tiles]
        same = len(tiles) == 1
        a, b = tiles[0], tiles[-1]
        every = a if same else np.concatenate([a, b])
        forest = _Forest(len(every))
        for p, q in _near(a, b, radius, same):
            forest.link(p, q if same else q + len(a))
        root = forest._roots(np.arange(len(every)))
        moved = np.flatnonzero(root != np.arange(len(every)))
        return pd.DataFrame({"u": every[moved].view(np.int64), "v": every[root[moved]].view(np.int64)})

    return compare


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) whose components are those of all links among ``nodes`` (fp, distinct)."""
    n = nodes.select("fp", F.bit_count("fp").alias("pop"))
    # 65 counts at most reach the driver
    per_pop = {r["pop"]: -(-r["count"] // tile) for r in n.groupBy("pop").count().collect()}
    slices = F.array(*[F.lit(per_pop.get(p, 0)) for p in range(65)])
    of = lambda pop: F.element_at(slices, pop + 1)
    n = n.withColumn("slice", F.pmod(F.xxhash64("fp", F.lit(1)), of(F.col("pop"))).cast("int"))
    tiles = n.groupBy("pop", "slice").agg(F.collect_list("fp").alias("fps"))
    tiles = tiles.withColumn("tile", F.struct("pop", "slice"))
    near = F.sequence(F.greatest(F.col("pop") - radius, F.lit(0)), F.least(F.col("pop") + radius, F.lit(64)))
    others = F.flatten(F.transform(near, lambda p: F.transform(
        F.filter(F.sequence(F.lit(0), of(p)), lambda s: s < of(p)), lambda s: F.struct(p.alias("pop"), s.alias("slice")))))
    sides = tiles.select("tile", "fps", F.explode(others).alias("other"))
    sides = sides.select("tile", "fps", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    # comparing costs far more than moving: one partition holds few pairs, and stays as it is
    total = sum(per_pop.get(p, 0) * sum(per_pop.get(q, 0) for q in range(p, p + radius + 1)) for p in per_pop)
    pairs = sides.repartition(max(partitions(nodes.sparkSession), min(total, 20_000)), "a", "b")
    return pairs.groupBy("a", "b").applyInPandas(_compared(radius), "u long, v long")


def groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, tie, fp, component_id, keeper (the tie of the document that stands for its component)."""
    prints = materialize(fingerprints(docs, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie"))
    nodes = materialize(prints.groupBy("fp").agg(first.alias("first")))
    found = components(links(nodes.select("fp"), radius))
    placed = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    of = placed.join(heads, "root").select("fp", F.col("head.doc_id").alias("component_id"), F.col("head.tie").alias("keeper"))
    return prints.join(of, "fp").select("doc_id", "tie", "fp", "component_id", "keeper")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of every component, that of smallest doc_id; columns as they are."""
    stay = groups(docs, width, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tie") == F.col("keeper")))
    stay = materialize(stay.groupBy("doc_id", "tie").count())
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text", row=True).withColumn("tie", F.xxhash64(text)).drop("text")
    ids = stay.select(F.col("doc_id").alias("stay_id"), F.col("tie").alias("stay_tie"), "count")
    kept = rows.join(ids, rows["doc_id"].eqNullSafe(ids["stay_id"]) & (rows["tie"] == ids["stay_tie"]))
    if stay.filter("count > 1").isEmpty():
        return unpack(kept, docs.columns)
    once = kept.filter("count > 1").groupBy("doc_id", "tie").agg(F.first("row").alias("row"))
    return unpack(kept.filter("count = 1").select("row").unionByName(once.select("row")), docs.columns)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
