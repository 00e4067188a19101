"""Approximate nearest neighbours from balanced posting lists.

``fit`` clusters a bounded sample (SAMPLE vectors by hash, balanced k-means)
into at most LISTS centroids and links these to a small navigable graph; both
are bounded and broadcast.  Every vector goes to the posting list of its
nearest centroid, boundary vectors to every list up to (1 + CLOSURE) times that
distance, at most REPLICAS.  Lists are balanced after counting them: large ones
are cut into pieces by hash, small ones share a bin, so a bin holds about BIN
vectors whatever the data.  A query walks the centroid graph and takes every
list up to (1 + PROBE) times the nearest centroid's distance, without a cap;
where none of them holds more than k ids, it goes on to the next nearest lists
until one does or all are taken, so no query is short of neighbours that exist.

A bin meets the queries that ask for it, in blocks of about QUERY_BLOCK where
more than that do; each block returns a query's k best, scored exactly
(cosine in double precision on the original vectors, ties kept), and the best
of all bins are the answer.

Defined results: vectors that are null, zero, hold null or non-finite
components, have no id, or another length than most, take no part; copies of a
vector tie and go to the smaller id; rows that share an id count once a query,
with their best score, and never answer a query of that id; a query has fewer
than k rows if there are fewer candidates; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightwords.llm.common import pick
from flightwords.session import broadcast_if_small, materialize

SAMPLE = 20_000
LISTS = 1024
CLOSURE = 0.05
REPLICAS = 8
PROBE = 0.28
DEGREE = 16
ROUNDS = 8
BIN = 4_096
QUERY_BLOCK = 4_096
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, vec: array<double>) of the vectors that take part."""
    d = pick(df, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = d.filter("vec_id is not null and vec is not null").filter(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
    most = d.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return d.filter(F.size("vec") == (most["n"] if most else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Model:
    centroids: np.ndarray
    graph: list[np.ndarray]

    def closure(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that hold each vector."""
        d = np.sqrt(np.maximum(2 - 2 * unit @ self.centroids.T, 0))
        near = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
        own = np.take_along_axis(d, near, axis=1)
        row, k = np.nonzero(own <= own[:, :1] * (1 + CLOSURE))
        return row, near[row, k]

    def probes(self, unit: np.ndarray, enough: np.ndarray | None = None) -> np.ndarray:
        """The lists within the distance ratio, found by walking the graph from its hub.

        ``enough`` marks lists that can answer a query alone; the probe widens to the next one.
        """
        dist = {0: self._dist(np.array([0]), unit)[0]}
        best, at = dist[0], 0
        while True:  # greedy descent
            fresh = np.array([x for x in self.graph[at] if x not in dist], np.int64)
            if len(fresh):
                dist.update(zip(fresh.tolist(), self._dist(fresh, unit).tolist()))
            step = min(self.graph[at].tolist(), key=dist.__getitem__, default=at)
            if dist[step] >= best:
                break
            best, at = dist[step], step
        front, done = [at], set()
        while front:  # everything within the ratio, from neighbour to neighbour
            done.update(front)
            around = np.unique(np.concatenate([self.graph[x] for x in front] + [np.zeros(0, np.int64)]))
            fresh = np.array([x for x in around.tolist() if x not in dist], np.int64)
            if len(fresh):
                dist.update(zip(fresh.tolist(), self._dist(fresh, unit).tolist()))
            best = min(dist.values())
            front = [x for x, d in dist.items() if x not in done and d <= best * (1 + PROBE)]
        taken = np.array([x for x, d in dist.items() if d <= best * (1 + PROBE)], np.int64)
        if enough is None or enough[taken].any():
            return taken
        order = np.argsort(self._dist(np.arange(len(self.centroids)), unit), kind="stable")
        able = np.flatnonzero(enough[order])
        return np.union1d(taken, order[: able[0] + 1] if len(able) else order)

    def _dist(self, which: np.ndarray, unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * self.centroids[which] @ unit, 0))


def train(sample: np.ndarray, lists: int) -> Model:
    """Balanced k-means on the unit sphere: full clusters repel a little."""
    x = _unit(sample)
    cen = x[np.unique(np.linspace(0, len(x) - 1, lists).astype(int))].copy()
    counts = np.full(len(cen), len(x) / len(cen))
    for _ in range(ROUNDS):
        at = (x @ cen.T - 0.02 * (counts * len(cen) / len(x) - 1)).argmax(axis=1)
        counts = np.bincount(at, minlength=len(cen))
        sums = np.zeros_like(cen)
        np.add.at(sums, at, x)
        good = np.abs(sums).max(axis=1) > 1e-12
        cen[good] = _unit(sums[good])
    near = np.argsort(-(cen @ cen.T), axis=1, kind="stable")[:, 1 : DEGREE + 1]
    links = {(i, int(j)) for i, row in enumerate(near) for j in row}
    links |= {(j, i) for i, j in links} | {(i, i + 1) for i in range(len(cen) - 1)} | {(i + 1, i) for i in range(len(cen) - 1)}
    graph: list[list[int]] = [[] for _ in cen]
    for i, j in sorted(links):
        graph[i].append(j)
    return Model(cen, [np.array(g, np.int64) for g in graph])


def fit(vectors: DataFrame, n: int) -> Model | None:
    taken = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vec")).limit(SAMPLE).select("vec").toArrow()
    if not taken.num_rows:
        return None
    lists = max(1, min(LISTS, round(n**0.5), taken.num_rows))
    return train(_matrix(taken["vec"].combine_chunks()), lists)


def _layout(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """list -> (first bin, number of bins): small lists share one, large ones are cut."""
    out, at, held = {}, 0, 0
    for name, n in sorted(sizes.items()):
        if n > BIN:
            pieces = -(-n // BIN)
            at += held > 0
            out[name], at, held = (at, pieces), at + pieces, 0
            continue
        if held + n > BIN:
            at, held = at + 1, 0
        out[name], held = (at, 1), held + n
    return out


def search(df: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query among all other rows.

    ``df`` has vec_id and embedding; ``is_query`` is a condition on vec_id.
    """
    spark = df.sparkSession
    vectors = materialize(usable(df))
    n = vectors.count()
    model = fit(vectors, n)
    if model is None:
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast(model)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                row, at = shared.value.closure(_unit(_matrix(part.column("vec"))))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *taken.columns], ["list", "vec_id", "vec"])

    postings = materialize(vectors.mapInArrow(posted, "list int, vec_id long, vec array<double>"))
    # at most LISTS counts reach the driver
    counted = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids")).collect()
    layout = _layout({r["list"]: r["n"] for r in counted})
    enough = np.zeros(len(model.centroids), bool)
    enough[[r["list"] for r in counted if r["ids"] > k]] = True
    place = F.create_map(*[F.lit(x) for name, (first, pieces) in layout.items() for x in (name, first * (1 << 20) + pieces)])
    slot = F.try_element_at(place.cast("map<int,long>"), "list")
    first, pieces = F.shiftright(slot, 20), slot.bitwiseAND((1 << 20) - 1)
    binned = postings.withColumn("bin", (first + F.pmod(F.xxhash64("vec_id"), pieces)).cast("long"))

    queries = materialize(vectors.filter(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    bins = {name: np.arange(a, a + b) for name, (a, b) in layout.items()}

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(_matrix(batch.column("vec"))) if batch.num_rows else []
            for i, unit in enumerate(units):
                near = [bins[x] for x in shared.value.probes(unit, enough).tolist() if x in bins]
                own = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), batch.column("vec_id").take(pa.array(np.full(len(own), i)))], ["bin", "vec_id"])

    asks = materialize(queries.mapInArrow(asked, "bin long, vec_id long"))
    # only where more queries ask for a bin than one task should compare is the bin sent more than once
    blocks = F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int")
    per_bin = broadcast_if_small(materialize(asks.groupBy("bin").agg(blocks.alias("blocks"))))
    asks = asks.join(per_bin, "bin").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks").join(queries, "vec_id")
    binned = binned.join(per_bin, "bin").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("list", "blocks")

    def best(posting: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(posting) and len(query):
            ids, x = posting["vec_id"].to_numpy(), np.stack(posting["vec"].to_numpy())
            names, q = query["vec_id"].to_numpy(), np.stack(query["vec"].to_numpy())
            ux = _unit(x)
            # a vector in several lists of the bin, or an id in several rows, must not crowd others out
            wide = k * int(posting["vec_id"].value_counts().iloc[0])
            norm = np.sqrt((x * x).sum(axis=1))
            for i, row in enumerate(q):
                near = ux @ _unit(row[None])[0]
                near[ids == names[i]] = -np.inf
                # all that may be among the k best, whatever the rounding of the product
                edge = np.partition(near, -wide)[-wide] if len(near) >= wide else -2.0
                at = np.flatnonzero(near >= max(edge - 1e-9, -2.0))
                score = (x[at] * row).sum(axis=1) / (norm[at] * np.sqrt((row * row).sum()))
                score = np.where(np.isfinite(score), score, near[at])
                top = np.lexsort((ids[at], -score))
                seen: dict[int, float] = {}
                for t in top:
                    if len(seen) == k:
                        break
                    seen.setdefault(int(ids[at[t]]), float(score[t]))
                out["query_id"] += [int(names[i])] * len(seen)
                out["vec_id"] += list(seen)
                out["score"] += list(seen.values())
        return pd.DataFrame({c: pd.Series(v, dtype="float64" if c == "score" else "int64") for c, v in out.items()})

    keys = ["bin", "block"]
    found = binned.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    met = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
