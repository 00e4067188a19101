"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Components become whole numbers floor(SCALE * c), so that counts and sums are
exact.  The fit list holds each distinct vector once.  It is read three times:

1. every task sums its vectors, Spark adds the sums up by place; S / n is the mean;
2. every task stacks blocks of centred rows on the triangle it holds and reduces
   them by QR; the triangles are stacked and reduced the same way, in two more
   steps.  What reaches the driver is one triangle, as large as a vector is long.
   Its right singular vectors are the eigenvectors of the covariance, which is
   never formed (``bidiagonal``);
3. rows (1, whitened) are reduced alike.  The triangle without its first row and
   column belongs to whitened values centred once more, and gives their true
   distance from identity.

Defined results: rows whose vector is null or holds null, NaN or infinite
entries are left out.  Vectors of another length than most of the fit list have
(ties: the shorter) take no part in the fit and get null measures, as do
components without variance their ``whitened``; a deviation beyond the range of
long is null; components beyond it become its ends.  Repeated rows are answered each,
null ids stay, an empty table gives an empty one, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwords.llm.bidiagonal import EPS, right_singular
from flightwords.llm.common import partitions, pick
from flightwords.session import materialize

SCALE = 256
COMPONENTS = 4
#: Rows that are reduced at a time, as a multiple of their length.
BLOCK = 8


@dataclass
class Whitening:
    """What a fit found; ``vectors`` and ``values`` are eigenvectors (rows) and eigenvalues, falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column per component; NaN where the component has no variance."""
        real = self.values > EPS * len(self.sums) * max(self.trace, 0.0)
        scale = np.where(real, self.values, np.nan) ** 0.5
        return (x - self.mean) @ self.vectors.T / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact."""
        most = max([abs(s) for s in self.sums] + [0]) + self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if most**2 * len(self.sums) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        own = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [v if v < 1 << 63 else None for v in own]


def scaled(df: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id, x array<long> of the rows that take part."""
    d = pick(df, id_column, vector).toDF("id", "v")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    known = d.filter(F.col("v").isNotNull() & F.forall("v", finite))
    return known.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x"))


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from decimal import Decimal

    n, high, low = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch.column("x"), np.int64)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
    if n:
        total = [Decimal((int(h) << 32) + int(b)) for h, b in zip(high, low)]
        columns = [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total, pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["place", "n", "total"])


def triangle(rows: DataFrame) -> np.ndarray | None:
    """R of all ``rows`` (one column array<double>, one length); None without rows."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, r = [], 0, None

        def stacked():
            blocks = held if r is None else [r, *held]
            return np.linalg.qr(np.concatenate(blocks), mode="r")

        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0), np.float64)
                held.append(x)
                count += len(x)
                if count >= BLOCK * x.shape[1]:
                    r, held, count = stacked(), [], 0
        if held:
            r = stacked()
        if r is not None:  # a row a line, so that triangles reduce as any rows do
            yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["row"])

    kind = "row array<double>"
    spread = max(1, round(partitions(rows.sparkSession) ** 0.5))
    some = rows.mapInArrow(reduced, kind).withColumn("part", F.spark_partition_id())
    fewer = some.repartition(spread, "part").select("row").mapInArrow(reduced, kind)
    last = fewer.coalesce(1).mapInArrow(reduced, kind).collect()  # at most as many rows as a vector is long
    return np.array([r["row"] for r in last]) if last else None


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``x`` (column x array<long>); None without any."""
    distinct = materialize(x.select("x").filter(F.size("x") > 0).distinct())
    common = distinct.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return None
    own = distinct.filter(F.size("x") == common["size"])
    parts = own.mapInArrow(_sums, "place int, n long, total decimal(38, 0)")
    by_place = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("place").collect()  # one row per dimension
    found = Whitening(by_place[0]["n"], [int(r["total"]) for r in by_place], np.zeros(0), np.zeros((0, len(by_place))), 0.0)
    shared = own.sparkSession.sparkContext.broadcast(found.mean)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column("x"), np.float64) - shared.value if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64()))], ["row"])

    r = triangle(own.mapInArrow(centred, "row array<double>"))
    square = np.zeros((r.shape[1], r.shape[1]))
    square[: len(r)] = r
    squares, vectors = right_singular(square, components)
    found.values, found.vectors, found.trace = squares[: len(vectors)] / found.n, vectors, float(squares.sum()) / found.n
    found.identity_error = _identity_error(own, found)
    return found


def _identity_error(own: DataFrame, found: Whitening) -> float:
    shared = own.sparkSession.sparkContext.broadcast(found)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            if batch.num_rows:
                w = shared.value.whitened(_rows(batch.column("x"), np.float64))
                rows = np.column_stack([np.ones(len(w)), w[:, ~np.isnan(w[0])]])
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64()))], ["row"])

    r = triangle(own.mapInArrow(marked, "row array<double>"))[1:, 1:]
    if not r.shape[1]:
        return 0.0
    return float(np.abs(r.T @ r / found.n - np.eye(r.shape[1])).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(x: DataFrame, found: Whitening | None) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error of every row of ``scaled``."""
    schema = f"id {x.schema['id'].dataType.simpleString()}, {RESULT}"
    if found is None:
        return x.sparkSession.createDataFrame([], schema)
    shared = x.sparkSession.sparkContext.broadcast(found)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, size = len(m.values), len(m.sums)
        explained = [float(v / m.trace) if m.trace > 0 else None for v in m.values]
        for batch in batches:
            ids, column = batch.column("id"), batch.column("x")
            fits = np.array([len(v) == size for v in column], bool) if batch.num_rows else np.zeros(0, bool)
            deviation, white = np.full(len(fits), None, object), np.full((len(fits), k), np.nan)
            if fits.any():
                own = _rows(column.filter(pa.array(fits)), np.int64)
                deviation[fits], white[fits] = m.deviations(own), m.whitened(own)
            at = np.repeat(np.arange(len(fits)), k)
            columns = [
                ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), len(fits)), pa.int32()), pa.array(np.full(len(at), m.n), pa.int64()),
                pa.array(deviation[at].tolist(), pa.int64()), pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel())),
                pa.array(explained * len(fits), pa.float64()), pa.array(np.full(len(at), m.identity_error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return x.mapInArrow(answered, schema)
