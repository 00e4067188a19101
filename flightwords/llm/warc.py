"""WARC archives with revisit records, and an index merged from sorted capture runs.

``write`` makes one WARC 1.1 record per page (payload: the html in UTF-8, null
is empty).  Of equal payloads of at least ``least_bytes`` the page with the
largest id is stored as a response; the others become revisit records that name
it and repeat no payload.  Pages meet their payload's digest in one shuffle
(skewed digests are split by Spark), and every output partition becomes one
gzipped archive whose records are sorted by URL key and time: a capture run.
Spark's text writer does the writing, so archives land where Spark writes.

``read`` takes archives apart by content length and yields, per archive and key
range, a sorted run of index entries.  ``merge`` brings the runs of a range
together with a tree of losers, k ways, ordered by (URL key, time, page id).
Ranges follow quantiles of those three, so one host or URL may hold any share
of the captures; together the ranges are one global capture history.

Defined results: null payloads are empty ones; pages that share the largest id
of a payload are all responses; null ids count as smaller than any; null URLs
have an empty key; repeated rows are captures of their own; an empty table
gives empty archives and an empty history; further columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightwords.llm.common import partitions, pick
from flightwords.session import checkpoint_dir, materialize

LEAST_BYTES = 0
#: Pages a second from here on, where pages carry no time of their own.
EPOCH = 1_577_836_800
#: What a date can say: years 1 to 9999.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799
RANGE_ROWS = 50_000
MAX_RANGES = 2_000
READ = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "page_id long, url_key string, captured long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long"
RUN = f"span int, archive string, entries array<struct<{', '.join(c.replace(' ', ': ') for c in ENTRY.split(', '))}>>"


def url_key(url: Column) -> Column:
    """Host parts from last to first, port and leading www dropped, then the path: sorts by site."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^www\d*\.|:\d+$", "")
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    return F.when(rest == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def decided(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest (SHA-1, binary), refers_to, is_revisit."""
    p = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    # only payloads that occur again need a decision; copies meet before the shuffle
    again = p.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept"))
    again = materialize(again.filter("n > 1").select("digest", "size", "kept"))
    out = p.join(again, ["digest", "size"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return out.select("page_id", "url", "payload", "size", "digest", revisit.alias("is_revisit"), F.when(revisit, F.col("kept")).alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Archives ``path``/*.txt.gz of the pages (page_id, url, html)."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "is_revisit", "refers_to", "url_key", "captured")]):
                page, url, payload, size, digest, revisit, refers, key, captured = r
                body = "" if revisit else payload
                head = [
                    "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
                    f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {_date(captured)}", f"X-Captured: {captured}",
                    f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"X-Payload-Length: {size}", f"X-URL-Key: {_line(key)}",
                ]
                if revisit:
                    head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
                head += ["Content-Type: text/html", f"Content-Length: {0 if revisit else size}"]
                out.append("\r\n".join(head) + "\r\n\r\n" + body)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows = decided(pages, least_bytes).withColumn("url_key", url_key(F.col("url"))).withColumn("captured", captured(F.col("page_id")))
    runs = rows.sortWithinPartitions("url_key", "captured", "page_id")
    runs.mapInArrow(records, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def captured(page_id: Column) -> Column:
    """Seconds since 1970; ids at the end of long's range stay there."""
    return F.coalesce(F.try_add(F.coalesce(page_id, F.lit(0)).cast("long"), F.lit(EPOCH).cast("long")), page_id.cast("long"))


def _date(captured: int) -> str:
    """The header's date, at the ends of the calendar for times beyond it; X-Captured has the time itself."""
    held = min(max(captured, FIRST_SECOND), LAST_SECOND)
    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=held)).isoformat() + "Z"


def _line(text: str | None) -> str:
    """A header value: line ends and percent signs escaped."""
    return re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", text or "")


def _plain(text: str) -> str:
    return re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), text)


def parse(packed: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of every record of a gzipped archive, framed by content length."""
    unzip, held, at, base = zlib.decompressobj(31), bytearray(), 0, 0
    chunks = iter(packed)

    def more() -> bool:
        nonlocal held, at, base
        chunk = next(chunks, None)
        if chunk is None:
            return False
        del held[:at]
        base, at = base + at, 0
        held += unzip.decompress(chunk)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        head = dict(line.split(": ", 1) for line in held[at:end].decode().split("\r\n")[1:])
        start, size = base + end + 4, int(head["Content-Length"])
        offset = base + at
        while len(held) < start - base + size + 4:
            if not more():
                raise ValueError(f"archive ends inside the record at {offset}")
        yield offset, head, bytes(held[start - base : start - base + size])
        at = start - base + size + 4


def _span(edges: list[tuple], entry: dict) -> int:
    import bisect

    return bisect.bisect_right(edges, _key(entry))


def _key(entry: dict) -> tuple:
    return entry["url_key"], entry["captured"], -1 if entry["page_id"] is None else entry["page_id"]


def read(spark: SparkSession, path: str, edges: list[tuple]) -> DataFrame:
    """RUN rows: per archive and key range, its entries in order.  Payloads are hashed again."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in ENTRY.split(", ")]
        schema = pa.schema([("span", pa.int32()), ("archive", pa.string()), ("entries", pa.list_(pa.struct(fields)))])
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                blob, name = memoryview(content.as_buffer()), os.path.basename(name)
                span, held = 0, []
                for offset, head, payload in parse(blob[k : k + READ] for k in range(0, len(blob), READ)):
                    revisit = head["WARC-Type"] == "revisit"
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (size != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"{name}: the payload at {offset} doesn't match its digest")
                    page = head["WARC-Record-ID"][len("<urn:page:") : -1]
                    entry = {
                        "page_id": int(page) if page else None, "url_key": _plain(head["X-URL-Key"]),
                        "captured": int(head["X-Captured"]), "record_type": head["WARC-Type"],
                        "payload_bytes": size, "payload_digest": digest,
                        "refers_to": int(head["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None, "archive": name, "offset": offset,
                    }
                    if (now := _span(edges, entry)) != span or len(held) >= RANGE_ROWS:
                        if held:
                            yield pa.RecordBatch.from_pylist([{"span": span, "archive": name, "entries": held}], schema)
                        span, held = now, []
                    held.append(entry)
                if held:
                    yield pa.RecordBatch.from_pylist([{"span": span, "archive": name, "entries": held}], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(runs, RUN)


class LoserTree:
    """Merges k sorted runs: inner nodes keep the loser of their match, the winner goes on."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _head(self, i: int):
        run = self.runs[i]
        return (0, self.key(run[self.at[i]]), i) if self.at[i] < len(run) else (1, (), i)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while the tree is built, the first to come waits for its match
                self.losers[node] = i
                return
            if self.heads[other] < self.heads[i]:
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.k and self.heads[w := self.losers[0]][0] == 0:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self._head(w)
            self._play(w)


def merge(runs: DataFrame) -> DataFrame:
    """The global capture history: entries with ``span`` and their ``position`` in it."""

    fields = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in ENTRY.split(", ")]
    schema = pa.schema([("span", pa.int32()), ("position", pa.int64()), *fields])

    def merged(rows: pa.Table) -> pa.Table:
        span = rows.column("span")[0].as_py()
        tree = LoserTree(rows.column("entries").to_pylist(), _key)
        return pa.Table.from_pylist([{"span": span, "position": k, **e} for k, e in enumerate(tree)], schema)

    return runs.groupBy("span").applyInArrow(merged, f"span int, position long, {ENTRY}")


def edges_of(pages: DataFrame) -> list[tuple]:
    """Keys that cut all captures into ranges of about RANGE_ROWS, from a bounded sample.

    They balance the work and decide nothing else.
    """
    keys = pick(pages, "page_id", "url").select(url_key(F.col("url")).alias("k"), captured(F.col("page_id")).alias("t"), F.coalesce("page_id", F.lit(-1)).alias("p"))
    n = pages.count()
    spans = min(MAX_RANGES, max(partitions(pages.sparkSession), -(-n // RANGE_ROWS)))
    most = spans * 20
    some = keys.filter(F.pmod(F.xxhash64("p", "k"), F.lit(max(1, n // most))) == 0).limit(4 * most) if n > most else keys
    rows = sorted(tuple(r) for r in some.collect())
    return [rows[len(rows) * i // spans] for i in range(1, spans)] if len(rows) >= spans else []


def history(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives (to the shared folder unless ``path`` is given), reads them back, merges their index."""
    spark = pages.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
    write(pages, path, least_bytes)
    return merge(read(spark, path, edges_of(pages)))
