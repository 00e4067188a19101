import base64
import gzip
import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from flightwords.llm import ann, warc

from .data import records


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:160] = x[100]  # ties
    x[7] *= np.float32(1e-18)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    rows += [(10_000 + 50 * i, v) for i, v in enumerate(bad)] + [(None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, "l", 1) for i, v in rows], "vec_id long, embedding array<float>, list string, bin int")
    got = {}
    for r in records(ann.search(df, F.col("vec_id") % 50 == 0, 5)):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    d = x.astype(float)
    norm = np.sqrt((d * d).sum(axis=1))
    hit = 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        cos = (d * d[q]).sum(axis=1) / (norm * norm[q])
        cos[q] = -9
        best = np.lexsort((np.arange(3000), -cos))[:5]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(cos[i] - s) < 1e-12 for i, s in found.values())
        order = [(-s, i) for i, s in (found[k] for k in range(1, 6))]
        assert order == sorted(order)
        hit += len(set(best) & {i for i, _ in found.values()})
    assert hit >= 0.95 * 5 * len(got)
    assert [found[0] for found in (got[100][k] for k in range(1, 6))] == [101, 102, 103, 104, 105]


def test_nearest_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], kind)
    got = records(ann.search(few, F.col("vec_id") % 50 == 0, 5))
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(spark.createDataFrame([], kind), F.col("vec_id") % 50 == 0).count() == 0


def test_posting_lists_are_balanced():
    out = ann._layout({0: 10, 1: 9000, 2: 4000, 3: 100, 4: 50})
    held = {}
    for name, n in {0: 10, 1: 9000, 2: 4000, 3: 100, 4: 50}.items():
        first, pieces = out[name]
        for b in range(first, first + pieces):
            held[b] = held.get(b, 0) + n / pieces
    assert max(held.values()) <= ann.BIN


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, tmp_path):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://www.B.org:80/x?y#z", "same é"), (2, "https://b.org/x", "same é"), (9, "http://a.com", "same é"), (3, None, None), (4, "http://a.com/\r\nX: y%", ""),
            (5, "http://a.com/", trap), (6, "ftp://q", trap + "\r\n"), (None, "http://n", "lone"), (7, "u", "again"), (7, "u", "again"), (8, "v", "x" * 300_000)]
    rows += [(100 + i, "http://hot.example/", f"page {i % 30}") for i in range(200)]
    got = records(warc.history(_pages(spark, rows).repartition(4), f"file://{tmp_path}/w"))
    assert len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        own = largest[h or ""] == (-1 if i is None else i)
        want.append((-1 if i is None else i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else largest[h or ""]))
    told = [(-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(map(str, told)) == sorted(map(str, want))
    # one global order over all ranges
    order = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in sorted(got, key=lambda r: (r["span"], r["position"]))]
    assert order == sorted(order)
    assert {r["url_key"] for r in got if r["page_id"] in (1, 2)} == {"org,b)/x?y", "org,b)/x"}
    # a plain reader of the format finds the same records
    plain = 0
    for f in tmp_path.glob("w/*.gz"):
        data, at = gzip.decompress(f.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
            assert data[at:].startswith(b"WARC/1.1\r\n")
            at = end + 4 + int(head["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at, plain = at + 4, plain + 1
    assert plain == len(rows)


def test_warc_least_bytes_and_nothing(spark, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = {r["page_id"]: r["refers_to"] for r in records(warc.history(_pages(spark, rows), f"file://{tmp_path}/a", least_bytes=5))}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    assert warc.history(_pages(spark, []), f"file://{tmp_path}/b").count() == 0


def test_warc_of_large_and_negative_ids(spark, tmp_path):
    ids = [300_000_000_000, 9_007_199_254_740_993, 9_007_199_254_740_992, (1 << 63) - 1, -5, -(1 << 63), 251_824_464_000]
    rows = [(i, "http://a.com/", "same") for i in ids] + [(None, "http://a.com/", "same"), (7, "http://a.com/", "own")]
    got = records(warc.history(_pages(spark, rows).repartition(3), f"file://{tmp_path}/w"))
    top = max(ids)
    assert {(r["page_id"], r["refers_to"]) for r in got} == {(i, None if i == top else top) for i in ids} | {(None, top), (7, None)}
    order = [r["captured"] for r in sorted(got, key=lambda r: (r["span"], r["position"]))]
    assert order == sorted(order)


def test_nearest_of_sparse_neighbourhoods(spark, monkeypatch):
    """Where the lists within the ratio hold too few vectors, more lists are asked."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x[0] = 0
    x[0, 0] = 1  # alone in its corner
    x[1:, 0] = -np.abs(x[1:, 0]) - 3
    monkeypatch.setattr(ann, "BIN", 2)
    model = ann.train(x, 40)
    sizes = np.bincount(model.closure(ann._unit(x))[1], minlength=40)
    assert sizes[model.probes(ann._unit(x[:1])[0])].sum() <= 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in records(ann.search(df, F.col("vec_id") % 50 == 0, 5)):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(found) == list(range(0, 600, 50)) and all(len(set(v)) == 5 for v in found.values())


def test_nearest_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    whole = records(ann.search(df, F.col("vec_id") % 3 == 0, 5))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert sorted(map(str, records(ann.search(df, F.col("vec_id") % 3 == 0, 5)))) == sorted(map(str, whole))
