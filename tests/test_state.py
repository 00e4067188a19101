"""Keyed state of streams, the fleet join, scripts and the catalog against plain models."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flightwords.operators import decode, mapping, series
from flightwords.plans import bridge, fleet_queries
from flightwords.schemas import SYNC_WORDS
from flightwords.sources import tables
from flightwords.streaming import stateful


class Held:
    """Value and map state as the processors use them."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):  # noqa: N802
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.map[key]


def _stream(rng, wps):
    """Bytes of subframes with lost, damaged and foreign parts."""
    out, number = b"", 0
    for _ in range(60):
        number = rng.randrange(4) if rng.random() < 0.15 else (number + 1) % 4
        words = [SYNC_WORDS[number]] + [rng.choice([rng.randrange(4096), *SYNC_WORDS]) for _ in range(wps - 1)]
        if rng.random() < 0.1:
            words = words[: rng.randrange(wps)]
        data = b"".join(w.to_bytes(2, "little") for w in words)
        out += (bytes([0xF7]) if rng.random() < 0.1 else b"") + data
    return out


def _plain(data, wps):
    """Words by dropping one byte at each bad container; then lock, slice, loss, search from the next word."""
    words, i = [], 0
    while i + 1 < len(data):
        if data[i + 1] & 0xF0:
            i += 1
        else:
            words.append(data[i] | data[i + 1] << 8)
            i += 2
    number = {w: k for k, w in enumerate(SYNC_WORDS, 1)}
    out, at, expected = [], 0, None
    while True:
        if expected is None:
            while at + wps < len(words) and not (words[at] in number and number.get(words[at + wps]) == number[words[at]] % 4 + 1):
                at += 1
            if at + wps >= len(words):
                return out
            expected = number[words[at]]
        if at + wps > len(words):
            return out
        ok = number.get(words[at]) == expected
        out.append((at, expected, ok, words[at : at + wps]))
        at, expected = (at + wps, expected % 4 + 1) if ok else (at + 1, None)


def test_synchronizer_of_bytes_cut_anywhere():
    rng = random.Random(7)
    for _ in range(25):
        wps = rng.choice([4, 8, 16])
        data, got = _stream(rng, wps), []
        p = stateful.Synchronizer(wps)
        p.held = Held()
        cuts = sorted(rng.randrange(len(data)) for _ in range(rng.randrange(1, 40)))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        numbered = list(enumerate(pieces))
        while numbered:  # a batch holds some chunks, in any order
            batch, numbered = numbered[: (n := rng.randrange(1, 6))], numbered[n:]
            rng.shuffle(batch)
            frames = [pd.DataFrame({"chunk_no": [k], "data": [d]}) for k, d in batch]
            for f in p.handleInputRows(("r",), iter(frames), None):
                got += [(r.pos, r.subframe, r.valid, list(r.words)) for r in f.itertuples()]
        assert got == _plain(data, wps)
        assert len(p.held.value[3]) <= 2 * 2 * wps  # what waits is bounded


def test_ring_keeps_both_bounds(monkeypatch):
    monkeypatch.setattr(stateful, "RING_BLOCK", 8)
    rng = random.Random(9)
    for _ in range(30):
        most, seconds = rng.choice([3, 8, 20, 1000]), rng.choice([5.0, 40.0, 1e9])
        p = stateful.Ring(most, seconds)
        p.place, p.blocks = Held(), Held()
        kept, t, seq = [], 0.0, 0
        for _ in range(20):
            rows = []
            for _ in range(rng.randrange(1, 12)):
                t += rng.choice([0.0, 1.0, 3.0, -2.0, 60.0])
                rows.append((seq := seq + 1, 1, t, rng.random()))
            kept += rows
            newest = max(r[2] for r in kept)
            while kept[0][2] < newest - seconds:
                kept.pop(0)
            kept = kept[-most:]
            while kept[0][2] < newest - seconds:
                kept.pop(0)
            mixed = rng.sample(rows, len(rows))
            (out,) = p.handleInputRows(("r", "p"), iter([pd.DataFrame(mixed, columns=["seq", "occ", "t", "value"])]), None)
            r, v = out.iloc[0], [x[3] for x in kept]
            # the newest point may have left by count; its time still bounds the others
            assert (r.n, r.oldest_t, r.current, r.minimum, r.maximum) == (len(kept), kept[0][2], v[-1], min(v), max(v))
            assert len(p.blocks.map) <= -(-most // 8) + 1 or most == 1000


def test_fleet_join_equals_the_broadcast_one(spark):
    sf = "/root/testdata/sf0.001"
    plans = mapping.sample_plans(*fleet_queries.fleet_mapping(spark, sf)).persist()
    subs = decode.decodable(fleet_queries.fleet_subframes(spark, sf)).persist()
    wide, narrow = decode.decode_fleet(subs, plans, slice_rows=4, hot_rows=50), decode.decode(subs, plans)
    assert "Broadcast" in narrow._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"Join Inner.*_slice#\d+ = _slice#.*", wide._jdf.queryExecution().optimizedPlan().toString())
    assert joins and not any("broadcast" in line for line in joins)  # only the table of cuts is
    keys = ["recording_id", "document_id", "seq", "param_id", "occ", "subframe", "raw_integer", "eng_value", "eng_label", "status", "message"]
    a, b = wide.select(*keys), narrow.select(*keys)
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_scripts_with_ties_long_segments_and_foreign_keys(spark):
    texts = {"a": "0:0, 10:20 10:40, 1000:-10", "b": "5:7", "c": "", "d": "3:1 3:2, 3:3"}
    scripts = spark.createDataFrame(list(texts.items()), "key string, text string").select("key", series.parse_script(F.col("text")).alias("points"))
    asked = [(k, x) for k in (*texts, "none", None) for x in (-5.0, 0.0, 3.0, 4.5, 5.0, 9.99, 10.0, 10.5, 500.0, 1000.0, 2000.0)]
    events = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(asked)], "id int, key string, x double")
    got = {r["id"]: r["y"] for r in series.script_values(events, scripts, "key", "x").collect()}
    own = events.join(scripts.filter(F.size("points") > 0), "key", "left")
    want = {r["id"]: r["y"] for r in own.select("id", series.script_value(F.col("x"), F.col("points")).alias("y")).collect()}
    assert len(got) == len(asked) and got == want


def test_catalog_replaces_whole_documents(spark, tmp_path):
    docs, pars, segs = bridge.literal_mapping(spark)
    other = [df.withColumn("document_id", F.lit("OTHER")) for df in (docs, pars, segs)]
    root = str(tmp_path / "cat")
    names = ("dataframe_documents", "parameters", "parameter_segments")
    assert tables.list_documents(spark, root).count() == 0
    assert tables.save(dict(zip(names, (docs, pars, segs))), root) == 1
    assert tables.save(dict(zip(names, other)), root) == 2
    fewer = pars.filter("param_ord <= 3")
    # a save that ended before its manifest is not seen
    fewer.withColumn("version", F.lit(9).cast("bigint")).write.mode("append").parquet(f"{root}/parameters")
    assert tables.load(spark, root, "parameters", bridge.DOCUMENT_ID).count() == len(bridge.MAPPING)
    tables.save(dict(zip(names, (docs.withColumn("status", F.lit("B")), fewer, segs))), root)
    listed = {r.document_id: (r.status, r.parameters) for r in tables.list_documents(spark, root).collect()}
    assert listed == {bridge.DOCUMENT_ID: ("B", 3), "OTHER": ("DRAFT", len(bridge.MAPPING))}
    assert tables.load(spark, root, "parameter_segments").count() == 2 * segs.count()


def test_containers_left_waiting():
    from flightwords.operators.capture import parse_containers, pending_byte

    rng = np.random.default_rng(3)
    for _ in range(200):
        data = rng.choice(np.array([0x47, 0x02, 0xF7, 0x0B, 0xB8], np.uint8), rng.integers(0, 12))
        i, left = 0, None
        while i < len(data):
            if i + 1 == len(data):
                left = int(data[i])
                break
            i += 1 if data[i + 1] & 0xF0 else 2
        assert pending_byte(data) == left
        assert len(parse_containers(data)[0]) * 2 + parse_containers(data)[1] + (left is not None) == len(data)
