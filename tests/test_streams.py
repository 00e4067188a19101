"""Distributed stream operators against the sequential models, on random input."""

import random
import struct
import zlib

from pyspark.sql import functions as F

from flightwords.operators import assemble, capture, sync
from tests import models

SYNCS = (583, 1464, 2631, 3512)


def chunks_df(spark, captures, rng, longest=40):
    rows = []
    for rec, data in captures.items():
        at, no = 0, 0
        while at < len(data):
            n = rng.randint(1, longest)
            rows.append((rec, no, float(no), bytearray(data[at: at + n])))
            at, no = at + n, no + 1
    return spark.createDataFrame(rows, "recording_id string, chunk_no bigint, t double, data binary").repartition(3)


def test_words_of_any_chunking(spark):
    rng = random.Random(1)
    captures = {}
    for i in range(25):
        data = bytearray()
        for _ in range(rng.randint(0, 200)):
            data += struct.pack("<H", rng.randint(0, 4095))
            if rng.random() < 0.15:
                data.append(rng.randint(0, 255))
            if rng.random() < 0.1 and data:
                del data[rng.randrange(len(data))]
        captures[f"r{i}"] = bytes(data)
    capture.CHUNK_BLOCK = 4
    got = capture.words_of(chunks_df(spark, captures, rng)).collect()
    for rec, data in captures.items():
        mine = sorted((r for r in got if r.recording_id == rec), key=lambda r: r.chunk_no)
        words, dropped = models.parse_words(data)
        assert [w for r in mine for w in r.words] == words, rec
        assert sum(r.invalid_words for r in mine) == dropped
        at = 0
        for r in mine:
            assert r.start == at
            at += r.n_words


def packet(rng, fid, sf, words, version=1, kind=1, corrupt=False):
    payload = b"".join(struct.pack("<H", w) for w in words)
    body = struct.pack("<2sBBHIBHH", b"SA", version, kind, 7, fid, sf, len(words), len(payload)) + payload
    return body + struct.pack("<I", zlib.crc32(body) ^ (0xA5A5A5A5 if corrupt else 0))


def framed_model(data):
    """(positions of packets, bad count) by the greedy rule."""
    pos, found, bad = 0, [], 0
    while True:
        at = data.find(b"SA", pos)
        if at < 0 or len(data) - at < 15:
            return found, bad
        _m, version, kind, _s, _f, _sf, _w, n = struct.unpack_from("<2sBBHIBHH", data, at)
        if version != 1 or n > 4096:
            bad, pos = bad + 1, at + 1
            continue
        total = 15 + n + 4
        if len(data) - at < total:
            return found, bad
        crc = struct.unpack_from("<I", data, at + total - 4)[0]
        if crc != zlib.crc32(data[at: at + total - 4]) or (kind == 1 and n % 2):
            bad, pos = bad + 1, at + 1
            continue
        found.append(at)
        pos = at + total


def test_packets_match_greedy_parser(spark):
    rng = random.Random(2)
    captures = {}
    for i in range(30):
        data = bytearray()
        for k in range(rng.randint(1, 12)):
            inner = [rng.randint(0, 4095) for _ in range(rng.randint(0, 30))]
            p = packet(rng, k, rng.randint(1, 5), inner, version=rng.choice([1, 1, 1, 2]), corrupt=rng.random() < 0.2)
            if rng.random() < 0.2:  # a whole packet inside the payload of another one
                p = packet(rng, k, 1, list(p)[:400])
                body = struct.pack("<2sBBHIBHH", b"SA", 1, 2, 1, 1, 1, 1, len(p)) + p
                p = body + struct.pack("<I", zlib.crc32(body))
            data += p
            if rng.random() < 0.4:
                data += rng.choice([b"S", b"SA", b"xxSAx", bytes(rng.randrange(256) for _ in range(20))])
        captures[f"r{i}"] = bytes(data)
    got, counters = capture.packets(capture.candidates(chunks_df(spark, captures, rng, 300), size=128))
    got, counters = got.collect(), {r.recording_id: r for r in counters.collect()}
    for rec, data in captures.items():
        found, bad = framed_model(data)
        assert sorted(r.pos for r in got if r.recording_id == rec) == found, rec
        if found or bad:
            assert (counters[rec].packets, counters[rec].bad_packets) == (len(found), bad)


def random_stream(rng, wps, n):
    words, sf = [rng.choice([1365, 583]) for _ in range(rng.randint(0, 30))], rng.randint(1, 4)
    for _ in range(n):
        block = [SYNCS[sf - 1]] + [rng.choice([0, 1, 583, 1464, 2631, 3512, 7]) if rng.random() < 0.2 else rng.randint(0, 4095)
                                   for _ in range(wps - 1)]
        if rng.random() < 0.15:
            block[0] = rng.choice([0, 583])
        if rng.random() < 0.1:
            del block[rng.randrange(len(block))]
        words += block
        sf = sf % 4 + 1
    return words[: len(words) - rng.randint(0, wps)]


def test_sync_matches_sequential_rule(spark):
    rng, wps = random.Random(3), 8
    streams = {f"r{i}": random_stream(rng, wps, rng.randint(0, 40)) for i in range(40)}
    rows = []
    for rec, words in streams.items():
        at = 0
        while at < len(words):
            n = rng.randint(1, 30)
            rows.append((rec, at, words[at: at + n]))
            at += n
    blocks_df = spark.createDataFrame(rows, "recording_id string, start bigint, words array<int>").repartition(3)
    sync.POS_BLOCK = 64
    cand = sync.sync_candidates(blocks_df, SYNCS)
    starts = sync.subframe_starts(sync.locks(blocks_df, cand, wps), wps)
    got = sync.with_words(starts, blocks_df, wps, size=32).collect()
    for rec, words in streams.items():
        mine = sorted((r.pos, r.subframe, r.valid, tuple(r.words)) for r in got if r.recording_id == rec)
        want = sorted((p, sf, ok, tuple(words[p: p + wps])) for p, sf, ok in models.sync(words, wps, SYNCS))
        assert mine == want, rec


def test_wrong_rate(spark):
    words = []
    for k in range(12):
        words += [SYNCS[k % 4]] + [5] * 127
    df = spark.createDataFrame([("a", 0, words)], "recording_id string, start bigint, words array<int>")
    cand = sync.sync_candidates(df, SYNCS)
    found = sync.wrong_rate(cand, sync.locks(df, cand, 256), 256).collect()
    assert [(r.recording_id, r.detected_wps) for r in found] == [("a", 128)]


def assemble_random(spark, framed, seed):
    rng, rows, want = random.Random(seed), [], {}
    for rec in ("a", "b", "c"):
        model, fid, sf = models.Assembler(), 40, 1
        for seq in range(150):
            p = rng.random()
            if p < 0.75:
                sf = sf % 4 + 1
                fid += sf == 1
            else:
                sf = rng.randint(1, 3 if rec == "c" else 4)
                fid += rng.choice([0, 0, 1, 2])
            valid = rng.random() > 0.1
            rows.append((rec, seq, sf, valid, fid if framed else None, float(seq)))
            model.take(seq, sf, valid, fid if framed else None)
        want[rec] = sorted(model.out)
    df = spark.createDataFrame(rows, "recording_id string, seq bigint, subframe int, valid boolean, frame_id bigint, t double")
    a = assemble.arrivals(df.repartition(3), run=16, group=4).collect()
    for rec in want:
        mine = sorted((r.seq, r.part, r.frame_index, r.subframe, r.state, tuple(r.slot_states), r.frame_completed)
                      for r in a if r.recording_id == rec)
        assert mine == want[rec], rec


def test_assembly_continuous(spark):
    assemble_random(spark, False, 5)


def test_assembly_with_frame_ids(spark):
    assemble_random(spark, True, 6)


def arrive(spark, *subframes):
    rows = [("r", i, sf, True, None, float(i)) for i, sf in enumerate(subframes)]
    df = spark.createDataFrame(rows, "recording_id string, seq bigint, subframe int, valid boolean, frame_id bigint, t double")
    return assemble.arrivals(df)


def test_missing_and_late_slots(spark):
    a = arrive(spark, 1, 3, 2)
    states = {r.seq: tuple(r.slot_states) for r in a.collect()}
    assert states[1] == ("RECEIVED", "MISSING", "RECEIVED", "PENDING")
    assert states[2] == ("RECEIVED", "LATE", "RECEIVED", "PENDING")
    s = assemble.stats(a).first()
    assert (s.missing_subframes, s.out_of_order) == (0, 1)


def test_early_close(spark):
    rows = arrive(spark, 1, 2, 1).orderBy("seq", "part").collect()
    assert tuple(rows[2].slot_states) == ("RECEIVED", "RECEIVED", "MISSING", "MISSING")
    assert (rows[2].subframe, rows[3].frame_index) == (0, 1)
    kinds = [r.kind for r in assemble.events(arrive(spark, 1, 2, 1)).filter(F.col("seq") == 2).collect()]
    assert sorted(kinds) == ["FRAME", "FRAME_INCOMPLETE", "SUBFRAME"]
