"""Sessions, frame files, ADB documents and the catalog: round trips and rejects."""

import json
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from flightwords.operators import adb
from flightwords.plans import bridge
from flightwords.sources import adb_files, frames, sessions, tables


def test_torn_session_and_header_checks(spark, tmp_path):
    head = json.dumps({"format": "arinc717-session", "version": 1, "wps": 4, "sync_words": [583], "future": 1})
    row = lambda t, sf: json.dumps({"kind": "subframe", "t": t, "frame": 0, "sf": sf, "words": "247000001FFF"})
    sample = json.dumps({"kind": "sample", "t": 3.5, "id": "p", "eng": "DOWN"})
    (tmp_path / "a").write_text("\n".join([head, row(1.0, 1), "", sample, row(2.0, 2), row(3.0, 3), row(4.0, 4)[:30]]) + "\n")
    (tmp_path / "b").write_text(json.dumps({"format": "other", "version": 1}) + "\n" + row(1.0, 1))
    (tmp_path / "c").write_text(head + "\n" + row(1.0, 1) + "\n" + '{"kind":"end","subframes":9,"samples":1,"events":0,"first_t":1.0,"last_t":5.0}')
    lines = sessions.read_lines(spark, str(tmp_path))
    assert sorted(r.problem or "" for r in sessions.headers(lines).collect()) == ["", "", "not a session file"]
    recs = sessions.records(lines)
    subs = sessions.subframes(recs).collect()
    mine = [r for r in subs if r.recording_id.endswith("/a")]
    assert [r.subframe for r in sorted(mine, key=lambda r: r.at)] == [1, 2, 3]
    assert mine[0].words == [583, 0, 1, 4095] and mine[0].state == "RECEIVED"
    s = sessions.samples(recs).first()
    assert (s.eng_label, s.eng_value, s.param_name, s.occ, s.status) == ("DOWN", None, "p", 1, "VALID")
    sums = {os.path.basename(r.recording_id): r for r in sessions.summary(recs).collect()}
    assert (sums["a"].subframes, sums["a"].samples, sums["a"].first_t, sums["a"].last_t) == (3, 1, 1.0, 3.0)
    assert (sums["c"].subframes, sums["c"].duration) == (9, 4.0)


def test_session_round_trip(spark, tmp_path):
    subs = bridge.subframes(spark, "/root/testdata/sf0.001").withColumn("t", F.col("t_end"))
    heads = subs.select("recording_id").distinct().withColumn("wps", F.lit(64))
    path = str(tmp_path / "s")
    sessions.write_sessions(sessions.session_lines(heads, subs), path, files=5)
    recs = sessions.records(sessions.read_written(spark, path))
    back = sessions.subframes(recs).select("recording_id", "frame_index", "subframe", "state", "words", "t")
    want = subs.select("recording_id", "frame_index", "subframe", "state", "words", "t")
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    assert sessions.summary(recs).agg(F.sum("subframes")).first()[0] == subs.count()


def test_frame_files(spark, tmp_path):
    good = {"format": "arinc717-frame", "version": 1, "wps": 2, "frame_index": 7, "subframes": [[1, 2], [3, 4], [5, 6], [7, 8]]}
    for name, doc in {"ok": good, "short": {**good, "subframes": [[1, 2]]}, "big": {**good, "subframes": [[1, 5000]] * 4}, "no": {"x": 1}}.items():
        (tmp_path / name).write_text(json.dumps(doc))
    rows, bad = frames.read_frames(spark, str(tmp_path))
    assert [(r.subframe, r.words) for r in rows.orderBy("subframe").collect()] == [(1, [1, 2]), (2, [3, 4]), (3, [5, 6]), (4, [7, 8])]
    assert bad.count() == 3
    text = json.loads(frames.frame_json(rows.drop("wps")).first().value)
    assert text == good


SETTING = "Setting,1,64,1,12,256,0,583,1464,2631,3512".split(",")
LOCATION_AT = 76  # fields before the 32 locations


def record(name, kind, locs, parts=1, slots=(), samples=None):
    """One record: (selector, word, lsb, msb) locations in file order, (value, label) slots."""
    f = [""] * 238
    f[0], f[2], f[6], f[7] = name, kind, "1", "0"
    f[9] = "Discrete" if kind == "Discrete" else "-"
    for k, (value, label) in enumerate(slots):
        f[10 + k], f[42 + k] = value, label
    f[74], f[75] = str(len(locs) // parts if samples is None else samples), str(parts)
    for k, loc in enumerate(locs):
        f[LOCATION_AT + 5 * k : LOCATION_AT + 5 * k + 4] = map(str, loc)
    return f


# Each rule of locations and slots, in several forms.
SLOTS3 = [("4", "idle"), ("2", "run, hot"), ("1", 'th"’ree')]
ROWS = [
    # selectors name subframes of relative words: one, two, all four
    record("REL ONE", "BCD", [("3", 17, 1, 12)]),
    record("REL PAIR", "Signed Analog", [("14", 40, 4, 11)]),
    record("REL TWICE", "Unsigned Analog", [("2", 20, 3, 9), ("4", 20, 3, 9)]),
    # frame-absolute words: merged where the shape repeats in every subframe, or in some
    record("ABS FOUR", "Unsigned Analog", [("", w, 2, 8) for w in (55, 119, 183, 247)]),
    record("ABS TWO", "Signed Analog", [("1234", 64 + 33, 1, 6), ("1234", 192 + 33, 1, 6)]),
    record("ABS SHAPES", "Unsigned Analog", [("1234", 13, 1, 5), ("1234", 77, 6, 12)]),
    # parts, lowest first: across words, three in one word with weights, too few weights
    record("LONG", "Signed Analog", [("24", 58, 5, 12), ("24", 57, 1, 12), ("24", 56, 1, 12)], parts=3),
    record("CLOCK", "BCD", [("1", 61, 1, 4), ("1", 61, 5, 8), ("1", 61, 9, 10)], parts=3, slots=[("0.1", ""), ("1", ""), ("10", "")]),
    record("SHORT WEIGHTS", "BCD", [("1", 62, 1, 4), ("1", 62, 5, 8)], parts=2, slots=[("1", "")]),
    # slots: two labels in falling order, a table with gaps
    record("LATCH", "Discrete", [("12", 9, 12, 12)], slots=[("1", "held"), ("0", "free")]),
    record("MOTOR", "Discrete", [("1234", 130, 7, 9)], slots=SLOTS3),
    # what is warned of: a selector that is not used, a count that does not fit
    record("IGNORED", "Signed Analog", [("34", 70, 1, 12)]),
    record("MISCOUNT", "Unsigned Analog", [("23", 11, 1, 12)], samples=3),
]


def adb_bytes():
    import csv
    import io

    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows([SETTING, *ROWS])
    return out.getvalue().encode("cp1252")


def test_adb_parse_export_round_trip(spark, tmp_path):
    raw = adb_bytes()
    (tmp_path / "demo.adb").write_bytes(raw)
    (tmp_path / "broken.adb").write_text(",".join(SETTING) + "\r\n" + ",".join(record("BAD", "Discrete", [("1234", 400, 1, 2)])) + "\r\nshort,record\r\n")
    recs = adb_files.read_adb(spark, str(tmp_path)).cache()
    p = adb.parsed(recs).cache()
    assert {(r.document_id, r.problem) for r in adb.rejects(p).collect()} == {
        ("broken", "word beyond the frame"), ("broken", "record is too short")}
    name = {r.param_id: r.mnemonic for r in adb.parameters(p).filter("document_id = 'demo'").collect()}
    segs = {}
    for r in adb.segments(p).filter("document_id = 'demo'").orderBy("param_id", "occ", "seq").collect():
        segs.setdefault(name[r.param_id], []).append((r.occ, r.seq, tuple(r.subframes), r.word, r.lsb, r.msb, r.bcd_weight))
    every = (1, 2, 3, 4)
    assert segs == {
        "REL ONE": [(1, 1, (3,), 17, 1, 12, None)],
        "REL PAIR": [(1, 1, (1, 4), 40, 4, 11, None)],
        "REL TWICE": [(1, 1, (2, 4), 20, 3, 9, None)],
        "ABS FOUR": [(1, 1, every, 55, 2, 8, None)],
        "ABS TWO": [(1, 1, (2, 4), 33, 1, 6, None)],
        "ABS SHAPES": [(1, 1, (1,), 13, 1, 5, None), (2, 1, (2,), 13, 6, 12, None)],
        "LONG": [(1, 1, (2, 4), 56, 1, 12, None), (1, 2, (2, 4), 57, 1, 12, None), (1, 3, (2, 4), 58, 5, 12, None)],
        "CLOCK": [(1, 1, (1,), 61, 9, 10, 10.0), (1, 2, (1,), 61, 5, 8, 1.0), (1, 3, (1,), 61, 1, 4, 0.1)],
        "SHORT WEIGHTS": [(1, 1, (1,), 62, 5, 8, None), (1, 2, (1,), 62, 1, 4, None)],
        "LATCH": [(1, 1, (1, 2), 9, 12, 12, None)],
        "MOTOR": [(1, 1, (3,), 2, 7, 9, None)],
        "IGNORED": [(1, 1, (2,), 6, 1, 12, None)],
        "MISCOUNT": [(1, 1, (2, 3), 11, 1, 12, None)],
    }
    pars = {r.mnemonic: r for r in adb.parameters(p).filter("document_id = 'demo'").collect()}
    assert (pars["LATCH"].true_state, pars["LATCH"].false_state, len(pars["LATCH"].states)) == ("held", "free", 0)
    assert [(s.value, s.label) for s in pars["MOTOR"].states] == [(int(v), t) for v, t in SLOTS3]
    notes = {}
    for r in adb.warnings(p).filter("document_id = 'demo'").collect():
        notes.setdefault(name[r.param_id], []).append(r.warning)
    assert set(notes) == {"IGNORED", "MISCOUNT", "SHORT WEIGHTS"}, notes
    assert notes["IGNORED"] == ["location 1: subframe selector ignored"] and notes["MISCOUNT"] == ["sample count does not match the locations"]

    docs = adb.documents(recs).filter("document_id = 'demo'").drop("problem")
    mine, seg = adb.parameters(p).filter("document_id = 'demo'"), adb.segments(p).filter("document_id = 'demo'")
    raw_recs = recs.filter("document_id = 'demo'")
    out = adb_files.contents(adb.export(docs, mine, seg, raw_recs))
    assert bytes(out.first().content) == raw
    adb_files.write_adb(out, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("document_id=demo/part-*")
    assert file.read_bytes() == raw
    back = adb_files.read_adb(spark, str(tmp_path / "out"))
    assert back.exceptAll(raw_recs.select(*back.columns)).count() == 0 and back.count() == raw_recs.count()

    # Generated records parse back to the same model.
    again = adb.parsed(adb.export(docs, mine, seg).withColumn("source_hash", F.lit("")))
    drop = ("source_type", "decimals")
    assert adb.parameters(again).drop(*drop).exceptAll(mine.drop(*drop)).count() == 0
    assert adb.segments(again).exceptAll(seg).count() == 0


def test_catalog(spark, tmp_path):
    docs, pars, segs = bridge.literal_mapping(spark)
    root = str(tmp_path / "cat")
    tables.save({"dataframe_documents": docs, "parameters": pars, "parameter_segments": segs}, root)
    assert tables.list_documents(spark, root).first().parameters == len(bridge.MAPPING)
    assert tables.load(spark, root, "parameter_segments", bridge.DOCUMENT_ID).exceptAll(segs).count() == 0


def test_records_are_split_as_the_csv_module_does_without_python_workers(spark):
    rng = random.Random(5)
    texts = ["", "\r\n", 'a,"b', '"a,\r\n', '"x"y"z,""""\rb\n\n,', "\x1f,\u3000\n,\n1", '"' + '""' * 50_000 + '",' + "b," * 50_000 + "c", '" \n",\r\n","']
    texts += ["".join(rng.choice('"",,\r\na é\xa0') for _ in range(rng.randrange(40))) for _ in range(600)]
    files = spark.createDataFrame([(str(i), bytearray(t.encode())) for i, t in enumerate(texts)], "document_id string, content binary")
    found = adb_files.records_of(files)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.document_id, r.record_index): r.fields for r in found.collect()}
    rows = pd.DataFrame({"document_id": [str(i) for i in range(len(texts))], "source_hash": "", "text": texts})
    want = {(r.document_id, r.record_index): r.fields for p in adb_files._split(iter([rows])) for r in p.itertuples()}
    assert len(want) > 600 and got == want
