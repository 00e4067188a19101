"""Decoding on documented values, wide fields, user types and whole-frame mode."""



from flightwords.operators import decode as dec
from flightwords.operators import mapping
from flightwords.schemas import DOCUMENTS, PARAMETERS, SEGMENTS

WPS = 16


def tables(spark, params):
    """params: id → (type, resolution, offset, states, [segments of one occurrence])."""
    docs = spark.createDataFrame([("d", "d", WPS, [583], None, None, None, None, None, None, None, None, None)], DOCUMENTS)
    pars = spark.createDataFrame(
        [("d", i, p, p, "", None, t, "u", None, None, res, off, "linear", None, None, None, states, None)
         for i, (p, (t, res, off, states, _)) in enumerate(params.items())], PARAMETERS)
    segs = spark.createDataFrame(
        [("d", p, 1, k, sfs, w, lo, hi, wt) for p, (*_, listed) in params.items() for k, (sfs, w, lo, hi, wt) in enumerate(listed, 1)], SEGMENTS)
    return docs, pars, segs


def run(spark, params, words, mode=mapping.MODE_SUBFRAME, **kw):
    plans = mapping.sample_plans(*tables(spark, params), mode=mode)
    full = [words.get(i, 0) for i in range(1, WPS + 1)]
    subs = spark.createDataFrame([("r", "d", 0, 0, 1, "RECEIVED", 1001.0, full)],
                                 "recording_id string, document_id string, seq bigint, frame_index bigint, subframe int, state string, t_end double, words array<int>")
    return {r.param_id: r for r in dec.decode(dec.decodable(subs), plans, **kw).collect()}


def test_documented_values(spark):
    one = lambda w, lo, hi, wt=None: [([1], w, lo, hi, wt)]
    got = run(spark, {
        "pitch": ("analog_signed", 0.176, 0.0, [], one(4, 3, 12)),
        "flap": ("analog_unsigned", 0.0062, -1.6, [], one(5, 1, 12)),
        "course": ("bcd", 1.0, 0.0, [], one(6, 12, 1)),
        "badbcd": ("bcd", 1.0, 0.0, [], one(7, 1, 12)),
        "fuel": ("bcd", 1.0, 0.0, [], [([1], 8, 9, 12, 10.0), ([1], 8, 5, 8, 1.0), ([1], 8, 1, 4, 0.1)]),
        "mode": ("discrete", 1.0, 0.0, [(2, "MID"), (2, "LATER")], one(9, 1, 2)),
        "alt": ("analog_signed", 0.25, 0.0, [], [([1], 11, 1, 9, None), ([1], 10, 1, 12, None)]),
        "wide": ("raw", 1.0, 0.0, [], [([1], 12, 1, 12, None)] * 6),
    }, {4: 3412, 5: 2738, 6: 0b001101011001, 7: 0b001110110000, 8: 0x275, 9: 2, 11: 5, 10: 240, 12: 0xABC}, trace=True)
    p = got["pitch"]
    assert (p.raw_bits, p.raw_integer, p.decoded, round(p.eng_value, 6), p.status) == ("1101010101", 853, -171.0, -30.096, "VALID")
    assert p.t == 1001.0 - 1.0 + 3 / WPS and [s.word_value for s in p.trace] == [3412]
    assert round(got["flap"].eng_value, 4) == 15.3756
    assert got["course"].decoded == 359.0 and got["badbcd"].status == "INVALID_BCD" and got["badbcd"].raw_integer is not None
    assert got["fuel"].decoded == 27.5 and got["mode"].eng_label == "MID" and got["mode"].unit is None
    assert (got["alt"].raw_integer, got["alt"].eng_value) == (20720, 5180.0)
    w = got["wide"]
    assert w.raw_integer is None and w.raw_bits == "101010111100" * 6 and w.decoded == float(int("ABC" * 6, 16))


def test_mapping_problems_and_frame_mode(spark):
    params = {
        "nothing": ("raw", 1.0, 0.0, [], []),
        "split": ("raw", 1.0, 0.0, [], [([1], 2, 1, 12, None), ([2], 3, 1, 12, None)]),
        "bits": ("raw", 1.0, 0.0, [], [([1], 2, 1, 12, None), ([1], 5, 0, 4, None)]),
        "word": ("raw", 1.0, 0.0, [], [([1], 99, 1, 12, None)]),
        "outside": ("raw", 1.0, 0.0, [], [([7], 2, 1, 12, None)]),
    }
    live = run(spark, params, {})
    assert {k: r.subframe for k, r in live.items()} == {"nothing": None, "split": None, "bits": 1, "word": 1}
    assert all(r.status == "INVALID_MAPPING" for r in live.values())
    assert live["bits"].message == "segment #2: lsb=0 outside 1..12" and live["word"].message == "segment #1: word 99 outside 1..16"
    assert run(spark, params, {}, mode=mapping.MODE_FRAME)["outside"].subframe == 7


def test_custom_type(spark):
    dec.register_type("half", lambda raw, width: (raw, raw / 2))
    try:
        got = run(spark, {"h": ("half", 1.0, 0.0, [], [([1], 2, 1, 12, None)])}, {2: 9}, keep=("ptype",))
        assert (got["h"].decoded, got["h"].eng_value, got["h"].status) == (9.0, 4.5, "VALID")
    finally:
        dec.CUSTOM_TYPES.clear()


def test_plan_has_no_shuffle_after_the_scan(spark):
    from flightwords.plans import bridge
    from flightwords.plans.decode_queries import prepared

    rows, profile = prepared(spark)
    subs = bridge.subframes_of(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    text = dec.decode(dec.decodable(subs), rows, profile=profile)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text.split("InMemoryTableScan")[0]


def test_no_loop_of_a_decode_is_too_long_to_be_compiled(spark, capsys):
    """The JVM interprets methods of more than 8000 bytes, however often they run."""
    from flightwords.operators import series
    from flightwords.plans import QUERIES, decode_queries

    folder = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("decode_samples", "decode_frames", "word_inspector"):
            QUERIES[name](spark, folder).explain("codegen")
        series.series(decode_queries.samples(spark, folder)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(line.split("maxMethodCodeSize:")[1].split(";")[0]) for line in capsys.readouterr().out.splitlines() if "maxMethodCodeSize:" in line]
    assert len(sizes) > 8 and max(sizes) < 8000
