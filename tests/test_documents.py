"""Cell parsing, row normalization and review, on the documented examples."""

import pytest
from pyspark.sql import functions as F

from flightwords.functions import cells, numbers, types
from flightwords.operators import normalize as norm
from flightwords.operators import pages, review
from flightwords.schemas import RAW_FIELDS


def values(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.v for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]


def test_lists_bits_numbers(spark):
    got = values(spark, cells.word_groups, ["121-124", "122-121", "4, 132", "5/69/133/197", "121 to 122", "14-15, 142-143", "x1", ""])
    assert got == [[[121, 122, 123, 124]], [[122, 121]], [[4], [132]], [[5], [69], [133], [197]], [[121, 122]], [[14, 15], [142, 143]], None, None]
    bits = values(spark, cells.bit_tokens, ["9-1", "1-9", "12..1", "9/12", "9.1"])
    assert [[(t.high, t.low) for t in b] for b in bits] == [[(9, 1)], [(9, 1)], [(12, 1)], [(9, 9), (12, 12)], [(9, 1)]]
    assert values(spark, numbers.parse_number, ["1/16", "2^-4", "−1.6", "1,000.5", "0,0625", "1e-3", "", "abc"]) == [
        0.0625, 0.0625, -1.6, 1000.5, None, 0.001, None, None]
    assert values(spark, lambda c: numbers.parse_number(c, True), ["0,0625", "1.000,5"]) == [0.0625, 1000.5]
    assert values(spark, numbers.parse_frequency, ["4 Hz", "1/4", "2 samples/sec", "0.5 s"]) == [4.0, 0.25, 2.0, 0.5]


def test_subframes_types_states_headers(spark):
    got = values(spark, cells.subframe_field, ["1 & 3", "13", "SF 2", "", "0", "0 (all 4)", "2-4", "5", "1.3"])
    assert [(g.subframes, g.note) for g in got] == [
        ([1, 3], None), ([1, 3], None), ([2], None), ([1, 2, 3, 4], "blank"), ([1, 2, 3, 4], "zero"), ([1, 2, 3, 4], "zero"),
        ([2, 3, 4], None), (None, None), ([1, 3], None)]
    assert values(spark, types.normalize_source_type, ["BNR (signed)", "Discrete - 2 states", "bcd 3 digits", "two's complement", "BNR", "x", None]) == [
        "analog_signed", "discrete", "bcd", "analog_signed", "analog_unsigned", "unknown", "unknown"]
    s = values(spark, cells.states_from_text, ["1 = UP, 0 = DOWN", "none"])
    assert [(x.one, x.zero) for x in s] == [("UP", "DOWN"), (None, None)]
    heads = ["Parameter", "Tvpe", "Word Location(s)", "Mnemonic/Name", "Freq (Hz)", "zzzz"]
    fields = values(spark, lambda c: cells.header_field(cells.normalize_header(c))["field"], heads)
    assert fields == ["parameter_name", "parameter_type", "word_location", "mnemonic_and_name", "frequency", None]


BASE = dict(parameter_name="OIL TEMP #2", parameter_type="Signed Analog", frequency="1", word_location="4", subframe="all", msb="12", lsb="3", resolution="0.176")


def rows(spark, *over, doc="d"):
    data = [(doc, i, *[{**BASE, **o}.get(f) for f in RAW_FIELDS]) for i, o in enumerate(over)]
    return spark.createDataFrame(data, "document_id string, row_no bigint, " + ", ".join(f"{f} string" for f in RAW_FIELDS))


CASES = [
    (dict(), [], [(1, 1, 4, 3, 12)]),
    (dict(word_location="121-122", msb="9-1", lsb="12-7"), [("warning", "normalize.bits_layout")], [(1, 1, 121, 1, 9), (1, 2, 122, 7, 12)]),
    (dict(word_location="4, 132", frequency=None), [("warning", "normalize.multiword")], [(1, 1, 4, 3, 12), (2, 1, 132, 3, 12)]),
    (dict(frequency="2"), [("warning", "normalize.frequency")], [(1, 1, 4, 3, 12)]),
    (dict(word_location="4, 132", frequency="2"), [], [(1, 1, 4, 3, 12), (2, 1, 132, 3, 12)]),
    (dict(word_location="154, 153", frequency="1", msb="9/12", lsb="1/1"), [], [(1, 1, 154, 1, 9), (1, 2, 153, 1, 12)]),
    (dict(frequency="1/8"), [("error", "normalize.superframe")], [(1, 1, 4, 3, 12)]),
    (dict(resolution=""), [("error", "normalize.resolution")], [(1, 1, 4, 3, 12)]),
    (dict(resolution="-40, 0.0195"), [("warning", "normalize.resolution_pair")], [(1, 1, 4, 3, 12)]),
    (dict(word_location="l2"), [("warning", "normalize.word_repaired")], [(1, 1, 12, 3, 12)]),
    (dict(parameter_type="Discret e", msb="1", lsb="1", resolution=None), [("warning", "normalize.type_repaired")], [(1, 1, 4, 1, 1)]),
    (dict(parameter_type="BNR", sign="S"), [("info", "normalize.sign_column")], [(1, 1, 4, 3, 12)]),
    (dict(msb="", lsb=""), [("error", "normalize.bits_missing")], None),
    (dict(word_location="abc"), [("error", "normalize.word")], None),
    (dict(subframe="0"), [("info", "normalize.subframe_zero")], [(1, 1, 4, 3, 12)]),
    (dict(word_location="4, 100", frequency="2"), [("warning", "normalize.spacing")], [(1, 1, 4, 3, 12), (2, 1, 100, 3, 12)]),
    (dict(msb="3", lsb="12"), [("info", "normalize.bit_order")], [(1, 1, 4, 12, 3)]),
    (dict(parameter_type="BCD", resolution=None), [("info", "normalize.resolution_default")], [(1, 1, 4, 3, 12)]),
]


def test_row_rules(spark):
    got = norm.normalize(rows(spark, *[c[0] for c in CASES]), norm.Conventions(frequency_unit="hz")).orderBy("row_no").collect()
    for r, (over, issues, segs) in zip(got, CASES):
        assert [(i.severity, i.rule) for i in r.issues] == issues, over
        assert (None if r.segments is None else [(s.occ, s.seq, s.word, s.lsb, s.msb) for s in r.segments]) == segs, over
    assert (got[8].resolution, got[8].offset) == (0.0195, -40.0)
    assert got[11].source_type == "BNR (signed)" and got[11].ptype == "analog_signed"


def test_document_evidence(spark):
    pair = dict(word_location="121-122", msb="9-1", lsb="12-7", frequency="4", subframe="2")
    c = {r.document_id: r for r in norm.effective_conventions(rows(spark, *[pair] * 3, doc="a").unionByName(rows(spark, {}, doc="b"))).collect()}
    assert (c["a"].frequency_unit, c["a"].multiword_bits) == ("seconds", "range_per_word")
    assert (c["b"].frequency_unit, c["b"].multiword_bits) == ("hz", "auto")


def test_review_flow(spark):
    raw = rows(spark, {}, dict(word_location="8", parameter_name="ROLL"), dict(word_location="9", frequency="2", parameter_name="YAW"),
               dict(word_location="10", description="second"), dict(word_location="abc", parameter_name="BAD"))
    items = review.build(raw, norm.Conventions(frequency_unit="hz"))
    got = {r.param_id: r for r in items.collect()}
    assert {k: r.state for k, r in got.items()} == {"pdf-0001": "APPROVED", "pdf-0002": "APPROVED", "pdf-0003": "REVIEW_REQUIRED",
                                                    "pdf-0004": "APPROVED", "pdf-0005": "REVIEW_REQUIRED"}
    assert (got["pdf-0001"].mnemonic, got["pdf-0004"].mnemonic) == ("OIL TEMP #2 #1", "OIL TEMP #2: second")
    assert review.publishable(items).first().problem == "rows still need review"
    decisions = spark.createDataFrame([("d", "pdf-0003", 1, "approve"), ("d", "pdf-0005", 1, "approve"), ("d", "pdf-0005", 2, "exclude")],
                                      "document_id string, param_id string, at int, action string")
    after, refused = review.decide(items, decisions)
    assert refused.count() == 0
    pars, segs, history = review.publish(after)
    assert (pars.count(), segs.count(), history.count()) == (4, 4, 4)
    _, refused = review.decide(items, decisions.filter("at = 1"))
    assert [r.problem for r in refused.collect()] == ["no parameter could be built"]
    counts = {r.state: r.n for r in review.state_counts(after).collect()}
    assert (counts["APPROVED"], counts["EXCLUDED"], counts["PUBLISHED"]) == (4, 1, 0)


def test_cells_to_rows(spark):
    def tab(no, page, *lines):
        return [("d", page, no, i, j, t, 0.9, "native", None) for i, line in enumerate(lines) for j, t in enumerate(line)]

    head = ["Parameter", "Type", "Word", "MSB", "LSB", "Description"]
    data = tab(1, 1, head, ["PITCH", "BNR", "4", "12", "3", "attitude"], head, ["ROLL", "BNR", "5", "12", "3", ""])
    data += tab(2, 2, ["", "", "", "", "", "of the aircraft"], ["YAW", "BNR", "6", "12", "3", ""]) + tab(3, 2, ["a", "b"], ["1", "2"])
    cells_df = spark.createDataFrame(data, "document_id string, page int, table_no int, row_no int, col_no int, text string, confidence double, source string, note string")
    out, skipped = norm.rows_from_cells(cells_df)
    got = [(r.parameter_name, r.word_location, r.description, r.continued) for r in out.orderBy("row_no").collect()]
    assert got == [("PITCH", "4", "attitude", False), ("ROLL", "5", "of the aircraft", True), ("YAW", "6", "", False)]
    assert [(r.table_no, r.code) for r in skipped.collect()] == [(3, "PDF_TABLE_SKIPPED")]


@pytest.mark.parametrize("text,wps", [("recorded at 256 WPS", 256), ("64 words per second, 64 wps", 64), ("128 WPS and 256 WPS", None), ("none", None)])
def test_stated_wps(spark, text, wps):
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    assert pages.stated_wps(df).first().wps == wps


def test_alignment_against_a_plain_table():
    import random

    import numpy as np

    from flightwords.operators.pages import GAP, _alignment

    rng = random.Random(12)
    for _ in range(60):
        n, m = rng.randrange(8), rng.randrange(8)
        a, b = ([[rng.randrange(3) for _ in range(3)] for _ in range(k)] for k in (n, m))
        pairs = _alignment(np.array(a).reshape(-1, 3), np.array(b).reshape(-1, 3), 100)
        assert [i for i, _ in pairs if i is not None] == list(range(n)) and [j for _, j in pairs if j is not None] == list(range(m))
        cost = lambda i, j: sum(x != y for x, y in zip(a[i], b[j])) / 3
        total = sum(GAP if None in p else cost(*p) for p in pairs)
        d = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(n + 1):
            for j in range(m + 1):
                ways = [d[i - 1][j] + GAP] * (i > 0) + [d[i][j - 1] + GAP] * (j > 0)
                if i and j and cost(i - 1, j - 1) < 1:
                    ways.append(d[i - 1][j - 1] + cost(i - 1, j - 1))
                d[i][j] = min(ways, default=0.0)
        assert abs(total - d[n][m]) < 1e-9
    long = [[k, k + 1, 7] for k in range(3000)]
    kept = [r for k, r in enumerate(long) if k % 50]
    pairs = _alignment(np.array(long), np.array(kept), 16)
    assert sum(j is None for _, j in pairs) == 60 and all(j is None or long[i] == kept[j] for i, j in pairs)
