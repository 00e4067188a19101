"""Personal data, periodic runs and whitening against plain models."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from flightwords.llm import bidiagonal, periodic, pii, whitening
from flightwords.llm.queries import QUERIES

from .data import SF, documents, records, texts

# --- periodic runs -------------------------------------------------------------


def _runs(words):
    """All (start, length, period), period by period."""
    n, seen = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                seen.setdefault((start, i - start + q), q)
            i = max(i, start + 1)
    return sorted((a, n, q) for (a, n), q in seen.items())


def _periodic_words(rng, n, kinds):
    words = [rng.randrange(1, kinds + 1) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_against_every_period():
    rng = random.Random(1)
    for _ in range(60):
        docs = [_periodic_words(rng, rng.choice([0, 1, 5, 6, 7, 20, 60, 300]), rng.choice([1, 2, 3, 10])) for _ in range(8)]
        docs += docs[:2]
        found = periodic.find_runs(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]))
        got = [[] for _ in docs]
        for d, *run in zip(*(x.tolist() for x in found)):
            got[d].append(tuple(run))
        assert got == [_runs(d) for d in docs]


def test_extensions_meet_at_samples():
    """Every extension, near and far, in any residues."""
    rng = random.Random(2)
    words = _periodic_words(rng, 40, 2) + [rng.randrange(1, 3) for _ in range(120)] * 2
    e = periodic.Extensions(np.array(words), np.array([len(words)]))
    pairs = [(i, j) for i in range(0, len(words), 3) for j in range(i + 1, len(words), 2)]
    i, j = np.array(pairs).T
    want = [next((k for k in range(len(words) - b) if words[a + k] != words[b + k]), len(words) - b) for a, b in pairs]
    assert e.lengths(np.zeros(len(i), np.int64), i, j).tolist() == want


def test_periodic_query_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 500)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a b"), (3, "é b é b é b é b"), (4, "x " * 5), (4, "x " * 6), (5, "  " * 7), (6, "w" * 100_000)]
    got = sorted((str(r["doc_id"]), r["words"], [tuple(x) for x in r["runs"]], r["collapsed"][:9]) for r in records(periodic.periodic_runs(documents(spark, rows))))
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 7, [(0, 6, 1)], "a b"), (3, 8, [(0, 8, 2)], "é b"), (4, 5, [], "x x x x x"),
            (4, 6, [(0, 6, 1)], "x"), (5, 7, [(0, 7, 1)], " "), (6, 1, [], "w" * 9)]
    assert got == sorted((str(i), *rest) for i, *rest in want)
    assert periodic.periodic_runs(documents(spark, [])).count() == 0
    for r in records(QUERIES["op12_periodic_runs"](spark, SF)):
        text = dict((i, t) for i, t, *_ in texts())[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 2500:
            continue
        runs = _runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


# --- whitening -----------------------------------------------------------------


@pytest.mark.parametrize("kind", ["plain", "graded", "deficient", "repeated", "diagonal", "zero"])
def test_right_singular_vectors(kind):
    rng = np.random.default_rng(zlib.crc32(kind.encode()))
    for n in (1, 2, 3, 17, 48):
        a = rng.normal(size=(n, n))
        if kind == "graded":
            a = a * 10.0 ** rng.uniform(-6, 3, n)
        if kind == "deficient":
            a = a[:, : max(1, n // 2)] @ rng.normal(size=(max(1, n // 2), n))
        if kind == "repeated":
            q, p = (np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(2))
            a = q * np.repeat(rng.uniform(1, 5, n), 3)[:n] @ p
        if kind == "diagonal":
            a = np.diag(rng.integers(0, 3, n)).astype(float)
        if kind == "zero":
            a = np.zeros((n, n))
        squares, vectors = bidiagonal.right_singular(np.linalg.qr(a, mode="r"))
        want = np.linalg.svd(a, compute_uv=False) ** 2
        scale = want.max() or 1.0
        assert np.abs(squares - want).max() <= 1e-13 * scale
        assert np.abs(vectors @ vectors.T - np.eye(n)).max() <= 1e-12
        assert np.abs(a.T @ (a @ vectors.T) - vectors.T * squares).max() <= 1e-13 * scale


def test_small_singular_values_are_relatively_accurate():
    diagonal, above = np.array([1.0, 1e-3, 1e-7, 1e-11]), np.array([1.0, 1e-4, 1e-8])
    from fractions import Fraction

    product = math.prod(Fraction(x) ** 2 for x in diagonal)  # of all squares: the squared determinant
    got = bidiagonal.dqds(diagonal, above)
    assert abs(math.prod(Fraction(x) for x in got) / product - 1) < 1e-13


def _whitened(x):
    """Plain model: (n, sums, eigenvalues, eigenvectors) of the distinct rows."""
    u = np.unique(x, axis=0)
    s = u.sum(0)
    c = u - s / len(u)
    e, v = np.linalg.eigh(c.T @ c / len(u))
    return len(u), s, e[::-1], v[:, ::-1].T


def test_whitening_against_a_plain_model(spark):
    rng = np.random.default_rng(3)
    raw = (rng.normal(size=(900, 6)) @ rng.normal(size=(6, 6)) + 100).astype(np.float32)
    raw[300:600] = raw[0]  # copies count once
    rows = [(i, v.tolist()) for i, v in enumerate(raw)]
    bad = [(5000, None), (5001, [1.0, math.nan] + [0.0] * 4), (5002, [math.inf] + [0.0] * 5), (5003, [None] + [0.0] * 5)]
    odd = [(6000, []), (6001, [1.0, 2.0]), (None, raw[5].tolist())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad + odd], "vec_id long, embedding array<float>, component int, n string").repartition(5)
    x = whitening.scaled(df, "vec_id", "embedding")
    found = whitening.fit(x)
    got = records(whitening.whiten(x, found))
    assert len(got) == 4 * (900 + 3)
    whole = np.floor(256 * raw.astype(float)).astype(np.int64)
    n, s, e, v = _whitened(whole)
    assert {r["n"] for r in got} == {n} and found.identity_error < 1e-10
    table = {(r["id"], r["component"]): r for r in got if r["id"] is not None}
    assert all(table[i, c]["whitened"] is None and table[i, c]["deviation"] is None for i in (6000, 6001) for c in (1, 2, 3, 4))
    white = np.array([[table[i, c]["whitened"] for c in (1, 2, 3, 4)] for i in range(900)])
    want = (whole - s / n) @ v[:4].T / np.sqrt(e[:4])
    assert np.abs(white - want * np.sign((white * want).sum(0))).max() < 1e-9
    assert [table[i, 1]["deviation"] for i in range(900)] == [int(d) for d in ((n * whole - s) ** 2).sum(1)]
    assert all(abs(table[0, c + 1]["explained"] / (e[c] / e.sum()) - 1) < 1e-9 for c in range(4))


def test_whitening_of_little_and_nothing(spark):
    kind = "vec_id long, embedding array<double>"

    def run(rows):
        x = whitening.scaled(spark.createDataFrame(rows, kind), "vec_id", "embedding")
        return records(whitening.whiten(x, whitening.fit(x)))

    assert run([]) == [] and run([(1, None)]) == []
    assert [(r["deviation"], r["whitened"], r["explained"]) for r in run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])] == [(0, None, None)] * 4
    flat = run([(1, [0.0, 5.0]), (2, [1.0, 5.0])])
    assert sorted((r["id"], r["component"], r["deviation"], r["whitened"] and abs(round(r["whitened"], 12))) for r in flat) == [
        (1, 1, 65536, 1.0), (1, 2, 65536, None), (2, 1, 65536, 1.0), (2, 2, 65536, None)]
    huge = run([(1, [1e300, 1.0]), (2, [-1e300, 1.0])])
    assert {r["deviation"] for r in huge} == {None} and len(huge) == 4


# --- personal data -------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def _base(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, good in ((2, CARD, lambda d: 13 <= len(d) <= 19 and _luhn(d)), (3, PHONE, lambda d: 9 <= len(d) <= 15)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if good(re.sub("[^0-9]", "", m[0]))]
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    for letters in ("a@b.-+1 ", "0123.@+- ()", "12. ", "4111 -", "+12() .-9", "a.@", "é@a.b1"):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
            assert pii.base_spans(text) == _base(text), text
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" + ")" * 300_000, "1." * 100_000, "1 " * 100_000):
        pii.candidates(text, pii.base_spans(text))  # in linear time


def _found(spark, rows):
    spans, sure = pii.personal_data(documents(spark, rows))
    told = {}
    for r in records(spans):
        told.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["base"]], [tuple(x) for x in r["found"]]))
    return told, {r["pattern"]: r for r in records(sure)}


def _plain_patterns(rows):
    """The scores of all patterns, by plain loops."""
    edges = {}
    for _, text in rows:
        base = pii.base_spans(text or "")
        own = [(k, a, b, k == 0) for k, a, b in base] + [(None, a, b, mail) for a, b, mail in pii.candidates(text or "", base)]
        for k, a, b, mail in own:
            for p in pii.patterns(text, a, b):
                key = (p, text[a:b].lower().translate(pii.JOINTS), mail)
                edges[key] = k if edges.get(key) is None else edges[key]
    scores, sure = {}, {}
    for _ in range(pii.ROUNDS):
        sure = {}
        for p in {p for p, _, _ in edges}:
            own = [(k, *((k, 1.0) if k is not None else scores.get(i, (None, 0.0)))) for (q, i, _), k in edges.items() if q == p]
            weight = [sum(s for _, of, s in own if of == k) for k in range(4)]
            kind = weight.index(max(weight))
            seeds = sum(k == kind for k, _, _ in own)
            if weight[kind] / (len(own) + 1) >= pii.CONFIDENT and seeds >= pii.LEAST_SEEDS:
                sure[p] = (kind, weight[kind] / (len(own) + 1))
        scores = {}
        for i in {i for (_, i, _), k in edges.items() if k is None}:
            around = [sure[p] for (p, j, mail), k in edges.items() if j == i and k is None and p in sure and mail == (sure[p][0] == 0)]
            if around:
                miss = [math.prod(1 - c for k, c in around if k == kind) for kind in range(4)]
                kind = miss.index(min(miss))
                scores[i] = (kind, round(1 - miss[kind], 9))
    return sure


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(4)
    rows = [(i, f"Please call me at +1 555 {1000 + i:04d} {i % 10}77 today or tomorrow, thanks.") for i in range(12)]
    rows += [(20 + i, f"wrong number {rng.randrange(10**7)} seen in year {1900 + i} or so") for i in range(6)]
    rows += [(30 + i, f"contact mail: user{i}@site{i}.example.org now") for i in range(8)]
    new = [(50, "you may call me at 020 7946 0958 today if you like"), (51, "contact mail: root@localhost now"), (52, "call me at 17 today"), (53, "é call me at (030) 123-4567"),
           (50, "call me at 020 7946 0958 today")]
    told, sure = _found(spark, rows + new)
    assert told[50] == [([], [(3, 19, 32)]), ([], [(3, 11, 24)])] or told[50] == [([], [(3, 11, 24)]), ([], [(3, 19, 32)])]
    assert told[51] == [([], [(0, 14, 28)])] and told[53] == [([], [(3, 13, 27)])]
    assert told[52] == [([], [])] and all(told[20 + i] == [([], [])] for i in range(6))
    assert all(told[i][0][0] == _base(t) for i, t in rows)
    want = _plain_patterns(rows + new)
    assert {p: r["kind"] for p, r in sure.items()} == {p: k for p, (k, _) in want.items()}
    assert all(abs(r["confidence"] - want[p][1]) < 1e-8 for p, r in sure.items())
    assert {"me at _", "contact mail: _"} <= set(sure)


def test_personal_data_of_awkward_rows_and_the_query(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "1.2.3.4"), (3, "1.2.3.4"), (4, "x" * 500_000 + " 4111111111111111")]
    told, sure = _found(spark, rows)
    assert sure == {} and told[None] == [([(0, 0, 5)], [])] and told[3] == [([(1, 0, 7)], [])] * 2 and told[1] == told[2] == [([], [])]
    assert told[4] == [([(2, 500_001, 500_017)], [])]
    spans, sure = pii.personal_data(documents(spark, []))
    assert spans.count() == 0 and sure.count() == 0
    got = {r["doc_id"]: r for r in records(QUERIES["op11_pii"](spark, SF))}
    for i, text, *_ in texts():
        base = _base(text or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == j for b in base) for j in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(got[i]["spans"].split(","))
