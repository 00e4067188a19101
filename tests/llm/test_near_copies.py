import random
import re

import corpus_pipeline
from flightwords.llm import near_copies

from .data import documents, records, texts
from .test_dedup import AWKWARD, _components


def _grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def _changed(rng, words, least, most):
    """A copy with changed words whose similarity lies within the bounds."""
    own, out = _grams(" ".join(words)), list(words)
    while not least <= (now := _jaccard(own, _grams(" ".join(out)))) < most:
        if now < least:
            out = list(words)
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


def _stage(spark, docs):
    return dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")


def test_near_copies_from_similarity_four_fifths(spark):
    rng = random.Random(8)
    rows = []
    for k in range(40):  # a text and one copy each, some just too far
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        least = (0.8, 0.85, 0.9, 0.95, 0.74)[k % 5]
        rows += [(k, " ".join(words)), (1000 + k, _changed(rng, words, least, least + 0.05))]
    kept = {r["doc_id"] for r in records(_stage(spark, documents(spark, rows)))}
    assert kept == {i for i, _ in rows if i < 1000 or i % 5 == 4}


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(9)
    rows = [t[:2] for t in texts()[:120]]
    rows += [(5000 + i, " ".join(w if rng.random() > 0.03 else "other" for w in t.split())) for i, t in rows[:40]]
    base = [f"w{k}" for k in range(60)]  # a large group, its members alike in part
    rows += [(6000 + k, " ".join(w if rng.random() > 0.015 else f"x{rng.random()}" for w in base)) for k in range(80)]
    rows += AWKWARD + [(77_777, "One Two three"), (77_778, "one two THREE"), (77_779, "one two three four five six"), (77_780, "one two three four five six seven")]
    sets = [_grams(t) for _, t in rows]
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    label = _components(numbered, lambda i, j: _jaccard(sets[i], sets[j]) >= 0.8)
    heads = {}
    for (i, t), g in zip(rows, label):
        heads[g] = min(heads.get(g, (True, 0)), (i is None, i or 0))
    docs = documents(spark, rows)
    kept = _stage(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in records(kept)) == sorted(heads.values())


def test_near_copies_on_nothing(spark):
    assert near_copies.drop_near_copies(documents(spark, [])).count() == 0


def test_lists_pair_only_what_may_be_similar(spark):
    """A list's large component and the sets around it: only pairs that sizes and positions allow are made."""
    rng = random.Random(10)
    rows = [(1, k, 300, rng.randrange(8), 1) for k in range(200)]  # gram, node, n, pos, comp
    rows += [(1, 1000 + k, 300, rng.randrange(40, 61), 1000 + k) for k in range(200)]
    rows += [(1, 2000 + k, rng.randrange(200, 400), rng.randrange(41), 2000 + k % 5) for k in range(40)]
    placed = spark.createDataFrame([(g, node, n, 0, pos, comp) for g, node, n, pos, comp in rows], "gram long, node long, n int, alone int, pos int, comp long")
    may = {
        (a[1], b[1]) for a in rows for b in rows
        if a[1] < b[1] and a[4] != b[4] and 9 * min(a[2] - a[3], b[2] - b[3]) >= 4 * (a[2] + b[2])
    }
    assert 0 < len(may) < 10_000
    assert sorted((r["u"], r["v"]) for r in records(near_copies._partners(placed))) == sorted(may)


def test_fingerprints_give_candidates_and_shingles_decide(spark):
    rng = random.Random(11)
    rows = []
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(k, " ".join(words)), (100 + k, " ".join([*words[:-1], "other"])), (200 + k, _changed(rng, words, 0.7, 0.79))]
    prints = near_copies.suspects(documents(spark, rows))
    nodes = prints.selectExpr("node", "fp", "size(grams) as n", "grams")
    doc = {r["node"]: r["doc_id"] for r in records(prints)}
    found = {tuple(sorted((doc[r["u"]], doc[r["v"]]))) for r in records(near_copies._print_links(nodes))}
    # of three near prints one stands for the others, which may be the one too far from both
    assert found <= {(k, 100 + k) for k in range(20)} and len(found) > 10
