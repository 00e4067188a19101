import random
import re
from hashlib import sha256

import numpy as np
import xxhash

from flightwords.llm import components, exact_dedup, simhash, substrings

from .data import documents, records, texts

AWKWARD = [(5, "a  b\tc"), (3, "a b c"), (3, "a b c"), (9, None), (8, ""), (None, "a\nb c"), (None, "lone"), (7, " x"), (6, "x" * 200_000)]


def test_cuckoo_index_inserts_deletes_and_grows():
    rng, index, live = random.Random(1), exact_dedup.CuckooIndex(4), {}
    keys = [sha256(str(i).encode()).digest() for i in range(3000)]
    # keys that share bucket and tag with others: only the stored digests tell them apart
    keys += [k[:10] + sha256(k).digest()[:22] for k in keys[:500]]
    for step in range(30_000):
        k = rng.choice(keys)
        if rng.random() < 0.6:
            index.insert(k, step)
            live.setdefault(k, [step, 0])[1] += 1
        else:
            assert index.delete(k) == (k in live)
            if k in live:
                live[k][1] -= 1
                if not live[k][1]:
                    del live[k]
    got = index.frame(0)
    assert {bytes(d): [i, n] for d, i, n in zip(got.digest, got.keep_id, got.live)} == live
    assert all((index.find(k) >= 0) == (k in live) for k in keys)


def _exact(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(i)
    return {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in by.items()}


def test_exact_groups_and_kept_rows(spark):
    rows = AWKWARD + [t[:2] for t in texts()[:60]] + [(10_000 + i, t[1]) for i, t in enumerate(texts()[:20])]
    docs, want = documents(spark, rows), _exact(rows)
    got = records(exact_dedup.groups(docs))
    assert len(got) == len(rows)
    digests = {sha256(k.encode()).digest(): v for k, v in want.items()}
    assert all((r["keep_id"], r["group_size"]) == digests[bytes(r["digest"])] for r in got)
    assert sorted(bytes(r["digest"]) for r in got if r["kept"]) == sorted(digests)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    out = records(kept)
    assert sorted((re.sub(r"[ \t-\r]+", " ", r["text"] or ""), r["doc_id"] if r["doc_id"] is not None else -1) for r in out) == sorted(
        (k, v[0] if v[0] is not None else -1) for k, v in want.items())
    assert all(r["size"] == 7 and r["row"] == "r" for r in out)


def test_exact_on_nothing(spark):
    docs = documents(spark, [])
    assert exact_dedup.groups(docs).count() == 0 and exact_dedup.drop_copies(docs).columns == docs.columns


def test_index_change(spark):
    keys = lambda rows: spark.createDataFrame([(bytearray(sha256(k).digest()), i) for k, i in rows], "digest binary, doc_id long")
    index = exact_dedup.build(keys([(b"a", 4), (b"a", 2), (b"b", 7)]), 3)
    after = exact_dedup.change(index, 3, inserts=keys([(b"b", 9), (b"c", 1)]), deletes=keys([(b"b", 7), (b"a", 4), (b"z", 0)]))
    got = {bytes(r["digest"]): (r["keep_id"], r["live"]) for r in records(after)}
    assert got == {sha256(b"a").digest(): (2, 1), sha256(b"b").digest(): (9, 1), sha256(b"c").digest(): (1, 1)}


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows, linked):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(rows))]


def test_simhash_against_all_pairs(spark):
    base = [t[:2] for t in texts()[:120]]
    near = [(5000 + i, " ".join(w if k % 40 else "other" for k, w in enumerate(t.split()))) for i, t in base[:40]]
    rows = base + near + AWKWARD + [(77_777, "One Two three"), (77_778, "one two THREE")]
    prints = [_fingerprint(t) for _, t in rows]
    want = _components(rows, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    docs = documents(spark, rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] % 2**64, r["component_id"]) for r in records(simhash.groups(docs)))
    assert got == sorted(((i if i is not None else -1, f, c) for (i, _), f, c in zip(rows, prints, want)), key=lambda x: x[:2])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert len(records(kept)) == len({find for find in _labels(rows, prints)})


def _labels(rows, prints):
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    return _components(numbered, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)


def test_simhash_tiles_of_any_size_agree(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(300)]
    prints = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(3)} | {0, 1, 2**64 - 1}
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in prints], "fp long")
    roots = [{r["node"]: r["root"] for r in records(components.components(simhash.links(nodes, 4, tile)))} for tile in (16, 1 << 17)]
    assert roots[0] == roots[1] and roots[0]


def test_simhash_on_nothing(spark):
    docs = documents(spark, [])
    assert simhash.groups(docs).count() == 0 and simhash.drop_near_copies(docs).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (1, 2), (2, 1), (3, 2)]
    got = {r["node"]: r["root"] for r in records(components.components(spark.createDataFrame(edges, "u long, v long")))}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 3: 1}


def _cut(rows, length=50):
    """What op8 asks for, string by string."""
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_substrings_against_every_string(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé ") for _ in range(180))
    rows = [(i, t[:1500]) for i, t, *_ in texts()[:80]]
    for i in range(100, 140):  # one passage in many surroundings, cut short at random
        a, b = sorted(rng.sample(range(len(passage)), 2))
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + passage[a:b] + str(rng.random())))
    rows += [(200, "ab" * 300), (201, "ab" * 100 + "c" + "ab" * 40), (202, "a" * 49), (203, "a" * 50), (204, "a" * 500), (205, None), (206, ""), (207, "\0" * 120), (208, "\0" * 70)]
    rng.shuffle(rows)
    want = _cut(rows)
    for hot in (substrings.HOT, 5):  # the second sends common strings one by one
        monkeypatch.setattr(substrings, "HOT", hot)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in records(substrings.remove(documents(spark, rows)))}
        assert got == want


def test_substrings_of_one_id_and_of_none(spark):
    text = "".join(map(str, range(60)))
    got = records(substrings.remove(documents(spark, [(4, text), (4, text + "!"), (None, text), (None, "?" + text)])))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in got) == [(-1, 110), (-1, 110), (4, 0), (4, 0)]
    assert substrings.remove(documents(spark, [])).count() == 0


def test_previous_factors_against_every_pair():
    rng = random.Random(11)
    for _ in range(40):
        n, width = rng.randrange(1, 40), 8
        made = sorted(("".join(rng.choice("ab") for _ in range(width)).encode(), rng.randrange(6)) for _ in range(n))
        strings, doc = np.array([m[0] for m in made], f"S{width}"), np.array([m[1] for m in made])

        def common(a, b):
            return next((k for k in range(width) if a[k] != b[k]), width)

        want = [max([common(a, b) for b, e in made if e < d], default=0) for a, d in made]
        assert substrings.previous_factors(strings, doc).tolist() == want
