import math
import zlib
from collections import Counter

import numpy as np

from flightwords.llm import chat, langid, mixing, packing, toxicity
from flightwords.llm.queries import QUERIES

from .data import SF, documents, records, texts

BIG = "/root/testdata/sf0.01"


def test_language_id_held_out(spark):
    lang = {t[0]: t[2] for t in texts(BIG)}
    got = records(QUERIES["op1_language_id"](spark, BIG))
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_code_lengths_against_a_plain_model():
    samples = {"aa": ["abracadabra", "abc abc"], "bb": ["zyzzyva", "abc zyx"]}
    model = langid.train(samples, order=2, cells=1 << 20)
    contexts = {tuple(x) for x in [()]}
    for k in (1, 2):
        n = Counter()
        for t in sum(samples.values(), []):
            b = b"\n" * k + t.encode()
            n.update(b[i - k : i] for i in range(k, len(b)))
        contexts |= {tuple(c) for c, x in n.items() if x >= langid.LEAST_SEEN}

    def bits(lang, text):
        total = 0.0
        padded = b"\n\n" + text
        for i in range(2, len(padded)):
            own = max((c for c in (tuple(padded[i - k : i]) for k in range(3)) if c in contexts and all(c[j:] in contexts for j in range(len(c)))), key=len)

            def prob(ctx):
                seen = Counter()
                for t in samples[lang]:
                    b = b"\n" * len(ctx) + t.encode()
                    seen.update(b[j] for j in range(len(ctx), len(b)) if tuple(b[j - len(ctx) : j]) == ctx)
                n, t = sum(seen.values()), len(seen)
                less = prob(ctx[1:]) if ctx else 1 / 256
                return less if not n else seen[padded[i]] / (n + t) if seen[padded[i]] else t / (n + t) * less

            total -= np.log2(prob(own))
        return total

    words = [b"abracazy", b"", b"q", b"abc" * 200]
    got = langid.code_lengths(model, words)
    assert np.allclose(got, [[bits(x, w) for x in ("aa", "bb")] for w in words], rtol=1e-5)
    langid_block = langid.BLOCK
    try:
        langid.BLOCK = 7
        assert np.allclose(langid.code_lengths(model, words), got, rtol=1e-6)
    finally:
        langid.BLOCK = langid_block


def test_language_id_of_awkward_rows(spark):
    docs = documents(spark, [(1, None, "en"), (2, "", None), (3, "12 !?", "en"), (4, "the cat", "en"), (None, "der hund", "de"), (4, "the cat", "en"), (5, "é" * 300_000, None)])
    got = records(langid.predict(docs, langid.fit(docs)))
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))][:3] == ["und"] * 3
    assert len(got) == 7 and {r["lang_pred"] for r in got if r["doc_id"] == 4} == {"en"}
    empty = documents(spark, [])
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in records(langid.predict(docs, None))} == {"und"}


def test_language_id_learns_from_long_texts_and_many_languages(spark):
    rows = [(1, "der hund und die katze " * 3000, "de"), (2, "the cat and the dog ran", "en"), (3, "the dog was there", "en")]
    model = langid.fit(documents(spark, rows))
    assert model.langs == ["de", "en"]
    got = records(langid.predict(documents(spark, [(9, "und die katze"), (10, "and the dog")]), model))
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {9: "de", 10: "en"}
    words = "".join(chr(97 + k % 26) + chr(97 + k // 26 % 26) + " " for k in range(3000))
    many = langid.train({f"l{k}": [words[k:] + f"word{k} " * 9] for k in range(60)}, cells=60 * 40)
    assert len(many.child) - 1 > 1000  # contexts don't shrink as languages are added


def test_toxicity_held_out_and_located(spark):
    rows = [(f"fine words number {i % 7} go on. All is well here {i}.\nSo it is.", False) for i in range(200)]
    rows += [(f"fine words number {i % 7} go on. You {'grumbo' if i % 2 else 'snarkil' + 'xyz'[i % 3]} here {i}.\nSo it is.", True) for i in range(60)]
    model = toxicity.train(rows)
    for word in ("grumbo", "snarkily"):
        p, found = model.score(f"So it is.\nAll of it. You {word} there. Fine words go on.")
        assert p >= 0.7 and max(found, key=lambda x: x[2])[:2] == (20, len(f" You {word} there"))
    assert model.score("fine words go on. " * 5000)[0] < 0.5 and model.score("")[0] == 0
    p, found = model.score("İ" * 30 + ". You GRUMBO here. So.")
    assert p >= 0.7 and found[0][:2] == (31, 16)


def test_toxicity_against_plain_loops():
    """One step of training equals a step worked out document by document, and scores follow the noisy-or."""
    texts = [("bad egg. fine day. fine egg", True), ("fine day. good egg", False), ("good day", False), ("bad day. bad", True)]
    names = {w: k for k, w in enumerate(["bad", "egg", "fine", "day", "good"])}
    bags = [[sorted({names[w] for w in s.split()}) for s in t.split(".")] for t, _ in texts]
    doc = [d for d, bag in enumerate(bags) for _ in bag]
    flat = [s for bag in bags for s in bag]
    sentence, feature = zip(*[(k, f) for k, s in enumerate(flat) for f in s])
    toxic, decay, rounds = [t for _, t in texts], 0.01, 7
    bias, weights = toxicity._descend(np.array(doc), np.array(sentence), np.array(feature), np.array(toxic), 5, rounds, decay)
    x, m, v = [0.0] * 5 + [-4.0], [0.0] * 6, [0.0] * 6
    for t in range(1, rounds + 1):
        g = [decay * w for w in x[:-1]] + [0.0]
        for bag, bad in zip(bags, toxic):
            p = [1 / (1 + math.exp(-(x[-1] + sum(x[f] for f in s)))) for s in bag]
            clean = math.prod(1 - q for q in p)
            for s, q in zip(bag, p):  # d/dz of -log likelihood of 1 - prod(1 - p)
                dz = (q if not bad else -q * clean / (1 - clean)) / len(texts)
                for f in [*s, 5]:
                    g[f] += dz
        m = [0.9 * a + 0.1 * b for a, b in zip(m, g)]
        v = [0.99 * a + 0.01 * b * b for a, b in zip(v, g)]
        x = [w - 0.3 * (a / (1 - 0.9**t)) / (math.sqrt(b / (1 - 0.99**t)) + 1e-8) for w, a, b in zip(x, m, v)]
    assert np.allclose([*weights, bias], x, rtol=1e-9, atol=1e-12)
    model = toxicity.Model(-1.5, {"bad": 2.0, "egg": 0.5, "egg*": 9.0, "eggs": -3.0})
    p = [1 / (1 + math.exp(1.5 - z)) for z in (2.0, 0.5)]
    assert abs(model.score("Bad. Fine. An egg!")[0] - (1 - (1 - p[0]) * (1 - p[1]))) < 1e-12


def test_toxicity_sample_fills_its_places(spark):
    long = " ".join(f"word{i} grumbo." for i in range(4000))
    rows = [(i, None) for i in range(50)] + [(100 + i, f"good day {i}") for i in range(30)] + [(200, long), (201, long), (202, "short grumbo"), (100, "good day 0")]
    labels = spark.createDataFrame([(i, 1) for i in [*range(50), 200, 201, 202]] + [(100 + i, 0) for i in range(30)] + [(900 + i, 1) for i in range(99)], "doc_id long, toxic int")
    got = toxicity.sample(documents(spark, rows), labels, per_class=2, most_bytes=1000)
    assert sum(t for _, t in got) == 2 and ("short grumbo", True) in got
    other = next(x for x, t in got if t and x != "short grumbo")
    assert "grumbo" in other and len(other) <= 4000
    assert sum(not t for _, t in got) >= 2


def test_toxicity_query(spark):
    import pyarrow.parquet as pq

    toxic = dict(zip(*[pq.read_table(f"{BIG}/labels.parquet").to_pydict()[c] for c in ("doc_id", "toxic")]))
    got = [r for r in records(QUERIES["op10_toxicity"](spark, BIG)) if r["held_out"] and r["doc_id"] in toxic]
    caught = sum(r["predicted"] and toxic[r["doc_id"]] for r in got)
    assert sum(r["predicted"] != toxic[r["doc_id"]] for r in got) <= 0.08 * len(got)
    # few labels teach few words here: most that is found is right, about half is found (README has the figures of more)
    assert caught >= 0.5 * sum(toxic[r["doc_id"]] for r in got) and caught >= 0.9 * sum(r["predicted"] for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_toxicity_of_awkward_rows(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "!!"), (None, "bad"), (3, "!!")])
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {r["score"] for r in records(toxicity.score(docs, model))} == {0.0}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 5
    assert toxicity.score(documents(spark, []), model).count() == 0


def _chats(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")


def test_chat_round_trip(spark):
    hard = ["", None, "\\", "\\\\</turn>\n", "### User: hi</turn>", "#### ", "<\\/turn>", "### ### Assistant: \\", "</turn", "é\n\n🙂 " * 2000]
    roles = ["system", "user", "assistant", "tool", "a ### b</turn>", None, "a ###", "#", "### ###", " ", "x \\###"]
    rows = [(1, i, roles[i % len(roles)], t) for i, t in enumerate(hard * 2)] + [(2, None, "user", "first"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (None, 0, "user", "q")]
    got = {r["conv_id"]: r for r in records(chat.format_chats(_chats(spark, rows)).select("*", chat.read_back("formatted").alias("turns"), chat.loss_text("segments").alias("loss")))}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv]["loss"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["formatted"] == "".join(s["text"] for s in got[conv]["segments"])
        assert got[conv]["formatted"].count("</turn>\n") == len(own)
    assert chat.format_chats(_chats(spark, [])).count() == 0


def test_chat_machine(spark):
    talks = {1: "system user assistant", 2: "user assistant user assistant", 3: "user", 4: "assistant user", 5: "user system assistant", 6: "user assistant assistant"}
    rows = [(c, i, r, "t") for c, t in talks.items() for i, r in enumerate(t.split())]
    got = {r["conv_id"]: (r["state"], r["valid"]) for r in records(chat.format_chats(_chats(spark, rows)))}
    assert got == {1: ("answered", True), 2: ("answered", True), 3: ("asked", False), 4: ("rejected", False), 5: ("rejected", False), 6: ("rejected", False)}


def _ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    odd = "It's, don't! A.B, x'S? 12,5 É. ßẞ, ’s, Σ. ΑΣ. İ, ½. ①! á, <|endoftext|>. e\x1cf g\x85h Ⅷ. 中, 's. "
    rows = [t[:2] for t in texts()[:50]] + [(900, None), (901, ""), (902, odd), (None, "x y"), (None, "x y"), (903, "word, " * 60_000)]
    pieces = packing.pack(documents(spark, rows).repartition(5))
    got = sorted(records(pieces), key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in got:
        assert r["sequence_id"] * 2048 + r["offset"] == at and r["offset"] + r["length"] <= 2048
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        at += r["length"]
    stream = np.frombuffer(b"".join(bytes(r["ids"]) for r in got), "<u4").tolist()
    found, begin = Counter(), 0
    for r in got:  # a document's pieces follow each other
        if r["start"] == 0:
            begin = r["sequence_id"] * 2048 + r["offset"]
            found[r["doc_id"], tuple(stream[begin : begin + r["doc_tokens"]])] += 1
    assert found == Counter((i, tuple(_ids(tokenizer, t))) for i, t in rows)
    full = records(packing.sequences(pieces))
    assert all(len(s["ids"]) == 2048 * 4 for s in full) and len(full) == -(-at // 2048)
    assert np.frombuffer(b"".join(bytes(s["ids"]) for s in sorted(full, key=lambda s: s["sequence_id"])), "<u4").tolist()[:at] == stream
    assert packing.pack(documents(spark, [])).count() == 0


def test_packing_of_added_tokens_in_any_case():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary())
    for t in tokenizer.get_added_tokens_decoder().values():
        for form in (t.content, t.content.upper(), t.content.title(), f"A{t.content.upper()}b.", f"{t.content.upper()},"):
            for text in (form, f"One {form} two, {t.content}."):
                assert np.frombuffer(encoder.encode(text), "<u4").tolist() == _ids(tokenizer, text)[:-1]


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 90)), None, ["a", "b", "c", None, "d"][min(i % 37, 4)]) for i in range(3000)]
    rows += [(7, None, None, "empty"), (None, "x y z", None, "a"), (None, "x y z", None, "a"), (8, "w " * 100_000, None, "long")]
    docs = documents(spark, rows)
    got = records(mixing.copies(docs))
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    want = _targets(sizes)
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(sizes.values())
    for source in sizes:
        own = [r for r in got if r["source"] == source]
        assert all(r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source]) for r in own)
        assert all(0 <= r["copies"] <= 3 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - want[source]) <= 3 * max(r["size"] for r in own)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    again = Counter((r["doc_id"], r["copies"]) for r in records(mixing.copies(docs.repartition(7))))
    assert again == Counter((r["doc_id"], r["copies"]) for r in got)
    assert mixing.copies(documents(spark, [])).count() == 0


def test_mixing_of_nothing_but_empty_texts(spark):
    got = records(mixing.copies(documents(spark, [(1, None, None, "a"), (2, "", None, None)])))
    assert [(r["target"], r["copies"]) for r in got] == [(0.0, 0), (0.0, 0)]


def test_native_operators_plan_no_python(spark):
    for name in ("op5_chat_format", "op9_mixing"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_training_holds_no_strings_of_rare_features():
    """Nearly all words are rare; they and what sentences hold of them stay numbers."""
    import random
    import tracemalloc

    from flightwords.llm import toxicity

    rng = random.Random(3)
    rare = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(n))
    rows = [(f"{rare(500)}. you vile creature {i % 7}. {rare(500)}" if i % 2 else f"{rare(500)}. a kind creature. {rare(500)}", bool(i % 2)) for i in range(60)]
    tracemalloc.start()
    model = toxicity.train(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert all((model.score(t)[0] > 0.7) == bad for t, bad in rows) and "vile" in model.weights
    assert not toxicity.train([("...", True), ("!!", False)]).weights
