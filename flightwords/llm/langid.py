"""Language identification by prediction by partial matching (PPM).

Every language has byte context trees of orders 0 to ``order`` with escape
method C: in a context of n bytes seen, t of them different, a byte seen c
times has probability c / (n + t), any other t / (n + t) times its probability
in the next shorter context, down to 1/256.  Statistics are frozen after
training, so the code length of every byte in every context is a fixed number:
the trees of all languages share their contexts, a table holds the bits for
each (context, byte, language), and a text's code lengths are sums over it.
The shortest code names the language.

The model is fitted on a bounded sample: at most SAMPLE documents a language,
chosen by hash.  Texts of more than SAMPLE_BYTES bytes come after all others and
give a stretch of half as many characters, at a place chosen by hash.  Of all contexts
CELLS / languages are kept, LEAST_CONTEXTS at least, those seen most.  Its tables so
take CELLS kB, or LEAST_CONTEXTS kB a language where that is more, and are
broadcast.  Scoring covers whole texts, block by block.

Defined results: ``und`` with score 0 where text is null or holds no letter,
or where there was nothing to learn from; equal code lengths go to the first
language by code point; repeated rows are scored each; empty tables give empty
tables; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightwords.llm.common import pick

ORDER = 4
SAMPLE = 600
SAMPLE_BYTES = 32_768
CELLS = 32_768
LEAST_CONTEXTS = 2_048
LEAST_SEEN = 4
BLOCK = 1 << 18
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    order: int
    child: np.ndarray  # (context, byte before it) -> longer context; the last row is the dead end
    bits: np.ndarray  # (context * 256 + byte, language)


def _bytes(text: str) -> bytes:
    return text.lower().encode()


def _grams(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context of k bytes, byte) of all texts, and how often each occurs."""
    pad = b"\n" * k
    parts = []
    for t in texts:
        b = np.frombuffer(pad + _bytes(t), np.uint8).astype(np.uint64)
        key = np.zeros(max(len(b) - k, 0), np.uint64)
        for j in range(k + 1):
            key = (key << np.uint64(8)) | b[j : len(b) - k + j]
        parts.append(key)
    return np.unique(np.concatenate(parts), return_counts=True)


def train(samples: dict[str, list[str]], order: int = ORDER, cells: int = CELLS) -> Model | None:
    langs = sorted(samples)
    if not langs:
        return None
    counted = {(k, lang): _grams(samples[lang], k) for k in range(order + 1) for lang in langs}
    # contexts of each order and how often they were seen in all languages
    found = []
    for k in range(1, order + 1):
        ctx = np.concatenate([counted[k, lang][0] >> np.uint64(8) for lang in langs])
        n = np.concatenate([counted[k, lang][1] for lang in langs])
        own, at = np.unique(ctx, return_inverse=True)
        found.append((own, np.bincount(at, n)))
    every = np.concatenate([n for _, n in found])
    keep = max(LEAST_CONTEXTS, cells // len(langs))
    least = max(LEAST_SEEN, np.partition(every, -keep)[-keep] + 1 if len(every) > keep else 0)
    levels = [np.zeros(1, np.uint64)] + [own[n >= least] for own, n in found]
    first = np.concatenate([[0], np.cumsum([len(x) for x in levels])])
    size = int(first[-1])
    child = np.full((size + 1, 256), size, np.int32)
    prob = np.full((size, 256, len(langs)), 1 / 256)
    for k, own in enumerate(levels):
        nodes = np.arange(first[k], first[k + 1])
        if k:
            # a context's suffix was seen as often at least, so it is there
            rest = own & np.uint64((1 << 8 * (k - 1)) - 1)
            parents = first[k - 1] + np.searchsorted(levels[k - 1], rest)
            child[parents, (own >> np.uint64(8 * (k - 1))).astype(np.int64)] = nodes
            prob[nodes] = prob[parents]
        for j, lang in enumerate(langs):
            key, n = counted[k, lang]
            at = np.searchsorted(own, key >> np.uint64(8))
            ok = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == key >> np.uint64(8)) if len(own) else np.zeros(len(key), bool)
            at, sym, n = at[ok], (key[ok] & np.uint64(255)).astype(np.int64), n[ok]
            total, kinds = np.bincount(at, n, len(own)), np.bincount(at, minlength=len(own))
            escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            prob[nodes, :, j] *= escape[:, None]
            prob[first[k] + at, sym, j] = n / (total[at] + kinds[at])
    return Model(langs, order, child, (-np.log2(prob)).astype(np.float32).reshape(size * 256, len(langs)))


def _costs(model: Model, b: np.ndarray) -> np.ndarray:
    """Bits of every byte from number ``order`` on, by language."""
    k, dead = model.order, len(model.child) - 1
    flat = model.child.ravel()
    last = node = np.zeros(len(b) - k, np.int32)
    for d in range(1, k + 1):
        node = flat[node * np.int32(256) + b[k - d : len(b) - d]]
        last = np.where(node == dead, last, node)
    return model.bits[last * np.int32(256) + b[k:]]


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of every text in every language; texts are joined to blocks, and long ones cut."""
    out = np.zeros((len(texts), len(model.langs)))
    pad, k = b"\n" * model.order, model.order
    block: list[bytes] = []
    spans: list[tuple[int, int, int]] = []
    held = 0

    def flush() -> None:
        nonlocal block, spans, held
        if spans:
            costs = _costs(model, np.frombuffer(b"".join(block), np.uint8))
            ends = np.array([(s, e) for _, s, e in spans]).ravel()
            sums = np.add.reduceat(np.concatenate([costs, np.zeros((1, costs.shape[1]), np.float32)]), ends, axis=0, dtype=np.float64)[::2]
            np.add.at(out, [i for i, _, _ in spans], sums)
        block, spans, held = [], [], 0

    for i, text in enumerate(texts):
        for at in range(0, len(text), BLOCK):
            piece = text[at : at + BLOCK]
            block += [text[at - k : at] if at else pad, piece]
            # costs begin k bytes into the block
            spans.append((i, held, held + len(piece)))
            held += k + len(piece)
            if held >= BLOCK:
                flush()
    flush()
    return out


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def sample(rows: DataFrame, per_lang: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """At most ``per_lang`` texts a language of ``rows`` (doc_id, lang, text), by hash."""
    rows = rows.filter("lang is not null and text is not null").filter(F.octet_length("text") > 0).withColumn("long", F.octet_length("text") > most_bytes)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    h = F.xxhash64("doc_id", F.lit("sample"))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * per_lang / n + 100.0 / n))])
    # about twice as many as are taken go on by hash; so the windows are small
    some = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, "lang") * (1 << 30))
    span = F.lit(most_bytes // 2)
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - span, F.lit(1))).cast("int") + 1
    order = Window.partitionBy("lang").orderBy("long", "h", "doc_id", F.xxhash64("text"))
    cut = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang)
    taken = cut.select("lang", F.when(F.col("long"), F.substr("text", place, span)).otherwise(F.col("text")).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in taken:
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def fit(rows: DataFrame, **bounds) -> Model | None:
    """The model of training ``rows`` (doc_id, lang, text)."""
    return train({k: sorted(v) for k, v in sample(pick(rows, "doc_id", "lang", "text"), **bounds).items()})


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (posterior under equal priors), bits_per_byte of every document."""
    d = pick(docs, "doc_id", "text")
    if model is None:
        return d.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = d.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.langs, object)
        for batch in batches:
            texts = [_bytes(t.as_py()) if t.is_valid else b"" for t in batch.column("text")]
            known = np.array([bool(t) for t in texts], bool)
            bits = code_lengths(m, texts)
            best = bits.argmin(axis=1) if len(texts) else np.zeros(0, int)
            gap = np.exp2(-(bits - bits.min(axis=1, keepdims=True))) if len(texts) else bits
            score = np.where(known, 1 / gap.sum(axis=1), 0.0)
            per = bits[np.arange(len(texts)), best] / np.maximum([len(t) for t in texts], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(score), pa.array(per, mask=~known)],
                ["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    with_letter = F.when(F.rlike("text", F.lit(r"\p{L}")), F.col("text"))
    return d.select("doc_id", with_letter.alias("text")).mapInArrow(scored, "doc_id long, lang_pred string, score double, bits_per_byte double")
