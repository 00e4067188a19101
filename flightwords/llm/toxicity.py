"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the
words it holds, each taken as itself and as its beginnings of PREFIXES letters;
a document's is the noisy-or of its sentences, 1 - prod(1 - p).  Weights are
trained from document labels alone, and the sentence probabilities then locate
what made a document toxic.

Training takes two rounds: over all features that WORD_DOCS sampled documents
hold, then over those that kept a good part of the largest weight; a sentence
with no word that speaks for toxicity has probability 0, so length alone never
makes a text toxic.

The classifier is fitted on a bounded sample: of each class the SAMPLE labelled
documents with a text that come first by hash.  Texts of more than SAMPLE_BYTES
bytes come after all others and give about that much, in whole sentences chosen
by hash.  Scoring covers whole texts.

Defined results: null, empty and wordless texts score 0; without labels of both
classes everything scores 0; several labels of one document count as toxic if
one is; repeated rows are scored each; empty tables give empty tables; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwords.llm.common import in_small_batches, pick, unpack
from flightwords.session import broadcast_if_small, materialize

SAMPLE = 2_000
SAMPLE_BYTES = 32_768
WORD_DOCS = 5
LEAST_WEIGHT = 0.15
ROUNDS = 120
THRESHOLD = 0.7
PREFIXES = (3, 4, 5)
REMEMBERED = 500_000
WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> list[str]:
    """The word, and its beginnings with a mark no word holds."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def __post_init__(self):
        self.words: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            w = self.words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, length, probability) of sentences that aren't 0."""
        low = text.lower()
        own = {w: x for w in set(WORDS.findall(low)) if (x := self.weight(w))}
        if not own or max(own.values()) <= 0:
            return 0.0, []
        same = len(low) == len(text)  # else lower-casing moved positions: sentences are lower-cased one by one
        clean, found = 1.0, []
        for m in SENTENCE.finditer(low if same else text):
            words = set(WORDS.findall(m[0] if same else m[0].lower()))
            known = [own.get(w) or self.weight(w) for w in words]
            if known and max(known) > 0:
                p = 1 / (1 + math.exp(-max(-500.0, self.bias + sum(known))))
                clean *= 1 - p
                found.append((m.start(), m.end() - m.start(), p))
        return 1 - clean, found


@dataclass
class Words:
    """Features of words: word ``of[i]`` has feature ``feature[i]``.  Sums over a sentence's
    features go by its words, so that only (sentence, word) is ever as long as the texts."""

    of: np.ndarray
    feature: np.ndarray
    n: int

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, x[self.feature], self.n)

    def shares(self, x: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.feature, x[self.of], width)


def _descend(
    doc: np.ndarray, sentence: np.ndarray, held: np.ndarray, toxic: np.ndarray, width: int, rounds: int, decay: float, words: Words | None = None
) -> tuple[float, np.ndarray]:
    """Bias and weights that fit the documents' labels; Adam on the noisy-or likelihood.

    ``doc`` is the document of each sentence, (sentence, held) the words they hold,
    which are features themselves unless ``words`` says which they have.
    """
    words = words or Words(np.arange(width), np.arange(width), width)
    x = np.zeros(width + 1)
    x[-1] = -4.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        z = x[-1] + np.bincount(sentence, words.sums(x)[held], len(doc))
        evidence = np.bincount(doc, np.logaddexp(0, z), len(toxic))  # -log of the probability to be clean
        slope = np.where(toxic, -1 / np.expm1(np.clip(evidence, 1e-6, 50)), 1.0)
        dz = slope[doc] / (1 + np.exp(-z))
        g = np.append(words.shares(np.bincount(held, dz[sentence], words.n), width), dz.sum()) / len(toxic)
        g[:-1] += decay * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return float(x[-1]), x[:-1]


def _renumbered(x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return (np.cumsum(keep) - 1).astype(np.int32)[x]


def _common(numbers: dict[str, int], docs_of: array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word, feature) and the names of the ``features`` whose words are in WORD_DOCS documents, each
    word counted for itself; the rare ones, nearly all there are, never become strings of their own."""
    of, feature, names = array("i"), array("i"), []
    words = sorted(numbers)
    whole = ((w, [w]) for w in words)
    begun = ((begin + "*", same) for k in PREFIXES for begin, same in groupby([w for w in words if len(w) > k], lambda w, k=k: w[:k]))
    for name, same in chain(whole, begun):
        own = [numbers[w] for w in same]
        if sum(docs_of[i] for i in own) >= WORD_DOCS:
            of.extend(own)
            feature.extend([len(names)] * len(own))
            names.append(name)
    of, feature = np.frombuffer(of, np.int32), np.frombuffer(feature, np.int32)
    order = np.argsort(of, kind="stable")
    return of[order], feature[order], names


def _seen(doc: np.ndarray, held: np.ndarray, of: np.ndarray, feature: np.ndarray, n: int, width: int, step: int = 65_536) -> np.ndarray:
    """Documents that hold each feature; ``doc`` rises, and about ``step`` words are looked at together."""
    seen, size = np.zeros(width, np.int64), np.bincount(of, minlength=n)
    begin, at = np.cumsum(size) - size, 0
    while at < len(doc):
        end = int(np.searchsorted(doc, doc[min(at + step, len(doc)) - 1], "right"))
        d, w = np.divmod(np.unique(doc[at:end].astype(np.int64) * n + held[at:end]), n)
        c = size[w]
        f = feature[np.repeat(begin[w] - np.cumsum(c) + c, c) + np.arange(c.sum())]
        seen += np.bincount(np.unique(np.repeat(d, c) * width + f) % max(1, width), minlength=width)
        at = end
    return seen


def train(rows: list[tuple[str, bool]]) -> Model:
    toxic = np.array([t for _, t in rows], bool)
    if not toxic.any() or toxic.all():
        return Model(0.0, {})
    # numbers instead of strings: every word is held once
    numbers: dict[str, int] = {}
    docs_of = array("i")  # documents that hold a word
    doc, sentence, held = array("i"), array("i"), array("i")
    for d, (text, _) in enumerate(rows):
        met: set[int] = set()
        for s in SENTENCE.findall(text.lower()):
            own = [numbers.setdefault(w, len(numbers)) for w in sorted(set(WORDS.findall(s)))]
            met.update(own)
            sentence.extend([len(doc)] * len(own))
            held.extend(own)
            doc.append(d)
        docs_of.extend([0] * (len(numbers) - len(docs_of)))
        for k in met:
            docs_of[k] += 1
    n = len(numbers)
    of, feature, names = _common(numbers, docs_of)
    del numbers
    doc, sentence, held = (np.frombuffer(x, np.int32) for x in (doc, sentence, held))
    vocabulary = np.array(names, object)
    seen = _seen(doc[sentence], held, of, feature, n, len(names))
    keep = seen >= WORD_DOCS
    for last in (False, True):
        on = keep[feature]
        of, feature, vocabulary = of[on], _renumbered(feature[on], keep), vocabulary[keep]
        told = np.bincount(of, minlength=n) > 0
        on = told[held]
        sentence, held = sentence[on], held[on]
        if last:  # sentences without a feature are clean
            full = np.bincount(sentence, minlength=len(doc)) > 0
            sentence, doc = _renumbered(sentence, full), doc[full]
        rounds, decay = ROUNDS * (3 if last else 1), (0.02 if last else 1) / len(rows)
        bias, weights = _descend(doc, sentence, held, toxic, len(vocabulary), rounds, decay, Words(of, feature, n))
        keep = weights > LEAST_WEIGHT * weights.max(initial=0.0)
    return Model(bias, {f: float(x) for f, x in zip(vocabulary, weights)})


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, bool]]:
    """At most ``per_class`` labelled texts of each class, by hash."""
    known = pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    texts = pick(docs, "doc_id", "text").filter(F.octet_length("text") > 0).withColumn("size", F.octet_length("text")).withColumn("tie", F.xxhash64("text"))
    # places go to texts that exist: ids, sizes and hashes meet the labels first
    able = texts.select("doc_id", "size", "tie").join(known, "doc_id").withColumn("h", F.xxhash64("doc_id", F.lit("sample")))
    order = (F.col("size") > most_bytes, "h", "doc_id", "tie")
    chosen = [able.filter(c).orderBy(*order).limit(per_class) for c in (F.col("toxic"), ~F.col("toxic"))]
    ids = chosen[0].unionByName(chosen[1]).groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n"), F.first("toxic").alias("toxic"))  # 2 * per_class rows at most
    every = F.ceil(F.col("size") / most_bytes)
    told = F.filter(F.regexp_extract_all("text", F.lit("([^.!?\\n]+)"), F.lit(1)), lambda s: F.pmod(F.xxhash64(s), every) == 0)
    stretch = F.substr(F.array_join(told, "\n"), F.lit(1), F.lit(4 * most_bytes))
    taken = texts.join(F.broadcast(ids), ["doc_id", "tie"]).withColumn("text", F.when(F.col("size") > most_bytes, stretch).otherwise(F.col("text")))
    # copies of a row were counted above, and each is met as often
    rows = taken.select("text", "toxic").collect()
    return sorted((r["text"], r["toxic"]) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    """The model of the documents that ``labels`` marks."""
    return train(sample(docs, labels, **bounds))


def _scored(d: DataFrame, model: Model) -> DataFrame:
    """``d`` with score and sentences for its text; written to the shared folder, so that texts reach Python in small batches."""
    shared = d.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, places = [], []
            for t in batch.column("text"):
                p, found = m.score(t.as_py() or "")
                scores.append(p)
                places.append([{"start": a, "length": n, "score": s} for a, n, s in found])
            carried = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(scores, pa.float64()), pa.array(places, spans)], [*carried, "score", "sentences"]
            )

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    place = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("score", DoubleType())])
    fields = [f for f in d.schema.fields if f.name != "text"]
    schema = StructType([*fields, StructField("score", DoubleType()), StructField("sentences", ArrayType(place))])
    out = in_small_batches(d.sparkSession, lambda: materialize(d.mapInArrow(scored, schema)))
    shared.destroy()  # workers would keep it
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, sentences array<struct<start, length, score>> of every document."""
    return _scored(pick(docs, "doc_id", "text"), model)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; columns as they are, which Python never sees."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))  # tells texts of one doc_id apart
    marks = _scored(pick(docs, "doc_id", "text").withColumn("tie", tie), model)
    gone = marks.filter(F.col("score") >= threshold).select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")).distinct()
    gone = broadcast_if_small(gone)
    rows = pick(docs, "doc_id", "text", row=True).withColumn("tie", tie).drop("text")
    return unpack(rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["tie"] == gone["gone_tie"]), "left_anti"), docs.columns)
