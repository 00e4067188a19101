"""Personal data: plain forms first, then identifiers that only their surroundings give away.

Base spans are e-mail addresses, IPv4 addresses, payment cards (Luhn) and
international phone numbers, found by form, leftmost and non-overlapping in each
kind.  They are the seeds of a bootstrapped extraction:

1. one pass over the texts notes each seed and each *candidate* (a run of digits
   and separators with LEAST_DIGITS digits, or a word with ``@``, that no base
   span touches) with the lexical patterns it stands in: the two words before
   it, one on each side, the two words after it (lower-cased, digits as 0,
   taken from CONTEXT code points around);
2. the pattern-instance graph (each pair once, however often it occurs) is
   scored in ROUNDS rounds of joins and aggregations: a pattern's confidence in a
   kind is the sum of its instances' scores over its number of instances plus
   one, seeds scoring 1; a candidate's score is the noisy-or of the confident
   patterns around it;
3. candidates inside a pattern of at least CONFIDENT confidence, held up by
   LEAST_SEEDS different seeds, become spans of that pattern's kind.  Candidates
   with ``@`` become e-mail addresses only, runs of digits the other kinds only.

All texts are read whole and every occurrence is kept; what is shuffled are
seeds, candidates and their patterns, pre-aggregated.

Defined results: null and empty texts have no spans; repeated rows are answered
each; null doc_ids stay; empty tables give empty tables; further columns are
ignored; patterns as good for two kinds go to the first of KINDS.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwords.llm.common import pick
from flightwords.session import broadcast_if_small, materialize

KINDS = ("email", "ip", "card", "phone")
LEAST_DIGITS = 4
CONTEXT = 64
ROUNDS = 3
LEAST_SEEDS = 3
CONFIDENT = 0.75

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# runs of digits are taken whole: what fails from a run's start fails from inside it
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[+(]?[0-9]++(?:[\x20().\-/]{1,2}+[0-9]++)*+")
WORD = re.compile(r"[^\x20\x09-\x0D]++")
LIKELY = re.compile("[0-9@]")
DIGIT = re.compile("[0-9]")
EDGES = "<>()[]{},;:\"'!?."
JOINTS = str.maketrans("", "", " ()-/")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def _part(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and int(short) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_part, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, holds @) of identifier-like stretches that no base span touches."""
    found = []
    if "@" in text:
        for m in WORD.finditer(text):
            if "@" in m[0]:
                inner = m[0].strip(EDGES)
                if len(inner) > 1:
                    start = m.start() + m[0].index(inner)
                    found.append((start, start + len(inner), True))
    mails = [(a, b) for a, b, _ in found]
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if b - a < LEAST_DIGITS or len(DIGIT.findall(m[0])) < LEAST_DIGITS:
            continue
        if (a and (text[a - 1].isalnum() or text[a - 1] in "_@")) or (b < len(text) and (text[b].isalnum() or text[b] in "_@")):
            continue
        found.append((a, b, False))
    fixed = _merged([(a, b) for _, a, b in base])
    taken = _merged([(a, b) for _, a, b in base] + mails)
    return sorted((a, b, mail) for a, b, mail in found if not _touches(fixed if mail else taken, a, b))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _touches(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the disjoint spans overlaps [a, b)."""
    k = bisect_left(spans, (b, -1))
    return k > 0 and spans[k - 1][1] > a


def patterns(text: str, start: int, end: int) -> list[str]:
    """The three lexical patterns around text[start:end]; ``_`` stands for it."""

    def words(part: str) -> list[str]:
        return [re.sub("[0-9]", "0", w) for w in part.lower().split()]

    left, right = words(text[max(0, start - CONTEXT) : start])[-2:], words(text[end : end + CONTEXT])[:2]
    left, right = ["^"] * (2 - len(left)) + left, right + ["$"] * (2 - len(right))
    found = [f"{left[0]} {left[1]} _", f"{left[1]} _ {right[0]}", f"_ {right[0]} {right[1]}"]
    return [p for p in found if p not in ("^ ^ _", "^ _ $", "_ $ $")]


SPAN = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
SPANS = "array<struct<kind: int, start: long, end: long>>"
SEEN = "array<struct<kind: int, start: long, end: long, mail: boolean, instance: string, patterns: array<string>>>"
ARROW_SEEN = pa.list_(pa.struct([*SPAN, ("mail", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def occurrences(docs: DataFrame) -> DataFrame:
    """uid, doc_id, base, seen (seeds with their kind, candidates without), written to the shared folder.

    ``uid`` numbers the rows, as doc_ids may repeat or be null.
    """

    def seen_in(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
        spans = [(k, a, b, k == 0) for k, a, b in base] + [(None, a, b, mail) for a, b, mail in candidates(text, base)]
        return [
            {"kind": k, "start": a, "end": b, "mail": mail, "instance": text[a:b].lower().translate(JOINTS), "patterns": patterns(text, a, b)}
            for k, a, b, mail in spans
        ]

    def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            base, seen = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                found = base_spans(text) if LIKELY.search(text) else []
                base.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                seen.append(seen_in(text, found) if LIKELY.search(text) else [])
            uids = pa.array(range(uid, uid + len(base)), pa.int64())
            uid += len(base)
            columns = [uids, batch.column("doc_id"), pa.array(base, pa.list_(pa.struct(SPAN))), pa.array(seen, ARROW_SEEN)]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "base", "seen"])

    d = pick(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return materialize(d.mapInArrow(noted, f"uid long, doc_id {kind}, base {SPANS}, seen {SEEN}"))


def _best(weights: list) -> tuple:
    """kind and weight of the largest of a weight per kind, the first of equal ones."""
    top = F.greatest(*weights)
    kind = F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        kind = F.when(weights[k] == top, k).otherwise(kind)
    return kind, top


def graph(occurrences: DataFrame) -> DataFrame:
    """pattern, instance, kind (null for candidates), mail: each pair once."""
    s = occurrences.select(F.explode("seen").alias("s")).select("s.*")
    pairs = s.select(F.explode("patterns").alias("pattern"), "instance", "mail", "kind")
    return pairs.groupBy("pattern", "instance", "mail").agg(F.min("kind").alias("kind"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence, seeds, instances of the patterns that are sure enough."""
    edges = materialize(edges)
    scores = None
    for _ in range(rounds):
        if scores is None:
            e = edges.withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).cast("decimal(10, 9)")).withColumn("of", F.col("kind"))
        else:
            e = edges.join(scores, "instance", "left").withColumn("of", F.coalesce("kind", "candidate"))
            e = e.withColumn("score", F.when(F.col("kind").isNotNull(), F.lit(1).cast("decimal(10, 9)")).otherwise(F.coalesce("part", F.lit(0).cast("decimal(10, 9)"))))
        sums = [F.coalesce(F.sum(F.when(F.col("of") == k, F.col("score"))), F.lit(0)).cast("double").alias(f"w{k}") for k in range(len(KINDS))]
        held = [F.count(F.when(F.col("kind") == k, 1)).alias(f"s{k}") for k in range(len(KINDS))]
        p = e.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), *sums, *held)
        kind, top = _best([F.col(f"w{k}") for k in range(len(KINDS))])
        p = p.withColumn("kind", kind).withColumn("confidence", top / (F.col("instances") + 1))
        p = p.withColumn("seeds", F.element_at(F.array(*[f"s{k}" for k in range(len(KINDS))]), F.col("kind") + 1))
        found = materialize(p.filter((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern", "kind", "confidence", "seeds", "instances"))
        around = edges.filter("kind is null").drop("kind").join(broadcast_if_small(found), "pattern").filter(F.col("mail") == (F.col("kind") == 0))
        misses = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.log1p(-F.col("confidence")))), F.lit(0.0)).alias(f"w{k}") for k in range(len(KINDS))]
        kind, top = _best([-F.col(f"w{k}") for k in range(len(KINDS))])
        by_instance = around.groupBy("instance").agg(*misses).select("instance", kind.alias("candidate"), (1 - F.exp(-top)).cast("decimal(10, 9)").alias("part"))
        scores = materialize(by_instance)
    return found


def extract(seen: DataFrame, sure: DataFrame) -> DataFrame:
    """uid, found (spans of candidates that stand in a sure pattern)."""
    c = seen.select("uid", F.explode("seen").alias("s")).select("uid", "s.*").filter("kind is null").drop("kind")
    c = c.select("uid", "start", "end", "mail", F.explode("patterns").alias("pattern"))
    hit = c.join(broadcast_if_small(sure), "pattern").filter(F.col("mail") == (F.col("kind") == 0))
    best = hit.groupBy("uid", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    span = F.struct((-F.col("b.k")).alias("kind"), "start", "end")
    return best.groupBy("uid").agg(F.collect_list(span).alias("found"))


def personal_data(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, base, found; arrays of kind, start, end, in order) of every row, and the patterns they come from."""
    seen = occurrences(docs)
    sure = score_patterns(graph(seen))
    found = F.array_sort(F.coalesce("found", F.expr(f"cast(array() as {SPANS})")))
    spans = seen.select("uid", "doc_id", "base").join(extract(seen, sure), "uid", "left")
    return spans.select("doc_id", "base", found.alias("found")), sure
