"""Periodic runs of words: difference-cover extensions on a harmonic grid.

A run is a stretch of words whose smallest period is q, that is at least
max(LEAST, REPEATS * q) long and that no neighbour extends.  Where word i equals
word i + q all over an interval of at least (REPEATS - 1) * q places, one of the
places 0, 3q, 6q, … lies in it; so every period q looks at that grid only, which
makes n log n pairs (i, i + q) in all.  From each pair that agrees the interval
is followed both ways with longest common extensions:

* of every 13 places of a document those of the difference cover {0, 1, 3, 9}
  are sampled; any two places are fewer than 13 words before two samples;
* these few words are compared one by one, and most pairs end there;
* the rest meet at samples.  Only the sampled suffixes of the documents
  concerned are sorted (by doubling of 13-word blocks), the common prefixes of
  neighbours in that order go into a sparse table, and a range minimum gives the
  extension.  The same over reversed documents extends to the left.

A stretch found with several periods is kept with the smallest, which is its
smallest period (multiples give the same stretch).

Documents are worked on in chunks of about CHUNK words, in the task that holds
them; a single longer one is a chunk of its own.  Nothing is shuffled.

Defined results: null, empty and wordless texts have no run and an empty
collapsed text; repeated rows are answered each; empty tables give empty tables;
null doc_ids stay; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flightwords.llm.common import pick

LEAST, REPEATS = 6, 4
#: A perfect difference set: every non-zero remainder of MODULUS is a difference of two entries.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words and pairs handled at a time.
CHUNK = 1 << 17
PAIRS = 1 << 21


def _shifts() -> np.ndarray:
    """[i % MODULUS, j % MODULUS] -> fewest words to go until both places are sampled."""
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for i in range(MODULUS):
        for j in range(MODULUS):
            out[i, j] = next(k for k in range(MODULUS) if (i + k) % MODULUS in COVER and (j + k) % MODULUS in COVER)
    return out


SHIFTS = _shifts()


def _starts(sizes: np.ndarray) -> np.ndarray:
    """First place of each document; all are multiples of MODULUS, with room for an end mark."""
    room = (sizes // MODULUS + 1) * MODULUS
    return np.cumsum(room) - room


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[d] + 0 … sizes[d] - 1 of all d, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Extensions:
    """Longest common extensions to the right within documents laid out by ``_starts``.

    ``words`` are numbers from 1, document after document.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.sizes, self.starts = sizes, _starts(sizes)
        total = int(self.starts[-1] + (sizes[-1] // MODULUS + 1) * MODULUS) if len(sizes) else 0
        self.ids = np.zeros(total + MODULUS, np.int64)
        self.ids[_spread(self.starts, sizes)] = words
        # every document ends with a mark of its own
        self.ids[self.starts + sizes] = (int(words.max()) if len(words) else 0) + 1 + np.arange(len(sizes))

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words before the next common samples, and whether all of them are."""
        limit = SHIFTS[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(limit > 0)
        for t in range(MODULUS):
            live = live[self.ids[i[live] + t] == self.ids[j[live] + t]]
            out[live] = t + 1
            live = live[limit[live] > t + 1]
            if not len(live):
                break
        return out, out == limit

    def lengths(self, doc: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extensions from places i and j of documents doc."""
        i, j = i + self.starts[doc], j + self.starts[doc]
        out, met = self.near(i, j)
        met = np.flatnonzero(met)
        if len(met):
            held = np.unique(doc[met])
            sorted_ = SampledSuffixes(self, held)
            move = sorted_.moved(doc[met])
            out[met] += sorted_.lengths(i[met] + out[met] + move, j[met] + out[met] + move)
        return out


class SampledSuffixes:
    """The sorted cover samples of some documents, with a sparse table over common prefixes."""

    def __init__(self, source: Extensions, held: np.ndarray):
        sizes = source.sizes[held]
        self.held, self.old, self.new = held, source.starts[held], _starts(sizes)
        total = int(self.new[-1] + (sizes[-1] // MODULUS + 1) * MODULUS)
        ids = np.zeros(total + MODULUS, np.int64)
        ids[_spread(self.new, sizes + 1)] = source.ids[_spread(self.old, sizes + 1)]
        self.ids = np.unique(ids, return_inverse=True)[1]
        places = _spread(self.new, sizes + 1)
        places = places[np.isin(places % MODULUS, COVER)]
        ends = np.repeat(self.new + sizes, np.diff(np.append(np.searchsorted(places, self.new), len(places))))
        self.slot = np.full(total + MODULUS, -1, np.int64)
        self.slot[places] = np.arange(len(places))
        self._sort(places, ends)

    def moved(self, doc: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.held, doc)
        return self.new[at] - self.old[at]

    def _blocks(self, places: np.ndarray) -> np.ndarray:
        """Ranks from 1 of the MODULUS words that begin at places."""
        width = 63 // max(1, int(self.ids.max()).bit_length())
        bits = 63 // width
        keys = []
        for first in range(0, MODULUS, width):
            key = np.zeros(len(places), np.int64)
            for t in range(first, min(first + width, MODULUS)):
                key = (key << bits) | self.ids[places + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(places), bool)
        for key in keys:
            new[1:] |= np.diff(key[order]) != 0
        ranks = np.empty(len(places), np.int64)
        ranks[order] = np.cumsum(new) + 1
        return ranks

    def _sort(self, places: np.ndarray, ends: np.ndarray) -> None:
        m, step = len(places), MODULUS
        ranks = self._blocks(places)
        levels = [(step, ranks)]
        while ranks.max() < m:
            behind = np.where(places + step <= ends, self.slot[np.minimum(places + step, len(self.slot) - 1)], -1)
            key = ranks * (m + 1) + np.where(behind >= 0, ranks[behind], 0)
            order = np.argsort(key, kind="stable")
            ranks = np.empty(m, np.int64)
            ranks[order] = np.append(1, np.cumsum(np.diff(key[order]) != 0) + 1)
            step *= 2
            levels.append((step, ranks))
        self.rank = ranks - 1
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        # prefixes of neighbours: the widest blocks that agree, then single words
        a, b = places[order[:-1]], places[order[1:]]
        common = np.zeros(m - 1, np.int64)
        for step, ranks in reversed(levels[:-1]):
            sa, sb = (self.slot[np.minimum(x + common, len(self.slot) - 1)] for x in (a, b))
            common += np.where((sa >= 0) & (sb >= 0) & (ranks[sa] == ranks[sb]), step, 0)
        live = np.arange(m - 1)
        for _ in range(MODULUS):
            live = live[self.ids[a[live] + common[live]] == self.ids[b[live] + common[live]]]
            if not len(live):
                break
            common[live] += 1
        self.table = [common]
        while 2 << (len(self.table) - 1) <= m - 1:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def lengths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of the samples at different places i and j."""
        a, b = self.rank[self.slot[i]], self.rank[self.slot[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        depth = np.log2(high - low).astype(np.int64)  # exact for fewer than 2^48 samples
        out = np.empty(len(i), np.int64)
        for k in np.unique(depth):
            on = depth == k
            out[on] = np.minimum(self.table[k][low[on]], self.table[k][high[on] - (1 << k)])
        return out


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of the grid, some PAIRS at a time."""
    most = np.where(sizes >= LEAST, sizes // REPEATS, 0)
    doc = np.repeat(np.arange(len(sizes)), most)
    period = _spread(np.ones_like(most), most)
    count = -(-(sizes[doc] - period) // (3 * period))
    edges = np.cumsum(count)
    first = 0
    while first < len(doc):
        base = edges[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(edges, base + PAIRS, "right")))
        c = count[first:last]
        yield np.repeat(doc[first:last], c), _spread(np.zeros_like(c), c) * 3 * np.repeat(period[first:last], c), np.repeat(period[first:last], c)
        first = last


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, start, length, period of all runs, by document, start and period.

    ``words`` are numbers from 1, document after document of ``sizes`` words.
    """
    right = Extensions(words, sizes)
    left = Extensions(words[::-1], sizes[::-1])
    last = len(sizes) - 1
    doc, at, period = [], [], []
    for d, i, p in _grid(sizes):
        place = right.starts[d] + i
        on = np.flatnonzero(right.ids[place] == right.ids[place + p])
        doc.append(d[on]), at.append(i[on]), period.append(p[on])
    doc, at, period = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, at, period))
    ahead = right.lengths(doc, at, at + period)
    # to the left of i are, reversed, the words from sizes - i on
    back = left.lengths(last - doc, sizes[doc] - at, sizes[doc] - at - period)
    start, length = at - back, ahead + back + period
    on = length >= np.maximum(LEAST, REPEATS * period)
    found = np.unique(np.stack([doc[on], start[on], length[on], period[on]], 1), axis=0)
    if len(found):  # the smallest period of equal stretches comes first
        found = found[np.append(True, (np.diff(found[:, :3], axis=0) != 0).any(1))]
        found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2], found[:, 3]


def _chunks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text in texts:
        words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        if held and n + len(words) > CHUNK:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


RUNS = "array<struct<start: long, length: long, period: long>>"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _answer(doc_ids: pa.Array, held: list[list[bytes]]) -> pa.RecordBatch:
    sizes = np.array([len(w) for w in held], np.int64)
    flat = [w for words in held for w in words]
    numbers = {w: k for k, w in enumerate(dict.fromkeys(flat), 1)}
    ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    doc, start, length, period = find_runs(ids, sizes)
    # words behind the first period of a run go
    begin, deep = np.cumsum(sizes) - sizes, np.zeros(len(flat) + 1, np.int64)
    np.add.at(deep, begin[doc] + start + period, 1)
    np.add.at(deep, begin[doc] + start + length, -1)
    dropped = np.cumsum(deep[:-1]) > 0
    texts, hit = [], set(doc.tolist())
    for d, words in enumerate(held):
        if d in hit:
            gone = dropped[begin[d] : begin[d] + sizes[d]]
            words = [w for w, g in zip(words, gone.tolist()) if not g]
        texts.append(b" ".join(words))
    offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=len(held)))).astype(np.int32)
    fields = [pa.array(x, pa.int64()) for x in (start, length, period)]
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    columns = [doc_ids, pa.array(sizes), runs, pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, words, runs (by start, then period), collapsed (the text without repeated periods, words joined by a space)."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for held in _chunks(batch.column("text")):
                yield _answer(batch.column("doc_id").slice(at, len(held)), held)
                at += len(held)

    d = pick(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(answered, f"doc_id {kind}, words long, runs {RUNS}, collapsed string")
