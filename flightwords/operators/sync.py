"""Subframe synchronisation of word streams.

Input: word blocks (recording_id, start, words), e.g. from ``capture.words_of``.
Only possible sync words are looked at; runs of them at the right distance form
chains, and only overlapping chains need a left-to-right decision.

Places compress to small files, by which a join of millions of them with themselves
would be broadcast; such joins are told to sort and merge.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import INVALID, RECEIVED, STANDARD_WPS, SYNC_WORDS
from ..session import materialize
from . import blocks

KEY = ["recording_id"]
WORD_BLOCK = 8192
POS_BLOCK = 1 << 22
#: Sync words of one rate follow each other within it.
PAIR_SECONDS = 2.0


def sync_candidates(words: DataFrame, sync_words: Iterable[int] = SYNC_WORDS) -> DataFrame:
    """Positions that hold a sync word, with its subframe number; from ``hits``, where only these were kept, and
    then with the time ``t`` of its chunk."""
    sync = list(sync_words)
    number = F.create_map(*[x for i, s in enumerate(sync, 1) for x in (F.lit(s), F.lit(i))])
    if "hits" in words.columns:
        found = words.select("recording_id", "t", F.inline("hits"))
    else:
        found = words.select("recording_id", "start", F.posexplode("words").alias("_i", "w")).withColumn("pos", F.col("start") + F.col("_i"))
    rest = ["t"] if "hits" in words.columns else []
    return materialize(found.filter(F.col("w").isin(*sync)).select("recording_id", "pos", F.try_element_at(number, F.col("w")).alias("idx"), *rest))


def _pairs(cand: DataFrame, distance: int) -> DataFrame:
    """Candidates followed by the next sync word ``distance`` words later."""
    nxt = cand.select("recording_id", (F.col("pos") - distance).alias("pos"), (F.col("idx") - 1).alias("_p"))
    return cand.withColumn("_p", F.col("idx") % 4).join(nxt.hint("merge"), ["recording_id", "pos", "_p"], "left_semi").drop("_p")


def chains(cand: DataFrame, wps: int) -> DataFrame:
    """Maximal runs of at least two sync words at distance ``wps``:
    (recording_id, first, idx, last).

    Links are found by joining on the exact position; first and last members
    of a residue class alternate, so pairing each first with the next last
    gives the run.
    """
    linked = materialize(_pairs(cand, wps).select("recording_id", "pos", "idx"))
    behind = linked.select("recording_id", (F.col("pos") + wps).alias("pos"), (F.col("idx") % 4 + 1).alias("idx"))
    firsts = linked.join(behind.hint("merge"), ["recording_id", "pos", "idx"], "left_anti").withColumn("at", F.col("pos")).withColumn("is_first", F.lit(True))
    lasts = behind.join(linked.hint("merge"), ["recording_id", "pos", "idx"], "left_anti").withColumn("at", F.col("pos")).withColumn("is_first", F.lit(False))
    both = materialize(firsts.unionByName(lasts).withColumn("res", F.col("pos") % wps).withColumn(
        "phase", F.pmod(F.col("idx") - F.floor(F.col("pos") / wps), F.lit(4))
    ))
    keys = ["recording_id", "res", "phase"]
    paired = blocks.carry_last(
        both, keys, blocks.block_of(F.col("at"), POS_BLOCK), [F.col("at")],
        F.when(F.col("is_first"), F.struct(F.col("pos").alias("first"), F.col("idx").alias("idx"))), "head", inclusive=False,
    )
    return paired.filter("NOT is_first").select(
        "recording_id", F.col("head.first").alias("first"), F.col("head.idx").alias("idx"), F.col("pos").alias("last")
    )


def _decide(wps: int):
    """Left-to-right lock decisions inside groups of overlapping chains, a group a row."""
    def held(chains: list, n: int) -> list:
        """A chain waits at its first place at or behind the cursor; the earliest of all is taken."""
        waiting, cursor, out = [(c["first"], i) for i, c in enumerate(chains)], 0, []
        heapq.heapify(waiting)
        while waiting:
            at, i = heapq.heappop(waiting)
            first, idx, last = chains[i]["first"], chains[i]["idx"], chains[i]["last"]
            if at < cursor:
                at = first - (first - cursor) // wps * wps
                if at < last:
                    heapq.heappush(waiting, (at, i))
            elif at < last:
                out.append((at, (idx - 1 + (at - first) // wps) % 4 + 1, last))
                cursor = last + wps + 1
                if last + 2 * wps > n:
                    break
        return out

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec, chains, n in zip(*(batch.column(c) for c in ("recording_id", "chains", "n_words"))):
                rec, n = rec.as_py(), n.as_py()
                out += [(rec, *lock, n) for lock in held(chains.as_py(), n)]
            columns = zip(*out) if out else [()] * 5
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["recording_id", "first", "idx", "last", "n_words"])

    return fold


def locks(words: DataFrame, cand: DataFrame, wps: int) -> DataFrame:
    """Locked stretches: (recording_id, first, idx, last, n_words), ``last`` being
    the last position whose sync word was right."""
    size = F.col("n_words") if "n_words" in words.columns else F.size("words")
    total = words.groupBy("recording_id").agg(F.max(F.col("start") + size).alias("n_words"))
    c = materialize(chains(cand, wps).join(total, "recording_id"))
    reach = F.col("last") + wps + 1
    grouped = blocks.interval_clusters(c, KEY, "first", reach, "_group", POS_BLOCK)
    chain = F.struct("first", F.col("idx").cast("int").alias("idx"), "last")
    grouped = materialize(grouped.groupBy("recording_id", "_group").agg(F.collect_list(chain).alias("chains"), F.max("n_words").alias("n_words")))
    one = F.size("chains") == 1
    single = grouped.filter(one).select("recording_id", F.inline("chains"), "n_words")
    contested = grouped.filter(~one).select("recording_id", "chains", "n_words").mapInArrow(
        _decide(wps), "recording_id string, first bigint, idx int, last bigint, n_words bigint"
    )
    return materialize(single.unionByName(contested))


def subframe_starts(locked: DataFrame, wps: int) -> DataFrame:
    """One row per delivered subframe: position, number, validity (STR-01, STR-02).

    The slice after a lost sync is delivered as INVALID when it is complete; a
    trailing partial subframe is not delivered.
    """
    q = F.col("last") + wps
    stop = F.least(q, F.col("n_words") - wps)
    members = F.when(stop >= F.col("first"), F.sequence(F.col("first"), stop, F.lit(wps).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    rows = locked.select("recording_id", "first", "idx", "last", F.explode(members).alias("pos"))
    return rows.select(
        "recording_id", "pos",
        ((F.col("idx") - 1 + (F.col("pos") - F.col("first")) / wps) % 4 + 1).cast("int").alias("subframe"),
        (F.col("pos") <= F.col("last")).alias("valid"),
    )


def aligned_blocks(words: DataFrame, size: int = WORD_BLOCK, more: int = 0) -> DataFrame:
    """Word blocks re-cut to aligned blocks of ``size`` words, each followed by the next ``more`` words."""
    d = words.select("recording_id", F.col("start").cast("bigint").alias("start"), "words").filter(F.size("words") > 0)
    end = F.col("start") + F.size("words") - 1
    first = F.greatest(F.floor((F.col("start") - more) / size), F.lit(0))
    pieces = d.withColumn("block", F.explode(F.sequence(first, F.floor(end / size))))
    lo = F.greatest(F.col("start"), F.col("block") * size)
    hi = F.least(F.col("start") + F.size("words"), (F.col("block") + 1) * size + more)
    cut = F.slice("words", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    whole = F.when(hi - lo == F.size("words"), F.col("words")).otherwise(cut)
    pieces = pieces.filter(hi > lo).select("recording_id", "block", F.struct(lo.alias("lo"), whole.alias("w")).alias("p"))
    return pieces.groupBy("recording_id", "block").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["w"])).alias("block_words")
    )


def with_words(starts: DataFrame, words: DataFrame, wps: int, size: int = WORD_BLOCK) -> DataFrame:
    """Attaches the ``wps`` words of every subframe.

    A block meets all subframes that begin in it as one row and holds their last
    words too, so no subframe carries a block and none is put together afterwards.
    """
    rest = [c for c in starts.columns if c != "recording_id"]
    asked = starts.groupBy("recording_id", F.floor(F.col("pos") / size).alias("block")).agg(
        F.collect_list(F.struct(*rest)).alias("_asked"))
    joined = aligned_blocks(words, size, wps - 1).join(asked.hint("merge"), ["recording_id", "block"])
    cut = F.transform("_asked", lambda s: F.struct(
        *[s[c].alias(c) for c in rest], F.slice("block_words", (s["pos"] - F.col("block") * size + 1).cast("int"), wps).alias("words")))
    return joined.select("recording_id", F.inline(cut))


def synchronize(words: DataFrame, wps: int, sync_words: Iterable[int] = SYNC_WORDS) -> DataFrame:
    """Word stream → subframes (recording_id, pos, subframe, valid, words)."""
    cand = sync_candidates(words, sync_words)
    return with_words(subframe_starts(locks(words, cand, wps), wps), words, wps)


def wrong_rate(cand: DataFrame, locked: DataFrame, wps: int) -> DataFrame:
    """Other standard rate at which sync words pair up while unlocked (STR-03).

    One row per unlocked stretch: the first rate in list order with a pair.  Where
    candidates have a time ``t``, a pair is less than ``PAIR_SECONDS`` apart: words of a
    rate come once a second, while lost subframes bring true sync words to another
    distance over four seconds or more.
    """
    order, heard = F.col("pos"), "t" in cand.columns
    t = F.lit(None).cast("double")
    starts = locked.select("recording_id", F.col("first").alias("pos"), F.lit(None).cast("int").alias("idx"), t.alias("t"),
                           F.struct("first", (F.col("last") + wps).alias("lost")).alias("lock"))
    rows = cand.select("recording_id", "pos", "idx", "t" if heard else t.alias("t")).withColumn(
        "lock", F.lit(None).cast("struct<first:bigint,lost:bigint>")).unionByName(starts)
    placed = blocks.carry_last(rows, KEY, blocks.block_of(order, POS_BLOCK), [order, F.col("idx").isNotNull()],
                               F.col("lock"), "held")
    open_ = materialize(placed.filter("idx IS NOT NULL").filter(F.coalesce(order >= F.col("held.lost"), F.lit(True))).select(
        "recording_id", "pos", "idx", "t", F.coalesce("held.lost", F.lit(0).cast("bigint")).alias("since")
    ))
    nxt = open_.select("recording_id", "since", F.col("pos").alias("pos2"), F.col("idx").alias("idx2"), F.col("t").alias("t2"))
    keys = ["recording_id", "since", "pos2", "idx2"]
    found = None
    for rank, rate in enumerate(STANDARD_WPS):
        if rate == wps:
            continue
        one = open_.withColumn("pos2", F.col("pos") + rate).withColumn("idx2", F.col("idx") % 4 + 1).alias("one")
        meet = functools.reduce(Column.__and__, [F.col(f"one.{k}") == F.col(f"two.{k}") for k in keys])
        if heard:
            meet = meet & (F.col("two.t2") - F.col("one.t") < PAIR_SECONDS)
        hit = one.join(nxt.alias("two").hint("merge"), meet, "left_semi").select(
            "recording_id", "since", F.struct(F.lit(rank).alias("r"), F.lit(rate).alias("wps")).alias("d"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("recording_id", "since").agg(F.min("d").alias("d")).select(
        "recording_id", "since", F.col("d.wps").alias("detected_wps")
    )


def standing_rates(rates: DataFrame, locked: DataFrame, wps: int) -> DataFrame:
    """``rates`` of the stretch in which a recording ends.

    A lock takes back what the search before it told: the rate was right, and a gap
    brought sync words to another distance.
    """
    ends = locked.groupBy("recording_id").agg((F.max("last") + wps).alias("_end"))
    return rates.join(ends, "recording_id", "left").filter("_end IS NULL OR since >= _end").drop("_end")


def lock_events(locked: DataFrame, wps: int) -> DataFrame:
    """(recording_id, pos, kind, message) where locks begin and are lost (STR-12); a
    loss is told with the whole slice that shows it."""
    begun = locked.select("recording_id", F.col("first").alias("pos"), F.lit("SYNC_LOCKED").alias("kind"), F.concat(F.lit("locked at SF"), F.col("idx")).alias("message"))
    lost = locked.filter(F.col("last") + 2 * wps <= F.col("n_words")).select(
        "recording_id", (F.col("last") + wps).alias("pos"), F.lit("SYNC_LOST").alias("kind"), F.lit("sync word mismatch").alias("message"))
    return begun.unionByName(lost)


def heard_at(rows: DataFrame, words: DataFrame, wps: int) -> DataFrame:
    """``rows`` (recording_id, pos, …) with ``t`` of the chunk that completes the subframe at ``pos``.

    An as-of join by word position: chunk beginnings and asked places are one
    sequence, in which every place takes the last beginning before it.
    """
    rest = [c for c in rows.columns if c not in ("recording_id", "pos")]
    chunks = words.filter(F.col("n_words") > 0).select(
        "recording_id", F.col("start").cast("bigint").alias("_at"), F.lit(None).cast(rows.select(F.struct("pos", *rest).alias("r")).schema["r"].dataType).alias("_r"), F.col("t").alias("_t"))
    asked = rows.select("recording_id", (F.col("pos") + wps - 1).cast("bigint").alias("_at"), F.struct("pos", *rest).alias("_r"), F.lit(None).cast("double").alias("_t"))
    both = chunks.unionByName(asked)
    placed = blocks.carry_last(both, KEY, blocks.block_of(F.col("_at"), POS_BLOCK), [F.col("_at"), F.col("_r").isNotNull()], F.col("_t"), "t")
    return placed.filter("_r IS NOT NULL").select("recording_id", "_r.*", "t")


def state_of(valid: Column) -> Column:
    return F.when(valid, RECEIVED).otherwise(INVALID)
