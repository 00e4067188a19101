"""Sample analytics: counts, windows, bounded history, latest values, rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MISSING, STATUSES
from ..session import broadcast_if_small, materialize
from . import blocks
from .decode import numeric_value

MAX_SAMPLES = 10_000
MAX_SECONDS = 600.0
# The selectable trailing windows in seconds.
WINDOWS = (10, 30, 60, 300, 600)
RATE_WINDOW = 2.0
RATE_MIN_SPAN = 0.25
LAST_EVENTS = 200

SERIES = ("recording_id", "param_id")


def series(samples: DataFrame) -> DataFrame:
    """The points a time series stores: samples with a finite number, in append order."""
    # a filter would move down into the join with the mapping and decode each sample several times
    found = F.filter(F.array(F.coalesce("eng_value", "decoded")), lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (
        samples.withColumn("value", F.explode(found))
        .select(*SERIES, "param_name", "unit", "seq", "occ", "t", "value")
    )


def _append_order() -> list[Column]:
    return [F.col("seq"), F.col("occ")]


def position() -> Column:
    """A point's place in append order as one number, which hash aggregates can hold:
    subframes below 2 ** 43 a recording, occurrences below 2 ** 20 a subframe."""
    return F.shiftleft(F.col("seq"), 20) + F.col("occ")


def _block(size: int) -> Column:
    return blocks.block_of(F.col("seq"), size)


# -- filters (FLT) ---------------------------------------------------------

def search(samples: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of mnemonic and description (FLT-01)."""
    hay = F.lower(F.concat_ws(" ", "param_name", "description"))
    return samples.filter(hay.contains(text.strip().lower()))


def select_samples(
    samples: DataFrame, ptype: str | None = None, status: str | None = None, subframe: int | None = None
) -> DataFrame:
    """Conjunctive type / status / subframe filter; None means all (FLT-02)."""
    for name, wanted in (("ptype", ptype), ("status", status), ("subframe", subframe)):
        if wanted is not None:
            samples = samples.filter(F.col(name) == wanted)
    return samples


def for_parameter(samples: DataFrame, param_id: str) -> DataFrame:
    return samples.filter(F.col("param_id") == param_id)


def touching_word(samples: DataFrame, subframe: int, word: int) -> DataFrame:
    """Samples with a traced segment in the cell (FLT-04)."""
    return samples.filter(F.exists("trace", lambda s: (s["subframe"] == subframe) & (s["word"] == word)))


def numeric_parameters(parameters: DataFrame, points: DataFrame) -> DataFrame:
    """Parameters that can be plotted: mapped ones of a known type, then any other
    series that holds numbers (FLT-05)."""
    mapped = parameters.filter("ptype <> 'unknown'").select("param_id", F.col("mnemonic").alias("name"), "unit")
    extra = (
        points.groupBy("param_id").agg(F.min("param_name").alias("name"), F.min("unit").alias("unit"))
        .join(mapped.select("param_id"), "param_id", "left_anti")
    )
    return mapped.unionByName(extra)


# -- counts and statistics -------------------------------------------------

def status_counts(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def status_matrix(samples: DataFrame, *keys: str) -> DataFrame:
    """One column per status, zero-filled."""
    return samples.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    )


def window_start(points: DataFrame, seconds: float, now: float | None = None) -> DataFrame:
    """First stored point of each series inside the trailing window, as ``_start``.

    Two hash aggregations with map-side combine; no series is ever sorted.
    """
    end = points.groupBy(*SERIES).agg(F.max_by("t", position()).alias("_end"))
    cut = end.select(*SERIES, ((F.lit(now) if now is not None else F.col("_end")) - seconds).alias("_cut"))
    return (
        points.join(cut, list(SERIES)).filter(F.col("t") >= F.col("_cut"))
        .groupBy(*SERIES).agg(F.min(position()).alias("_start"))
    )


def trailing_window(points: DataFrame, seconds: float | None, now: float | None = None) -> DataFrame:
    """Everything from the first point not older than ``seconds`` on (WIN-03)."""
    if seconds is None:
        return points
    start = window_start(points, seconds, now)
    return points.join(start, list(SERIES)).filter(position() >= F.col("_start")).drop("_start")


def recent_points(subframes: DataFrame, points_of: Callable[[DataFrame], DataFrame], seconds: float) -> DataFrame:
    """``trailing_window`` of the points that ``points_of`` decodes from subframes, without storing them.

    One pass finds where series end (a row per series is kept).  A point lies in
    the second before its subframe's end, so the windows then need only the
    subframes from the earliest cut of their recording on, which are decoded
    again; the rest is never looked at.
    """
    keys = list(SERIES)
    ends = points_of(subframes).groupBy(*keys).agg(F.max_by("t", position()).alias("_end"))
    cut = materialize(ends.select(*keys, (F.col("_end") - seconds).alias("_cut")))
    low = cut.groupBy("recording_id").agg(F.min("_cut").alias("_low"))
    near = subframes.join(broadcast_if_small(low), "recording_id").filter(F.col("t_end") >= F.col("_low")).drop("_low")
    first = points_of(near).join(broadcast_if_small(cut), keys).filter(F.col("t") >= F.col("_cut"))
    start = materialize(first.groupBy(*keys).agg(F.min(position()).alias("_start")))
    begin = start.groupBy("recording_id").agg(F.shiftright(F.min("_start"), 20).alias("_begin"))
    late = subframes.join(broadcast_if_small(begin), "recording_id").filter(F.col("seq") >= F.col("_begin")).drop("_begin")
    return points_of(late).join(broadcast_if_small(start), keys).filter(position() >= F.col("_start")).drop("_start")


def recent_stats(subframes: DataFrame, points_of: Callable[[DataFrame], DataFrame], seconds: float) -> DataFrame:
    """``series_stats`` of the trailing window, without storing points.

    One pass finds where series end.  The second needs only the subframes from the
    earliest cut of their recording on (see ``recent_points``): it sums up the points
    not older than the cut and notes whether an older one was appended after the
    first of them.  Subframes before that cut are asked for such points only if they
    come late.  Only series where that happened, whose window holds such older
    points too, are decoded once more.
    """
    keys, value, at = list(SERIES), F.col("value"), position()
    ends = points_of(subframes).groupBy(*keys).agg(F.max_by("t", at).alias("_end"))
    cut = materialize(ends.select(*keys, (F.col("_end") - seconds).alias("_cut")))
    low = broadcast_if_small(cut.groupBy("recording_id").agg(F.min("_cut").alias("_low")))
    placed = subframes.join(low, "recording_id")
    placed = placed if "t_end" in subframes.columns else placed.withColumn("t_end", F.col("_low"))  # all of them, if their end isn't known
    inside = F.col("t") >= F.col("_cut")
    own = F.when(inside, value)
    found = points_of(placed.filter(F.col("t_end") >= F.col("_low")).drop("_low")).join(broadcast_if_small(cut), keys).groupBy(*keys).agg(
        F.count(own).alias("n"), F.max_by("value", F.when(inside, at)).alias("current"), F.min(own).alias("minimum"), F.max(own).alias("maximum"),
        F.avg(own).alias("average"), F.min(F.when(inside, at)).alias("_start"), F.max(F.when(~inside, at)).alias("_old"),
    )
    found = materialize(found)
    begin = broadcast_if_small(found.groupBy("recording_id").agg(F.shiftright(F.min("_start"), 20).alias("_begin")))
    late = placed.join(begin, "recording_id").filter((F.col("t_end") < F.col("_low")) & (F.col("seq") >= F.col("_begin"))).drop("_low", "_begin")
    if not late.isEmpty():
        starts = broadcast_if_small(found.select(*keys, "_start"))
        behind = points_of(late).join(starts, keys).filter(at >= F.col("_start")).groupBy(*keys).agg(F.max(at).alias("_late"))
        found = found.join(materialize(behind), keys, "left").withColumn("_old", F.greatest("_old", "_late")).drop("_late")
    mixed = F.coalesce(F.col("_old") > F.col("_start"), F.lit(False))
    clean = found.filter(~mixed).drop("_start", "_old")
    odd = found.filter(mixed).select(*keys, "_start")
    if odd.isEmpty():
        return clean
    return clean.unionByName(series_stats(points_of(subframes).join(broadcast_if_small(odd), keys).filter(at >= F.col("_start"))))


def latest_subframes(subframes: DataFrame) -> DataFrame:
    """The subframe rows that can hold a latest sample: of each recording, document,
    subframe number and length the last one (WIN-04).  Only numbers are aggregated."""
    keys = ["recording_id", "document_id", "subframe", "_n"]
    d = subframes.withColumn("_n", F.size("words"))
    last = d.groupBy(*keys).agg(F.max("seq").alias("seq"))
    return d.join(last, [*keys, "seq"], "left_semi").drop("_n")


def series_stats(points: DataFrame, seconds: float | None = None, now: float | None = None) -> DataFrame:
    """count / current / min / max / mean of the window (AGG-02)."""
    return trailing_window(points, seconds, now).groupBy(*SERIES).agg(
        F.count("*").alias("n"),
        F.max_by("value", position()).alias("current"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.avg("value").alias("average"),
    )


def ring(points: DataFrame, n: int = MAX_SAMPLES, block: int = blocks.BLOCK) -> DataFrame:
    """Last ``n`` points of each series in append order (WIN-01)."""
    return blocks.last_n(points, SERIES, _block(block), _append_order(), n)


def duration_bound(points: DataFrame, seconds: float = MAX_SECONDS) -> DataFrame:
    """Drops the leading points older than the newest minus ``seconds`` (WIN-02)."""
    newest = points.groupBy(*SERIES).agg((F.max("t") - seconds).alias("_cut"))
    start = (
        points.join(newest, list(SERIES)).filter(F.col("t") >= F.col("_cut"))
        .groupBy(*SERIES).agg(F.min(position()).alias("_start"))
    )
    return points.join(start, list(SERIES)).filter(position() >= F.col("_start")).drop("_start")


def history(points: DataFrame, n: int = MAX_SAMPLES, seconds: float = MAX_SECONDS) -> DataFrame:
    """Both bounds of a stored series (STR-09, batch form)."""
    return ring(duration_bound(points, seconds), n)


def latest(samples: DataFrame) -> DataFrame:
    """Latest sample per (parameter, occurrence, subframe) (WIN-04, STR-07)."""
    keys = ["recording_id", "param_id", "occ", "subframe"]
    rest = [c for c in samples.columns if c not in keys and c != "trace"]
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("l")).select(*keys, "l.*")


def canonical_order(samples: DataFrame) -> DataFrame:
    """Parameter position, occurrence, subframe (SRT-01)."""
    return samples.orderBy("recording_id", "param_ord", "occ", F.coalesce("subframe", F.lit(0)))


def sample_keys_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sample keys removed and added between two sample sets (SET-04)."""
    keys = ["param_id", "occ", "subframe"]
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return a.exceptAll(b).withColumn("change", F.lit("removed")).unionByName(
        b.exceptAll(a).withColumn("change", F.lit("added"))
    )


def overlay(points: DataFrame, param_id: str) -> DataFrame:
    """Series sharing the unit of ``param_id`` with the common end time (WIN-09)."""
    ends = points.groupBy(*SERIES).agg(
        F.min("unit").alias("unit"), F.max_by("t", position()).alias("end_t")
    )
    chosen = ends.filter(F.col("param_id") == param_id).select("recording_id", F.col("unit").alias("_unit"))
    same = ends.join(chosen, "recording_id").filter(F.col("unit").eqNullSafe(F.col("_unit"))).drop("_unit")
    common = same.groupBy("recording_id").agg(F.max("end_t").alias("common_end"))
    return same.join(common, "recording_id")


# -- stream-shaped analytics over subframe rows ----------------------------

def carry_forward(subframes: DataFrame, block: int = 16_384) -> DataFrame:
    """For every frame and slot, the frame whose words the slot shows (WIN-06).

    Only frame numbers travel; ``with_words`` attaches the words afterwards.
    """
    frames = subframes.select("recording_id", "frame_index").distinct()
    grid = frames.withColumn("subframe", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    got = subframes.filter(F.col("state") != MISSING).select(
        "recording_id", "frame_index", "subframe", F.col("frame_index").alias("_got")
    )
    slots = grid.join(got, ["recording_id", "frame_index", "subframe"], "left")
    return blocks.carry_last(
        slots, ["recording_id", "subframe"], blocks.block_of(F.col("frame_index"), block),
        [F.col("frame_index")], F.col("_got"), "source_frame",
    ).drop("_got")


def with_words(slots: DataFrame, subframes: DataFrame) -> DataFrame:
    """Words of the carried frame; NULL where nothing was ever received."""
    words = subframes.select("recording_id", F.col("frame_index").alias("source_frame"), "subframe", "words")
    return slots.join(words, ["recording_id", "source_frame", "subframe"], "left")


def word_rate(arrivals: DataFrame, block_seconds: float = 3600.0) -> DataFrame:
    """Words per second over the trailing 2 s at each arrival (STR-08)."""
    spread = blocks.neighbours(arrivals, ["recording_id"], F.col("t"), F.lit(RATE_WINDOW), block_seconds)
    micros = F.round(F.col("t") * 1_000_000).cast("bigint")
    w = Window.partitionBy("recording_id", "_block").orderBy(micros).rangeBetween(int(-RATE_WINDOW * 1_000_000), 0)
    span = F.greatest(F.col("t") - F.min("t").over(w), F.lit(RATE_MIN_SPAN))
    return (
        spread.withColumn("word_rate", F.sum("n_words").over(w) / span).filter("_own")
        .select("recording_id", "seq", "t", "word_rate")
    )


def rate_at(arrivals: DataFrame, now: DataFrame) -> DataFrame:
    """Rate as seen at later instants ``now(recording_id, now)``; decays to 0.

    Instants and arrivals meet by stretches of the window's length, so a recording's
    arrivals never meet all of its instants.
    """
    stretch = lambda c: F.floor(F.col(c) / RATE_WINDOW).cast("bigint")
    asked = now.select("recording_id", "now", F.explode(F.array(stretch("now") - 1, stretch("now"))).alias("_b"))
    near = arrivals.select("recording_id", "t", "n_words", stretch("t").alias("_b"))
    hit = asked.join(near, ["recording_id", "_b"]).filter(F.col("t").between(F.col("now") - RATE_WINDOW, F.col("now")))
    rate = hit.groupBy("recording_id", "now").agg(
        F.sum("n_words").alias("_words"), F.greatest(F.col("now") - F.min("t"), F.lit(RATE_MIN_SPAN)).alias("_span")
    )
    return now.join(rate, ["recording_id", "now"], "left").select(
        "recording_id", "now", F.coalesce(F.col("_words") / F.col("_span"), F.lit(0.0)).alias("word_rate")
    )


def last_events(events: DataFrame, n: int = LAST_EVENTS, block: int = blocks.BLOCK) -> DataFrame:
    """The ``n`` latest events of each recording (SRT-03)."""
    return blocks.last_n(events, ["recording_id"], _block(block), [F.col("seq")], n, rank="recency")


# -- scripted values (JON-07, SCL-30) --------------------------------------

def parse_script(text: Column) -> Column:
    """``0:0, 10:20`` → points sorted by time; NULL when a pair is malformed."""
    number = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    tokens = F.filter(F.split(F.trim(text), r"[,;\s]+"), lambda x: x != "")
    points = F.transform(
        tokens,
        lambda p: F.struct(
            F.split_part(p, F.lit(":"), F.lit(1)).try_cast("double").alias("t"),
            F.split_part(p, F.lit(":"), F.lit(2)).try_cast("double").alias("v"),
        ),
    )
    return F.when(F.forall(tokens, lambda x: x.rlike(f"^{number}:{number}$")), F.array_sort(points))


def format_script(points: Column) -> Column:
    def number(c: Column) -> Column:
        return F.regexp_replace(c.cast("string"), r"\.0$", "")

    return F.array_join(F.transform(F.array_sort(points), lambda p: F.concat(number(p["t"]), F.lit(":"), number(p["v"]))), ", ")


def script_value(t: Column, points: Column) -> Column:
    """Piecewise-linear value of sorted points at ``t``, clamped at both ends.

    The first interval holding ``t`` decides.
    """
    first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
    # 1-based position of the first point at or after t.
    at = F.array_position(F.transform(points, lambda p: p["t"] >= t), F.lit(True)).cast("int")
    a, b = F.get(points, at - 2), F.get(points, at - 1)
    linear = a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"])
    return F.when(t <= first["t"], first["v"]).when(t >= last["t"], last["v"]).otherwise(linear)


def script_segments(scripts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(ends, segments) of scripts (``key``, points): the first and last point of
    each with the length of its blocks, and pieces (block, a, b) between neighbours.

    Blocks are as long as a script's mean segment, so spreading long segments over
    all their blocks at most doubles the rows.
    """
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    mean = (last["t"] - first["t"]) / F.greatest(F.size("points") - 1, F.lit(1))
    known = scripts.filter(F.size("points") > 0).select(key, "points", first.alias("first"), last.alias("last"), mean.alias("step"))
    pair = F.transform(F.slice("points", 2, F.size("points")), lambda b, i: F.struct(F.get("points", i).alias("a"), b.alias("b")))
    pieces = known.select(key, "first", "step", F.explode(pair).alias("p")).select(key, "first", "step", "p.*").filter(F.col("a.t") < F.col("b.t"))
    blocks_ = F.sequence(_script_block(F.col("a.t")), _script_block(F.col("b.t")))
    return known.drop("points"), pieces.select(key, F.explode(blocks_).alias("block"), "a", "b")


def _script_block(t: Column) -> Column:
    return F.floor((t - F.col("first.t")) / F.col("step"))


def script_values(events: DataFrame, scripts: DataFrame, key: str, at: str, out: str = "y") -> DataFrame:
    """``events`` with the value of their key's script at position ``at`` (JON-07).

    ``scripts`` has one row (``key``, points) per key, the points sorted.  Inside a
    script events meet the segments of their position's block; a hot key is spread
    over its blocks.  Events of keys without a script keep NULL.
    """
    ends, segments = script_segments(scripts, key)
    e = events.join(broadcast_if_small(ends), key, "left")
    x = F.col(at)
    outer = F.when(x <= F.col("first.t"), F.col("first.v")).when(x >= F.col("last.t"), F.col("last.v"))
    e = e.withColumn("_outer", outer).withColumn("block", F.when(F.col("_outer").isNull(), _script_block(x)))
    settled = e.filter("_outer IS NOT NULL OR block IS NULL").select(*events.columns, F.col("_outer").alias(out))
    inner = e.filter("_outer IS NULL AND block IS NOT NULL").join(segments, [key, "block"]).filter((x > F.col("a.t")) & (x <= F.col("b.t")))
    slope = (F.col("b.v") - F.col("a.v")) * (x - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    return settled.unionByName(inner.select(*events.columns, (F.col("a.v") + slope).alias(out)))
