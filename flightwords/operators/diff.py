"""Semantic comparison of two mapping documents (DIF-01, JON-06).

Documents are paired by ``pair_id`` (both sides carry it) and compared position
by position: parameters by ``param_ord``, occurrences and segments by rank.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decode import effective_decimals
from .mapping import first_label_map

# The compared attributes, as the report names them.
ATTRIBUTES = (
    ("mnemonic", "mnemonic"), ("description", "description"), ("source_type", "source_parameter_type"),
    ("ptype", "parameter_type"), ("unit", "unit"), ("minimum", "minimum"), ("maximum", "maximum"),
    ("true_state", "true_state"), ("false_state", "false_state"), ("notes", "notes"),
)


def _show(c: Column) -> Column:
    return c.cast("string")


def _pairs(rows: list[tuple[str, Column, Column]]) -> Column:
    """Array of (what, left, right) holding only the entries that differ."""
    items = F.array(*[F.struct(F.lit(n).alias("what"), _show(a).alias("left"), _show(b).alias("right")) for n, a, b in rows])
    return F.filter(items, lambda i: ~i["left"].eqNullSafe(i["right"]))


def _states() -> Column:
    implied = F.filter(
        F.array(
            F.when(F.col("false_state").isNotNull(), F.struct(F.lit(0).cast("bigint").alias("value"), F.col("false_state").alias("label"))),
            F.when(F.col("true_state").isNotNull(), F.struct(F.lit(1).cast("bigint").alias("value"), F.col("true_state").alias("label"))),
        ),
        lambda s: s.isNotNull(),
    )
    table = F.when(F.coalesce(F.size("states"), F.lit(0)) > 0, F.col("states")).otherwise(implied)
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(F.coalesce(first_label_map(table), F.create_map().cast("map<bigint,string>")))),
                    lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ";"
    )


def parameter_differences(left: DataFrame, right: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Attribute differences of parameters at the same position of a pair."""
    ignored = set(ignore)
    def prepare(df: DataFrame, side: str) -> DataFrame:
        cols = [a for a, _ in ATTRIBUTES] + ["resolution", "offset"]
        return df.select("pair_id", "param_ord", *[F.col(c).alias(f"{side}_{c}") for c in cols],
                         effective_decimals().alias(f"{side}_decimals"), _states().alias(f"{side}_states"))

    names = [(a, n) for a, n in ATTRIBUTES if n not in ignored and a not in ignored]
    if "conversion" not in ignored:
        names += [("resolution", "resolution"), ("offset", "offset")]
    names += [(x, x) for x in ("decimals", "states") if x not in ignored]
    joined = prepare(left, "a").join(prepare(right, "b"), ["pair_id", "param_ord"])
    return joined.select(
        "pair_id", "param_ord",
        F.inline(_pairs([(name, F.col(f"a_{a}"), F.col(f"b_{a}")) for a, name in names])),
    )


def document_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """wps, sync words and settings of paired documents."""
    def prepare(df: DataFrame, side: str) -> DataFrame:
        return df.select("pair_id", F.col("wps").alias(f"{side}_wps"), F.array_join("sync_words", ",").alias(f"{side}_sync"),
                         F.array_join("settings_raw", ",").alias(f"{side}_set"))

    d = prepare(left, "a").join(prepare(right, "b"), "pair_id")
    both = F.col("a_set").isNotNull() & F.col("b_set").isNotNull()
    return d.select("pair_id", F.lit(None).cast("int").alias("param_ord"), F.inline(_pairs([
        ("wps", F.col("a_wps"), F.col("b_wps")), ("sync_words", F.col("a_sync"), F.col("b_sync")),
        ("settings record", F.when(both, F.col("a_set")), F.when(both, F.col("b_set"))),
    ])))


def count_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs whose parameter counts differ; their parameters are not compared further."""
    a = left.groupBy("pair_id").agg(F.count("*").alias("a_n"))
    b = right.groupBy("pair_id").agg(F.count("*").alias("b_n"))
    return a.join(b, "pair_id", "full_outer").select(
        "pair_id", F.coalesce("a_n", F.lit(0)).alias("a_n"), F.coalesce("b_n", F.lit(0)).alias("b_n")
    ).filter("a_n <> b_n")


def _segment_list(segments: DataFrame) -> DataFrame:
    """Per parameter position: occurrences in order, each an ordered list of segments."""
    seg = F.struct("seq", "word", "lsb", "msb", "subframes", "bcd_weight")
    occ = segments.groupBy("pair_id", "param_ord", "occ").agg(
        F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), seg))).alias("segs")
    )
    return occ.groupBy("pair_id", "param_ord").agg(F.array_sort(F.collect_list(F.struct("occ", "segs"))).alias("occs"))


def mapping_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Occurrence and segment differences of parameters at the same position.

    Both inputs are segments with pair_id and param_ord.
    """
    a = _segment_list(left).withColumnRenamed("occs", "a")
    b = _segment_list(right).withColumnRenamed("occs", "b")
    j = a.join(b, ["pair_id", "param_ord"], "full_outer")
    na, nb = F.coalesce(F.size("a"), F.lit(0)), F.coalesce(F.size("b"), F.lit(0))
    counts = j.filter(na != nb).select(
        "pair_id", "param_ord", F.lit("occurrence count").alias("what"), na.cast("string").alias("left"), nb.cast("string").alias("right")
    )
    o = j.filter(na == nb).select("pair_id", "param_ord", F.inline(F.arrays_zip("a", "b")))
    sa, sb = F.size("a.segs"), F.size("b.segs")
    occ_level = o.select("pair_id", "param_ord", F.inline(_pairs([
        ("occurrence index", F.col("a.occ"), F.col("b.occ")), ("segment count", sa, sb),
    ])))
    zipped = F.arrays_zip(F.col("a.segs").alias("s"), F.col("b.segs").alias("u"))
    s = o.filter(sa == sb).select("pair_id", "param_ord", F.explode(zipped).alias("z")).select("pair_id", "param_ord", "z.*")
    spot = lambda x: F.concat_ws(",", F.col(f"{x}.word"), F.col(f"{x}.lsb"), F.col(f"{x}.msb"))
    seg_level = s.select("pair_id", "param_ord", F.inline(_pairs([
        ("sequence", F.col("s.seq"), F.col("u.seq")),
        ("subframes", F.array_join("s.subframes", ","), F.array_join("u.subframes", ",")),
        ("word/lsb/msb", spot("s"), spot("u")),
        ("BCD weight", F.col("s.bcd_weight"), F.col("u.bcd_weight")),
    ])))
    return counts.unionByName(occ_level).unionByName(seg_level)


def differences(left: tuple[DataFrame, ...], right: tuple[DataFrame, ...], ignore: Iterable[str] = ()) -> DataFrame:
    """All differences; each side is (documents, parameters, segments), paired by ``pair_id``."""
    docs = document_differences(left[0], right[0])
    counts = count_differences(left[1], right[1])
    count_rows = counts.select(
        "pair_id", F.lit(None).cast("int").alias("param_ord"), F.lit("parameter count").alias("what"),
        F.col("a_n").cast("string").alias("left"), F.col("b_n").cast("string").alias("right"),
    )
    stopped = counts.select("pair_id")
    pars = parameter_differences(left[1], right[1], ignore).join(stopped, "pair_id", "left_anti")
    maps = mapping_differences(left[2], right[2]).join(stopped, "pair_id", "left_anti")
    return docs.unionByName(count_rows).unionByName(pars).unionByName(maps)
