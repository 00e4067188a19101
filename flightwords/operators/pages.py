"""Document text and page reports, cell accuracy, and document rows of a mapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cell_value
from ..functions.numbers import plain_decimal
from ..schemas import FRAME_SECONDS
from .mapping import occurrences

SCANNED_COVERAGE = 0.8
# How a document states its word rate.
WPS_PATTERNS = (
    r"(?i)\b([0-9]{2,4})\s*(?:WPS|W/S)\b",
    r"(?i)\b([0-9]{2,4})\s*WORDS?\s*(?:PER|/)\s*(?:SECOND|SEC|S)\b",
)


def stated_rates(text: Column) -> Column:
    """Distinct word rates a text states."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in WPS_PATTERNS])
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def stated_wps(pages: DataFrame) -> DataFrame:
    """(document_id, wps): the rate stated by all pages together, if only one (AGG-11)."""
    rates = pages.select("document_id", stated_rates(F.col("text")).alias("r"))
    found = rates.groupBy("document_id").agg(F.min(F.array_min("r")).alias("lo"), F.max(F.array_max("r")).alias("hi"))
    return found.select("document_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("wps"))


def scan_summary(pages: DataFrame) -> DataFrame:
    """Pages, scans and scans with a text layer per document (AGG-13)."""
    scan = F.col("image_coverage") >= SCANNED_COVERAGE
    layer = F.trim(F.coalesce("text", F.lit(""))) != ""
    return pages.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.count_if(scan).alias("scanned"), F.count_if(scan & layer).alias("with_text_layer"))


def row_confidence(cells: DataFrame) -> DataFrame:
    """Lowest confidence of the cells of a row (AGG-14)."""
    return cells.groupBy("document_id", "page", "table_no", "row_no").agg(F.min("confidence").alias("confidence"))


def character_error_rate(truth: Column, read: Column) -> Column:
    """Edit distance over the length of the truth, placeholders empty (SCL-33)."""
    t, r = cell_value(truth), cell_value(read)
    return F.levenshtein(t, r) / F.greatest(F.length(t), F.lit(1))


def accuracy(cells: DataFrame, *keys: str) -> DataFrame:
    """Exact, space-insensitive and character accuracy of read cells (AGG-12).

    ``cells`` pairs truth and read text, matched by key.
    """
    squeeze = lambda c: F.regexp_replace(cell_value(c), r"\s+", "")
    t, r = F.col("truth"), F.coalesce("read", F.lit(""))
    c = cells.withColumn("_d", F.levenshtein(cell_value(t), cell_value(r))).withColumn("_n", F.length(cell_value(t)))
    return c.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.count_if(F.col("_d") == 0).alias("exact"), F.count_if(squeeze(t) == squeeze(r)).alias("loose"),
        F.sum("_d").cast("bigint").alias("edits"), F.avg(F.col("_d") / F.greatest("_n", F.lit(1))).alias("mean_cer"),
    )


GAP = 0.5
BAND = 256


def _alignment(truth: np.ndarray, read: np.ndarray, band: int) -> list[tuple[int | None, int | None]]:
    """Row numbers that belong together, in order; None beside a lost or an inserted row.

    Rows of equal cells cost nothing, others the part of cells that differ, a row
    without partner GAP.  One pass a row; its own insertions are a running minimum.
    Only places within ``band`` of the diagonal (and of its slope) are looked at.
    """
    n, m = len(truth), len(read)
    reach = band + abs(n - m)
    best, low, steps = np.arange(min(m, reach) + 1) * GAP, 0, []
    for i in range(1, n + 1):
        a, b = max(0, i - reach), min(m, i + reach)  # columns a … b of this row
        above = np.full(b - a + 1, np.inf)
        left, right = max(a, low), min(b, low + len(best) - 1)
        above[left - a : right - a + 1] = best[left - low : right - low + 1] + GAP
        match = np.full(b - a + 1, np.inf)
        first, last = max(a, low + 1, 1), min(b, low + len(best))
        if last >= first:
            cost = (truth[i - 1] != read[first - 1 : last]).mean(axis=1)
            # without a common cell two rows are no pair
            match[first - a : last - a + 1] = best[first - 1 - low : last - low] + np.where(cost < 1, cost, np.inf)
        row = np.minimum(match, above)
        at = np.arange(b - a + 1) * GAP
        row = np.minimum.accumulate(row - at) + at
        steps.append((a, np.where(row == match, 0, np.where(row == above, 1, 2)).astype(np.int8)))
        best, low = row, a
    i, j, out = n, m, []
    while i or j:
        step = 2 if i == 0 else (1 if j == 0 else int(steps[i - 1][1][j - steps[i - 1][0]]))
        i, j = i - (step < 2), j - (step != 1)
        out.append((i if step < 2 else None, j if step != 1 else None))
    return out[::-1]


def align_rows(truth: DataFrame, read: DataFrame, keys: list[str], band: int = BAND) -> DataFrame:
    """Rows of two readings of the same table, paired in order (AGG-12): ``keys``, truth_row, read_row.

    Both sides have ``keys`` (say document and table), row_no and cells, an array
    of texts.  A table is one group, as long as a printed table is.
    """
    schema = ", ".join(f"{k} {truth.schema[k].dataType.simpleString()}" for k in keys) + ", truth_row bigint, read_row bigint"

    def paired(group: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("row_no"), b.sort_values("row_no")
        width = max([len(c) for c in (*a["cells"], *b["cells"])], default=0)
        numbers: dict = {}
        rows = [np.array([[numbers.setdefault(x, len(numbers)) for x in (list(c) + [None] * (width - len(c)))] for c in side["cells"]], np.int64).reshape(-1, max(width, 1))
                for side in (a, b)]
        pairs = _alignment(*rows, band)
        own, other = a["row_no"].tolist(), b["row_no"].tolist()
        out = {k: [v] * len(pairs) for k, v in zip(keys, group)}
        out["truth_row"] = pd.array([None if i is None else own[i] for i, _ in pairs], "Int64")
        out["read_row"] = pd.array([None if j is None else other[j] for _, j in pairs], "Int64")
        return pd.DataFrame(out)

    mine = [d.select(*keys, F.col("row_no").cast("bigint").alias("row_no"), "cells").groupBy(*keys) for d in (truth, read)]
    return mine[0].cogroup(mine[1]).applyInPandas(paired, schema)


def _short(v: Column) -> Column:
    return F.when(v.isNotNull(), plain_decimal(F.round(v, 9))).otherwise("")


def document_rows(parameters: DataFrame, segments: DataFrame, style: str = "generic") -> tuple[DataFrame, DataFrame]:
    """A mapping as document rows (SNK-06): (rows, parameters that cannot be written).

    ``generic`` lists the rate and MSB/LSB columns; ``interval`` lists the sample
    interval and word pairs.
    """
    occ = occurrences(segments).select("document_id", "param_id", "occ", "segs", "subframes", "error")
    one = occ.groupBy("document_id", "param_id").agg(
        F.array_sort(F.collect_list(F.struct("occ", "segs"))).alias("occs"), F.collect_set("subframes").alias("sets"), F.max("error").alias("error"),
    )
    p = parameters.join(one, ["document_id", "param_id"], "left")
    widths = F.array_distinct(F.transform("occs", lambda o: F.size(o["segs"])))
    p = p.withColumn("_w", F.when(F.size(widths) == 1, F.get(widths, F.lit(0)))).withColumn("_n", F.size("occs")).withColumn("_sfs", F.get("sets", F.lit(0)))
    flat = F.flatten(F.transform("occs", lambda o: o["segs"]))
    hi = F.transform(flat, lambda s: F.greatest(s["lsb"], s["msb"]).cast("string"))
    lo = F.transform(flat, lambda s: F.least(s["lsb"], s["msb"]).cast("string"))
    words = F.transform(flat, lambda s: s["word"].cast("string"))
    all_four = F.array_join("_sfs", ",") == "1,2,3,4"
    broken = F.when(F.col("occs").isNull() | F.col("error").isNotNull(), "no usable mapping").when(F.size("sets") != 1, "segments differ in subframes")
    same = (F.size(F.array_distinct(hi)) == 1) & (F.size(F.array_distinct(lo)) == 1)
    samples = F.col("_n") * F.size("_sfs")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if style == "generic":
        problem = F.coalesce(broken, F.when((F.coalesce(F.col("_w"), F.lit(0)) != 1) & (F.col("_n") > 1), "several multi-segment occurrences"))
        p = p.withColumn("problem", problem)
        rows = p.filter("problem IS NULL").select(
            "document_id", "param_ord", F.col("mnemonic").alias("parameter_name"), text("description").alias("description"),
            text("source_type").alias("parameter_type"), plain_decimal(samples / FRAME_SECONDS).alias("frequency"),
            F.array_join(words, ", ").alias("word_location"), F.when(all_four, "all").otherwise(F.array_join("_sfs", ",")).alias("subframe"),
            F.when(same, F.get(hi, F.lit(0))).otherwise(F.array_join(hi, "/")).alias("msb"),
            F.when(same, F.get(lo, F.lit(0))).otherwise(F.array_join(lo, "/")).alias("lsb"), text("unit").alias("units"),
            _short(F.col("resolution")).alias("resolution"), _short(F.col("offset")).alias("offset"), _short(F.col("minimum")).alias("minimum"),
            _short(F.col("maximum")).alias("maximum"), text("true_state").alias("true_state"), text("false_state").alias("false_state"), text("notes").alias("notes"),
        )
    else:
        span = lambda k: F.array_distinct(F.transform("occs", lambda o: F.concat(
            F.greatest(o["segs"][k]["lsb"], o["segs"][k]["msb"]).cast("string"), F.lit("-"), F.least(o["segs"][k]["lsb"], o["segs"][k]["msb"]).cast("string"))))
        pair = F.col("_w") == 2
        p = p.withColumn("_first", F.when(pair, span(0))).withColumn("_second", F.when(pair, span(1)))
        uneven = pair & ((F.size("_first") != 1) | (F.size("_second") != 1))
        problem = F.coalesce(broken, F.when(~F.coalesce(F.col("_w").isin(1, 2), F.lit(False)), "only single words or word pairs").when(uneven, "word pairs differ"))
        p = p.withColumn("problem", problem)
        pairs = F.transform("occs", lambda o: F.array_join(F.transform(o["segs"], lambda s: s["word"].cast("string")), "-"))
        scale = F.when(F.col("offset") != 0, F.concat(_short(F.col("offset")), F.lit(", "), _short(F.col("resolution")))).otherwise(_short(F.col("resolution")))
        dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
        rows = p.filter("problem IS NULL").select(
            "document_id", "param_ord", F.when(text("description") != "", F.concat("mnemonic", F.lit("\n"), "description")).otherwise(F.col("mnemonic")).alias("mnemonic_and_name"),
            text("source_type").alias("parameter_type"), plain_decimal(F.round(FRAME_SECONDS / samples, 9)).alias("frequency"), F.array_join(pairs, ", ").alias("word_location"),
            F.when(pair, F.get("_first", F.lit(0))).otherwise(F.array_join(F.array_distinct(hi), "/")).alias("msb"),
            F.when(pair, F.get("_second", F.lit(0))).otherwise(F.array_join(F.array_distinct(lo), "/")).alias("lsb"),
            F.when(all_four, "0 (all 4)").otherwise(F.array_join("_sfs", ",")).alias("subframe"), dash("unit").alias("units"), scale.alias("resolution"),
            dash("true_state").alias("true_state"), dash("false_state").alias("false_state"), text("notes").alias("notes"),
        )
    return rows, p.filter("problem IS NOT NULL").select("document_id", "param_id", "problem")
