"""Source type text to canonical types and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ANALOG_SIGNED, ANALOG_UNSIGNED, BCD, DISCRETE, RAW, UNKNOWN

# Exact source texts.
EXACT = {
    "SIGNED ANALOG": ANALOG_SIGNED, "SIGNED": ANALOG_SIGNED, "BNR SIGNED": ANALOG_SIGNED, "UNSIGNED ANALOG": ANALOG_UNSIGNED,
    "UNSIGNED": ANALOG_UNSIGNED, "BNR": ANALOG_UNSIGNED, "ANALOG": ANALOG_UNSIGNED, "BCD": BCD, "DISCRETE": DISCRETE,
    "STATUS": DISCRETE, "RAW": RAW,
}
# Keywords in order of precedence.
KEYWORDS = (
    (("BCD",), BCD),
    (("DISCRETE", "DISC", "DIS", "BOOLEAN", "BOOL", "STATUS", "LOGIC"), DISCRETE),
    (("UNSIGNED",), ANALOG_UNSIGNED),
    (("SIGNED", "2'S", "TWO'S", "TWOS", "2S", "COMPLEMENT"), ANALOG_SIGNED),
    (("BNR", "BINARY", "ANALOG", "ANALOGUE", "ANLG"), ANALOG_UNSIGNED),
    (("RAW",), RAW),
)
# The type words an ADB file knows.
VENDOR = {ANALOG_SIGNED: "Signed Analog", ANALOG_UNSIGNED: "Unsigned Analog", BCD: "BCD", DISCRETE: "Discrete"}


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def normalize_source_type(text: Column) -> Column:
    """Exact table, then the strongest keyword, else unknown (SCL-06)."""
    key = F.upper(one_line(F.coalesce(text, F.lit(""))))
    tokens = F.regexp_extract_all(key, F.lit("([A-Z0-9']+)"), 1)
    out = F.when(F.try_element_at(_lookup(EXACT), key).isNotNull(), F.try_element_at(_lookup(EXACT), key))
    for words, kind in KEYWORDS:
        out = out.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])), kind)
    return out.otherwise(UNKNOWN)


def vendor_type_text(ptype: Column, source: Column) -> Column:
    """Type column of an exported record (SCL-07)."""
    own = F.trim(F.coalesce(source, F.lit("")))
    known = F.upper(one_line(own)).isin(*[v.upper() for v in VENDOR.values()])
    return F.when(known, own).otherwise(F.coalesce(F.try_element_at(_lookup(VENDOR), ptype), own))
