"""Number text: plain decimal spelling and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_decimal(v: Column) -> Column:
    """Decimal spelling without exponent or trailing zeros; NULL → '' (SCL-08).

    The shortest digits that give the number back are kept; only its point is
    moved, so no size is too large or too small.
    """
    text = v.cast("double").cast("string")
    digits = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), "^-", "")
    power = F.coalesce(F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
    left, right = F.split_part(digits, F.lit("."), F.lit(1)), F.split_part(digits, F.lit("."), F.lit(2))
    every, point = F.concat(left, right), F.length(left) + power
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(1 - point, F.lit(0))), every, F.repeat(F.lit("0"), point - F.length(every)))
    at = F.greatest(point, F.lit(1))
    whole = F.regexp_replace(F.substr(padded, F.lit(1), at), "^0+(?=[0-9])", "")
    rest = F.regexp_replace(F.substr(padded, at + 1), "0+$", "")
    out = F.concat(F.when(v < 0, "-").otherwise(""), whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    return F.when(v.isNull(), "").when(v == 0, "0").when(F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")), text).otherwise(out)


def resolution_decimals(resolution: Column, cap: int = 4) -> Column:
    """Decimals a resolution implies, at most ``cap`` (SCL-09)."""
    return F.least(F.length(F.split_part(plain_decimal(F.abs(resolution)), F.lit("."), F.lit(2))), F.lit(cap))


def unify_minus(t: Column) -> Column:
    return F.translate(t, "−–—", "---")


def parse_number(text: Column, decimal_comma: bool = False) -> Column:
    """Decimal, ``1/16``, ``2^-4`` or scientific text; NULL when unreadable (SCL-20).

    A lone comma between digits is refused unless ``decimal_comma`` is set.
    """
    t = unify_minus(F.trim(text))
    if decimal_comma:
        t = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        refused = F.lit(False)
    else:
        refused = t.rlike(r"^-?[0-9]+,[0-9]+$")
        t = F.replace(t, F.lit(","), F.lit(""))
    # two operands around one sign of operation, each read by itself
    side = lambda sign, i: F.trim(F.split_part(t, F.lit(sign), F.lit(i)))
    num, den = whole_number(side("/", 1)), whole_number(F.when(~side("/", 2).startswith("-"), side("/", 2)))
    raised = F.regexp_replace(side("^", 2), r"^\(|\)$", "")
    bare = side("^", 1)
    plain = (F.translate(bare, "0123456789.-", "") == "") & ~bare.startswith(".") & ~bare.endswith(".") & ~bare.startswith("-.")
    base, exponent = F.when(plain, bare.try_cast("double")), whole_number(raised)
    return (
        F.when(refused, F.lit(None).cast("double"))
        .when(t.contains("/"), F.when((den != 0) & (F.size(F.split(t, "/")) == 2), num / den))
        .when(t.contains("^"), F.when(F.size(F.split(t, r"\^")) == 2, F.pow(base, exponent)))
        .when(t.rlike(r"^[-+]?(?=\.?\d)\d*\.?\d*([eE][-+]?\d+)?$"), t.try_cast("double"))
    )


def whole_number(t: Column) -> Column:
    return F.when(t.rlike(r"^-?\d+$"), t.try_cast("double"))


def _plainly_written(t: Column) -> Column:
    """One decimal or scientific number that begins (after a minus) and ends with a digit."""
    is_digit = lambda c: c.between("0", "9")
    first = F.when(t.startswith("-"), F.substr(t, F.lit(2), F.lit(1))).otherwise(F.substr(t, F.lit(1), F.lit(1)))
    return parse_number(t).isNotNull() & ~t.contains("/") & ~t.contains("^") & is_digit(first) & is_digit(F.right(t, F.lit(1)))


def split_number_pair(text: Column) -> Column:
    """Struct (first, second) of a two-number cell, else NULL (SCL-21)."""
    t = F.trim(F.regexp_replace(unify_minus(text), r"\s+", " "))
    listed = F.regexp_replace(F.translate(t, ",;", "  "), " +", " ")
    signs = F.length(t) - F.length(F.translate(t, ",;", ""))
    parts = F.split(listed, " ")
    pair = (signs <= 1) & (F.size(parts) == 2) & F.forall(parts, _plainly_written)
    return F.when(pair, F.struct(F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second")))


# Unit words that may surround a rate.
FREQUENCY_NOISE = (
    r"(?i)\b(?:hz|sps|s/s|sec|s|samples?(?:\s*/\s*|\s+per\s+)(?:s|sec|second)|per\s+second|/s)\b"
)


def parse_frequency(text: Column) -> Column:
    """The number in a rate or interval cell (SCL-22)."""
    return parse_number(F.trim(F.regexp_replace(F.trim(text), FREQUENCY_NOISE, "")))
