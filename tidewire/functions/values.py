"""Number, time, array, JSON and vector functions on columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.fixed_values import SUFFIX_REGIONS, VENDOR_COINS, VENDOR_FUTURES, VENDOR_SUFFIXES


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounding of ties to even, on doubles."""
    return F.bround(c, digits)


def ratio(part: Column, whole: Column, digits: int = 3, empty: float | None = None) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(empty).cast("double"))


def band(c: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """The name of the first step that the value reaches; steps fall. Null stays null."""
    out = F.lit(below)
    for least, name in reversed(steps):
        out = F.when(c >= least, F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def parse_time(c: Column) -> Column:
    """ISO text with Z, an offset or none (UTC); null where it isn't a time."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def age_hours(c: Column, as_of: Column) -> Column:
    """Hours since, not below 0; null without a time."""
    return F.when(c.isNotNull() & as_of.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(c)) / 3.6e9))


def decay(age: Column, half_life: Column | float) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def clamp_horizon(c: Column) -> Column:
    """Days in [10, 120]; 45 where it isn't a positive number."""
    days = c.try_cast("int")
    return F.when(days.isNull() | (days <= 0), F.lit(45)).otherwise(F.greatest(F.lit(10), F.least(F.lit(120), days)))


def overlap(a: Column, b: Column) -> Column:
    """Whether the sets meet; an empty set meets any."""
    return F.arrays_overlap(a, b) | (F.size(a) == 0) | (F.size(b) == 0)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def text_list(c: Column) -> Column:
    """A JSON list of strings without blank ones; an empty list where it doesn't parse."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: F.trim(x) != "")


def sorted_json(c: Column) -> Column:
    return F.to_json(F.array_sort(c))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(a.cast("array<double>"))


def has_column(df: DataFrame, name: str, kind: T.DataType | str) -> Column:
    """The column, or a typed null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# ------------------------------------------------------------------ symbols and labels


def regions_of(symbol: Column) -> Column:
    """Regions of a symbol by its suffix; an index is global, a plain symbol North American."""
    out = F.when(symbol.startswith("^"), F.array(F.lit("global"))).otherwise(F.array(F.lit("north_america")))
    for suffix, regions in reversed(SUFFIX_REGIONS):
        out = F.when(symbol.endswith(suffix), F.array(*[F.lit(r) for r in regions])).otherwise(out)
    return out


def vendor_symbol(symbol: Column, own: Column | None = None) -> Column:
    """A symbol in the form of another vendor: its own entry if there is one, else by rules for futures, indices, currencies, coins and
    exchanges, the first that holds."""
    out = F.concat(symbol, F.lit(".US"))
    for suffix, to in reversed(VENDOR_SUFFIXES):
        out = F.when(symbol.endswith(suffix), F.concat(F.regexp_replace(symbol, re.escape(suffix) + "$", ""), F.lit(to))).otherwise(out)
    coin = F.split(symbol, "-")
    out = F.when(~symbol.endswith("=F") & (F.size(coin) == 2) & F.get(coin, F.lit(1)).isin(VENDOR_COINS), F.concat(symbol, F.lit(".CC"))).otherwise(out)
    out = F.when(symbol.endswith("=X"), F.concat(F.regexp_replace(symbol, "=X$", ""), F.lit(".FOREX"))).otherwise(out)
    out = F.when(symbol.startswith("^"), F.concat(F.regexp_replace(symbol, r"^\^", ""), F.lit(".INDX"))).otherwise(out)
    for future, to in VENDOR_FUTURES.items():
        out = F.when(symbol == future, F.lit(to)).otherwise(out)
    return out if own is None else F.coalesce(F.nullif(own, F.lit("")), out)


def one_of(c: Column, allowed: list[str], default: str) -> Column:
    """A label without regard to case and blanks around it, if it is allowed; else the default."""
    form = F.lower(F.trim(c))
    return F.when(form.isin(allowed), form).otherwise(F.lit(default))


def all_of(*conditions: Column | None) -> Column:
    """Of optional conditions (None: not asked for) all that are given; true without any."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def majority(label: Column, one: str, other: str) -> Column:
    """An aggregate: ``one`` if it is more frequent than ``other``, else ``other``."""
    return F.when(F.count_if(label == one) > F.count_if(label == other), F.lit(one)).otherwise(F.lit(other))


def float_or_null(c: Column) -> Column:
    """The number that a text is as a whole, blanks around it aside; null for anything else."""
    text = F.trim(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    word = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.coalesce(number, F.when(word.isin("inf", "infinity"), sign * float("inf")).when(word == "nan", F.lit(float("nan"))))


def int_or_null(c: Column) -> Column:
    """The whole number that a text is, blanks around it aside; null for anything else, fractions included."""
    text = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))


def first_int(c: Column) -> Column:
    """The first whole number in a text, with commas between its digits."""
    return F.replace(F.nullif(F.regexp_extract(c, r"(-?\d[\d,]*)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("long")
