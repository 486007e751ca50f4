"""Conversions of values as Column expressions: rounded half up, never cut off, never silently null.

Each gives (value, bad): bad is true where the source has a value that the target type cannot take. All of it stays in
the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ColumnSpec
from .types import BINARY, CHARACTER, INTEGERS, NUMERIC, TEMPORAL, UNSIGNED_MOST, family, is_unsigned, spark_type

# Texts of booleans, numbers and points in time.
TRUE, FALSE = ("1", "true", "t", "y", "yes", "on"), ("0", "false", "f", "n", "no", "off", "")
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
CLOCK = r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]{1,9})?)?$"


def as_text(c: Column, source: ColumnSpec) -> Column:
    """Canonical text: booleans 1 and 0, decimals without exponent, points in time without needless zeros.

    Floating-point numbers are written as the JVM writes them, with an exponent from 1e7 on.
    """
    kind = family(source)
    if kind in ("boolean", "bit") and spark_type(source).simpleString() == "boolean":
        return F.when(c, "1").when(~c, "0")
    if kind in BINARY or kind == "bit":
        return F.try_validate_utf8(c.cast("string"))
    return c.cast("string")


def _number(c: Column, source: ColumnSpec, to: str) -> Column:
    """The value as Spark SQL type `to`, null where it is none."""
    kind = family(source)
    if kind in ("boolean", "bit"):
        return as_text(c, source).try_cast(to)
    if kind in NUMERIC | {"year"}:
        return c.try_cast(to)
    text = F.trim(as_text(c, source))
    return F.when(text.rlike(NUMBER), text.try_cast(to))


def _whole(c: Column, source: ColumnSpec, to: str) -> Column:
    """Rounded half up, once: a value is rounded as it stands, and of text only the first decimal counts."""
    kind = family(source)
    if kind in INTEGERS or kind == "year":
        return c.try_cast(to)
    if kind in NUMERIC:
        return F.round(c, 0).try_cast(to)
    if kind in ("boolean", "bit"):
        return as_text(c, source).try_cast(to)
    text = F.trim(as_text(c, source))
    plain = F.regexp_replace(text, r"^([+-]?[0-9]*[.][0-9])[0-9]*$", "$1")
    # with an exponent: the point is moved among the digits first, then again only the first decimal counts
    power = F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int")
    before, after = F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), F.regexp_extract(text, r"[.]([0-9]*)", 1)
    place = F.length(before) + power
    digits = F.concat(F.repeat(F.lit("0"), F.least(F.greatest(-place, F.lit(0)), F.lit(40))), before, F.rpad(after, F.least(F.greatest(power + 1, F.length(after)), F.lit(80)), "0"))
    at = F.greatest(place, F.lit(0))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    moved = F.concat(sign, F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, F.lit(1)), F.lit("0"))
    # so great a power with a digit that is not zero fits no whole number
    shifted = F.when(place > 40, F.when(F.concat(before, after).rlike("^0*$"), "0")).otherwise(moved)
    first = F.when(power.isNull(), plain).otherwise(shifted)
    return F.when(text.rlike(NUMBER), F.round(first.try_cast("decimal(38,18)"), 0).try_cast(to))


def _truth(c: Column, source: ColumnSpec) -> Column:
    """Numbers and single bytes are true unless zero, no byte at all is false, and texts go by the fixed words."""
    kind = family(source)
    if kind in NUMERIC | {"year"}:
        return c != 0
    if kind == "boolean" or kind == "bit" and source.length <= 1:
        return c
    if kind in BINARY | {"bit"}:
        return F.when(F.octet_length(c) <= 1, F.coalesce(F.conv(F.hex(c), 16, 10).cast("int"), F.lit(0)) != 0)
    text = F.lower(F.trim(as_text(c, source)))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def _bytes(c: Column, source: ColumnSpec) -> Column:
    kind = family(source)
    if kind in BINARY or kind == "bit" and source.length > 1:
        return c
    if kind in ("boolean", "bit"):
        return F.when(c, F.lit(b"\x01")).when(~c, F.lit(b"\x00"))
    return as_text(c, source).cast("binary")


def _clock(c: Column, source: ColumnSpec) -> Column:
    """Time of day as text: a time as it stands, the time part of a point in time."""
    if family(source) not in CHARACTER | {"time"}:
        return F.date_format(_moment(c, source), "HH:mm:ss.SSSSSS")
    text = F.trim(c)
    return F.when(text.rlike(CLOCK), text).otherwise(F.date_format(F.when(text.rlike(MOMENT), text).try_cast("timestamp_ntz"), "HH:mm:ss.SSSSSS"))


def _moment(c: Column, source: ColumnSpec) -> Column:
    kind = family(source)
    if kind == "year":
        return F.make_date(c.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    if kind in ("date", "timestamp"):
        return c.cast("timestamp_ntz")
    if kind == "timestamptz":
        return c.cast("timestamp_ntz")
    text = F.trim(as_text(c, source))
    if kind == "time":
        return F.when(text.rlike(CLOCK), F.concat(F.lit("1970-01-01 "), text)).try_cast("timestamp_ntz")
    return F.when(text.rlike(MOMENT), text).try_cast("timestamp_ntz")


def convert(c: Column, source: ColumnSpec, target: ColumnSpec) -> tuple[Column, Column]:
    """(value for the target, whether the row is bad by it)."""
    t, s = family(target), family(source)
    fits = F.lit(True)
    if t == "bit" and target.length > 1 and s == "bit" and source.length > 1:
        new, fits = c, F.octet_length(c) * 8 < target.length + 8
    elif t in ("boolean", "bit"):
        new = _truth(c, source)
        if spark_type(target).simpleString() == "binary":
            new = F.when(new, F.lit(b"\x01")).when(~new, F.lit(b"\x00"))
    elif t == "year":
        new = F.year(_moment(c, source)) if s in TEMPORAL - {"year"} else _whole(c, source, "int")
    elif t in INTEGERS:
        new = _whole(c, source, spark_type(target).simpleString())
        if is_unsigned(target):
            fits = new.between(F.lit(0), F.lit(str(UNSIGNED_MOST[t])).cast("decimal(20,0)"))  # over what a JVM long holds
    elif t == "decimal":
        # without a precision a decimal stays as it is
        new = c if s == "decimal" and target.length <= 0 else _number(c, source, spark_type(target).simpleString())
    elif t in ("float", "double"):
        new = _number(c, source, "double").cast(t)
        fits = F.coalesce(~F.isnan(new) & (F.abs(new) != float("inf")), F.lit(True))
    elif t in CHARACTER:
        new = as_text(c, source)
        if t != "text" and target.length > 0:
            fits = F.length(new) <= target.length
    elif t in BINARY:
        new = _bytes(c, source)
        if t == "binary" and target.length > 0:
            fits = F.octet_length(new) <= target.length
    elif t == "date":
        new = _moment(c, source).cast("date")
    elif t == "time":
        new = _clock(c, source)
    elif t == "timestamp":
        new = _moment(c, source)
    elif t == "timestamptz":
        new = c if s == "timestamptz" else _moment(c, source).cast("timestamp")
    else:
        new = c
    bad = c.isNotNull() & (new.isNull() | ~F.coalesce(fits, F.lit(True)))
    return new, bad
