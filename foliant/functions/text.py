"""Display forms of names, numbers, times and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _spaced(x: Column) -> Column:
    return F.trim(F.replace(x, F.lit("_"), F.lit(" ")))


def display_name(cls: Column | str) -> Column:
    """`Crop_x___Name_y` as `Crop x - Name y`, cut at the first `___`; a name without one is only spaced."""
    c = _c(cls)
    at = F.instr(c, "___")
    return F.when(at > 0, F.concat(_spaced(F.substr(c, F.lit(1), at - 1)), F.lit(" - "), _spaced(F.substr(c, at + 3)))).otherwise(_spaced(c))


def common_name(cls: Column | str) -> Column:
    """Every `___` as ` - `, other `_` as blanks."""
    return F.replace(F.replace(_c(cls), F.lit("___"), F.lit(" - ")), F.lit("_"), F.lit(" "))


def is_healthy(cls: Column | str) -> Column:
    """Whether the name holds `healthy`, in exact case."""
    return F.contains(_c(cls), F.lit("healthy"))


def iso(ts: Column | str) -> Column:
    """ISO 8601 without a zone; the fraction is left out where it is zero, as in Python."""
    t = _c(ts)
    return F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def stamp(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd_HHmmss")


def short_label(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "MMM d HH:mm")


def percent(x: Column | str, digits: int = 0) -> Column:
    """A share as a percentage with a fixed number of digits; null for null."""
    return F.when(_c(x).isNotNull(), F.format_string(f"%.{digits}f%%", _c(x) * 100))


def html_escape(x: Column | str) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def error_key(kind: str, error: Column | str) -> Column:
    """`kind:error`, cut to 200 characters, `unknown` for a null error."""
    return F.concat(F.lit(kind + ":"), F.left(F.coalesce(_c(error), F.lit("unknown")), F.lit(200)))


def data_uri(png: Column | str) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(_c(png)))


def half_even(x: Column) -> Column:
    """The nearest whole number, halves to the even one, as bigint."""
    return F.rint(x).cast("bigint")


def to_digits(x: Column | str, digits: int) -> Column:
    """A number from 0 up as the nearest one of so many decimals, by the exact value of the double, halves to the even digit, as C and Python print it; null for null.

    `format_string` and `round` start from the shortest decimal form, so to them 0.075 (a double a little below) is a half. Here the double is
    split into two short ones, whose products with the scale are exact, and their sum tells on which side of the half it lies.
    """
    v, scale = _c(x).cast("double"), 10.0**digits
    wide = v * 134217729.0
    high = wide - (wide - v)
    low = F.floor(v * scale).cast("double")
    over = (high * (2 * scale) - (2 * low + 1)) + (v - high) * (2 * scale)
    return (low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1.0).otherwise(0.0)) / scale
