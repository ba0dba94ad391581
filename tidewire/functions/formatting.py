"""Formatting of durations, integers and sizes, and sequences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dhms(seconds: Column) -> dict[str, Column]:
    """Sign, days, hours, minutes, whole seconds and milliseconds of a number of seconds, rounded to tenths of a millisecond."""
    tenths = F.bround(F.abs(seconds.cast("double")) * 10000, 0).cast("long")
    whole = F.floor(tenths / 10000)
    return {
        "sign": F.when(seconds < 0, F.lit("-")).otherwise(F.lit("")), "d": F.floor(whole / 86400), "h": F.floor(whole % 86400 / 3600),
        "m": F.floor(whole % 3600 / 60), "s": whole % 60, "ms": (tenths % 10000) / 10,
    }


def pretty_duration(seconds: Column) -> Column:
    """``D days h:mm:ss hours``, ``m:ss minutes``, ``s seconds`` or ``x.x milliseconds``; infinite ones are ``inf``.

    Milliseconds are a decimal fraction of the seconds where minutes are 0, else follow as ``:mmm``.
    """
    x = seconds.cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    p = dhms(F.when(finite, x).otherwise(F.lit(0.0)))
    d, h, m, s, ms = p["d"], p["h"], p["m"], p["s"], p["ms"]
    fraction = F.when(m == 0, F.regexp_replace(F.format_string("%.4f", ms / 1000), "^0|0+$", "")).otherwise(F.format_string(":%03d", F.floor(ms).cast("int")))
    fraction = F.when(ms > 0, fraction).otherwise(F.lit(""))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = (
        F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s), fraction, F.lit(" hours")))
        .when(m > 0, F.concat(m.cast("string"), F.lit(":"), two(s), fraction, F.lit(" minutes")))
        .when(s > 0, F.concat(s.cast("string"), fraction, F.lit(" seconds")))
        .otherwise(F.format_string("%.1f milliseconds", ms))
    )
    days = F.when(d > 0, F.concat(d.cast("string"), F.lit(" days "))).otherwise(F.lit(""))
    return F.when(F.isnan(x), F.lit("nan")).when(~finite, F.lit("inf")).otherwise(F.concat(p["sign"], days, text))


def pretty_int(x: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(x, 0)


def _three_decimals(y: Column) -> Column:
    """Doubles from 1 to 2**113 as ``%.3f`` in C prints them: the exact binary value, ties to even. Without branches, so that common parts are worked out once."""
    high = F.floor(y / 2.0**50)
    rest = y - high * 2.0**50
    low = F.floor(rest)
    part = ((rest - low) * 2.0**52).cast("long") * 1000  # doubles from 1 on have no bits below 2**-52
    t = F.shiftright(part + 2**51, 52)
    t = t - ((part.bitwiseAND(F.lit(2**52 - 1)) == 2**51) & (t % 2 == 1)).cast("int")
    whole = high.cast("decimal(20,0)") * F.lit(2**50) + low + F.floor(t / 1000)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((t % 1000).cast("string"), 3, "0"))


def pretty_bytes(x: Column) -> Column:
    """Bytes, or kilobytes to terabytes of 1024 with three decimals; sizes beyond a long are decimals."""
    unit, name = F.when(x >= 1024, 1024.0), F.lit(" kilobytes")
    for power, longer in ((2, " megabytes"), (3, " gigabytes"), (4, " terabytes")):
        unit, name = F.when(x >= 1024**power, float(1024**power)).otherwise(unit), F.when(x >= 1024**power, longer).otherwise(name)
    y = x / unit
    beyond = F.concat(F.format_string("%.3f", y), name)
    return F.coalesce(F.concat(_three_decimals(F.when(y < 2.0**113, y)), name), F.when(x >= 1024, beyond).otherwise(F.concat(x.cast("string"), F.lit(" bytes"))))


def frange(start: float, stop: float, step: float) -> Column:
    """Floor((stop - start) / step) values from ``start``, evenly spaced over the range without ``stop``."""
    n = int((stop - start) // step)
    if n < 1:
        return F.array().cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * (float(stop) - start) / n)
