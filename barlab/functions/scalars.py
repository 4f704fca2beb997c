"""Column functions shared by the operators; all are native expressions and safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_change(old: Column, new: Column) -> Column:
    """Percent from old to new; null unless old is positive and both are finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite(old) & finite(new) & (old > 0), (F.try_divide(new, old) - 1) * 100)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.try_divide(a, b)


def joined(*values: Column) -> Column:
    """The values as text, joined by a bar; a null is the word None."""
    return F.concat_ws("|", *(F.coalesce(v.cast("string"), F.lit("None")) for v in values))


def tie_break(*values: Column) -> Column:
    """SHA-256 of the joined values: an order that doesn't depend on the data's."""
    return F.sha2(joined(*values), 256)


def stable_integer(*values: Column) -> Column:
    """The first 64 bits of the tie-break, as a decimal of 20 digits."""
    return F.conv(F.substring(tie_break(*values), 1, 16), 16, 10).cast("decimal(20,0)")


#: The namespace of URLs (fixed by RFC 4122), in hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(*values: Column) -> Column:
    """Name-based UUID, version 5, of the values joined by a bar, in the URL namespace."""
    name = F.concat(F.unhex(F.lit(URL_NAMESPACE)), joined(*values).cast("binary"))
    h = F.sha1(name)
    part = lambda at, n: F.substring(h, at, n)
    variant = F.lower(F.conv(((F.conv(part(17, 1), 16, 10).cast("int") % 4) + 8).cast("string"), 10, 16))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


#: Bands of a duration by its whole minutes, rounded up, and their last minute.
DURATION_BANDS = (("le_3h", 180), ("gt_3h_to_6h", 360), ("gt_6h_to_7h", 420), ("gt_7h_to_8h", 480))


def duration_band(minutes: Column) -> Column:
    """Band of a duration in minutes; what is missing or not finite is unknown."""
    m = F.ceil(finite_or_null(minutes.cast("double")))
    band = F.when(m.isNull(), "unknown").when(m < 0, "outside_8h")
    for name, last in DURATION_BANDS:
        band = band.when(m <= last, name)
    return band.otherwise("outside_8h")


def safe_filename(name: Column) -> Column:
    """ASCII letters and digits, runs of others as one underscore; a name that changes ends in a piece of its hash."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9]+", "_"), "^_|_$", "")
    prefix = F.when(clean == "", "symbol").otherwise(F.substring(clean, 1, 60))
    changed = F.concat(prefix, F.lit("_"), F.substring(F.sha2(name, 256), 1, 12))
    return F.when((clean == name) & (clean != ""), F.substring(clean, 1, 80)).otherwise(changed)


def minute_of(at: Column) -> Column:
    """The whole minute."""
    return F.date_trunc("minute", at)


def iso_time(text: Column) -> Column:
    """A timestamp from ISO text; without a zone it is UTC, and what isn't one is null."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def finite_or_null(value: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def holds(condition: Column) -> Column:
    """A condition that an unknown makes false."""
    return F.coalesce(condition, F.lit(False))
