"""Numbers and dates from texts in local conventions; what can't be read is null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def locale_decimal(c: Column, kind: str = "decimal(18,4)") -> Column:
    """A number whose decimal sign is the last of comma and dot if both are there, and the only one otherwise."""
    t = F.regexp_replace(c, r"[$\s ]", "")
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))  # a sign that is missing leaves the whole text
    plain = F.when(comma_last, F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(",")))
    return plain.try_cast(kind)


def fraction(c: Column) -> Column:
    """A percentage as a fraction: what has a percent sign or is above 1 is divided by 100; half-even to four places."""
    t = F.trim(c)
    value = locale_decimal(F.replace(t, F.lit("%")), "decimal(18,8)")
    return F.bround(F.when(F.contains(t, F.lit("%")) | (value > 1), value / 100).otherwise(value), 4).cast("decimal(5,4)")


def last_separator_decimal(c: Column) -> Column:
    """All but digits, separators and minus removed; the last separator is decimal."""
    t = F.regexp_replace(c, r"[^0-9.,\-]", "")
    head = F.regexp_replace(F.regexp_extract(t, r"^(.*)[.,]([^.,]*)$", 1), "[.,]", "")
    tail = F.regexp_extract(t, r"[.,]([^.,]*)$", 1)
    return F.when(t.rlike("[.,]"), F.concat(head, F.lit("."), tail)).otherwise(t).try_cast("decimal(18,4)")


def integer(c: Column) -> Column:
    """An integer, or a number without its fraction."""
    return F.coalesce(F.trim(c).try_cast("bigint"), F.trim(c).try_cast("double").try_cast("bigint"))


def regime(c: Column) -> Column:
    value = integer(c)
    return F.when(value.isin(1, 2, 3), value)


DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyyMMdd")


def any_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date by the first format that reads it. A format of numbers alone is tried only on texts of its shape, as a failed try costs far more."""
    t = F.trim(c)

    def read(f: str) -> Column:
        tried = F.to_date(F.try_to_timestamp(t, F.lit(f)))
        shape = re.sub("[yMd]+", r"[+-]?\\d+", re.sub("[./]", r"\\\g<0>", f))
        return F.when(t.rlike(f"^{shape}$"), tried) if re.fullmatch("(?:y{4}|MM?|dd?|[-./ ])+", f) else tried

    return F.coalesce(*map(read, formats))
