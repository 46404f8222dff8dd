"""Rows that can't be read don't end a job: every field is read on its own, and what was wrong stands in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.functions import numbers


def read_as(c: Column, kind: str) -> Column:
    """A text as a number in local conventions (decimal), whole number, date, or text; null where it can't be read."""
    if kind.startswith("decimal"):
        return numbers.locale_decimal(c, kind)
    if kind in ("int", "bigint"):
        return numbers.integer(c).try_cast(kind)
    if kind == "date":
        return numbers.any_date(c)
    return F.nullif(F.trim(c), F.lit("")) if kind == "string" else F.trim(c).try_cast(kind)


def typed_rows(df: DataFrame, fields: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """df with each text column of fields read as its kind, and ``error``.

    error names, joined by `; `, each field whose text is there but can't be read (bad_<field>) and each required one that
    is missing (no_<field>); it is null in good rows. Other columns stay as they are.
    """
    text = lambda f: F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))
    read = df.withColumns({f"_{f}": read_as(F.col(f).cast("string"), kind) for f, kind in fields.items()})
    wrong = [F.when(text(f).isNotNull() & F.col(f"_{f}").isNull(), F.lit(f"bad_{f}")) for f in fields] + [F.when(text(f).isNull(), F.lit(f"no_{f}")) for f in required]
    error = F.nullif(F.concat_ws("; ", *wrong), F.lit(""))
    return read.withColumn("error", error).select(*(F.col(f"_{c}").alias(c) if c in fields else F.col(c) for c in df.columns if c != "error"), "error")


def json_rows(lines: DataFrame, column: str, fields: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Lines of JSON in ``column`` as typed_rows; a line that isn't an object has all fields null and the error bad_line."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    parsed = lines.withColumn("_line", F.from_json(column, f"{schema}, `_bad` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("_line").isNull() | F.col("_line._bad").isNotNull()
    flat = parsed.select(*lines.columns, broken.alias("_broken"), *(F.when(~broken, F.col(f"_line.{f}")).alias(f) for f in fields))
    typed = typed_rows(flat, fields, required)
    return typed.withColumn("error", F.when(F.col("_broken"), "bad_line").otherwise(F.col("error"))).drop("_broken")
