"""Supplier files and masters: every column a text, headers resolved by candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewren.sources.spreadsheets import read_sheet
from pricewren.tables import written

# Standard fields and the header patterns that feed them.
FIELD_PATTERNS = {
    "cum_code": (r"\bcum\b", r"codigo\s*cum", r"c[oó]digo.*cum"),
    "precio_unidad": (r"precio\s*umd", r"precio.*unidad\s*m[ií]nima"),
    "precio_presentacion": (r"precio.*presentaci[oó]n", r"precio.*caja", r"precio.*empaque", r"precio.*presentac"),
    "porcentaje_iva": ("iva", r"impuesto.*valor.*agregado", "tax"),
    "precio_unitario": (r"precio.*unit", r"unit.*price", "precio"),
    "descripcion": (r"descripci[oó]n", r"principio\s*activo", "principio", "producto", r"\bnombre(?!\s*comercial)\b", "description"),
    "vigente_desde": (r"vigente?\s*desde", r"valid\s*from", r"fecha\s*inicio"),
    "vigente_hasta": (r"vigente?\s*hasta", r"valid\s*to", r"fecha\s*fin", r"fecha\s*vencimiento"),
}


def read_texts(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """SRC-01, SRC-02: a file with a header, all columns text: a workbook's first sheet, tabs for .tsv and .txt, else commas."""
    if path.lower().endswith((".xlsx", ".xls")):
        return read_sheet(spark, path)
    sep = sep or ("\t" if path.lower().endswith((".tsv", ".txt")) else ",")
    return spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").option("encoding", encoding).csv(path, sep=sep)


def read_numbered(spark: SparkSession, path: str, place: str = "row") -> DataFrame:
    """read_texts() with ``place``, the number of each row from 1 on, in the order of files by name and rows in them.

    Blocks of files are counted, and each begins where those before it end; only one row a block is sorted and goes to
    every task, which finds a row's block by the task that read it and its place there: rows stay where they are.
    They are written to the shared folder once, so that numbers don't depend on how often the files are read.
    """
    if path.lower().endswith((".xlsx", ".xls")):
        return read_sheet(spark, path, place)
    df = read_texts(spark, path)
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = written(df.select("*", *block, F.monotonically_increasing_id().alias("_at")), "numbered")
    blocks = rows.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reader = lambda at: F.shiftright(at, 33)  # noqa: E731  # upper bits of monotonically_increasing_id()
    begun = blocks.select(reader("_first").alias("_reader"), "_first", (F.col("_first") + F.col("_n")).alias("_end"), before.alias("_before"))
    within = (reader("_at") == F.col("_reader")) & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_end"))
    return rows.join(F.broadcast(begun), within).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(place))


def header_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return (row["value"] if row else "").lstrip("﻿")


def read_master(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A master whose separator is the first of tab, semicolon and comma under which the header has all required columns."""
    head = header_line(spark, path)
    for sep in ("\t", ";", ","):
        if set(required) <= {h.strip().strip('"') for h in head.split(sep)}:
            return read_texts(spark, path, sep)
    raise ValueError(f"no separator yields the columns {', '.join(required)}")


def first_column(columns: list[str], candidates: list[str]) -> str:
    """The first candidate among columns, letter case aside."""
    by_name = {c.strip().lower(): c for c in columns}
    for candidate in candidates:
        if candidate.lower() in by_name:
            return by_name[candidate.lower()]
    raise ValueError(f"none of {', '.join(candidates)} among the columns")


# Columns of names in hospital lists, in order of preference.
NAME_COLUMNS = ("nombre", "Nombre", "NOMBRE", "medicamento", "Medicamento", "MEDICAMENTO", "producto", "Producto", "PRODUCTO", "description", "name")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: ``name`` of a hospital's list, trimmed; blank rows go. A list without a column of names is an error."""
    df = read_texts(spark, path)
    found = next((c for c in NAME_COLUMNS if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(NAME_COLUMNS)} among the columns {', '.join(df.columns)}")
    return df.select(F.trim(F.col(f"`{found}`")).alias("name")).where(F.length("name") > 0)


def suggest_mapping(columns: list[str], patterns: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Standard field -> column: the first column in which any of the field's patterns is found. A column may feed several fields."""
    out: dict[str, str] = {}
    for field, tests in (patterns or FIELD_PATTERNS).items():
        hit = next((c for c in columns if any(re.search(test, c.lower()) for test in tests)), None)
        if hit is not None:
            out[field] = hit
    return out


def apply_mapping(df: DataFrame, mapping: dict[str, str], fields: list[str]) -> DataFrame:
    """fields by mapping (null where unmapped) and ``raw``, a map of the whole row."""
    def of(field: str) -> Column:
        return F.trim(F.col(f"`{mapping[field]}`")) if field in mapping else F.lit(None).cast("string")

    raw = F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))))
    return df.select(*(of(f).alias(f) for f in fields), raw.alias("raw"))
