"""Files of regulated prices: one key column or a pair, found by their headers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions.catalog import currency
from pricewren.functions.text import canonical_key

# Headers, in order of preference, as header_name() leaves them.
KEYS = ("cum", "id_cum", "codigo cum", "codigo_cum", "expediente-consecutivo")
PRICES = ("precio maximo venta", "precio_maximo_venta", "precio maximo", "pvp", "precio venta", "valor maximo", "precio", "price")
RECORDS = ("expediente", "exp", "nro expediente")
SEQUENCES = ("consecutivo", "consecutivocum", "consecutivo cum", "consec")


def header_name(header: str) -> str:
    """FN-STR-18: lower case without outer space, and without all signs but a-z, digits, space, _ and -; letters with accents go."""
    return re.sub(r"[^a-z0-9 _-]", "", header.lower().strip())


def resolve(headers: list[str], key: str | None = None, price: str | None = None) -> tuple[list[int], int]:
    """Places of the key's columns (one, or record and sequence) and of the price's; of headers that look alike the last counts."""
    place = {header_name(h): i for i, h in enumerate(headers)}
    own = {h: i for i, h in enumerate(headers)}
    first = lambda names: next((place[n] for n in names if n in place), None)
    paid = own[price] if price else first(PRICES)
    if paid is None:
        raise ValueError(f"no column of prices among {', '.join(headers)}")
    code = own[key] if key else first(KEYS)
    if code is not None:
        return [code], paid
    pair = [first(RECORDS), first(SEQUENCES)]
    if None in pair:
        raise ValueError(f"neither a column of keys nor a pair among {', '.join(headers)}")
    return pair, paid


def pair_key(record: Column, sequence: Column) -> Column:
    """FN-STR-25: `record-sequence` of two columns' digits, the second padded to two; null where either has none."""
    a, b = (F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "") for c in (record, sequence))
    return F.when((a != "") & (b != ""), F.format_string("%d-%02d", a.try_cast("bigint"), b.try_cast("bigint")))


def read_circular(spark: SparkSession, path: str, circular: str | None, valid_from, sep: str = ",", encoding: str = "UTF-8", key: str | None = None, price: str | None = None) -> DataFrame:
    """item, price, circular and valid_from of a delimited file with a header; a byte order mark is no part of it. Rows without a key go."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path, sep=sep)
    keys, paid = resolve([c.lstrip("﻿") for c in raw.columns], key, price)
    column = lambda i: F.col(f"`{raw.columns[i]}`")
    item = F.nullif(canonical_key(column(keys[0])), F.lit("")) if len(keys) == 1 else pair_key(*map(column, keys))
    return raw.select(item.alias("item"), currency(column(paid)).alias("price"), F.lit(circular).cast("string").alias("circular"), F.lit(valid_from).cast("date").alias("valid_from")).where("item is not null")
