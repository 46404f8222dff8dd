"""Quotations as flat rows, their filters, and prices compared with the best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_rows(rows: DataFrame) -> DataFrame:
    """PRJ-12, SNK-10: eighteen columns of quotation rows.

    rows: nombre_input, match_stage, match_confidence, cum_id, nombre_matcheado, forma_farmaceutica, concentracion,
    precios_count and mejor_precio (a struct, null without a price).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    best = lambda c: text(f"mejor_precio.{c}")
    yes = lambda c: F.when(c, "SI").otherwise("NO")
    return rows.select(
        "nombre_input", F.col("match_stage").alias("match_estado"), F.col("match_confidence").alias("match_confianza"), text("cum_id").alias("cum_id"), text("nombre_matcheado").alias("principio_activo"), text("forma_farmaceutica").alias("forma_farmaceutica"),
        text("concentracion").alias("concentracion"), best("proveedor_nombre").alias("proveedor_mejor"), F.col("mejor_precio.precio_unitario").alias("precio_unitario"), F.col("mejor_precio.precio_unidad").alias("precio_unidad_min"),
        F.col("mejor_precio.precio_presentacion").alias("precio_presentacion"), F.bround(F.col("mejor_precio.porcentaje_iva").cast("double") * 100, 2).alias("iva_pct"), best("vigente_desde").alias("vigente_desde"), best("vigente_hasta").alias("vigente_hasta"),
        best("fecha_publicacion").alias("fecha_precio"), F.col("precios_count").alias("num_proveedores"), yes(F.col("mejor_precio").isNull()).alias("sin_precio"), yes(F.col("match_stage").isin("NO_MATCH", "ERROR")).alias("sin_match"),
    )


def shown(rows: DataFrame, text: str = "", kind: str = "all") -> DataFrame:
    """FLT-14: rows whose name or match contains text, letter case aside; kind: all, match, nomatch, noprecio or regulados."""
    none = F.col("match_stage").isNull() | (F.col("match_stage") == "") | (F.col("match_stage") == "NO_MATCH")
    tests = {"all": F.lit(True), "match": ~none, "nomatch": none, "noprecio": ~(F.coalesce("precios_count", F.lit(0)) > 0), "regulados": F.coalesce("es_regulado", F.lit(False))}
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return rows.where((has("nombre_input") | has("nombre_matcheado")) & tests[kind])


def compared(price: Column, best: Column, ceiling: Column) -> Column:
    """CMP-02: is_best, deviation (per cent above the best price, null for it), band and exceeds (above the regulated ceiling, if there is one)."""
    top = F.coalesce(price == best, F.lit(False))
    deviation = F.when(~top, (price - best) / best * 100)
    band = F.when(deviation <= 5, "low").when(deviation <= 20, "medium").when(deviation.isNotNull(), "high")
    return F.struct(top.alias("is_best"), deviation.alias("deviation"), band.alias("band"), F.coalesce(price > ceiling, F.lit(False)).alias("exceeds"))
