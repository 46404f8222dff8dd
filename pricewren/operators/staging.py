"""Rows of supplier files before they are matched: staging rows, fields derived from a product's name, and the audit of quotations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.functions import catalog, numbers, records

# Units of a concentration and words of dosage forms, in the order in which they are tried.
UNITS = ("MG", "G", "MCG", "ML", "%", "GR", "MGR", "µG", "KG", "MGM")
FORM_WORDS = (
    "TAB", "TABLETA", "TABLETAS", "CAP", "CAPS", "CAPSULA", "CAPSULAS", "SOL", "SOLUCION", "JBE", "JARABE", "SUSP", "SUSPENSION",
    "AMP", "AMPO", "AMPOLLA", "AMPOLLAS", "CREMA", "UNG", "UNGUENTO", "GEL", "PARCHE", "PARCHES", "GOTAS", "GOTA",
)
TRADE_NAME = "comercial"


def staging_rows(df: DataFrame, mapping: dict[str, str], archive: str, place: str = "row", normalized: str | None = None) -> DataFrame:
    """PRJ-08: a supplier's file as staging rows: typed fields, first state, and the whole row as a map in ``datos_raw``.

    df has texts and ``place``, the row's number; mapping names the column of each standard field (sources.files.suggest_mapping()).
    The description is the column ``normalized`` where that says something, else the mapped one; without a dose it gets those of
    the first column of trade names. Rows with neither key, description nor a price other than 0 go, the others keep their
    numbers. Unread values are null; a row without both days is valid without end. Rows with a key are approved, all others
    wait. archive and fila_numero are the row's identity.
    """
    columns = [c for c in df.columns if c != place]
    of = lambda name: F.col(f"`{name}`").cast("string")
    full = lambda c: F.nullif(F.trim(c), F.lit(""))

    def field(name: str) -> Column:
        return of(mapping[name]) if name in mapping else F.lit(None).cast("string")

    trade = next((of(c) for c in columns if re.search(TRADE_NAME, c, re.IGNORECASE)), F.lit(None).cast("string"))
    described = F.coalesce(full(of(normalized)), full(field("descripcion"))) if normalized else full(field("descripcion"))
    money = {name: numbers.locale_decimal(field(name)) for name in ("precio_unitario", "precio_unidad", "precio_presentacion")}
    cum, priced = full(field("cum_code")), F.coalesce(money["precio_unitario"] != 0, F.lit(False))
    # on the file's own columns, so that doses aren't looked for twice; they never make a null description one that says something
    out = df.where(cum.isNotNull() | described.isNotNull() | priced).select(
        F.lit(archive).alias("archivo_id"), F.col(f"`{place}`").cast("long").alias("fila_numero"), cum.alias("cum_code"), *(c.alias(n) for n, c in money.items()),
        numbers.fraction(field("porcentaje_iva")).alias("porcentaje_iva"), records.with_doses(described, trade).alias("descripcion_raw"), *(numbers.any_date(field(n)).alias(n) for n in ("vigente_desde", "vigente_hasta")),
        F.create_map(*(x for c in columns for x in (F.lit(c), of(c)))).alias("datos_raw"),
    )
    keyed = F.col("cum_code").isNotNull()
    return out.select(
        *[c for c in out.columns if c != "datos_raw"], F.coalesce("vigente_desde", "vigente_hasta").isNull().alias("fecha_vigencia_indefinida"), F.when(keyed, F.lit(1).cast("decimal(5,4)")).alias("confianza_score"), F.when(keyed, "APROBADO").otherwise("PENDIENTE").alias("estado_homologacion"), "datos_raw"
    )


def named_fields(df: DataFrame, name: str) -> DataFrame:
    """PRJ-14: df with fields derived from a product's name: cleaned name, concentration, form, substance and maker.

    Concentration and form are the first ones in capitals; the substance is what remains of the cleaned name without any;
    the maker is a last word of 2 to 10 letters A-Z. What isn't found is null; of a null name the texts are empty.
    """
    dose = rf"(\d+[.,]?\d*\s*(?:{'|'.join(map(re.escape, UNITS))}))"
    form = rf"\b({'|'.join(FORM_WORDS)})\b"
    raw = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    clean = catalog.upper_words(raw)
    found = lambda c, pattern: F.nullif(F.regexp_extract(c, f"(?U){pattern}", 1), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(clean, f"(?U){dose}", " "), f"(?U){form}", " ")
    return df.withColumns({
        "producto_limpio": clean, "concentracion": found(raw, dose), "forma_farmaceutica": found(raw, form), "principio_activo": F.trim(F.regexp_replace(rest, r"(?U)\s+", " ")), "laboratorio": found(clean, r"\b([A-Z]{2,10})\z"),
    })


def joined_key(df: DataFrame, columns: list[str]) -> Column:
    """PRJ-14: those of columns that df has, joined and cleaned, null as empty. None of them there is an error."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError(f"none of {', '.join(columns)} among the columns")
    return catalog.upper_words(F.concat_ws(" ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in present)))


def crossed(df: DataFrame, other: DataFrame, columns: list[str], value: str) -> DataFrame:
    """PRJ-14, JN-12: df with ``llave_norm`` and the sum of other's value over all rows of that key, null where it has none.

    Both sides name their columns alike. other is summed by key before the join, so its keys are unique there.
    """
    of_key = other.select(joined_key(other, columns).alias("llave_norm"), F.col(f"`{value}`").alias(value)).groupBy("llave_norm").agg(F.sum(value).alias(value))
    return df.withColumn("llave_norm", joined_key(df, columns)).join(of_key, "llave_norm", "left")


def supplier_audit(quotes: DataFrame, details: DataFrame, links: DataFrame, first: str, last: str) -> DataFrame:
    """JN-18, AGG-10: by supplier, what its quotations from first to last name: official items, orphans, both, and the share of orphans in per cent.

    quotes: quote, supplier, day. details: quote, official, orphan (keys or null). links: the same of old quotations, which have no
    details; where a quotation has any detail its links don't count. Suppliers without items have 0 per cent. Rows of a quote are
    summed before they are joined, so a quote with many costs no more than one.
    """
    summed = lambda df, tag: df.groupBy("quote").agg(F.count(F.lit(1)).alias(f"{tag}_n"), F.count("official").alias(f"{tag}_official"), F.count("orphan").alias(f"{tag}_orphan"))
    asked = quotes.where(F.col("day").cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("quote", "supplier")
    rows = asked.join(summed(details, "d"), "quote", "left").join(summed(links, "l"), "quote", "left")
    of = lambda kind: F.sum(F.when(F.col("d_n") > 0, F.col(f"d_{kind}")).otherwise(F.coalesce(f"l_{kind}", F.lit(0))))
    by_supplier = rows.groupBy("supplier").agg(of("official").alias("total_match"), of("orphan").alias("total_huerfanos"))
    items = F.col("total_match") + F.col("total_huerfanos")
    share = F.when(items == 0, 0.0).otherwise(F.floor(F.col("total_huerfanos") / items * 10000 + 0.5) / 100)
    return by_supplier.select("supplier", "total_match", "total_huerfanos", items.alias("total_items"), share.alias("porcentaje_huerfanos"))
