"""Queries of supplier files, derived fields, audits and workbooks over the driver's tables, with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.operators import staging
from pricewren.plans.queries import table
from pricewren.sources import files, spreadsheets
from pricewren.tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pick(key: Column, *values: str | None) -> Column:
    """One of values by key modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


@query(
    """with l as (select *, row_number() over (order by l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate, l_linestatus) as n from lineitem),
r as (select n as fila_numero, case when l_partkey % 5 <> 0 then l_partkey || '-01' end as cum_code, case when l_linenumber % 4 <> 3 then round(l_extendedprice, 2) end as precio_unitario,
[0.19, 0.05, 0.05, null][l_suppkey % 4 + 1]::double as porcentaje_iva, case l_suppkey % 3 when 1 then 'Duloxetina ' || l_suppkey || case when l_orderkey % 2 = 0 then ' 30 mg 2,5ml' else '' end when 2 then 'Jarabe ' || l_suppkey || ' mg' end as descripcion_raw,
case when l_linestatus = 'F' then cast(l_shipdate as date) end as vigente_desde, 'X' || l_orderkey || case when l_orderkey % 2 = 0 then ' 30 MG 2,5ML' else '' end as comercial from l)
select *, vigente_desde is null as fecha_vigencia_indefinida, case when cum_code is not null then 1.0::double end as confianza_score, case when cum_code is null then 'PENDIENTE' else 'APROBADO' end as estado_homologacion, 6 as columnas
from r where cum_code is not null or descripcion_raw is not null or precio_unitario is not null"""
)
def staging_file(spark, sf_dir):
    """PRJ-08, SRC-01: lines as a supplier's file, written in order, read back with row numbers and staged by its headers."""
    line = table(spark, sf_dir, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate", "l_linestatus")
    supplier = F.col("l_suppkey").cast("string")
    described = F.when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("Duloxetina "), supplier)).when(F.col("l_suppkey") % 3 == 2, F.concat(F.lit(" Jarabe "), supplier, F.lit(" mg")))
    path = f"{shared_folder(spark)}/supplier-{uuid.uuid4().hex}.csv"
    line.select(
        F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit("-01 "))).alias("CUM"), F.when(F.col("l_linenumber") % 4 == 3, "N/A").otherwise(F.format_number("l_extendedprice", 2)).alias("Precio unitario"), pick(F.col("l_suppkey"), "19%", "0.05", "5", None).alias("IVA"),
        described.alias("Descripción"), F.concat(F.lit("X"), F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, " 30 MG 2,5ML").otherwise("")).alias("Nombre comercial"), F.when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "d/M/yyyy")).alias("Vigente desde"),
    ).write.option("header", True).csv(path)
    df = files.read_numbered(spark, path)
    rows = staging.staging_rows(df, files.suggest_mapping([c for c in df.columns if c != "row"]), "A1")
    doubles = [F.col(c).cast("double").alias(c) for c in ("precio_unitario", "porcentaje_iva", "confianza_score")]
    return rows.select("fila_numero", "cum_code", *doubles, "descripcion_raw", "vigente_desde", F.element_at("datos_raw", "Nombre comercial").alias("comercial"), "fecha_vigencia_indefinida", "estado_homologacion", F.size("datos_raw").alias("columnas"))


_NAMED = """(select p_partkey, p_name || ', ' || p_size || [' MG', ',5 ML', '% ', 'KG', ' UI'][p_partkey % 5 + 1] || [' TABLETA', ' jarabe', ' AMP.', ' GEL GOTAS', ' solución', ' CAPSULAS'][p_partkey % 6 + 1] || ' x' || p_partkey || [' LAFRANCOL', ' Bayer*', ' a', ' ' || p_type][p_partkey % 4 + 1] as nombre, p_brand, p_name from part)"""
_CLEAN = r"trim(regexp_replace(regexp_replace(upper(%s), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_DOSE = rf"(\d+[.,]?\d*\s*(?:{'|'.join(staging.UNITS)}))"
_FORM = rf"\b({'|'.join(staging.FORM_WORDS)})\b"


@query(
    rf"""with n as (select *, {_CLEAN % "nombre"} as producto_limpio from {_NAMED})
select p_partkey, producto_limpio, nullif(regexp_extract(nombre, '{_DOSE}', 1), '') as concentracion, nullif(regexp_extract(nombre, '{_FORM}', 1), '') as forma_farmaceutica,
trim(regexp_replace(regexp_replace(regexp_replace(producto_limpio, '{_DOSE}', ' ', 'g'), '{_FORM}', ' ', 'g'), '\s+', ' ', 'g')) as principio_activo, nullif(regexp_extract(producto_limpio, '\b([A-Z]{{2,10}})$', 1), '') as laboratorio from n"""
)
def named_fields(spark, sf_dir):
    """PRJ-14, FN-STR-17: fields derived from names of products."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    maker = F.coalesce(pick(k, " LAFRANCOL", " Bayer*", " a", None), F.concat(F.lit(" "), F.col("p_type")))
    name = F.concat("p_name", F.lit(", "), F.col("p_size").cast("string"), pick(k, " MG", ",5 ML", "% ", "KG", " UI"), pick(k, " TABLETA", " jarabe", " AMP.", " GEL GOTAS", " solución", " CAPSULAS"), F.lit(" x"), k.cast("string"), maker)
    return staging.named_fields(p.select("p_partkey", name.alias("nombre")), "nombre").drop("nombre")


_KEY = _CLEAN % "p_name || ' ' || p_brand"


@query(f"with u as (select {_KEY} as llave_norm, sum(l_quantity::decimal(18,2))::double as l_quantity from lineitem join part on l_partkey = p_partkey group by 1) select p_partkey, k.llave_norm, l_quantity from (select p_partkey, {_KEY} as llave_norm from part) k left join u on u.llave_norm = k.llave_norm")
def named_cross(spark, sf_dir):
    """PRJ-14, JN-12: quantities crossed with the master on a cleaned key."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("decimal(18,2)").alias("l_quantity")).join(p, "p_partkey")
    return staging.crossed(p, used, ["p_name", "p_brand", "p_maker"], "l_quantity").select("p_partkey", "llave_norm", F.col("l_quantity").cast("double").alias("l_quantity"))


@query(
    """with d as (select l_orderkey as q, count(*) as n, count(*) filter (l_partkey % 4 <> 0) as a, count(*) filter (l_partkey % 8 = 0) as b from lineitem where l_orderkey % 3 <> 0 group by 1),
o as (select l_orderkey as q, count(*) filter (l_partkey % 4 <> 0) as a, count(*) filter (l_partkey % 8 = 0) as b from lineitem group by 1),
s as (select o_custkey as supplier, coalesce(sum(case when d.n > 0 then d.a else o.a end), 0)::bigint as total_match, coalesce(sum(case when d.n > 0 then d.b else o.b end), 0)::bigint as total_huerfanos from orders left join d on d.q = o_orderkey left join o on o.q = o_orderkey where o_orderdate between '1996-01-01' and '1999-12-31' group by 1)
select supplier, total_match, total_huerfanos, total_match + total_huerfanos as total_items, case when total_match + total_huerfanos = 0 then 0.0 else floor(total_huerfanos / (total_match + total_huerfanos) * 10000 + 0.5) / 100 end as porcentaje_huerfanos from s"""
)
def supplier_audit(spark, sf_dir):
    """JN-18, AGG-10: orders of some years as quotations of suppliers; two thirds have details, the others only their old links."""
    quotes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quote"), F.col("o_custkey").alias("supplier"), F.col("o_orderdate").alias("day"))
    item = F.col("l_partkey")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("quote"), F.when(item % 4 != 0, item).alias("official"), F.when(item % 8 == 0, item).alias("orphan"))
    return staging.supplier_audit(quotes, links.where("quote % 3 <> 0"), links, "1996-01-01", "1999-12-31")


@query("select p_partkey, p_name, case when p_partkey % 3 = 0 then null else p_brand || ' <&\"> ' || p_type end as marked, p_retailprice, p_size from part")
def workbook_rows(spark, sf_dir):
    """SRC-01, SRC-12: parts written as workbooks of some thousand rows each and read back by their headers."""
    p = table(spark, sf_dir, "part")
    marked = F.when(F.col("p_partkey") % 3 != 0, F.concat("p_brand", F.lit(' <&"> '), "p_type"))
    sheet = p.select("p_partkey", "p_name", marked.alias("marked"), "p_retailprice", "p_size")
    cells = spreadsheets.sheet_cells(spreadsheets.workbooks(sheet)).where("row > 1")
    kinds = {"p_partkey": "bigint", "p_retailprice": "double", "p_size": "int"}
    return cells.select(*(F.get("cells", F.lit(i)).cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(sheet.columns)))
