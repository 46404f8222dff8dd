"""Queries of mapped records, supplier rows, quotations and counters over the driver's tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewren.functions import drugs, records, similarity
from pricewren.functions.text import dose_tokens
from pricewren.operators import merge, quotation, search, topk
from pricewren.plans.catalog import SQL as CATALOG_SQL
from pricewren.plans.queries import PRICES, ROW, TIE, prices, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """with l as (select *, l_linenumber % 3 as g from lineitem), m as (select l_orderkey || '-' || lpad(cast(l_linenumber as varchar), 2, '0') as id_cum,
case when l_partkey % 4 = 3 then null when l_partkey % 4 < 2 then 'INS' else 'COM' end as canal_mercado, case when g = 2 then null when l_suppkey % 5 in (1, 2, 3) then l_suppkey % 5 end as regimen_precios,
case when g = 2 then null else round(l_extendedprice, 2) end as precio_regulado_maximo, case when g = 0 then l_returnflag end as acto_administrativo_precio, round(l_quantity, 2) as precio_sismed_minimo,
case when g = 1 then null else round(l_tax, 2) end as precio_sismed_maximo, case when g = 2 then strftime(l_shipdate, '%Y/%m/%d') else '' end as fechacorte from l)
select id_cum, canal_mercado, cast(regimen_precios as bigint) as regimen_precios, precio_regulado_maximo, acto_administrativo_precio, precio_sismed_minimo, precio_sismed_maximo, fechacorte from m where canal_mercado is not null"""
)
def market_prices(spark, sf_dir):
    """PRJ-03: market prices under three generations of names. In the second a null stands in the preferred column and wins over a later one."""
    line = table(spark, sf_dir, "lineitem")
    text = lambda c: F.format_number(c, 2)
    kind = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 4 + 1).cast("int"))
    key, seq = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    regime = (F.col("l_suppkey") % 5).cast("string")
    of = lambda k, **columns: line.where(F.col("l_linenumber") % 3 == k).select(*(c.alias(n) for n, c in columns.items()))
    first = of(0, expediente=key, consecutivocum=seq, canal=kind("INS", "i", "com", "OTRO"), regimen=regime, acto_administrativo=F.col("l_returnflag"), precio_maximo_venta_regulado=text("l_extendedprice"), precio_minimo_venta=text("l_quantity"), precio_maximo_venta=text("l_tax"))
    second = of(1, expediente=key, consecutivo=seq, canal_mercado=kind("Institucional", "INS", "C", None), regimen_precios=regime, precio_maximo_regulado=text("l_extendedprice"), precio_minimo=text("l_quantity"), precio_maximo=F.lit(None).cast("string"), preciomax=text("l_tax"))
    third = of(2, expedientecum=key, consecutivo=seq, consecutivocum=F.lit("99"), transaccionsismeddesc=kind("TRANSACCION PRIMARIA INSTITUCIONAL", "transaccion secundaria institucional", "TRANSACCION PRIMARIA COMERCIAL", "ninguna"), valorminimo=text("l_quantity"), valormaximo=text("l_tax"), fechacorte=F.date_format("l_shipdate", "yyyy/MM/dd"))
    out = records.market_prices(first).unionByName(records.market_prices(second)).unionByName(records.market_prices(third))
    money = [F.col(c).cast("double").alias(c) for c in ("precio_regulado_maximo", "precio_sismed_minimo", "precio_sismed_maximo")]
    return out.select("id_cum", "canal_mercado", "regimen_precios", "acto_administrativo_precio", "fechacorte", *money)


@query(
    r"""with c as (select cast(p_partkey as varchar) as id_cum, case when p_partkey % 3 = 0 then null else p_name || '  X' || p_size end as d, p_type as p, case when p_partkey % 2 = 0 then p_brand end as pa, ['Vigente', 'ACTIVO', 'Vencido', null][p_partkey % 4 + 1] as st from part),
n as (select id_cum, lower(trim(regexp_replace(coalesce(d, p, '') || ' ' || coalesce(pa, ''), '\s+', ' ', 'g'))) as nombre_limpio, pa as principio_activo, st as estado_cum, lower(coalesce(st, '')) in ('vigente', 'activo') as activo from c)
select id_cum, nombre_limpio, principio_activo, estado_cum, activo, 'pending' as embedding_status from n union all select cast(-1 - p_partkey as varchar), 'old', null, null, true, 'ready' from part"""
)
def catalog_products(spark, sf_dir):
    """PRJ-06, SNK-05: the product table after catalog rows are merged in by key; what isn't in them stays."""
    p, null = table(spark, sf_dir, "part"), F.lit(None).cast("string")
    state = F.element_at(F.array(F.lit("Vigente"), F.lit("ACTIVO"), F.lit("Vencido"), null), (F.col("p_partkey") % 4 + 1).cast("int"))
    described = F.when(F.col("p_partkey") % 3 != 0, F.format_string("%s  X%d", "p_name", "p_size"))
    rows = p.select(
        F.col("p_partkey").cast("string").alias("id_cum"), described.alias("descripcioncomercial"), F.col("p_type").alias("producto"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("principioactivo"), state.alias("estadocum"), *(null.alias(c) for c in ("titular", "formafarmaceutica", "registrosanitario", "atc"))
    )
    fresh = records.products(rows)
    old = p.select(F.explode(F.array(F.col("p_partkey"), -1 - F.col("p_partkey"))).alias("k"))
    old = old.select(F.col("k").cast("string").alias("id_cum"), F.lit("old").alias("nombre_limpio"), *(null.alias(c) for c in ("laboratorio", "principio_activo", "forma_farmaceutica", "registro_invima", "atc", "estado_cum")), F.lit(True).alias("activo"), F.lit("ready").alias("embedding_status"))
    return merge.merge(old, fresh, ["id_cum"]).select("id_cum", "nombre_limpio", "principio_activo", "estado_cum", "activo", "embedding_status")


def _supplier_frame(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_linenumber") % 4 == 3, F.lit("N/A")).otherwise(F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"))
    return line.select(
        F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit("-01 "))).alias("cum"), price.alias("valor"), F.when(F.col("l_linenumber") % 2 == 0, "USD").alias("moneda"),
        F.concat(F.lit(" Caja  No. "), F.col("l_suppkey").cast("string"), F.lit(" (A*B) ")).alias("descripcion"), F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("centro_distribucion"),
    )


_SUPPLIER = """(select case when l_partkey % 5 <> 0 then l_partkey || '-01' else '' end as cum, round(l_extendedprice, 2) as price, case when l_linenumber % 2 = 0 then 'USD' else 'COP' end as moneda, 'Caja  No. ' || l_suppkey || ' (A*B)' as texto, 'caja no. ' || l_suppkey || '  a b' as plain, l_orderkey || '/' || l_linenumber as centro from lineitem where l_linenumber % 4 <> 3)"""


@query(f"select cum, price as precio_proveedor, null::double as porcentaje_aumento, texto as texto_original, '' as laboratorio_raw, moneda, centro as centro_distribucion from {_SUPPLIER}")
def supplier_rows(spark, sf_dir):
    """PRJ-07: a supplier's file by a map of its columns; missing ones get their defaults, rows without a price go."""
    out = records.supplier_rows(_supplier_frame(spark, sf_dir), "D1", "Prov", "2024-01-31", {"precio_proveedor": "valor"})
    return out.select("cum", "precio_proveedor", "porcentaje_aumento", "texto_original", "laboratorio_raw", "moneda", "centro_distribucion")


@query(f"select centro, sha1('d1|prov|2024-01-31|' || cum || '|' || centro || '|' || plain || '|' || cast(price as varchar)) as row_key, sha1('d1|prov|2024-01-31|' || cum || '|' || plain || '|||' || cast(price as varchar)) as orphan_key from {_SUPPLIER}")
def supplier_keys(spark, sf_dir):
    """FN-HASH-01: keys of a supplier's rows and of orphans, from fields in a regular form."""
    out = records.supplier_rows(_supplier_frame(spark, sf_dir), "D1", "Prov", "2024-01-31", {"precio_proveedor": "valor"})
    return out.select(F.col("centro_distribucion").alias("centro"), records.row_key().alias("row_key"), records.row_key(True).alias("orphan_key"))


_QUOTED = f"""with best as (select * from (select *, row_number() over (partition by l_partkey order by price, {ROW}) as rn, count(*) over (partition by l_partkey) as n from {PRICES}) where rn = 1),
q as (select o_orderkey, o_orderpriority as nombre_input, case when o_custkey % 4 = 0 then 'NO_MATCH' when o_custkey % 7 = 0 then 'ERROR' else 'EXACT' end as match_stage, case when o_custkey % 4 = 0 or o_custkey % 7 = 0 then null else o_custkey end as item from orders),
r as (select q.*, p_partkey, p_name, p_type, p_size, p_retailprice, price, l_suppkey, n, s_name, l_shipdate from q left join part on p_partkey = item left join best on l_partkey = p_partkey left join supplier on s_suppkey = l_suppkey)"""


def _quoted(spark, sf_dir):
    """Orders as quotation rows: the customer's number stands for the item that a name was matched to, if it was."""
    best = prices(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_partkey")))
    best = topk.first_of(best, ["l_partkey"], [F.col("price").asc_nulls_last(), *TIE]).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")
    found = F.struct(F.col("s_name").alias("proveedor_nombre"), F.col("price").alias("precio_unitario"), F.lit(None).cast("double").alias("precio_unidad"), F.lit(None).cast("double").alias("precio_presentacion"), F.lit("0.19").cast("decimal(5,4)").alias("porcentaje_iva"), F.to_date("l_shipdate").alias("vigente_desde"), F.lit(None).cast("date").alias("vigente_hasta"), F.lit(None).cast("string").alias("fecha_publicacion"))
    best = best.select(F.col("l_partkey").alias("p_partkey"), found.alias("mejor_precio"), "n")
    no, bad = F.col("o_custkey") % 4 == 0, F.col("o_custkey") % 7 == 0
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("nombre_input"), F.when(no, "NO_MATCH").when(bad, "ERROR").otherwise("EXACT").alias("match_stage"), F.when(~(no | bad), F.col("o_custkey")).alias("p_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("nombre_matcheado"), F.col("p_type").alias("forma_farmaceutica"), F.format_string("%d mg", "p_size").alias("concentracion"), (F.col("p_size") > 25).alias("es_regulado"))
    out = q.join(p, "p_partkey", "left").join(best, "p_partkey", "left")
    return out.withColumn("cum_id", F.when(F.col("nombre_matcheado").isNotNull(), F.col("p_partkey").cast("string"))).withColumn("precios_count", F.coalesce("n", F.lit(0))).withColumn("match_confidence", F.when(F.col("match_stage") == "EXACT", 1.0).otherwise(0.0))


@query(
    _QUOTED + """ select o_orderkey, nombre_input, match_stage as match_estado, cast(case when match_stage = 'EXACT' then 1 else 0 end as double) as match_confianza, coalesce(cast(p_partkey as varchar), '') as cum_id, coalesce(p_name, '') as principio_activo, coalesce(p_type, '') as forma_farmaceutica,
case when p_partkey is null then '' else p_size || ' mg' end as concentracion, coalesce(s_name, '') as proveedor_mejor, price as precio_unitario, null::double as precio_unidad_min, null::double as precio_presentacion, case when price is not null then 19.0::double end as iva_pct, coalesce(cast(cast(l_shipdate as date) as varchar), '') as vigente_desde, '' as vigente_hasta, '' as fecha_precio,
coalesce(n, 0) as num_proveedores, case when price is null then 'SI' else 'NO' end as sin_precio, case when match_stage in ('NO_MATCH', 'ERROR') then 'SI' else 'NO' end as sin_match from r"""
)
def quotation_flat(spark, sf_dir):
    """PRJ-12, SNK-10: all eighteen columns of quotation rows."""
    rows = _quoted(spark, sf_dir)
    # the order's number goes along inside the name and is taken out again, so that rows can be told apart
    flat = quotation.flat_rows(rows.withColumn("nombre_input", F.concat_ws("#", "o_orderkey", "nombre_input")))
    return flat.withColumn("o_orderkey", F.substring_index("nombre_input", "#", 1).cast("long")).withColumn("nombre_input", F.regexp_replace("nombre_input", "^[0-9]+#", ""))


@query(
    _QUOTED + """ select kind, o_orderkey from r, (select unnest(['match', 'nomatch', 'noprecio', 'regulados']) as kind) where (contains(lower(nombre_input), 'urgent') or contains(lower(coalesce(p_name, '')), 'red'))
and case kind when 'match' then match_stage <> 'NO_MATCH' when 'nomatch' then match_stage = 'NO_MATCH' when 'noprecio' then price is null else coalesce(p_size > 25, false) end"""
)
def quotation_filters(spark, sf_dir):
    """FLT-14: rows by each filter, and a text in the name or the match."""
    rows = _quoted(spark, sf_dir)
    parts = [quotation.shown(rows, word, kind).select(F.lit(kind).alias("kind"), "o_orderkey") for kind in ("match", "nomatch", "noprecio", "regulados") for word in ("URGENT", "red")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


@query(
    f"""with b as (select *, min(price) over (partition by l_partkey) as lo from {PRICES}), d as (select b.*, p_retailprice, case when price <> lo then (price - lo) / lo * 100 end as dev from b left join part on p_partkey = l_partkey)
select l_partkey, l_suppkey, l_orderkey, l_linenumber, price = lo as is_best, floor(dev * 10000 + 0.5) / 10000 as deviation, case when dev <= 5 then 'low' when dev <= 20 then 'medium' when dev is not null then 'high' end as band, l_partkey % 2 = 0 and price > p_retailprice as exceeds from d"""
)
def price_comparison(spark, sf_dir):
    """CMP-02: every price against the item's best one and the ceiling, which half of the items have."""
    low = prices(spark, sf_dir).groupBy("l_partkey").agg(F.min("price").alias("lo"))
    ceiling = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("p_retailprice"))
    out = prices(spark, sf_dir).join(low, "l_partkey").join(ceiling, "l_partkey", "left").withColumn("v", quotation.compared(F.col("price"), F.col("lo"), F.col("p_retailprice")))
    return out.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "v.is_best", (F.floor(F.col("v.deviation") * 10000 + 0.5) / 10000).alias("deviation"), "v.band", "v.exceeds")


@query(f"select l_partkey, l_orderkey, l_linenumber, l_suppkey, floor((price / p_retailprice - 1) * 100 * 10000 + 0.5) / 10000 as pct, case when price / p_retailprice > 1 then 'SUPERA_REGULADO' else 'RATIO_SOSPECHOSO_FUERA_RANGO_5_100' end as motivo from {PRICES} join part on p_partkey = l_partkey where price / p_retailprice > 1 or price / p_retailprice < 0.05")
def ceiling_alerts(spark, sf_dir):
    """PRJ-16: per cent above or below the ceiling, with the reason."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    r = prices(spark, sf_dir).join(p, "l_partkey").withColumn("ratio", F.col("price") / F.col("p_retailprice")).where("ratio > 1 or ratio < 0.05")
    reason = F.when(F.col("ratio") > 1, "SUPERA_REGULADO").otherwise("RATIO_SOSPECHOSO_FUERA_RANGO_5_100")
    return r.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", (F.floor((F.col("ratio") - 1) * 100 * 10000 + 0.5) / 10000).alias("pct"), reason.alias("motivo"))


@query(
    """select l_suppkey, count(*) as total, count(*) filter (l_partkey % 5 <> 0) as con_cum, count(*) filter (l_partkey % 5 = 0) as sin_cum, count(*) filter (l_returnflag = 'N') as auto_aprobados, count(*) filter (l_linestatus = 'O') as fechas_indefinidas,
floor(sum(case when l_linenumber % 3 = 0 then 0 else l_discount end::decimal(18,4))::double / count(*) * 1000000 + 0.5) / 1000000 as confianza from lineitem group by 1"""
)
def ingest_counters(spark, sf_dir):
    """AGG-02, AGG-15: an ingest's rows with and without a key, approved, without an end, and their mean confidence, where none counts as 0."""
    line = table(spark, sf_dir, "lineitem")
    sure = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).cast("decimal(18,4)")
    out = line.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_partkey") % 5 != 0).alias("con_cum"), F.count_if(F.col("l_partkey") % 5 == 0).alias("sin_cum"), F.count_if(F.col("l_returnflag") == "N").alias("auto_aprobados"), F.count_if(F.col("l_linestatus") == "O").alias("fechas_indefinidas"),
        (F.floor(F.sum(F.coalesce(sure, F.lit(0).cast("decimal(18,4)"))).cast("double") / F.count(F.lit(1)) * 1000000 + 0.5) / 1000000).alias("confianza"),
    )
    return out


@query(
    """select p_partkey, case p_partkey % 4 when 0 then p_size || 'mg|5ml' when 1 then '' when 2 then '' else p_size || 'ui' end as doses,
case p_partkey % 4 when 0 then p_name || ' ' || p_size || ' MG / ' || p_size % 7 || ',5 ml x ' || p_size || ' mg' when 1 then p_name || ' (' || p_size || ' %)' when 2 then p_name || ' ' || p_size || ' mg ' || p_size % 9 || '.5 ml' else p_name || '  ' || p_size || 'UI/dosis' end as described from part"""
)
def product_doses(spark, sf_dir):
    """FN-STR-06, FN-STR-07, FN-STR-09: doses in product texts, each once, and descriptions that get the doses of the trade name where they have none."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    text = F.when(k == 0, F.format_string("%s %d MG / %d,5 ml x %d mg", "p_name", size, size % 7, size)).when(k == 1, F.format_string("%s (%d %%)", "p_name", size)).when(k == 2, F.col("p_name")).otherwise(F.format_string("%s  %dUI/dosis", "p_name", size))
    trade = F.format_string("%s %d MG %d.5 ML X 30", F.upper("p_brand"), size, size % 9)
    # a comma isn't kept in such texts, and a per cent sign ends a dose only before a letter or digit, where a word ends
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(dose_tokens(text), "|").alias("doses"), records.with_doses(text, trade).alias("described"))


@query(
    r"""with t as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents), f as (select doc_id, len(w) as n, word, len(list_filter(w, lambda x: x = word)) as tf from t, (select unnest(['the', 'er', 'rights', 'de', 'in']) as word)),
a as (select count(*) as docs, avg(len(w)) as mean from t), d as (select word, count_if(tf > 0) as df from f group by word), s as (select doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as score from f join d using (word), a group by doc_id having sum(tf) > 0)
select doc_id, floor(score * 1000000 + 0.5) / 1000000 as score from s order by 2 desc, 1 limit 8"""
)
def safe_search(spark, sf_dir):
    """FN-RNK-02: a query with signs that a search must not see, cut to its words; the eight best documents."""
    words = search.safe_words('THE +"er" rights~2 (de) && in:*')
    # "2" is a word of its own; no document of the tables has it often enough to matter, and it is left out here
    scored = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", [w for w in words if not w.isdigit()])
    return scored.select("doc_id", (F.floor(F.col("score") * 1000000 + 0.5) / 1000000).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(8)


@query("select p_partkey, p_name || ['|codeina', '(a+b)|c)', '[x+(y', ')|b(+c'][p_partkey % 4 + 1] as parts from part")
def plus_parts(spark, sf_dir):
    """FN-PARSE-05: names divided at plus signs outside signs that open and close, or don't."""
    ends = F.element_at(F.array(*map(F.lit, ("+codeina", "(a+b)+c)", "[x+(y", ")+b(+c"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(drugs.outside_plus(F.concat("p_name", ends)), "|").alias("parts"))


@query("select s_suppkey, (select p_name from part join lineitem on l_partkey = p_partkey where l_suppkey = s_suppkey and contains(p_name, 'red') order by p_name, p_partkey limit 1) as red_item from supplier")
def first_by_lookup(spark, sf_dir):
    """JN-11: for each supplier the first matching name among its items, null without one."""
    named = table(spark, sf_dir, "part").where(F.contains("p_name", F.lit("red"))).select("p_partkey", "p_name")
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).join(named, "p_partkey")
    least = sold.groupBy("s_suppkey").agg(F.min(F.struct("p_name", "p_partkey")).alias("x"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(least, "s_suppkey", "left").select("s_suppkey", F.col("x.p_name").alias("red_item"))


@query(
    """select p_partkey || '-' || p_size as id_cum, 'Vigente / Activo' as estado_regulatorio, lower(p_name) || ' acido ' || lower(p_type) as nombre_limpio, case when p_partkey % 3 = 0 then '' else p_brand end as laboratorio, case when p_partkey % 2 = 0 then 'B' else 'A' end as atc
from part where p_partkey % 5 <> 4"""
)
def master_records(spark, sf_dir):
    """PRJ-05: master rows twice each, of which the later one counts; every fifth isn't valid, and signs, marks and missing data are cleaned."""
    p, text = table(spark, sf_dir, "part"), lambda x: F.lit(x)
    def rows(place):
        atc = F.when((F.col("p_partkey") % 2 == 0) & F.lit(place == 1), "B").otherwise("A")
        columns = {
            "EXPEDIENTE": F.format_string(" %d", "p_partkey"), "CONSECUTIVO": F.col("p_size").cast("string"), "ATC": atc, "REGISTRO INVIMA": text("R"), "NOMBRE COMERCIAL": F.concat(F.upper("p_name"), text("®")), "PRINCIPIO ACTIVO": F.concat(text("ÁCIDO™  "), "p_type"),
            "FORMA FARMACEUTICA": text("SIN DATO"), "LABORATORIO TITULAR": F.when(F.col("p_partkey") % 3 == 0, "Sin Dato").otherwise(F.col("p_brand")), "ESTADO REGISTRO": F.when(F.col("p_partkey") % 5 == 4, "Vencido").otherwise(" Vigente"), "ESTADO CUM": text("Activo"),
        }
        return p.select(*(c.alias(n) for n, c in columns.items()), F.lit(place).alias("place"))

    out = records.master_rows(rows(0).unionByName(rows(1)), "place")
    return out.select("id_cum", "estado_regulatorio", "nombre_limpio", "laboratorio", "atc")


@query(
    """select printf('%d-%02d', o_orderkey, o_custkey) as id_cum, case when o_orderkey % 3 = 0 then 'Vencido' else o_orderstatus end as estadocum, 'vencidos' as estado_origen, cast(cast(o_orderdate as date) as varchar) as vence from orders"""
)
def dated_records(spark, sf_dir):
    """PRJ-01, PRJ-02: open-data records of an origin, whose state stands in where a record has none."""
    o = table(spark, sf_dir, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("expediente"), F.col("o_custkey").cast("string").alias("consecutivocum"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).otherwise("").alias("estadocum"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("fechavencimiento"))
    out = records.open_records(raw, "vencidos", "2026-03-20")
    return out.select("id_cum", "estadocum", "estado_origen", F.to_date("fechavencimiento").cast("string").alias("vence"))


@query(
    f"""with r as ({CATALOG_SQL["cover_ranks"]}), q as (select embedding as qe from embeddings where vec_id = 0), d as (select vec_id, 1 - list_cosine_similarity(embedding::double[], qe::double[]) as distance from embeddings, q)
select doc_id, rank, floor(distance * 10000 + 0.5) / 10000 as distance from r left join d on vec_id = doc_id order by rank desc, floor(distance * 10000 + 0.5) / 10000 asc nulls last, doc_id limit 10"""
)
def hybrid_search(spark, sf_dir):
    """SRT-01, FLT-03, FN-SIM-05: documents with all words by cover density, then by a vector's distance, then by key; the best ten."""
    ranked = search.cover_density(table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "que"]).select("doc_id", (F.floor(F.col("rank") * 1000000 + 0.5) / 1000000).alias("rank"))
    e = table(spark, sf_dir, "embeddings")
    row = e.where("vec_id = 0").select("embedding").first()
    at = F.array(*(F.lit(float(x)) for x in (row["embedding"] if row else [])))
    far = e.select(F.col("vec_id").alias("doc_id"), (F.floor((1 - similarity.cosine_similarity(F.col("embedding"), at)) * 10000 + 0.5) / 10000).alias("distance"))
    return search.best_hits(ranked.join(far, "doc_id", "left"), "doc_id")


@query("select l_orderkey, l_linenumber, l_suppkey, coalesce(case when l_linenumber % 2 = 0 then l_partkey end, o_custkey) as owner from lineitem left join (select o_orderkey + 1 as k, o_custkey from orders) on k = l_orderkey where coalesce(case when l_linenumber % 2 = 0 then l_partkey end, o_custkey) is not null")
def backfilled_rows(spark, sf_dir):
    """JN-10: a column filled from another table where it was null; rows in which it stays null go."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("owner"))
    source = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("k"), F.col("o_custkey").alias("owner"))
    return merge.backfill(lines, source, "k", "owner").withColumnRenamed("k", "l_orderkey")


@query("select p_partkey from part where lower(p_type) like '%e_o%y%'")
def like_filter(spark, sf_dir):
    """FLT-02: a part of a text with signs that stand for others."""
    return table(spark, sf_dir, "part").where(search.like_inside(F.col("p_type"), " E_O%Y ")).select("p_partkey")
