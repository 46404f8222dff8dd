"""Queries of catalog records, names of medicines and supplier files over the driver's tables, with SQL where it can express them.

Texts are written from the tables' columns, so that SQL tells from these what reading the texts has to give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewren.functions import catalog, drugs, numbers
from pricewren.operators import merge, search, topk
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


def _by_key(key: str, *values):
    """The value that a key's remainder picks."""
    return F.element_at(F.array(*values), (F.col(key) % len(values) + 1).cast("int"))


def _text(pattern: str, *columns: str):
    return F.format_string(pattern, *columns)


@query(
    """with p as (select *, p_partkey % 5 as v from part)
select p_partkey, case v when 3 then 'acetaminofen' when 2 then case when p_name < 'codeina' then p_name || ' / codeina' else 'codeina / ' || p_name end else p_name end as inn_query,
cast(case v when 2 then null when 3 then p_size * 1000 else p_size end as double) as value, case v when 0 then 'mg' when 1 then 'mg/mL' when 3 then 'IU/mL' when 4 then 'mg' end as unit,
case v when 0 then 'tableta' when 1 then 'solucion oral' when 2 then 'capsula blanda' when 3 then 'solucion inyectable' else 'crema' end as form,
case v when 0 then 'ORAL_SOLID' when 1 then 'ORAL_LIQUID' when 2 then 'ORAL_SOLID' when 3 then 'INJECTABLE' else 'TOPICAL' end as form_group,
v = 2 as is_combo, true as is_matchable, v = 1 and abs(20 - p_size) > 0.01 * p_size as inconsistent from p"""
)
def parsed_names(spark, sf_dir):
    """FN-PARSE-00 to FN-PARSE-17, LNK-00, LNK-08: names in five ways of writing, read once for each distinct name."""
    name = _by_key("p_partkey", _text("%s %dmg Tableta", "p_name", "p_size"), F.format_string("%s 2%% [%dmg/5mL] Solucion oral", "p_name", F.col("p_size") * 5), _text("%s + codeina %dmg + 37,5mg Cápsula blanda".replace("á", "a"), "p_name", "p_size"),
                   _text("%s (paracetamol) %d,000UI/mL Solucion inyectable Vial x 4mL", "p_name", "p_size"), _text("%s [%dmg] Crema Tubo x 43g", "p_name", "p_size"))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    read = p.join(drugs.parse_names(p, "name"), "name")
    return read.select("p_partkey", "inn_query", F.col("concentration.value").cast("double").alias("value"), "concentration.unit", "form", "form_group", "is_combo", "is_matchable", F.array_contains("warnings", "BRACKET_RATIO_INCONSISTENT").alias("inconsistent"))


@query("select p_partkey, case when p_partkey % 3 = 0 then p_size = 25 when p_partkey % 3 = 1 then p_size = 5 else true end as same, p_partkey % 4 <> 1 as same_route from part")
def barriers(spark, sf_dir):
    """LNK-06, LNK-07, FN-PARSE-09, FN-PARSE-18: concentrations and routes of catalog texts against 25 mg (5 mg/mL) by mouth."""
    written = _by_key("p_partkey", _text("%d mg", "p_size"), F.format_string("[%dmg/10mL]", F.col("p_size") * 10), F.lit("as labelled"))
    form = _by_key("p_partkey", F.lit("Tabletas"), F.lit("Solución inyectable"), F.lit("who knows"), F.lit(None).cast("string"))
    asked = F.when(F.col("p_partkey") % 3 == 1, drugs.dose(F.lit("5 mg"))).otherwise(drugs.dose(F.lit("25mg")))
    wanted = F.when(F.col("p_partkey") % 3 == 1, asked.withField("unit", F.lit("mg/mL"))).otherwise(asked)
    ratio = F.when(F.col("p_partkey") % 3 == 1, drugs.bracket(F.regexp_replace(written, r"[\[\]]", ""))).otherwise(drugs.catalog_concentration(written))
    return table(spark, sf_dir, "part").select("p_partkey", drugs.same_concentration(wanted, ratio).alias("same"), drugs.form_barrier(F.lit("ORAL_SOLID"), form).alias("same_route"))


@query("select p_partkey, p_name || case when p_partkey % 4 = 3 then ' glucosamina' else ' 500 mg' end as name from part")
def pharma_texts(spark, sf_dir):
    """FN-STR-03, FN-STR-04: product texts without packs, forms, salts and codes."""
    raw = _by_key("p_partkey", _text("%s Trihidrato 500MG CAJA X 30 (oral) COL", "p_name"), _text("%s 500mg, Suspensión  FCOX50ML", "p_name"), _text("%s 500 MG blister 10 EOF", "p_name"), _text("%s GLUCO jarabe", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", catalog.pharma_text(raw).alias("name"))


@query(
    """select p_partkey, p_name as trade_name, case when p_partkey % 2 = 0 then p_name || '®' end as brand, case p_partkey % 3 when 0 then 'retardada' when 1 then 'liofilizado' end as release_type,
case p_partkey % 6 when 0 then 'Caja x ' || p_size when 1 then 'Blister x ' || p_size when 2 then 'Caja x ' || p_size when 3 then 'Frasco ' || p_size || '.5 ml' when 4 then p_size || ' ml' else null end as presentation,
case when p_partkey % 6 = 4 then cast(p_size as double) when p_partkey % 6 = 3 then 5.0 end as volume, cast(p_size as double) as quantity,
['tableta recubierta', 'cápsula dura', 'solución oral', 'polvo fino'][p_partkey % 4 + 1] as form, ['intravenosa', 'oral', 'tópica'][p_partkey % 3 + 1] as route from part"""
)
def text_macros(spark, sf_dir):
    """FN-STR-10 to FN-STR-16, FN-NUM-07, PRJ-11: fields of product texts."""
    release = _by_key("p_partkey", F.lit("LIBERACION RETARDADA"), F.lit("Liofilizado"), F.lit(""))
    sign = F.when(F.col("p_partkey") % 2 == 0, "®").otherwise("")
    product = F.concat(F.col("p_name"), sign, F.lit(" "), F.col("p_size"), F.lit(" mg tableta recubierta "))
    packed = _by_key("p_partkey", _text("Caja por %d tabletas", "p_size"), _text("BLISTER X %d", "p_size"), _text("%d cápsulas", "p_size"), _text("Frasco con %d,5 ml", "p_size"), _text("%d ml", "p_size"), F.lit("suelto"))
    form = _by_key("p_partkey", F.lit(" TABLETA RECUBIERTA "), F.lit("CÁPSULA DURA"), F.lit("solucion oral"), F.lit("Polvo (fino)"))
    way = F.when(F.col("p_partkey") % 3 == 1, "ORAL").when(F.col("p_partkey") % 3 == 0, "SIN DATO")
    of = F.when(F.col("p_partkey") % 3 == 0, "Solución INYECTABLE").otherwise("crema")
    return table(spark, sf_dir, "part").select(
        "p_partkey", catalog.trade_name(product).alias("trade_name"), catalog.brand(product).alias("brand"), catalog.release_type(F.concat(product, release)).alias("release_type"), catalog.presentation(packed).alias("presentation"),
        catalog.solution_volume(packed).alias("volume"), catalog.dose_quantity(F.col("p_size").cast("string")).alias("quantity"), catalog.plain_form(form).alias("form"), catalog.route(way, of).alias("route"),
    )


@query(
    """select o_orderkey, printf('%d-%02d', o_orderkey, o_custkey % 200) as record_key, cast(cast(o_orderdate as date) as varchar) as issued, case o_orderkey % 5 when 0 then 'INS' when 1 then 'COM' when 2 then 'INS' when 3 then 'COM' end as channel,
case when o_orderkey % 4 in (1, 2, 3) then o_orderkey % 4 end as regime, case when o_orderkey % 3 = 0 then 'Vigente' else o_orderstatus end as state, o_orderkey % 2 = 0 as sample, case when o_orderkey % 3 = 1 then '' else o_orderpriority end as priority from orders"""
)
def catalog_records(spark, sf_dir):
    """PRJ-01, PRJ-02, PRJ-05, FN-STR-19, FN-STR-24, FN-DT-02, FN-NUM-05, FN-NUM-06: raw records mapped; rows without a key go."""
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    issued = _by_key("o_orderkey", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy"))
    sold = _by_key("o_orderkey", F.lit("Transaccion primaria INSTITUCIONAL"), F.lit("transaccion secundaria comercial"), F.lit(" i "), F.lit("COM"), F.lit("otro"))
    state = catalog.or_default(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")), F.lit("Vigente"))
    key = catalog.record_key(F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 200).cast("string"))
    mapped = o.select("o_orderkey", key.alias("record_key"), F.to_date(catalog.instant(issued)).cast("string").alias("issued"), catalog.channel(sold).alias("channel"), numbers.regime((F.col("o_orderkey") % 4).cast("string")).alias("regime"), state.alias("state"),
                      catalog.is_yes(_by_key("o_orderkey", F.lit("Sí"), F.lit("no"))).alias("sample"), catalog.no_data(F.when(F.col("o_orderkey") % 3 == 1, "Sin Dato").otherwise(F.col("o_orderpriority"))).alias("priority"))
    return mapped.where("record_key is not null")


@query("select p_partkey, case when p_partkey % 2 = 1 and p_retailprice < 1000 then cast(round(p_retailprice * 100) as double) else round(p_retailprice, 2) end as price from part")
def currency_prices(spark, sf_dir):
    """FN-NUM-04: prices with dots or commas for thousands; a comma alone is dropped."""
    us = F.concat(F.lit("$ "), F.format_number("p_retailprice", 2))
    european = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(catalog.currency(F.when(F.col("p_partkey") % 2 == 0, us).otherwise(european)), 2).alias("price"))


@query(
    """with k as (select s_suppkey, s_suppkey % 12 as k from supplier)
select s_suppkey, ['TECNOQUIMICAS', 'LA_SANTE', 'MEGALABS', 'MK', 'COASPHARMA', 'SANOFI', 'FRESENIUS', 'LA_SANTE', 'TECNOQUIMICAS', 'PROCAPS', null, null][k + 1] as code,
case when k < 6 then 0.95 when k < 10 then 0.9 else 0.0 end::double as confidence, case when k < 6 then 'filename' when k < 10 then 'header' else 'unknown' end as method from k"""
)
def supplier_detection(spark, sf_dir):
    """FN-STR-22, ARR-04: who sent a file, by its name or its headers; names and headers vary with the supplier's columns."""
    k, by_name = F.col("s_suppkey") % 12, F.regexp_replace("s_name", "[^A-Za-z0-9]", "_")
    number = F.col("s_suppkey").cast("string")
    names = [("in/", " TecnoQuimicas ", ".xlsx"), ("c:\\x\\", " LISTA la sante ", ".csv"), ("MK/", "-MEGALAB-", ".v2.tsv"), ("", " mk ", ".csv"), ("pfizer/", "Coas Pharma", ".txt"), ("", "_SANOFI_", ".xls")]
    plain = F.concat(F.lit("roche/bayer/"), by_name, F.lit("-"), number, F.lit(".csv"))
    file = F.coalesce(*(F.when(k == i, F.concat(F.lit(folder), number, F.lit(stem), by_name, F.lit(end))) for i, (folder, stem, end) in enumerate(names)), plain)
    heads = {6: (" CUM", "Precio", "Vigente desde", "vigente hasta "), 7: ("CUM ", "PRECIO", "Descripcion"), 8: ("Codigo CUM", " Producto", "precio UNITARIO"), 9: ("Reg. Invima", "descripcion", "Precio"), 10: ("cum", "descripcion")}
    rest = F.array(F.lit("precio"), F.concat(F.lit("x"), number))
    columns = F.coalesce(*(F.when(k == i, F.array(F.concat(F.lit("col "), by_name), *map(F.lit, head))) for i, head in heads.items()), rest)
    return table(spark, sf_dir, "supplier").select("s_suppkey", catalog.supplier_of(file, columns).alias("v")).select("s_suppkey", "v.*")


@query("select l_orderkey, round(1 - min(l_discount), 4) as confidence, case when min(l_discount) <= 0.01 then first(l_partkey order by l_linenumber, l_partkey, l_suppkey) end as id, min(l_discount) <= 0.01 as approved from lineitem group by 1")
def auto_approval(spark, sf_dir):
    """FN-SCO-03: an order's lines as suggestions in their order, scored by discount."""
    s = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (1 - F.col("l_discount")).alias("score")))), lambda x: F.struct(x["l_partkey"].alias("id"), x["score"].alias("score")))
    out = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(s.alias("s"))
    return out.select("l_orderkey", catalog.approve(F.col("s")).alias("v")).select("l_orderkey", "v.*")


@query("select p_partkey from part where lower(p_name) like '%cold%' and (lower(p_name) like '%24%' or abs(p_size - 24) <= 0.51)")
def fallback_search(spark, sf_dir):
    """FLT-04, FLT-05: all words of a search text, and any of its numbers in the text or within 0.51 of the dose."""
    return table(spark, sf_dir, "part").where(search.fallback("Cold24 MG tableta", F.col("p_name"), F.col("p_size"))).select("p_partkey")


_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(
    f"""with t as (select doc_id, {_TOKENS} as w from documents), p as (select doc_id, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the') as a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'que') as b from t),
s as (select doc_id, a, b, unnest(list_concat(a, b)) as s from p where len(a) > 0 and len(b) > 0), e as (select *, list_min(list_filter(a, lambda x: x >= s)) as ea, list_min(list_filter(b, lambda x: x >= s)) as eb from s),
c as (select doc_id, a, b, greatest(ea, eb) as e, max(s) as s from e where ea is not null and eb is not null group by all)
select doc_id, floor(sum(0.1 / (1 + (e - s) - (len(list_filter(list_concat(a, b), lambda x: x between s and e)) - 1))) * 1000000 + 0.5) / 1000000 as rank from c group by doc_id"""
)
def cover_ranks(spark, sf_dir):
    """FN-RNK-01: cover density of two words in every document that has both."""
    ranked = search.cover_density(table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "que"])
    return ranked.select("doc_id", (F.floor(F.col("rank") * 1000000 + 0.5) / 1000000).alias("rank"))


@query("select pattern, p_partkey from (select pattern, p_partkey, row_number() over (partition by pattern order by p_partkey) as n from part, (select unnest(['red', 'cold', 'widget', 'small']) as pattern) where lower(p_name) like '%' || pattern || '%') where n <= 100")
def regulated_items(spark, sf_dir):
    """FLT-10: the first hundred items that contain each of some patterns, a top-k report."""
    hits = F.filter(F.array(*map(F.lit, ("red", "cold", "widget", "small"))), lambda x: F.contains(F.lower("p_name"), x))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(hits).alias("pattern"))
    return topk.top_k(found, ["pattern"], [F.col("p_partkey")], 100).select("pattern", "p_partkey")


@query("select o_orderkey, o_custkey from orders where upper(o_orderstatus) = 'F' and o_orderdate between timestamp '1996-01-01' and timestamp '1997-12-31'")
def active_quotations(spark, sf_dir):
    """FLT-01, FLT-12, FLT-13: rows of a state, letter case aside, in a range of dates."""
    between = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp"))
    return table(spark, sf_dir, "orders").where((F.upper("o_orderstatus") == "F") & between).select("o_orderkey", "o_custkey")


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as k, coalesce(json_extract_string(props, '$.name'), 'unknown') as name, event_type || ':' || cast(user_id as varchar) as label, epoch_ms(cast(user_id * 1000 as bigint)) as at from events")
def nested_fields(spark, sf_dir):
    """JSN-02, JSN-03, FN-DT-03: fields of nested results with defaults, and epoch seconds."""
    read = F.from_json("props", "k long, name string")
    e = table(spark, sf_dir, "events").withColumn("v", read)
    return e.select("event_id", F.coalesce("v.k", F.lit(0)).alias("k"), F.coalesce("v.name", F.lit("unknown")).alias("name"), F.get_json_object(F.to_json(F.struct(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("x"))), "$.x").alias("label"), F.timestamp_seconds("user_id").cast("timestamp_ntz").alias("at"))


@query("select 'brand' as kind, p_brand as source, cast(count(*) as bigint) as n from part group by all union all select 'type', p_type, count(*) from part group by all union all select 'edge', p_brand || '>' || p_type, count(*) from part group by all")
def graph_tables(spark, sf_dir):
    """SNK-14, JN-17: vertices and edges of the catalog graph, with how many items each stands for."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("source")), F.struct(F.lit("type").alias("kind"), F.col("p_type").alias("source")), F.struct(F.lit("edge").alias("kind"), F.concat_ws(">", "p_brand", "p_type").alias("source")))
    return p.select(F.explode(kinds).alias("v")).groupBy("v.kind", "v.source").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with best as (select l_partkey, price, l_suppkey from (select *, row_number() over (partition by l_partkey order by price, {ROW}) as rn from {PRICES}) where rn = 1)
select o_orderkey, l_linenumber, l_partkey, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey_) as line, p_name, coalesce(price, 0) as price, case when p_partkey is null then 'NO_MATCH' when price is null then 'NO_PRICE' when price > p_retailprice then 'ABOVE_CEILING' else 'OK' end as state
from (select o_orderkey, l_linenumber, l_partkey, l_suppkey as l_suppkey_ from orders join lineitem on l_orderkey = o_orderkey) left join part on p_partkey = l_partkey and p_size <= 40 left join best using (l_partkey)"""
)
def quotation_export(spark, sf_dir):
    """JN-06, PRJ-12, PRJ-16, SNK-10, FLT-14: quotation lines joined to their match and its best price, flat."""
    lines = table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey"), "o_orderkey")
    kept = lambda c: F.when(F.col("p_size") <= 40, F.col(c)).alias(c)
    match = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), kept("p_name"), kept("p_retailprice"))
    best = topk.first_of(prices(spark, sf_dir), ["l_partkey"], [F.col("price").asc_nulls_last(), *TIE]).select("l_partkey", "price")
    place = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    state = F.when(F.col("p_name").isNull(), "NO_MATCH").when(F.col("price").isNull(), "NO_PRICE").when(F.col("price") > F.col("p_retailprice"), "ABOVE_CEILING").otherwise("OK")
    out = lines.join(match, "l_partkey", "left").join(best, "l_partkey", "left").withColumn("line", place)
    return out.select("o_orderkey", "l_linenumber", "l_partkey", "line", "p_name", F.coalesce("price", F.lit(0.0)).alias("price"), state.alias("state"))


@query(
    """select o_orderkey, ['APROBADO', 'APROBADO', 'RECHAZADO', 'PENDIENTE', 'PENDIENTE', null][o_orderkey % 6 + 1] as state,
case when o_orderkey % 4 = 0 then 'DESCONOCIDA' else o_orderpriority end as company from orders"""
)
def staging_states(spark, sf_dir):
    """PRJ-17, PRJ-18: states of older rows made regular, and a default company."""
    raw = _by_key("o_orderkey", F.lit(" aprobado"), F.lit("auto_aprobado "), F.lit("Rechazado"), F.lit("PENDIENTE"), F.lit("otro"), F.lit(None).cast("string"))
    company = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.homologation_state(raw).alias("state"), F.coalesce(company, F.lit("DESCONOCIDA")).alias("company"))


@query("select l_orderkey, l_linenumber, l_suppkey, case when l_linenumber % 2 = 0 then l_partkey else p_partkey end as item, l_extendedprice as price, '2026-01-01' as published from lineitem left join part on p_partkey = l_partkey and p_size <= 40")
def published_prices(spark, sf_dir):
    """PRJ-09: staged rows with their own item or, without one, the catalog's, at one time of publication."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_extendedprice").alias("price"))
    items = table(spark, sf_dir, "part").select(F.when(F.col("p_size") <= 40, F.col("p_partkey")).alias("found"), F.col("p_partkey").alias("l_partkey"))
    own = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey"))
    return lines.join(items, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce(own, "found").alias("item"), "price", F.lit("2026-01-01").alias("published"))


@query("select distinct p_partkey, p_name from part join lineitem on l_partkey = p_partkey where l_suppkey = 1")
def items_of_supplier(spark, sf_dir):
    """JN-02: items that one supplier has prices for, each once."""
    sold = table(spark, sf_dir, "lineitem").where("l_suppkey = 1").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(sold, "p_partkey", "left_semi")


@query("select p_partkey, p_name, coalesce(m, p_retailprice) as p_retailprice from part left join (select l_partkey, min(l_extendedprice / l_quantity) as m from lineitem where l_returnflag = 'R' group by 1) on l_partkey = p_partkey")
def refreshed_prices(spark, sf_dir):
    """JN-10: prices replaced by the least one of returned lines where there is one."""
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") / F.col("l_quantity"))
    least = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(returned).alias("p_retailprice"))
    return merge.refresh(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), least, "p_partkey", ["p_retailprice"])


@query(f"select p_partkey, p_name, m as market, p_size <= 40 as regulated from part left join (select l_partkey, min(price) as m from {PRICES} group by 1) on l_partkey = p_partkey")
def item_rows(spark, sf_dir):
    """JN-03, PRJ-13: each item with its market price, if any, and whether it is among the regulated ones."""
    market = prices(spark, sf_dir).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("price").alias("market"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    ceilings = parts.select("p_partkey", F.when(F.col("p_size") <= 40, True).alias("held"))
    return parts.join(market, "p_partkey", "left").join(ceilings, "p_partkey", "left").select("p_partkey", "p_name", "market", F.col("held").isNotNull().alias("regulated"))


@query("select s_suppkey, count(*) as n_lines, count(distinct p_partkey) as n_items from supplier join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey group by 1")
def supplier_items(spark, sf_dir):
    """JN-19: how many prices each supplier has, and of how many items."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    known = sold.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return known.groupBy("s_suppkey").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_items"))


@query("select * from (select p_partkey, p_name, case when p_partkey % 3 > 0 then p_partkey end as item from part where lower(p_name) like '%red%' order by p_name, p_partkey limit 50) where item is not null")
def suggestions_with_ids(spark, sf_dir):
    """SRT-03, FLT-16: the first fifty names; those without an item go only then, so fewer may stay."""
    named = table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("red"))).select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")).alias("item"))
    return named.orderBy("p_name", "p_partkey").limit(50).where("item is not null")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 5")
def first_staged_rows(spark, sf_dir):
    """SRT-06, SRT-07: the first five rows by file and row number."""
    place = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(*place).orderBy(*place).limit(5)
