"""Queries over the driver's tables: catalog = part, prices = lineitem, quotations = orders, audit log = events.

Each entry is a DataFrame function and, where SQL can express it, the same in DuckDB's SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.functions import catalog as catalog_functions
from pricewren.functions import numbers, similarity, text
from pricewren.operators import fuzzy, linkage, merge, quality, search, topk
from pricewren.streaming.incremental import above_mark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


TIE = ["l_orderkey", "l_linenumber", "l_suppkey"]
PRICES = "(select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_extendedprice / l_quantity as price from lineitem)"
ROW = "l_orderkey, l_linenumber, l_suppkey"


@query(f"select l_partkey, l_suppkey, price, cast(rn as integer) as rank from (select *, row_number() over (partition by l_partkey order by l_shipdate desc, {ROW}) as rn from {PRICES}) where rn <= 20")
def latest_prices_topn(spark, sf_dir):
    """AGG-03: the latest twenty prices of each item."""
    out = topk.top_k(prices(spark, sf_dir), ["l_partkey"], [F.col("l_shipdate").desc(), *TIE], 20)
    return out.select("l_partkey", "l_suppkey", "price", "rank")


@query(f"select l_partkey, price, coalesce(s_name, 'unknown') as s_name from (select *, row_number() over (partition by l_partkey order by price, {ROW}) as rn from {PRICES}) left join supplier on s_suppkey = l_suppkey where rn = 1")
def best_price_per_item(spark, sf_dir):
    """AGG-04, JN-05: the cheapest price of each item and who asks it."""
    best = topk.first_of(prices(spark, sf_dir), ["l_partkey"], [F.col("price").asc_nulls_last(), *TIE])
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return best.join(s, best["l_suppkey"] == s["s_suppkey"], "left").select("l_partkey", "price", F.coalesce("s_name", F.lit("unknown")).alias("s_name"))


#: Ceilings of the regulated items; others have none.
CEILINGS = "(select p_partkey, case when p_type <> 'ECONOMY' then p_retailprice end as p_retailprice from part)"


@query(f"select l_partkey, price, compliant, s_name from (select l_partkey, l_suppkey, price, price <= p_retailprice as compliant, row_number() over (partition by l_partkey order by coalesce(price <= p_retailprice, false) desc, price, {ROW}) as rn from {PRICES} left join {CEILINGS} on p_partkey = l_partkey) left join supplier on s_suppkey = l_suppkey where rn = 1")
def compliant_best_price(spark, sf_dir):
    """CMP-01, JN-04: the cheapest price below the regulated ceiling, else the cheapest; items without a ceiling are there too."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_type") != "ECONOMY", F.col("p_retailprice")).alias("p_retailprice"))
    all_ = prices(spark, sf_dir).join(p, "l_partkey", "left").withColumn("compliant", F.col("price") <= F.col("p_retailprice"))
    best = topk.first_of(all_, ["l_partkey"], [F.coalesce("compliant", F.lit(False)).desc(), F.col("price").asc_nulls_last(), *TIE])
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return best.join(s, "l_suppkey", "left").select("l_partkey", "price", "compliant", "s_name")


@query(f"select l_partkey, l_suppkey, l_orderkey, l_linenumber, pct, case when pct <= 5 then 'low' when pct <= 20 then 'medium' else 'high' end as band from (select *, floor((price - lo) / lo * 100 * 10000 + 0.5) / 10000 as pct from (select *, min(price) over (partition by l_partkey) as lo from {PRICES}))")
def price_deviation_bands(spark, sf_dir):
    """CMP-02: each price's deviation from the item's best one, in bands of 5 and 20 per cent."""
    low = prices(spark, sf_dir).groupBy("l_partkey").agg(F.min("price").alias("lo"))
    d = prices(spark, sf_dir).join(low, "l_partkey").withColumn("pct", F.floor((F.col("price") - F.col("lo")) / F.col("lo") * 100 * 10000 + 0.5) / 10000)
    band = F.when(F.col("pct") <= 5, "low").when(F.col("pct") <= 20, "medium").otherwise("high")
    return d.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "pct", band.alias("band"))


@query(f"with m as (select l_partkey, min(price) as market from {PRICES} group by 1), e as (select p_partkey, p_brand, least(p_retailprice, coalesce(market, p_retailprice)) as effective from part left join m on l_partkey = p_partkey) select p_partkey, effective, effective = min(effective) over (partition by p_brand) as is_min from e")
def effective_price_min_flag(spark, sf_dir):
    """CMP-03: the effective price under the ceiling, and whether it is the brand's least."""
    market = prices(spark, sf_dir).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("price").alias("market"))
    e = table(spark, sf_dir, "part").join(market, "p_partkey", "left").withColumn("effective", F.least("p_retailprice", F.coalesce("market", "p_retailprice")))
    low = e.groupBy("p_brand").agg(F.min("effective").alias("low"))
    return e.join(low, "p_brand").select("p_partkey", "effective", (F.col("effective") == F.col("low")).alias("is_min"))


@query(f"select l_partkey, l_orderkey, l_linenumber, l_suppkey, price / p_retailprice as ratio, price - p_retailprice as diff, case when price / p_retailprice > 1 then 'ABOVE_CEILING' else 'SUSPICIOUS_RATIO' end as reason from {PRICES} join part on p_partkey = l_partkey where price / p_retailprice > 1 or price / p_retailprice < 0.05")
def price_vs_ceiling_alerts(spark, sf_dir):
    """PRJ-16: prices above the ceiling or suspiciously far below it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    r = prices(spark, sf_dir).join(p, "l_partkey").withColumn("ratio", F.col("price") / F.col("p_retailprice")).where("ratio > 1 or ratio < 0.05")
    reason = F.when(F.col("ratio") > 1, "ABOVE_CEILING").otherwise("SUSPICIOUS_RATIO")
    return r.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "ratio", (F.col("price") - F.col("p_retailprice")).alias("diff"), reason.alias("reason"))


@query("select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by (o_orderpriority = '1-URGENT') desc, o_orderdate desc, o_orderkey) as rn from orders) where rn = 1")
def channel_preference(spark, sf_dir):
    """AGG-05: one row a key, the preferred channel first."""
    o = table(spark, sf_dir, "orders")
    return topk.first_of(o, ["o_custkey"], [(F.col("o_orderpriority") == "1-URGENT").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("with l as (select distinct l_orderkey from lineitem), s as (select count(*) as total, count(l_orderkey) as priced from orders left join l on l_orderkey = o_orderkey) select total, priced, total - priced as unpriced, case when total = 0 then 0.0 else floor(priced * 1.0::double / total * 10000 + 0.5) / 10000 end as rate from s")
def quotation_summary(spark, sf_dir):
    """AGG-01: totals and the priced share."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    s = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("priced"))
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.floor(F.col("priced") / F.nullif("total", F.lit(0)) * 10000 + 0.5) / 10000)
    return s.select("total", "priced", (F.col("total") - F.col("priced")).alias("unpriced"), rate.alias("rate"))


_SHIFTED = "(select p_partkey + (select cast(floor(max(p_partkey) / 3) as bigint) from part) from part)"


def _shifted(spark, sf_dir):
    """All catalog keys, shifted by a third of them, so that some of the lines' keys aren't there."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    shift = (p.agg(F.max("l_partkey").alias("m")).first()["m"] or 0) // 3
    return p.select((F.col("l_partkey") + shift).alias("l_partkey"))


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_partkey in {_SHIFTED}")
def matched_split(spark, sf_dir):
    """JN-08: rows whose key is in the catalog."""
    return table(spark, sf_dir, "lineitem").join(_shifted(spark, sf_dir), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_partkey not in {_SHIFTED}")
def orphan_split(spark, sf_dir):
    """JN-08, JN-09: rows whose key isn't."""
    return table(spark, sf_dir, "lineitem").join(_shifted(spark, sf_dir), "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def dedup_keep_latest(spark, sf_dir):
    """AGG-06, AGG-07: the latest row of each key."""
    return merge.dedup_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


@query("with f as (select c_nationkey as nation, c_custkey as id, 'customer' as origin, c_acctbal as bal from customer union all select s_nationkey, s_suppkey, 'supplier', s_acctbal from supplier), r as (select *, row_number() over (partition by nation order by origin desc, id desc) as rn from f) select r.nation, r.id, r.origin, g.labels, g.latest from r join (select nation, string_agg(distinct origin, ',' order by origin) as labels, max(bal) as latest from f group by 1) g using (nation) where rn = 1")
def multi_source_merge(spark, sf_dir):
    """AGG-08, SET-01, SET-02: feeds united, the last row of each key with all its labels."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("origin"), F.col("s_acctbal").alias("bal"))
    out = merge.merge_sources(c.unionByName(s), ["nation"], [F.col("origin").desc(), F.col("id").desc()], "origin", "bal")
    return out.select("nation", "id", "origin", "labels", "latest")


def _both(spark, sf_dir):
    """All orders, and what all lines say of their orders, under keys shifted by a tenth of the orders, so that some are new."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("o_orderstatus"), F.max("l_extendedprice").alias("o_totalprice"))
    shift = (o.agg(F.max("o_orderkey").alias("m")).first()["m"] or 0) // 10
    return o, lines.withColumn("o_orderkey", F.col("o_orderkey") + shift)


_T = "(select o_orderkey, o_orderstatus, o_totalprice from orders)"
_S = "(select l_orderkey + (select cast(floor(max(o_orderkey) / 10) as bigint) from orders) as o_orderkey, min(l_linestatus) as o_orderstatus, max(l_extendedprice) as o_totalprice from lineitem group by l_orderkey)"


@query(f"select coalesce(t.o_orderkey, s.o_orderkey) as o_orderkey, case when t.o_orderkey is null then s.o_orderstatus else t.o_orderstatus end as o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) as o_totalprice from {_T} t full join {_S} s on t.o_orderkey = s.o_orderkey")
def merge_upsert(spark, sf_dir):
    """SNK-01 to SNK-05: matched rows take the listed columns, others are inserted."""
    target, source = _both(spark, sf_dir)
    return merge.merge(target, source, ["o_orderkey"], update=["o_totalprice"])


@query(f"select * from {_T} union all select * from {_S} where o_orderkey not in (select o_orderkey from {_T})")
def merge_ignore(spark, sf_dir):
    """SNK-07: matched rows stay, others are inserted."""
    target, source = _both(spark, sf_dir)
    return merge.merge(target, source, ["o_orderkey"], when_matched="ignore")


@query("with c as (select o_custkey, o_orderstatus, cast(o_orderdate as date) as d, o_orderkey, lag(o_orderstatus) over w as p, lag(1) over w as h from orders window w as (partition by o_custkey order by cast(o_orderdate as date), o_orderkey)), k as (select * from c where h is null or p is distinct from o_orderstatus) select o_custkey, o_orderstatus, cast(d as varchar) as d, cast(cast(lead(d) over w2 - 1 as date) as varchar) as valid_to, lead(d) over w2 is null as is_current from k window w2 as (partition by o_custkey order by d, o_orderkey)")
def scd2_history(spark, sf_dir):
    """WIN-02, SNK-06: periods of unchanged status."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("d"), "o_orderkey")
    return merge.scd2(o, ["o_custkey"], "d", ["o_orderstatus"], [F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", F.col("d").cast("string").alias("d"), F.col("valid_to").cast("string").alias("valid_to"), "is_current")


def _rules():
    return {"bad_quantity": F.col("l_quantity") <= 5, "deep_discount": F.col("l_discount") >= 0.09, "no_tax": F.col("l_tax") == 0, "returned": F.col("l_returnflag") == "R"}


@query("select unnest(['bad_quantity', 'deep_discount', 'no_tax', 'returned']) as rule, unnest([count(*) filter (l_quantity <= 5), count(*) filter (l_discount >= 0.09), count(*) filter (l_tax = 0), count(*) filter (l_returnflag = 'R')]) as violations from lineitem")
def dq_rule_counts(spark, sf_dir):
    """AGG-13: violations by rule in one pass."""
    return quality.rule_counts(table(spark, sf_dir, "lineitem"), _rules())


@query("with h as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([case when l_quantity <= 5 then 'bad_quantity' end, case when l_discount >= 0.09 then 'deep_discount' end, case when l_tax = 0 then 'no_tax' end, case when l_returnflag = 'R' then 'returned' end]) as rule from lineitem) select rule, l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by rule order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn from h where rule is not null) where rn <= 10")
def dq_rule_samples(spark, sf_dir):
    """AGG-13: ten rows of each rule, a report."""
    out = quality.rule_samples(table(spark, sf_dir, "lineitem"), _rules(), [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return out.select("rule", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("select p_partkey, concat_ws('; ', case when length(p_name) < 10 then 'short_name' end, case when contains(p_name, 'red') then 'banned_term' end, case when p_size > 40 then 'oversize' end) as reasons from part where length(p_name) < 10 or contains(p_name, 'red') or p_size > 40")
def rejection_reasons(spark, sf_dir):
    """FLT-11, SNK-13: the rejected branch with its reasons."""
    rules = {"short_name": F.length("p_name") < 10, "banned_term": F.contains("p_name", F.lit("red")), "oversize": F.col("p_size") > 40}
    return quality.split_valid(table(spark, sf_dir, "part"), rules)[1].select("p_partkey", "reasons")


_L = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"


@query(rf"select doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])([{_L}])', '\1 \2', 'g'), '([{_L}])([0-9])', '\1 \2', 'g'), '[^0-9{_L}]+', ' ', 'g'), '\s+', ' ', 'g'))) as norm from documents")
def normalize_names(spark, sf_dir):
    """FN-STR-05: search text of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", text.search_text(F.col("text")).alias("norm"))


@query()
def fold_texts(spark, sf_dir):
    """FN-STR-01, FN-STR-02: folded forms of every document, as digests."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(text.ascii_fold(F.col("text"))).alias("folded"), F.sha1(text.strip_marks(F.col("text"))).alias("stripped"))


@query(r"select p_partkey, list_distinct(list_filter(list_transform(string_split_regex(upper(trim(regexp_replace(replace(p_name, ' ', ' + '), '\s+', ' ', 'g'))), '\s*[+/]\s*'), lambda x: trim(x)), lambda x: x <> '')).list_sort().list_aggregate('string_agg', '|') as parts from part")
def ingredient_explode(spark, sf_dir):
    """ARR-01, ARR-02, FN-STR-08: ingredients of compound names."""
    parts = text.ingredients(F.replace("p_name", F.lit(" "), F.lit(" + ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(parts), "|").alias("parts"))


_DOSED = "coalesce(text, '') || ' Tab. ' || doc_id % 997 || [' MG', 'mcg', ' Ui', ' kg', '%x'][doc_id % 5 + 1] || ' (' || doc_id % 13 || '.' || doc_id % 4 || ' ml)/' || doc_id % 13 || '.' || doc_id % 4 || 'ML + ' || doc_id % 3 || ' g'"
_GRAPH = rf"trim(regexp_replace(lower(trim(regexp_replace({_DOSED}, '\s+', ' ', 'g'))), '[^a-z0-9%./+\- ]+', ' ', 'g'))"


@query(rf"select doc_id, d as dose, cast(count(*) as bigint) as n from (select doc_id, unnest(list_transform(regexp_extract_all({_GRAPH}, '{text.DOSE}'), lambda x: replace(x, ' ', ''))) as d from documents) group by all")
def extract_doses(spark, sf_dir):
    """FN-STR-06, FN-STR-07, FN-STR-09: every dose in every document and in a line of doses after it, as few documents have one."""
    k, of = F.col("doc_id"), lambda n: (F.col("doc_id") % n).cast("string")
    unit = F.element_at(F.array(*map(F.lit, (" MG", "mcg", " Ui", " kg", "%x"))), (k % 5 + 1).cast("int"))
    ml = F.concat(of(13), F.lit("."), of(4))
    dosed = F.concat(F.coalesce("text", F.lit("")), F.lit(" Tab. "), of(997), unit, F.lit(" ("), ml, F.lit(" ml)/"), ml, F.lit("ML + "), of(3), F.lit(" g"))
    found = F.regexp_extract_all(text.graph_text(dosed), F.lit(text.DOSE), F.lit(0))
    e = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("d")).withColumn("dose", F.replace("d", F.lit(" "), F.lit("")))
    return e.groupBy("doc_id", "dose").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, sha1(o_orderkey || '|' || coalesce(o_orderstatus, '') || '|' || coalesce(o_orderpriority, '')) as row_key from orders")
def row_key_hash(spark, sf_dir):
    """FN-HASH-01: row keys."""
    return table(spark, sf_dir, "orders").select("o_orderkey", text.row_key(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("row_key"))


@query("select p_partkey, cast(cast(p_retailprice as decimal(18,4)) as double) as value, cast(p_size as bigint) as whole from part")
def locale_decimal(spark, sf_dir):
    """FN-NUM-01, FN-NUM-05: numbers rendered with local separators and read back."""
    us, eu = F.format_number("p_retailprice", 2), F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    written = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("$ "), us)).otherwise(eu)
    return table(spark, sf_dir, "part").select("p_partkey", numbers.locale_decimal(written).cast("double").alias("value"), numbers.integer(F.concat(F.col("p_size").cast("string"), F.lit(".7"))).alias("whole"))


@query("select o_orderkey, cast(cast(o_orderdate as date) as varchar) as d from orders")
def multi_format_dates(spark, sf_dir):
    """FN-DT-01: dates written in four formats and read back."""
    d = F.col("o_orderdate")
    written = F.element_at(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d/M/yyyy"), F.date_format(d, "dd-MM-yyyy"), F.date_format(d, "yyyyMMdd")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.any_date(written).cast("string").alias("d"))


_GRAMS = "list_distinct(flatten(list_transform(string_split(lower({c}), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_NAMES = f"(select name, {_GRAMS.format(c='name')} as g from (select distinct p_name as name from part))"


@query(f"select a.name as left_key, b.name as right_key, floor(len(list_intersect(a.g, b.g)) * 1.0::double / len(list_distinct(a.g || b.g)) * 1000000 + 0.5) / 1000000 as similarity from {_NAMES} a, {_NAMES} b where a.name < b.name and len(list_intersect(a.g, b.g)) * 1.0::double / len(list_distinct(a.g || b.g)) >= 0.3")
def trigram_similarity(spark, sf_dir):
    """FN-SIM-01, JN-14: pairs of names with a trigram similarity of 0.3 or more."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    out = fuzzy.similarity_join(n.withColumn("k", F.col("name")), n.withColumn("k", F.col("name")), "k", "name", 0.3).where("left_key < right_key")
    return out.select("left_key", "right_key", (F.floor(F.col("similarity") * 1000000 + 0.5) / 1000000).alias("similarity"))


@query(f"select left_key, right_key, cast(rn as integer) as rank from (select a.name as left_key, b.name as right_key, row_number() over (partition by a.name order by len(list_intersect(a.g, b.g)) * 1.0::double / len(list_distinct(a.g || b.g)) desc, b.name) as rn from {_NAMES} a, {_NAMES} b where a.name <> b.name and len(list_intersect(a.g, b.g)) * 1.0::double / len(list_distinct(a.g || b.g)) >= 0.3) where rn <= 3")
def fuzzy_top_candidates(spark, sf_dir):
    """JN-14, SRT-02: the three nearest other names of each name."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("k", F.col("name"))
    pairs = fuzzy.similarity_join(n, n, "k", "name", 0.3).where("left_key <> right_key")
    return topk.top_k(pairs, ["left_key"], [F.col("similarity").desc(), F.col("right_key")], 3).select("left_key", "right_key", "rank")


@query()
def word_similarity(spark, sf_dir):
    """FN-SIM-02, FN-SIM-03: brand phrases and altered names against the names, pairs with a word similarity of 0.3 or more."""
    p = table(spark, sf_dir, "part")
    n = p.select(F.col("p_name").alias("name")).distinct().withColumn("k", F.col("name"))
    phrase = F.explode(F.array(F.concat_ws(" ", "p_brand", "p_name"), F.concat("p_name", F.lit("s")))).alias("name")
    phrases = p.select(phrase).distinct().withColumn("k", F.col("name"))
    pairs = fuzzy.word_similarity_join(phrases, n, "k", "name", 0.3)
    whole = similarity.similarity(F.col("left_key"), F.col("right_key"))
    return pairs.select(F.col("left_key").alias("word"), F.col("right_key").alias("name"), F.col("similarity").alias("ws"), F.greatest("similarity", whole).alias("best"))


@query()
def linkage_stages(spark, sf_dir):
    """LNK-01 to LNK-05, JN-15: altered names linked to the catalog of distinct names, stage by stage."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    catalog = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("item"))
    k = F.col("p_partkey") % 4
    altered = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit("s"))).when(k == 2, F.concat(F.lit("the "), F.col("p_name"))).otherwise(F.concat(F.lit("zq "), F.substring("p_name", 1, 3)))
    # synonyms for a part of the abbreviated names; the others go on to the later stages
    synonym = F.concat(F.lit("zq "), F.substring("name", 1, 3)).alias("name")
    dictionary = catalog.select(F.when(F.col("name") < "h", synonym).alias("name"), "item").groupBy("name").agg(F.min("item").alias("item"))
    return linkage.link(p.select(F.col("p_partkey").alias("id"), altered.alias("name")), catalog, dictionary)


@query("select doc_id from documents where list_contains(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), 'the') and list_contains(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), 'of')")
def fts_and_match(spark, sf_dir):
    """FLT-03: documents with all words."""
    return table(spark, sf_dir, "documents").where(search.matches_all(F.col("text"), ["the", "of"])).select("doc_id")


@query(
    r"""with t as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
f as (select doc_id, len(w) as n, word, len(list_filter(w, lambda x: x = word)) as tf from t, (select unnest(['license', 'copyright', 'que', 'the']) as word)),
a as (select count(*) as docs, avg(len(w)) as mean from t), d as (select word, count_if(tf > 0) as df from f group by word),
s as (select doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as score from f join d using (word), a group by doc_id having sum(tf) > 0)
select doc_id, floor(score * 1000000 + 0.5) / 1000000 as score from s order by 2 desc, 1 limit 8"""
)
def bm25_top8(spark, sf_dir):
    """FN-RNK-02: the eight best documents for some words, a top-k report."""
    scored = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["license", "copyright", "que", "the"])
    return scored.select("doc_id", (F.floor(F.col("score") * 1000000 + 0.5) / 1000000).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(8)


@query("select p_partkey from part where lower(p_name) like '%red%' and lower(p_name) like '%ing%'")
def token_fallback_search(spark, sf_dir):
    """FLT-04, FLT-02: names that contain all parts."""
    return table(spark, sf_dir, "part").where(search.contains_all(F.col("p_name"), ["red", "ing"])).select("p_partkey")




@query("with q as (select embedding as qe from embeddings where vec_id = 0) select vec_id, floor(list_cosine_similarity(embedding::double[], qe::double[]) * 10000 + 0.5) / 10000 as cosine from embeddings, q order by list_cosine_similarity(embedding::double[], qe::double[]) desc, vec_id limit 10")
def vector_topk(spark, sf_dir):
    """FN-SIM-05, SRT-01: the ten nearest vectors of the first, an exact scan."""
    e = table(spark, sf_dir, "embeddings")
    row = e.where("vec_id = 0").select("embedding").first()
    at = F.array(*(F.lit(float(x)) for x in (row["embedding"] if row else [])))
    scored = e.withColumn("c", similarity.cosine_similarity(F.col("embedding"), at))
    return scored.orderBy(F.col("c").desc(), "vec_id").limit(10).select("vec_id", (F.floor(F.col("c") * 10000 + 0.5) / 10000).alias("cosine"))


@query()
def homologation_margin(spark, sf_dir):
    """FN-SCO-01, FN-SCO-02, FN-SIM-04, SRT-04: the best candidate of each name by the five-part score, its margin, and whether it is accepted.

    A name's words stand for its ingredients; doses are read from it, and maker and search rank are missing.
    """
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("k", F.col("name"))
    pairs = fuzzy.similarity_join(n, n, "k", "name", 0.3).where("left_key <> right_key")
    ratio = similarity.sequence_ratio("left_key", "right_key")
    none = F.lit(None).cast("string")
    doses = tuple(text.dose_tokens(F.col(c)) for c in ("left_key", "right_key"))
    parts = tuple(catalog_functions.ingredient_tokens(F.replace(c, F.lit(" "), F.lit(" + "))) for c in ("left_key", "right_key"))
    scored = pairs.withColumn("ratio", ratio).withColumn("score", catalog_functions.five_part_score(F.col("ratio"), doses, (none, none), parts, F.lit(None).cast("double")))
    best = topk.margin(scored, "left_key", "score", [F.col("right_key")])
    return best.select("left_key", "right_key", "score", "margin", ((F.col("score") >= 0.93) & (F.col("margin") >= 0.10)).alias("accepted"))


@query("select p.p_partkey, p.p_brand || '-' || p.p_size as key, cast(coalesce(n, 0) as bigint) as n from part p left join (select p_brand || '-' || p_size as k, count(*) as n from part join lineitem on l_partkey = p_partkey group by 1) on k = p_brand || '-' || p_size")
def derived_key_cross(spark, sf_dir):
    """C10, JN-12, PRJ-14: consumption crossed with the master on a derived key."""
    key = F.concat_ws("-", "p_brand", "p_size")
    p = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    by_key = used.join(p, "p_partkey").groupBy(key.alias("key")).agg(F.sum("n").alias("n"))
    return p.select("p_partkey", key.alias("key")).join(by_key, "key", "left").select("p_partkey", "key", F.coalesce("n", F.lit(0)).alias("n"))


@query("with k as (select l_suppkey, count(*) as total, count(*) filter (p_size <= 25) as matched from lineitem left join part on p_partkey = l_partkey group by 1) select s_name, matched, total - matched as orphan, total, floor((total - matched) * 100.0::double / total * 100 + 0.5) / 100 as orphan_pct from k join supplier on s_suppkey = l_suppkey")
def supplier_quality_kpi(spark, sf_dir):
    """AGG-10, JN-18: matched and orphan rows by supplier."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    k = table(spark, sf_dir, "lineitem").join(p, "l_partkey", "left").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size") <= 25).alias("matched"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    orphan = F.col("total") - F.col("matched")
    return k.join(s, "l_suppkey").select("s_name", "matched", orphan.alias("orphan"), "total", (F.floor(orphan * 100.0 / F.col("total") * 100 + 0.5) / 100).alias("orphan_pct"))


@query("select user_id, count(*) as n from events where event_type = 'error' group by 1 order by n desc, user_id limit 10")
def top10_orphans(spark, sf_dir):
    """AGG-11: the ten most frequent, a report."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "user_id").limit(10)


@query("select event_type, count(*) as n, count(distinct user_id) as users from events group by 1")
def pending_volume(spark, sf_dir):
    """AGG-12, AGG-17: volumes and distinct keys."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("select event_id, user_id, value from events where ts > (select max(ts) - interval 1 day from events)")
def high_water_incremental(spark, sf_dir):
    """STM-01, AGG-16: rows above a stored mark."""
    e = table(spark, sf_dir, "events")
    mark = e.agg((F.max("ts") - F.expr("interval 1 day")).alias("m")).first()["m"]
    return above_mark(e, "ts", mark).select("event_id", "user_id", "value")


@query("select l_suppkey, count(*) as rows_, count(l_partkey) as with_key, count(*) filter (l_returnflag = 'N') as approved, sum(l_quantity::decimal(18,2))::double as quantity from lineitem group by 1")
def staging_counters(spark, sf_dir):
    """AGG-02, AGG-14, AGG-15: counters of an ingest."""
    approved = F.count_if(F.col("l_returnflag") == "N").alias("approved")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows_"), F.count("l_partkey").alias("with_key"), approved, F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@query("select n_name, r_name, count(*) as n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by grouping sets ((n_name, r_name), (r_name), ())")
def rollup_extension(spark, sf_dir):
    """Extension: customers rolled up by nation and region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n")).select("n_name", "r_name", "n")


@query("select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as n from events group by all")
def tumbling_extension(spark, sf_dir):
    """Extension: events in tumbling windows of an hour."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("event_type", F.col("w.start").alias("start"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliant_best_price(spark, sf_dir)


