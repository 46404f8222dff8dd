"""Queries of matching, stored tables, graphs and rows with errors over the driver's tables, with SQL.

Names, files and rows are written from the tables' columns, so that SQL tells from these what reading them has to give.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.operators import ceilings, fuzzy, graph, matching, rows
from pricewren.plans.queries import _GRAMS, table
from pricewren.streaming.incremental import above_mark
from pricewren.streaming.marks import Marks
from pricewren.tables import shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fresh(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


_LEFT = "(select distinct name, " + _GRAMS.format(c="name") + " as g from (select unnest([p_name || 's', 'the ' || p_name, 'zq ' || substr(p_name, 1, 3), lower(replace(p_brand, '#', ' ')) || ' ' || substr(p_name, 1, 7), 'zzqqxx']) as name from part))"
_RIGHT = "(select distinct p_name as name, " + _GRAMS.format(c="p_name") + " as g from part)"


@query(
    f"""with s as (select a.name as left_key, b.name as right_key, len(list_intersect(a.g, b.g)) * 1.0::double / len(list_distinct(a.g || b.g)) as s from {_LEFT} a, {_RIGHT} b),
r as (select *, row_number() over (partition by left_key order by s desc, right_key) as n from s where s > 0) select left_key, right_key, floor(s * 1000000 + 0.5) / 1000000 as similarity from r where n = 1"""
)
def closest_candidates(spark, sf_dir):
    """JN-15: the name most alike each altered name, without a threshold; none for names that share no trigram with any."""
    p = table(spark, sf_dir, "part")
    altered = F.array(F.concat("p_name", F.lit("s")), F.concat(F.lit("the "), "p_name"), F.concat(F.lit("zq "), F.substring("p_name", 1, 3)), F.concat(F.lower(F.translate("p_brand", "#", " ")), F.lit(" "), F.substring("p_name", 1, 7)), F.lit("zzqqxx"))
    asked = p.select(F.explode(altered).alias("name")).distinct().withColumn("k", F.col("name"))
    found = fuzzy.nearest(asked, p.select(F.col("p_name").alias("name")).distinct().withColumn("k", F.col("name")), "k", "name")
    return found.select("left_key", "right_key", (F.floor(F.col("similarity") * 1000000 + 0.5) / 1000000).alias("similarity"))


@query(
    """with p as (select *, p_partkey % 6 as v, min(p_partkey) over (partition by p_name, p_size) as own, min(p_partkey) over (partition by p_name) as near, max(p_partkey) over (partition by p_name) as told from part),
s as (select *, case when p_size > 45 then 'ERROR' when v in (0, 2) then 'EXACT' when v = 4 and p_partkey % 4 = 0 then 'SYNONYM_DICT' else 'NO_MATCH' end as stage from p)
select p_partkey, case stage when 'EXACT' then own when 'SYNONYM_DICT' then told end as item, stage, cast(case stage when 'EXACT' then 1.0 when 'SYNONYM_DICT' then 0.9 else 0.0 end as double) as confidence,
case when stage = 'NO_MATCH' and v in (1, 4) then near end as closest, case when stage = 'NO_MATCH' and v in (1, 4) then 1.0::double end as similarity,
case stage when 'ERROR' then 'bad_size' when 'NO_MATCH' then case when v in (1, 4) then 'CONCENTRATION_MISMATCH' when v = 3 then 'NO_CANDIDATES' else 'INPUT_NOT_MATCHABLE' end end as reason from s"""
)
def matched_names(spark, sf_dir):
    """LNK-00 to LNK-10, FLT-06, JN-16: names matched to the catalog of names and sizes as tablets: equal ones, another route, a
    decimal comma, combinations, an unknown dose (of which a hospital has resolved some, twice) and doses that don't fit; rows that can't be read."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    v = F.col("p_partkey") % 6
    name = F.when(v == 0, F.format_string("%s %dmg Tableta", "p_name", "p_size")).when(v == 1, F.format_string("%s %dmg Crema", "p_name", "p_size")).when(v == 2, F.format_string("%s %d,0 mg Tabletas", "p_name", "p_size"))
    name = name.when(v == 3, F.format_string("%s + codeina %dmg + 5mg Tableta", "p_name", "p_size")).when(v == 4, F.format_string("%s 9999mg Tableta", "p_name")).otherwise(F.format_string("%s + codeina %dmg Tableta", "p_name", "p_size"))
    size = F.when(F.col("p_size") > 45, "much").otherwise(F.col("p_size").cast("string"))
    asked = rows.typed_rows(p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.when(F.col("p_partkey") % 4 == 0, "H1").otherwise("H2").alias("hospital"), size.alias("size")), {"size": "int"})
    catalog = p.groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("item")).select("item", F.col("p_name").alias("ingredient"), F.lit("Tableta").alias("form"), F.format_string("%d MG", "p_size").alias("concentration"))
    by_name = p.groupBy("p_name").agg(F.max("p_partkey").alias("item"))
    told = by_name.select(F.lit("H1").alias("hospital"), F.format_string("%s  9999MG tableta", F.upper("p_name")).alias("name"), F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("item"), F.lit("2024-01-01").alias("at")), F.struct(F.col("item").alias("item"), F.lit("2024-02-01").alias("at")))).alias("x"))
    told = told.select("hospital", "name", "x.item", F.col("x.at").alias("resolved_at"), F.lit(0.9).alias("confidence"))
    out = matching.match_names(asked, catalog, told)
    return out.select(F.col("id").alias("p_partkey"), "item", "stage", "confidence", "closest", F.col("closest_similarity").alias("similarity"), "reason")


_C2 = "(select p_partkey as k, p_retailprice + case when p_partkey % 3 = 0 then 1 else 0 end as price, case when p_partkey % 5 = 0 then 'C2' else 'C1' end as circular, p_partkey % 3 = 0 or p_partkey % 5 = 0 as changed from part union all select -1 - p_partkey, p_retailprice, 'C2', true from part)"


@query(
    f"""select cast(k as varchar) as item, 'current' as kind, price, circular, '2024-03-01' as valid_from, null::varchar as valid_to from {_C2}
union all select cast(k as varchar), 'history', price, circular, '2024-03-01', null from {_C2} where changed
union all select cast(p_partkey as varchar), 'history', p_retailprice, 'C1', '2024-01-01', case when p_partkey % 3 = 0 or p_partkey % 5 = 0 then '2024-02-29' end from part"""
)
def circular_history(spark, sf_dir):
    """SNK-06, FN-DT-04: a stored history of ceilings after two circulars (new, unchanged, dearer and moved items), the second of which is applied twice."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    day = lambda d: F.lit(d).cast("date").alias("valid_from")
    first = p.select(F.col("p_partkey").cast("string").alias("item"), F.col("p_retailprice").alias("price"), F.lit("C1").alias("circular"), day("2024-01-01"))
    dearer = F.col("p_retailprice") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)
    second = p.select(F.col("p_partkey").cast("string").alias("item"), dearer.alias("price"), F.when(F.col("p_partkey") % 5 == 0, "C2").otherwise("C1").alias("circular"), day("2024-03-01"))
    new = p.select((-1 - F.col("p_partkey")).cast("string").alias("item"), F.col("p_retailprice").alias("price"), F.lit("C2").alias("circular"), day("2024-03-01"))
    stored = ceilings.ceilings_table(spark, fresh(spark, "ceilings"), 8)
    for rows_ in (first, second.unionByName(new), second.unionByName(new)):
        ceilings.load_circular(stored, rows_)
    return stored.read().withColumn("valid_from", F.col("valid_from").cast("string")).withColumn("valid_to", F.col("valid_to").cast("string"))


@query("select event_id, event_type, value from events e join (select event_type, max(ts) - interval 2 day as m from events group by 1) using (event_type) where ts > m or event_type = 'error'")
def stored_marks(spark, sf_dir):
    """STM-01: events above the stored mark of their source. A first run stores marks of two days before each source's end; the
    second reads them. The source that failed in the first run has no mark, so all of it is read."""
    e = table(spark, sf_dir, "events")
    ends = {r["event_type"]: r for r in e.groupBy("event_type").agg((F.max("ts") - F.expr("interval 2 days")).cast("string").alias("early"), F.max("ts").cast("string").alias("end")).collect()}
    path = fresh(spark, "marks")

    def fails(since):
        raise OSError("unreachable")

    for source, r in ends.items():
        Marks(spark, path).sync(source, r["early"], fails if source == "error" else lambda since: None)
    again, parts = Marks(spark, path), []
    for source, r in ends.items():
        again.sync(source, r["end"], lambda since, s=source: parts.append(above_mark(e.where(F.col("event_type") == s), "ts", since and F.lit(since).cast("timestamp_ntz"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("event_id", "event_type", "value")


def _graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """Parts as items, brands as makers, words of names as substances; then rows of a second state, by which a quarter has another maker too."""
    p = table(spark, sf_dir, "part")
    first = p.select(F.col("p_partkey").cast("string").alias("cum"), F.col("p_type").alias("producto"), F.lit("Vigente").alias("estado_origen"), F.lit(None).cast("string").alias("estadocum"), F.when(F.col("p_size") > 3, F.col("p_brand")).otherwise(" ").alias("titular"), F.replace("p_name", F.lit(" "), F.lit(" + ")).alias("principio_activo_raw"))
    changed = F.col("cum").cast("long") % 4 == 0
    later = {"producto": F.lit("new"), "estado_origen": F.lit(""), "estadocum": F.lit("Vencido"), "titular": F.col("producto"), "principio_activo_raw": F.lit("agua Y sal")}
    second = first.withColumns({name: F.when(changed, value).otherwise(F.col(name)) for name, value in later.items()})
    made = graph.merge_rows(graph.empty_graph(spark), graph.golden_rows(first))
    made = graph.Graph(*(written(t, "graph") for t in (made.items, made.makers, made.substances, made.made_by, made.contains)))
    return graph.merge_rows(graph.merge_rows(made, graph.golden_rows(second)), graph.golden_rows(second))


_EDGES = """e as (select p_partkey, unnest(list_distinct(string_split(upper(p_name), ' '))) as s from part union select p_partkey, unnest(['AGUA', 'SAL']) from part where p_partkey % 4 = 0),
m as (select p_partkey, p_brand as maker from part where p_size > 3 union select p_partkey, p_type from part where p_partkey % 4 = 0)"""


@query(
    f"""with {_EDGES} select cast(p.p_partkey as varchar) as item, case when p.p_partkey % 4 = 0 then 'new' else p_type end as product, p.p_partkey % 4 <> 0 as active,
coalesce((select string_agg(maker, '|' order by maker) from m where m.p_partkey = p.p_partkey), '') as makers, coalesce((select string_agg(s, '|' order by s) from e where e.p_partkey = p.p_partkey), '') as substances from part p"""
)
def graph_neighbours(spark, sf_dir):
    """SNK-14, JN-17: items of a graph merged three times (the last changes nothing) with their collected makers and substances."""
    out = graph.neighbours(_graph(spark, sf_dir))
    return out.select("item", "product", "active", F.array_join("makers", "|").alias("makers"), F.array_join("substances", "|").alias("substances"))


@query(f"with {_EDGES} select maker, string_agg(s || ':' || n, '|' order by s) as held from (select maker, s, count(*) as n from m join e using (p_partkey) group by all) group by maker")
def maker_substances(spark, sf_dir):
    """JN-17: makers with the substances of their items, two hops away."""
    out = graph.maker_substances(_graph(spark, sf_dir))
    return out.select("maker", F.array_join(F.transform("held", lambda x: F.concat(x["substance"], F.lit(":"), x["n"].cast("string"))), "|").alias("held"))


@query(
    """select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when l_linenumber % 5 in (1, 3) then null else cast(l_quantity as decimal(18,4)) end::double as quantity, case when l_linenumber % 5 in (2, 3) then null else cast(cast(l_shipdate as date) as varchar) end as day,
case l_linenumber % 5 when 1 then 'bad_quantity' when 2 then 'no_day' when 3 then 'bad_line' end as error from lineitem"""
)
def row_errors(spark, sf_dir):
    """LNK-10: lines of JSON, of which some have a field that can't be read, some lack one, and some aren't JSON."""
    k = F.col("l_linenumber") % 5
    quantity = F.when(k == 1, F.lit("many")).otherwise(F.translate(F.format_number("l_quantity", 2), ",.", ".,"))
    line = F.when(k == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(quantity.alias("quantity"), F.when(k != 2, F.date_format("l_shipdate", "d/M/yyyy")).alias("day"))))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", line.alias("line"))
    out = rows.json_rows(lines, "line", {"quantity": "decimal(18,4)", "day": "date"}, ("day",))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("quantity").cast("double").alias("quantity"), F.col("day").cast("string").alias("day"), "error")
