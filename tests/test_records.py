"""Mapped records, quotations, files of a folder, reports, key ranges, and expressions that no query of the tables reaches."""

import hashlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from pricewren.functions import catalog, drugs, records, text
from pricewren.functions.similarity import word_similarity
from pricewren.operators import quotation, search
from pricewren.plans import records as plans
from pricewren.sources import files, folders
from pricewren.sources.keyset import KeysetReader, KeysetTable


def one(spark, column, *values, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_market_records_of_three_generations(spark):
    first = spark.createDataFrame([("123456", "1", "INS", "1", "C1", "52300.50", "45000", "55000")], "expediente string, consecutivocum string, canal string, regimen string, acto_administrativo string, precio_maximo_venta_regulado string, precio_minimo_venta string, precio_maximo_venta string")
    r = records.market_prices(first).first()
    assert (r["id_cum"], r["canal_mercado"], r["regimen_precios"], float(r["precio_regulado_maximo"]), r["fechacorte"]) == ("123456-01", "INS", 1, 52300.5, "")
    real = spark.createDataFrame([("20097257", "18", "99", "TRANSACCION PRIMARIA INSTITUCIONAL", "-", "52300,50"), ("1", "2", "3", "OTRO", "1", "1"), (None, "2", "3", "INS", "1", "1")], "expedientecum string, consecutivo string, consecutivocum string, transaccionsismeddesc string, valorminimo string, valormaximo string")
    got = records.market_prices(real).collect()
    assert [(r["id_cum"], r["canal_mercado"], r["precio_sismed_minimo"], float(r["precio_sismed_maximo"]), r["regimen_precios"]) for r in got] == [("20097257-18", "INS", None, 52300.5, None)]


def test_supplier_rows_and_keys(spark):
    d = spark.createDataFrame([(" 123-01", "12.500,25", "5", " AMOXI (500) ", None), (None, "N/A", None, "x", "USD"), ("9-1", "2", None, None, " EUR ")], "cum string, precio string, porcentaje_aumento string, descripcion string, moneda string")
    got = records.supplier_rows(d, "DOC 1", "Prov", "2024-01-31")
    rows = {r["cum"]: r for r in got.select("*", records.row_key().alias("k"), records.row_key(True).alias("o")).collect()}
    assert set(rows) == {"123-01", "9-1"} and len(got.columns) == 12
    assert (rows["123-01"]["precio_proveedor"], rows["123-01"]["porcentaje_aumento"], rows["123-01"]["texto_original"], rows["123-01"]["moneda"]) == (12500.25, 5.0, "AMOXI (500)", "COP")
    assert (rows["9-1"]["moneda"], rows["9-1"]["texto_original"], rows["9-1"]["laboratorio_raw"]) == ("EUR", "", "")
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert rows["123-01"]["k"] == sha("doc 1|prov|2024-01-31|123-01||amoxi  500|12500.25")
    assert rows["9-1"]["o"] == sha("doc 1|prov|2024-01-31|9-1||||2.0")
    with pytest.raises(ValueError, match="precio"):
        records.supplier_rows(d.drop("precio"), "d", "p", "x")


def test_plain_numbers_are_pythons(spark):
    values = [0.0, 2.0, 12500.25, 1e16, 1.5e20, 0.0001, 0.00001, 123456789.125, 1234567.0, 1e15, 2.5e-7, -3.0]
    assert one(spark, records.plain_number(F.col("c")), *values, schema="c double") == [repr(v) for v in values]


def test_descriptions_get_doses_of_trade_names(spark):
    d = spark.createDataFrame([("Duloxetina", "ALACIR 30 MG X 30"), ("Duloxetina 10 mg", "ALACIR 30 MG"), ("  ", "A 5 ML"), (None, "A 5 ML"), ("Solo", None), ("Jarabe", "X 0,5ML y 10 %")], "a string, b string")
    assert [r[0] for r in d.select(records.with_doses(F.col("a"), F.col("b"))).collect()] == ["Duloxetina 30 mg", "Duloxetina 10 mg", None, None, "Solo", "Jarabe 0,5ml 10 %"]


def test_plus_signs_at_any_depth_and_distance(spark):
    far = "[" + "x" * 900
    cases = {"a+b": ["a", "b"], "a(b+c)+d": ["a(b+c)", "d"], "a+(b+[c+d)+e": ["a", "(b+[c+d)+e"], "a)+b(+c)+d": ["a)", "b(+c)", "d"], f"{far}+y": [f"{far}+y"], f"{far}]+y": [f"{far}]", "y"], "": [""], "a++b": ["a", "", "b"], "])(+)+": ["])(+)", ""]}
    assert one(spark, drugs.outside_plus(F.col("c")), *cases) == list(cases.values())


def test_flat_rows_have_defaults(spark):
    best = "struct<proveedor_nombre: string, precio_unitario: double, precio_unidad: double, precio_presentacion: double, porcentaje_iva: double, vigente_desde: string, vigente_hasta: string, fecha_publicacion: string>"
    schema = f"nombre_input string, match_stage string, match_confidence double, cum_id string, nombre_matcheado string, forma_farmaceutica string, concentracion string, precios_count int, es_regulado boolean, mejor_precio {best}"
    rows = spark.createDataFrame([("Uno", "EXACT", 1.0, "1-01", "uno", "tableta", "5 mg", 2, True, ("Prov", 1.5, None, 3.0, 0.19, "2024-01-01", None, None)), ("Dos", "NO_MATCH", 0.0, None, None, None, None, 0, None, None), ("Tres", "ERROR", 0.0, None, None, None, None, None, False, None)], schema)
    got = {r["nombre_input"]: r.asDict() for r in quotation.flat_rows(rows).collect()}
    assert len(got["Uno"]) == 18 and (got["Uno"]["iva_pct"], got["Uno"]["vigente_hasta"], got["Uno"]["sin_precio"], got["Uno"]["sin_match"]) == (19.0, "", "NO", "NO")
    assert (got["Dos"]["cum_id"], got["Dos"]["precio_unitario"], got["Dos"]["sin_precio"], got["Dos"]["sin_match"]) == ("", None, "SI", "SI")
    names = lambda *a: sorted(r["nombre_input"] for r in quotation.shown(rows, *a).collect())
    assert (names(), names("O", "match"), names("", "nomatch"), names("", "noprecio"), names("", "regulados"), names("TRE")) == (["Dos", "Tres", "Uno"], ["Uno"], ["Dos"], ["Dos", "Tres"], ["Uno"], ["Tres"])


def test_folder_of_mixed_files_widens_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v,d\n1,2,2024-01-01\n2,3,2024-01-02\n")
    (tmp_path / "b.tsv").write_text("k\tv\td\tw\n3\t2.5\t2024-01-01 10:00:00\tx\n")
    (tmp_path / "c.txt").write_text("k\tv\nx9\t9999999999\n")
    (tmp_path / "d.md").write_text("not read")
    got = folders.read_folder(spark, str(tmp_path))
    assert dict(got.dtypes) == {"k": "string", "v": "double", "d": "timestamp", "w": "string", "file_name": "string"}
    assert {(r["k"], r["v"], r["w"], r["file_name"]) for r in got.collect()} == {("1", 2.0, None, "a.csv"), ("2", 3.0, None, "a.csv"), ("3", 2.5, "x", "b.tsv"), ("x9", 9999999999.0, None, "c.txt")}
    (tmp_path / "e.xls").write_text("")
    with pytest.raises(ValueError, match="spreadsheets"):
        folders.read_folder(spark, str(tmp_path))


def test_reports_are_whole_or_not_there(spark, tmp_path):
    rows = [("b", 'say "hi", all', 2), ("a", "line\nend", 1), ("a", "plain", 3), ("c", None, 4), ("b", "", 5)]
    d = spark.createDataFrame(rows, "company string, name string, n int").repartition(3)
    folders.write_report(d, str(tmp_path / "whole"), ["n"])
    assert len(list((tmp_path / "whole").glob("*.csv"))) == 1
    back = folders.read_report(spark, str(tmp_path / "whole"), "company string, name string, n int")
    assert [(r["n"], r["name"] or None) for r in back.collect()] == [(1, "line\nend"), (2, 'say "hi", all'), (3, "plain"), (4, None), (5, None)]
    folders.write_report(d, str(tmp_path / "by"), ["n"], "company")
    assert {p.parent.name: p.read_text().count("\n") for p in (tmp_path / "by").glob("*/*.csv")} == {"company=a": 4, "company=b": 3, "company=c": 2}
    with pytest.raises(Exception, match="exists"):
        folders.write_report(d, str(tmp_path / "by"), ["n"], "company")
    broken = d.withColumn("n", F.when(F.col("n") == 5, F.raise_error(F.lit("bad row"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="bad row"):
        folders.write_report(broken, str(tmp_path / "broken"), ["name"])
    assert not list((tmp_path / "broken").rglob("*.csv"))


def test_key_ranges_read_a_table_once(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as c:
        c.execute("create table items (id text primary key, n integer, name text)")
        c.executemany("insert into items values (?, ?, ?)", [(f"{i:04d}-01", i, None if i % 7 == 0 else f"n{i % 5}") for i in range(95)])
    spark.dataSource.register(KeysetTable)
    read = lambda rows, push="false": spark.read.format("keyset_table").schema("id string, name string, n bigint").options(database=path, table="items", key="id", rows=rows, push=push).load()
    for rows in (1, 10, 19, 95, 1000):
        got = read(rows)
        assert sorted(r["n"] for r in got.collect()) == list(range(95))
    assert read(10).rdd.getNumPartitions() == 10
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert sorted(r["n"] for r in read(10, "true").where("name = 'n3' and n > 50 and length(id) = 7").collect()) == [i for i in range(95) if i % 5 == 3 and i % 7 and i > 50]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    reader = KeysetReader(spark.createDataFrame([], "id string, n bigint").schema, {"database": path, "table": "items", "key": "id", "rows": "10"})
    parts = reader.partitions()
    assert [len(list(reader.read(p))) for p in parts] == [10] * 9 + [5] and parts[0].low is None and parts[-1].high is None
    with sqlite3.connect(path) as c:
        c.execute("delete from items")
    assert read(10).count() == 0


def test_words_of_a_query_are_safe():
    assert search.safe_words('a+"B" c:(d) é ' + "x " * 30) == ["a", "b", "c", "d"] + ["x"] * 14
    assert search.safe_words("¡!") == []


def test_expressions_that_queries_use_elsewhere(spark):
    assert one(spark, catalog.upper_words(F.col("c")), " ácido-b_c (x) ", None) == ["ÁCIDO B_C X", None]
    words = [tuple(r) for r in spark.createDataFrame([("Dolex 500MG tableta oral B12",)], "c string").select(*catalog.search_words(F.col("c"))).collect()]
    assert words == [(["dolex"], ["500", "12"])]
    d = spark.createDataFrame([("word", "two words"), ("abc abc", "abc"), ("", "x"), ("x", "")], "a string, b string")
    assert [round(r[0], 6) for r in d.select(word_similarity(F.col("a"), F.col("b"))).collect()] == [0.8, 1.0, 0.0, 0.0]
    assert one(spark, text.dose_tokens(F.col("c")), "A 5 MG y 5mg, 2.5 ml") == [["5mg", "2.5ml"]]
    assert plans.QUERIES.keys() == plans.SQL.keys()


def test_names_of_hospital_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,Nombre,name\n1, Uno ,q\n2,,q\n3,   ,q\n4,Dos,q\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    assert sorted(r["name"] for r in files.read_names(spark, str(tmp_path / "a.csv")).collect()) == ["Dos", "Uno"]
    with pytest.raises(ValueError, match="among the columns x, y"):
        files.read_names(spark, str(tmp_path / "b.tsv"))


def test_display_texts(spark):
    values = ["  a?\ufffdbC  dE ", None, "o'neil 5mg x_y", "ácido ÚRICO"]
    assert one(spark, records.display_text(F.col("c")), *values) == ["abC dE", "", "o'neil 5mg x_y", "ácido ÚRICO"]
    # an accented letter isn't a word sign to the original's border
    assert one(spark, records.title_case(F.col("c")), *values) == ["Abc De", "", "O'Neil 5mg X_y", "áCido úRico"]


def test_patterns_and_hits(spark):
    d = spark.createDataFrame([(1, "Tableta"), (2, "tab"), (3, None)], "k int, c string")
    assert sorted(r["k"] for r in d.where(search.like_inside(F.col("c"), "T_b")).collect()) == [1, 2]
    hits = spark.createDataFrame([(1, 0.5, None), (2, 0.5, 0.3), (3, 0.9, 0.8), (4, 0.5, 0.3)], "k int, rank double, distance double")
    assert [r["k"] for r in search.best_hits(hits, "k", k=4).collect()] == [3, 2, 4, 1]
