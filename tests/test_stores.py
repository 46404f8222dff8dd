"""Circulars and their files, the catalog graph, recorded resolutions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pricewren.operators import ceilings, graph, matching
from pricewren.sources import regulation

ROWS = "item string, price double, circular string, valid_from date"


def state(table):
    return {(r["item"], r["kind"], r["price"], r["circular"], str(r["valid_from"]), r["valid_to"] and str(r["valid_to"])) for r in table.read().collect()}


def test_circulars_change_the_history_only_where_something_changed(spark, tmp_path):
    table = ceilings.ceilings_table(spark, str(tmp_path / "c"), 8)
    load = lambda rows, day: ceilings.load_circular(table, spark.createDataFrame([(*r, date.fromisoformat(day)) for r in rows], ROWS))
    load([("1-01", 10.0, "C1"), ("2-01", 20.0, "C1"), ("3-01", None, None), ("4-01", 5.0, "C1")], "2024-01-01")
    first = state(table)
    assert len(first) == 8 and ("3-01", "history", None, None, "2024-01-01", None) in first
    # unchanged, another price, a new item, another circular; 4-01 isn't in it
    second = [("1-01", 10.0, "C1"), ("2-01", 21.0, "C1"), ("5-01", 7.0, "C2"), ("3-01", None, "C2"), ("5-01", 6.0, "C2")]
    touched = load(second, "2024-03-01")
    assert 1 <= len(touched) <= 4
    got = state(table)
    assert {x for x in got if x[0] == "1-01"} == {("1-01", "current", 10.0, "C1", "2024-03-01", None), ("1-01", "history", 10.0, "C1", "2024-01-01", None)}
    assert {x for x in got if x[0] == "4-01"} == {x for x in first if x[0] == "4-01"}
    assert {x[1:] for x in got if x[0] == "2-01"} == {("current", 21.0, "C1", "2024-03-01", None), ("history", 20.0, "C1", "2024-01-01", "2024-02-29"), ("history", 21.0, "C1", "2024-03-01", None)}
    assert {x[1:] for x in got if x[0] == "5-01"} == {("current", 7.0, "C2", "2024-03-01", None), ("history", 7.0, "C2", "2024-03-01", None)}
    assert {x[1:] for x in got if x[0] == "3-01"} == {("current", None, "C2", "2024-03-01", None), ("history", None, None, "2024-01-01", "2024-02-29"), ("history", None, "C2", "2024-03-01", None)}
    load(second, "2024-03-01")
    assert state(table) == got
    assert load([], "2024-04-01") == []


@pytest.mark.parametrize(
    ("head", "lines", "sep"),
    [
        ("CUM;Precio Maximo", ["123-1;1.234,56", " 9 - 02 ;5", ";7", "abc;x"], ";"), ("﻿Expediente,Otro,Consecutivo,PVP", ["123,z,1,\"1,234.56\"", "9,z,2,5", "9,z,,7", "x,z,3,1"], ","), ("id_cum\tprecio\tPrecio_Maximo_Venta", ["123-1\t0\t1234.56", "9-2\t0\t5", "\t0\t1", "abc\t0\t"], "\t"),
    ],
)
def test_circular_files_by_their_headers(spark, tmp_path, head, lines, sep):
    path = tmp_path / "c.csv"
    path.write_text("\n".join([head, *lines]), encoding="utf-8")
    got = {r["item"]: (r["price"], r["circular"], str(r["valid_from"])) for r in regulation.read_circular(spark, str(path), "C13", date(2024, 1, 1), sep).collect()}
    want = {"123-01": (1234.56, "C13", "2024-01-01"), "9-02": (5.0, "C13", "2024-01-01"), "abc": (None, "C13", "2024-01-01")}
    assert got == ({k: v for k, v in want.items() if k != "abc"} if "Expediente" in head else want)


def test_headers_that_say_too_little_are_errors():
    assert regulation.header_name(" Código CUM* ") == "cdigo cum"
    assert regulation.resolve(["x", "y", "Precio"], key="y") == ([1], 2)
    for headers in (["CUM", "x"], ["expediente", "precio"], []):
        with pytest.raises(ValueError, match="among"):
            regulation.resolve(headers)


CATALOG = "cum string, producto string, estado_origen string, estadocum string, titular string, principio_activo_raw string"


def test_graph_merges_by_key_and_twice_is_once(spark):
    first = [("1", " Uno ", "Vigente", None, "Lab A", "AMOXICILINA + ACIDO CLAVULANICO"), ("2", None, None, "Activo", " ", "A y B / C con D"), ("3", "x", "Vencido", None, "Lab B", None), ("4", "x", " ", "Vigente", "Lab A", "a + A")]
    rows = graph.golden_rows(spark.createDataFrame(first, CATALOG))
    read = {r["item"]: r for r in rows.collect()}
    assert (read["1"]["product"], read["1"]["active"], read["1"]["substances"]) == ("Uno", True, ["AMOXICILINA", "ACIDO CLAVULANICO"])
    assert (read["2"]["state"], read["2"]["active"], read["2"]["maker"], read["2"]["substances"]) == ("Activo", True, None, ["A", "B", "C", "D"])
    assert (read["3"]["active"], read["3"]["substances"], read["4"]["state"], read["4"]["active"], read["4"]["substances"]) == (False, [], "Vigente", False, ["A"])
    g = graph.merge_rows(graph.empty_graph(spark), rows)
    again = graph.merge_rows(g, rows)
    for name in ("items", "makers", "substances", "made_by", "contains"):
        table = getattr(g, name)
        assert sorted(map(str, table.collect())) == sorted(map(str, getattr(again, name).collect()))
        assert table.count() == table.distinct().count()
    more = graph.merge_rows(g, graph.golden_rows(spark.createDataFrame([("1", "New", "Vencido", None, "Lab C", "A"), ("9", "n", "Vigente", None, None, None)], CATALOG)))
    got = {r["item"]: (r["product"], r["active"], r["makers"], r["substances"]) for r in graph.neighbours(more).collect()}
    assert got["1"] == ("New", False, ["Lab A", "Lab C"], ["A", "ACIDO CLAVULANICO", "AMOXICILINA"])
    assert got["9"] == ("n", True, [], []) and got["3"] == ("x", False, ["Lab B"], []) and len(got) == 5
    held = {r["maker"]: [tuple(x) for x in r["held"]] for r in graph.maker_substances(more).collect()}
    assert held == {"Lab A": [("A", 2), ("ACIDO CLAVULANICO", 1), ("AMOXICILINA", 1)], "Lab B": [], "Lab C": [("A", 1), ("ACIDO CLAVULANICO", 1), ("AMOXICILINA", 1)]}


def test_recorded_resolutions_are_used_by_the_next_match(spark, tmp_path):
    path = str(tmp_path / "told")
    catalog = spark.createDataFrame([(1, "acetaminofen", "tableta", "500 mg"), (2, "codeina", "jarabe", "5 mg")], "item int, ingredient string, form string, concentration string")
    names = spark.createDataFrame([(1, "Jarabe raro"), (2, "acetaminofen 500 mg tableta")], "id int, name string")
    run = lambda: {r["id"]: (r["item"], r["stage"]) for r in matching.match_names(names, catalog, matching.recorded_resolutions(spark, path)).collect()}
    assert run() == {1: (None, "NO_MATCH"), 2: (1, "EXACT")}
    told = lambda item, day: spark.createDataFrame([(None, " JARABE  raro", item, 0.8, day)], "hospital string, name string, item string, confidence double, resolved_at string")
    matching.record_resolutions(told("1", "2024-01-01 10:00:00"), path)
    matching.record_resolutions(told("2", "2024-01-02 10:00:00"), path)
    assert run() == {1: (2, "SYNONYM_DICT"), 2: (1, "EXACT")}
    assert matching.recorded_resolutions(spark, path).where(F.col("item") == "2").first()["confidence"] == 0.8
