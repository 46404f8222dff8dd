"""Supplier files with row numbers, staging rows, derived fields, audits and workbooks."""

import contextlib
import io
import re
import time
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricewren.functions import numbers, records
from pricewren.operators import staging
from pricewren.sources import files, folders, spreadsheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(rows, shared="", styles="", settings="", target="worksheets/data.xml"):
    """A workbook whose sheet has the given XML rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}>{settings}<sheets><sheet name="a" sheetId="9" r:id="r7"/><sheet name="b" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/none.xml"/><Relationship Id="r7" Target="{target}"/></Relationships>')
        z.writestr("xl/worksheets/data.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
    return out.getvalue()


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="[Red]dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00 &quot;dry&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
SHARED = "<si><t>CUM</t></si><si><r><t>Pre</t></r><r><t>cio</t></r><rPh><t>zz</t></rPh></si><si><t> día </t></si>"
ROWS = """<row r="2"/><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>2</v></c><c r="E3" t="s"><v>0</v></c></row>
<row r="4"><c r="A4"><v>5</v></c><c r="B4" s="3"><v>12500.50</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" s="1"><v>45322</v></c><c r="E4" t="inlineStr"><is><t>x &amp; </t></is></c></row>
<row r="5"><c r="B5"/></row>
<row r="7"><c r="B7"><v>1E-3</v></c><c r="D7" s="2"><v>45322.5</v></c><c r="E7" t="e"><v>#N/A</v></c></row>
<row r="8"><c r="AA8" t="str"><v>far</v></c><c r="AB8" t="str"><v></v></c></row>"""


def test_cells_of_a_workbook(spark, tmp_path):
    path = tmp_path / "s.xlsx"
    path.write_bytes(book(ROWS, SHARED, STYLES))
    df = files.read_numbered(spark, str(path))
    assert df.columns == ["CUM", "Precio", "column_3", "día", "CUM_1", "row"]
    assert [tuple(r) for r in df.collect()] == [("5", "12500.5", "true", "2024-01-31", "x & ", 1), (None, "0.001", None, "2024-01-31 12:00:00", None, 4), (None, None, None, None, None, 5)]
    assert [tuple(r) for r in files.read_texts(spark, str(path)).collect()] == [tuple(r)[:-1] for r in df.collect()]
    old = spreadsheets.Book(book('<row><c s="1"><v>0</v></c><c><v>-2.5</v></c></row>', "", STYLES, '<workbookPr date1904="1"/>', "/xl/worksheets/data.xml"))
    assert list(old.rows()) == [(1, ["1904-01-01", "-2.5"])]
    assert [spreadsheets.column_number(x) for x in ("A1", "Z9", "AA7", "XFD1048576")] == [0, 25, 26, 16383]
    (tmp_path / "none.xlsx").write_bytes(book(""))
    with pytest.raises(ValueError, match="no rows"):
        spreadsheets.read_sheet(spark, str(tmp_path / "none.xlsx"))
    with pytest.raises(ValueError, match="not an .xlsx"):
        files.read_texts(spark, str(tmp_path / "old.xls"))


def test_workbooks_round_trip(spark):
    rows = [(1, 'a <&"> b', 2.5), (2, None, None), (3, "", float("nan")), (4, " \n\x07é😀", 1e300)]
    d = spark.createDataFrame(rows, "k int, select string, v double").repartition(2)
    books = spreadsheets.workbooks(d)
    got = {tuple(r["cells"]) for r in spreadsheets.sheet_cells(books).where("row > 1").collect()}
    assert got == {("1", 'a <&"> b', "2.5"), ("2", None, None), ("3", "", None), ("4", " \n�é😀", "1e+300")}
    assert all(r["cells"] == ["k", "select", "v"] for r in spreadsheets.sheet_cells(books).where("row = 1").collect())
    assert spreadsheets.sheet_cells(spreadsheets.workbooks(d.where("k > 9"))).count() == 0


def test_folder_with_a_workbook(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,d,w\n1,2024-01-01,x\n")
    (tmp_path / "b.xlsx").write_bytes(spreadsheets.workbook(["n", "d", "w", "t"], [(2.5, "2024-02-01", "7", True), (3, None, None, None)]))
    got = folders.read_folder(spark, str(tmp_path))
    assert dict(got.dtypes) == {"n": "double", "d": "date", "w": "string", "t": "boolean", "file_name": "string"}
    assert {(r["n"], str(r["d"]), r["w"], r["file_name"]) for r in got.collect()} == {(1.0, "2024-01-01", "x", "a.csv"), (2.5, "2024-02-01", "7", "b.xlsx"), (3.0, "None", None, "b.xlsx")}


def test_types_that_read_all_values(spark):
    d = spark.createDataFrame([("1", "1", "true", "2024-01-01", "2024-01-01", None, "1"), (" 2", "2.5e3", "FALSE", "2024-1-2", "2024-01-01 10:00:00", " ", "1d"), ("", None, None, None, None, None, "x")], "a string, b string, c string, d string, e string, f string, g string")
    got = spreadsheets.with_types(d)
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "date", "e": "timestamp", "f": "string", "g": "string"}
    assert got.collect()[1][:5] == (2, 2500.0, False, date(2024, 1, 2), datetime(2024, 1, 1, 10))
    assert dict(spreadsheets.with_types(d.where("false")).dtypes) == dict.fromkeys("abcdefg", "string")


def test_rows_are_numbered_over_files_and_blocks(spark, tmp_path):
    sizes = {"p-0.csv": 700, "p-1.csv": 0, "p-2.csv": 1, "p-3.csv": 1500}
    want, k = [], 0
    for name, n in sizes.items():
        values = [f"v{k + i}" + "y" * (i % 17) for i in range(n)]
        want, k = [*want, *values], k + n
        (tmp_path / name).write_text("\n".join(["v,w", *(f"{v},é" for v in values), ""]), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = files.read_numbered(spark, str(tmp_path))
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert df.columns == ["v", "w", "row"]
    assert {r["row"]: r["v"] for r in rows} == dict(enumerate(want, 1)) and len(rows) == k


STAGED = "row long, CUM string, `Precio unitario` string, IVA string, `Principio activo` string, `NOMBRE  Comercial` string, `Vigente desde` string, `Valid to` string, limpia string"


def test_staging_rows(spark):
    rows = [
        (1, " 12-1 ", "1.234,50", "19%", "Duloxetina", "ALACIR 30 MG X 30", "31/01/2024", None, ""), (2, "  ", "0", None, " ", "X 5 MG", None, None, " "), (3, None, "0,5", "8", None, "X 5 MG", "x", "2024-02-01", " lista "),
        (4, "", "abc", "", "Solo 5%", "Z 9 ML", "", "", None), (5, None, None, None, None, None, None, None, None), (6, "9", "0", "0.05", None, None, None, None, "b"),
    ]
    d = spark.createDataFrame(rows, STAGED)
    mapping = files.suggest_mapping(d.columns)
    got = {r["fila_numero"]: r for r in staging.staging_rows(d, mapping, "A", normalized="limpia").collect()}
    assert sorted(got) == [1, 3, 4, 6]
    one, three, four, six = (got[i] for i in (1, 3, 4, 6))
    assert (one["cum_code"], one["precio_unitario"], one["porcentaje_iva"], one["descripcion_raw"], one["vigente_desde"]) == ("12-1", Decimal("1234.5000"), Decimal("0.1900"), "Duloxetina 30 mg", date(2024, 1, 31))
    assert (one["confianza_score"], one["estado_homologacion"], one["fecha_vigencia_indefinida"], one["archivo_id"]) == (Decimal("1.0000"), "APROBADO", False, "A")
    assert (three["descripcion_raw"], three["vigente_desde"], three["vigente_hasta"], three["fecha_vigencia_indefinida"], three["porcentaje_iva"]) == ("lista 5 mg", None, date(2024, 2, 1), False, Decimal("0.0800"))
    assert (four["descripcion_raw"], four["precio_unitario"], four["confianza_score"], four["estado_homologacion"], four["fecha_vigencia_indefinida"]) == ("Solo 5%", None, None, "PENDIENTE", True)
    assert six["descripcion_raw"] == "b" and set(one["datos_raw"]) == set(d.columns) - {"row"} and one["datos_raw"]["CUM"] == " 12-1 "
    bare = staging.staging_rows(d.select("row", "CUM"), {"cum_code": "CUM"}, "B").collect()
    assert {(r["fila_numero"], r["cum_code"], r["precio_unitario"], r["descripcion_raw"]) for r in bare} == {(1, "12-1", None, None), (6, "9", None, None)}
    assert staging.staging_rows(d.where("false"), mapping, "A").count() == 0


def test_rows_stay_where_they_are_read(spark, tmp_path):
    for name in ("b.csv", "a.csv"):
        (tmp_path / name).write_text("v\n" + "".join(f"{name}{i}\n" for i in range(50)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = files.read_numbered(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = {r["row"]: r["v"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows == dict(enumerate([f"{name}{i}" for name in ("a.csv", "b.csv") for i in range(50)], 1))


def test_staging_code_is_small_enough_to_be_compiled(spark, tmp_path):
    texts = ["CUM", "Precio unitario", "IVA", "Descripción", "Nombre comercial", "Vigente desde"]
    spark.range(9).select(*(F.col("id").cast("string").alias(c) for c in texts), F.col("id").alias("row")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        staging.staging_rows(df, files.suggest_mapping(texts), "A").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < 8000  # the JVM only interprets larger methods


def test_long_keys_without_a_unit_are_searched_once(spark):
    key = "X" + "1" * 4000
    d = spark.createDataFrame([("Solo", key), ("Solo " + "7" * 4000, "30 MG"), ("Solo", f"{key} 1.2.5 MG")], "a string, b string")
    began = time.time()
    got = [r[0] for r in d.select(records.with_doses(F.col("a"), F.col("b"))).collect()]
    assert got == ["Solo", "Solo " + "7" * 4000 + " 30 mg", "Solo 2.5 mg"] and time.time() - began < 10
    old = r"(?i)\d+[.,]?\d*\s*(?:mg|mcg|ug|ml|g\b|ui\b|iu\b|%)"
    for text in ("1.2.3mg", "5 g", "5 gr 12,UI", "12 3 %4,5,6ml", "1..2mg 3. 4ug", "7 \t mcg8MG"):
        assert re.findall(records.DESCRIBED_DOSE, text) == re.findall(old, text)


@pytest.mark.parametrize(("raw", "want"), [(" 1-2-2024", "2024-02-01"), ("2024-1-2 ", "2024-01-02"), ("+12024-01-02", "+12024-01-02"), ("1/2", None), ("1/2/2024 10:00", None), ("2024-13-01", None), ("N/A", None)])
def test_dates_are_tried_by_their_shape(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "c string").select(numbers.any_date(F.col("c")).cast("string").alias("d")).first()["d"]
    assert got == want


def test_fields_of_names(spark):
    names = ["Acetaminofén 500 MG TABLETA LAFRANCOL", "Jarabe 5.5ML x 10 JBE, frasco", "GEL 2 % azul", "x 5 mg tab", "", None, "5 GR AMPOLLAS ab1"]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, `a name` string")
    got = [tuple(r)[2:] for r in staging.named_fields(d, "a name").orderBy("i").collect()]
    assert got == [
        ("ACETAMINOFÉN 500 MG TABLETA LAFRANCOL", "500 MG", "TABLETA", "ACETAMINOFÉN LAFRANCOL", "LAFRANCOL"), ("JARABE 5 5ML X 10 JBE FRASCO", "5.5ML", "JBE", "5 X 10 FRASCO", "FRASCO"), ("GEL 2 AZUL", "2 %", "GEL", "2 AZUL", "AZUL"), ("X 5 MG TAB", None, None, "X", "TAB"),
        ("", None, None, "", None), ("", None, None, "", None), ("5 GR AMPOLLAS AB1", "5 G", "AMPOLLAS", "R AB1", None),
    ]
    assert [r[0] for r in d.select(staging.joined_key(d, ["a name", "none"])).limit(1).collect()] == ["ACETAMINOFÉN 500 MG TABLETA LAFRANCOL"]
    with pytest.raises(ValueError, match="none of b"):
        staging.joined_key(d, ["b"])


def test_audit_takes_links_only_where_details_are_missing(spark):
    quotes = spark.createDataFrame([(1, "A", "2024-01-01"), (2, "A", "2024-01-31"), (3, "B", "2024-01-15"), (4, None, "2024-01-15"), (5, "A", "2024-02-01"), (None, "B", "2024-01-02")], "quote int, supplier string, day string")
    details = spark.createDataFrame([(1, "x", None), (1, None, "o"), (1, None, None), (5, "x", None), (4, None, "o"), (4, None, "o")], "quote int, official string, orphan string")
    links = spark.createDataFrame([(1, "y", "o"), (2, "y", None), (2, None, "o"), (2, None, "p"), (None, "x", "o")], "quote int, official string, orphan string")
    got = {tuple(r) for r in staging.supplier_audit(quotes, details, links, "2024-01-01", "2024-01-31").collect()}
    assert got == {("A", 2, 3, 5, 60.0), ("B", 0, 0, 0, 0.0), (None, 0, 2, 2, 100.0)}
    assert staging.supplier_audit(quotes.where(F.lit(False)), details, links, "2024-01-01", "2024-01-31").count() == 0
