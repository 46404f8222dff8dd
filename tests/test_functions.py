import unicodedata
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricewren.functions import catalog, drugs, numbers, similarity, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "value"), [("1.234,50", "1234.5"), ("1,234.50", "1234.5"), ("12,5", "12.5"), ("1.500", "1.5"), ("$ 7", "7"), ("x", None), ("", None), (None, None)])
def test_locale_decimal(spark, raw, value):
    got = one(spark, raw, numbers.locale_decimal)
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize(("raw", "value"), [("19%", "0.19"), ("19", "0.19"), ("0.05", "0.05"), ("12,345%", "0.1234"), (None, None)])
def test_fraction(spark, raw, value):
    got = one(spark, raw, numbers.fraction)
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize("raw", ["2025-02-01", "1/2/2025", "01-02-2025", "20250201"])
def test_any_date(spark, raw):
    assert one(spark, raw, numbers.any_date) == date(2025, 2, 1)
    assert one(spark, "soon", numbers.any_date) is None


def test_last_separator_and_regime(spark):
    assert one(spark, "COP 1.234.567,89", numbers.last_separator_decimal) == Decimal("1234567.89")
    assert one(spark, "2", numbers.regime) == 2
    assert one(spark, "9", numbers.regime) is None


def test_folds_equal_unicode(spark):
    words = ["DÓLEX® ÁCIDO™", "½ µg", "naïve Straße", "ﬁn º ª", "plain", "Żółć İ"]
    got = spark.createDataFrame([(w,) for w in words], "c string").select("c", text.ascii_fold(F.col("c")).alias("f"), text.strip_marks(F.col("c")).alias("s")).collect()
    for row in got:
        assert row["f"] == unicodedata.normalize("NFKD", row["c"]).encode("ascii", "ignore").decode().lower()
    assert one(spark, "DÓLEX® ÁCIDO™", text.strip_marks) == "DOLEX ACIDO"


def test_texts(spark):
    assert one(spark, "Acetaminofén500MG x10", text.search_text) == "acetaminofén 500 mg x 10"
    assert one(spark, "500 MG / 5ml, 500mg", text.dose_tokens) == ["500mg", "5ml"]
    assert one(spark, "500 gramos 10 gotas 5 ug", text.dose_tokens) == ["5ug"]
    assert one(spark, "a ñ b", text.graph_text) == "a   b"
    assert one(spark, "Ibuprofeno + cafeina y zinc con tio", catalog.ingredient_tokens) == ["IBUPROFENO", "CAFEINA", "ZINC"]
    assert one(spark, "a + b / A y c con d", text.ingredients) == ["A", "B", "C", "D"]
    assert one(spark, "123-1", text.canonical_key) == "123-01"
    assert one(spark, "123-100", text.canonical_key) == "123-100"
    assert one(spark, "abc", text.canonical_key) == "abc"


def test_similarity(spark):
    row = spark.createDataFrame([("word", "two words")], "a string, b string").select(similarity.similarity(F.col("a"), F.col("b")).alias("s"), similarity.word_similarity(F.col("a"), F.col("b")).alias("w"), similarity.sequence_ratio("a", "b").alias("r")).first()
    assert row["s"] == pytest.approx(0.363636, abs=1e-5)
    assert row["w"] == pytest.approx(0.8)
    assert row["r"] == pytest.approx(8 / 13)


def test_names_of_medicines(spark):
    raw = [
        "Abacavir 2% [100mg/5mL] Solucion oral", "Acetaminofen + Codeina 325mg + 15mg Tableta", "Acetaminofen + Tramadol 325mg + 37,5mg Tableta", "Vitamina D3 (colecalciferol) 25,000UI/mL Solucion oral",
        "Aciclovir 5% [500mg/10g] Unguento topico", "Agua destilada esteril 10mL Solucion inyectable", "Amoxicilina + Acido clavulanico [875mg + 125mg] Tableta Caja x 14 unidades", "Cosa 1,2345mg Polvo esteril para reconstituir Vial",
        "Foo [bar]", "Uno + dos 5mg Tableta", "", None, "Acetaminofen 325mg Tableta", "Acetaminofen 500mg Tableta",
    ]
    got = {r["name"]: r for r in drugs.parse_names(spark.createDataFrame([(n,) for n in raw] * 2, "name string"), "name").collect()}
    assert set(got) == set(raw)
    canonical = lambda n: [c["canonical"] for c in got[n]["components"]]
    best = lambda n: (got[n]["concentration"]["value"], got[n]["concentration"]["unit"], got[n]["concentration"]["encoding"])
    values = lambda n: [(c["value"], c["unit"]) for c in got[n]["concentrations"]]
    assert canonical(raw[0]) == ["abacavir"] and best(raw[0]) == (20, "mg/mL", "BRACKET_RATIO") and len(values(raw[0])) == 2 and not got[raw[0]]["warnings"]
    assert (got[raw[0]]["form"], got[raw[0]]["form_group"]) == ("solucion oral", "ORAL_LIQUID")
    assert canonical(raw[1]) == ["acetaminofen", "codeina"] and values(raw[1]) == [(325, "mg"), (15, "mg")] and got[raw[1]]["is_combo"] and got[raw[1]]["is_matchable"]
    assert values(raw[2])[1] == (Decimal("37.5"), "mg")
    assert got[raw[1]]["inn_query"] == "acetaminofen / codeina" and got[raw[1]]["concentration"] is None
    assert canonical(raw[3]) == ["colecalciferol"] and got[raw[3]]["components"][0]["aliases"] == ["vitamina d3"] and best(raw[3]) == (25000, "IU/mL", "INLINE")
    assert best(raw[4]) == (50, "mg/g", "BRACKET_RATIO") and (got[raw[4]]["form"], got[raw[4]]["form_group"]) == ("unguento", "TOPICAL")
    assert canonical(raw[5]) == ["agua para preparaciones inyectables"] and best(raw[5])[:2] == (10, "mL") and got[raw[5]]["form_group"] == "INJECTABLE"
    assert values(raw[6]) == [(875, "mg"), (125, "mg")] and got[raw[6]]["form"] == "tableta"
    assert got[raw[7]]["warnings"] == ["AMBIGUOUS_DECIMAL", "INN_NOT_IN_SYNONYM_TABLE"] and not got[raw[7]]["is_matchable"] and got[raw[7]]["form"] == "polvo para reconstitucion"
    assert got[raw[8]]["warnings"] == ["UNPARSEABLE_BRACKET", "NO_CONCENTRATION_FOUND", "INN_NOT_IN_SYNONYM_TABLE"]
    assert "COMPONENT_COUNT_MISMATCH" in got[raw[9]]["warnings"] and not got[raw[9]]["is_matchable"]
    assert got[""]["components"] == got[None]["components"] == [] and got[None]["warnings"] == ["NO_CONCENTRATION_FOUND"]
    assert best(raw[12])[0] != best(raw[13])[0]


def test_five_part_score(spark):
    rows = [("ibuprofeno 400 mg tab", "Lab X", "Ibuprofeno", "IBUPROFENO 400MG", "laboratorio lab x sa", "ibuprofeno", 2.5), ("algo", None, None, "otra cosa 5mg", "z", "cosa", None), ("algo 5mg", "q", "zinc", "otra cosa", "z", None, 9.0)]
    df = spark.createDataFrame(rows, "t string, lab string, pa string, product string, maker string, parts string, ft double")
    score = catalog.five_part_score(F.lit(0.5), (text.dose_tokens(F.col("t")), text.dose_tokens(F.col("product"))), (F.col("lab"), F.col("maker")), (catalog.ingredient_tokens(F.col("pa")), catalog.ingredient_tokens(F.col("parts"))), F.col("ft"))
    got = [r["s"] for r in df.select(score.alias("s")).collect()]
    assert got == pytest.approx([0.225 + 0.25 + 0.15 + 0.1 + 0.025, 0.225 + 0.125 + 0.075 + 0.05, 0.225 + 0.05])


def test_numbers_and_units(spark):
    assert [one(spark, x, drugs.number) for x in ("25,000", "37,5", "1.5", "1,2345")] == [25000, Decimal("37.5"), Decimal("1.5"), Decimal("1.2345")]
    assert [one(spark, x, drugs.unit) for x in ("UI/ml", " µg ", "frob")] == ["IU/mL", "mcg", "FROB"]
    assert one(spark, "Solución  Oftálmica", drugs.form) == "solucion oftalmica"
    assert one(spark, "Ácido Fólico sodico", drugs.substance) == "acido folico"
    assert [one(spark, x, catalog.currency) for x in ("$ 1.234,56", "1,234.56", "12,5", "x", None)] == [1234.56, 1234.56, 125.0, None, None]
