from pyspark.sql import functions as F

from pricewren.operators import fuzzy, linkage, merge, quality, search, topk
from pricewren.sources import files
from pricewren.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_is_idempotent_and_keeps_columns(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, v string, w int")
    s = spark.createDataFrame([(2, "B", 9), (3, "c", 3)], "k int, v string, w int")
    out = merge.merge(t, s, ["k"], update=["v"])
    assert rows(out) == rows(spark.createDataFrame([(1, "a", 1), (2, "B", 2), (3, "c", 3), (None, "n", 0)], t.schema))
    assert rows(merge.merge(out, s, ["k"], update=["v"])) == rows(out)
    assert rows(merge.merge(t, s, ["k"], when_matched="ignore")) == rows(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 0)], t.schema))
    assert merge.merge(t.limit(0), s, ["k"]).count() == 2


def test_scd2_periods_do_not_overlap(spark):
    d = spark.createDataFrame([(1, "2024-01-01", "a"), (1, "2024-02-01", "a"), (1, "2024-03-01", "b"), (1, "2024-04-01", None)], "k int, s string, v string").withColumn("s", F.to_date("s"))
    got = [(str(r["s"]), r["v"], r["valid_to"] and str(r["valid_to"]), r["is_current"]) for r in merge.scd2(d, ["k"], "s", ["v"], []).orderBy("s").collect()]
    assert got == [("2024-01-01", "a", "2024-02-29", False), ("2024-03-01", "b", "2024-03-31", False), ("2024-04-01", None, None, True)]


def test_topk_and_margin(spark):
    df = spark.createDataFrame([(1, 0.9, "x"), (1, 0.7, "y"), (2, 0.5, "z")], "k int, s double, n string")
    assert rows(topk.margin(df, "k", "s", [F.col("n")]).select("k", "n", F.round("margin", 3))) == [(1, "x", 0.2), (2, "z", 0.5)]
    assert rows(topk.top_k(df, ["k"], [F.col("s").desc()], 1).select("k", "n")) == [(1, "x"), (2, "z")]


def test_quality(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    rules = {"low": F.col("v") < 3, "none": F.col("v").isNull()}
    assert rows(quality.rule_counts(df, rules)) == [("low", 1), ("none", 1)]
    good, bad = quality.split_valid(df, rules)
    assert rows(good) == [(5,)]
    assert sorted(r["reasons"] for r in bad.collect()) == ["low", "none"]


def test_similarity_join_equals_brute_force(spark):
    names = ["red ring", "red rings", "blue ring", "small widget", "small widgets", "", None]
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "k string, t string")
    from pricewren.functions.similarity import similarity

    a, b = df.select(F.col("k").alias("left_key"), F.col("t").alias("x")), df.select(F.col("k").alias("right_key"), F.col("t").alias("y"))
    for threshold in (0.3, 0.6, 0.9):
        want = a.crossJoin(b).withColumn("s", similarity(F.col("x"), F.col("y"))).where(F.col("s") >= threshold).select("left_key", "right_key")
        got = fuzzy.similarity_join(df, df, "k", "t", threshold).select("left_key", "right_key")
        assert rows(got) == rows(want)


def _grams(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return [f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)]


def _word_similarity(a, b):
    q, t = set(_grams(a)), _grams(b)
    return max((len(q & set(t[i:j])) / len(q | set(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)), default=0.0)


LONG_NAMES = ["hidroclorotiazida losartan potasico", "hidroclorotiazida", "losartan potasico", "acetaminofen codeina jarabe", "acido acetilsalicilico tabletas", "amoxicilina acido clavulanico", "", None]
TYPED_NAMES = ["hidroclorotiazidas losartan", "hidroclorotiazida", "acetaminofem codeina jarabe", "codeina", "acido acetilsalicilicos", "amoxicilinas acido clavulanico", "zz", "", None]


def test_word_similarity_join_equals_brute_force(spark):
    left = spark.createDataFrame([(str(i), n) for i, n in enumerate(TYPED_NAMES)], "k string, t string")
    right = spark.createDataFrame([(str(i), n) for i, n in enumerate(LONG_NAMES)], "k string, t string")
    for threshold in (0.1, 0.3, 0.6, 0.88, 1.0):
        want = [(str(i), str(j), round(s, 9)) for i, a in enumerate(TYPED_NAMES) for j, b in enumerate(LONG_NAMES) if (s := _word_similarity(a, b)) >= threshold]
        got = fuzzy.word_similarity_join(left, right, "k", "t", threshold).select("left_key", "right_key", F.round("similarity", 9))
        assert rows(got) == sorted(want, key=str)


def test_linkage_by_word_similarity_equals_brute_force(spark):
    catalog = spark.createDataFrame([(i, n) for i, n in enumerate(LONG_NAMES) if n], "item int, name string")
    typed = spark.createDataFrame(list(enumerate(TYPED_NAMES)), "id int, name string")
    got = {r["id"]: (r["item"], r["stage"]) for r in linkage.link(typed, catalog).collect()}
    assert len(got) == len(TYPED_NAMES)
    for i, name in enumerate(TYPED_NAMES):
        scored = [(-s, j) for j, n in enumerate(LONG_NAMES) if n and (s := _word_similarity(name, n)) >= linkage.WORD]
        if name in LONG_NAMES and name:
            assert got[i] == (LONG_NAMES.index(name), "exact")
        elif scored:
            assert got[i] == (min(scored)[1], "word"), name
        else:
            assert got[i][1] in ("trigram", "none")
    assert got[0] == (0, "word")


def test_linkage_gives_one_row_each(spark):
    catalog = spark.createDataFrame([(1, "acetaminofen 500 mg"), (2, "acetaminofen 1 g"), (3, "ibuprofeno")], "item int, name string")
    q = spark.createDataFrame([(10, "ACETAMINOFEN 500MG"), (11, "ibuprofenoo"), (12, "zz"), (13, "ibuprofeno oral"), (14, None), (15, "zz")], "id int, name string")
    got = {r["id"]: (r["item"], r["stage"]) for r in linkage.link(q, catalog).collect()}
    assert set(got) == {10, 11, 12, 13, 14, 15}
    assert got[10] == (1, "exact")
    assert got[12] == got[15] == got[14] == (None, "none")


def test_unmatched_names_get_their_closest_candidate(spark):
    catalog = spark.createDataFrame([(1, "acetaminofen 500 mg"), (2, "ibuprofeno"), (3, "ibuprofeno"), (4, "iburelax forte")], "item int, name string")
    typed = spark.createDataFrame([(10, "acetaminofen 1 g"), (11, "ibu"), (12, "zz"), (13, "ibuprofeno"), (14, "syn x"), (15, "acido"), (16, None)], "id int, name string")
    got = {r["id"]: r for r in linkage.link(typed, catalog, spark.createDataFrame([("syn x", 4)], "name string, item int")).collect()}
    names = {r["item"]: r["name"] for r in catalog.collect()}
    assert (got[14]["item"], got[14]["stage"], got[14]["reason"]) == (4, "dictionary", None)
    assert (got[13]["item"], got[13]["stage"], got[13]["closest"]) == (2, "exact", None)
    for i, name, reason in ((10, "acetaminofen 1 g", "CONCENTRATION_MISMATCH"), (11, "ibu", "BELOW_THRESHOLD"), (12, "zz", "NO_CANDIDATES"), (15, "acido", "CONCENTRATION_MISMATCH"), (16, "", "NO_CANDIDATES")):
        q = set(_grams(name))
        scored = [(-len(q & set(_grams(n))) / len(q | set(_grams(n))), item) for item, n in names.items()]
        best = min(scored) if min(scored)[0] else (None, None)
        assert (got[i]["item"], got[i]["stage"], got[i]["confidence"]) == (None, "none", 0.0)
        assert got[i]["closest"] == best[1], name
        assert got[i]["reason"] == reason
        assert got[i]["closest_similarity"] == (None if best[0] is None else -best[0])


def test_search(spark):
    d = spark.createDataFrame([(1, "the red ring"), (2, "red red"), (3, "blue"), (4, None)], "k int, t string")
    assert rows(d.where(search.matches_all(F.col("t"), ["red", "the"])).select("k")) == [(1,)]
    scores = {r["k"]: r["score"] for r in search.bm25(d, "k", "t", ["red"]).collect()}
    assert set(scores) == {1, 2}
    assert scores[2] > scores[1]


def test_files(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("cum;precio unitario;descripcion\n1-1;12,5;a\n2-2;;b\n", encoding="utf-8")
    df = files.read_master(spark, str(path), ["cum", "descripcion"])
    mapping = files.suggest_mapping(df.columns)
    assert mapping == {"cum_code": "cum", "precio_unitario": "precio unitario", "descripcion": "descripcion"}
    assert files.suggest_mapping(["Precio caja", "Código CUM", "Precio"]) == {"cum_code": "Código CUM", "precio_presentacion": "Precio caja", "precio_unitario": "Precio caja"}
    out = files.apply_mapping(df, mapping, ["cum_code", "precio_unitario", "vigente_desde"])
    assert [(r["cum_code"], r["precio_unitario"], r["vigente_desde"], r["raw"]["descripcion"]) for r in out.orderBy("cum_code").collect()] == [("1-1", "12,5", None, "a"), ("2-2", None, None, "b")]


def test_replay_equals_batch(spark, tmp_path):
    folder, table, schema = str(tmp_path / "in"), str(tmp_path / "table"), "k int, v string, pos int"
    parts = [[(1, "a", 1), (2, "b", 2)], [(2, "B", 3), (3, "c", 4)], [(1, "A", 5)]]
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(folder)
        incremental.replay(spark, folder, schema, str(tmp_path / "cp"), incremental.merging(spark, table, ["k"], [F.col("pos").desc()]))
    assert rows(incremental.latest(spark, table)) == [(1, "A", 5), (2, "B", 3), (3, "c", 4)]


def test_refresh_keeps_what_has_no_newer_value(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None), (None, "d", 4.0)], "k int, name string, v double")
    source = spark.createDataFrame([(1, 9.0), (2, None), (4, 8.0)], "k int, v double")
    got = merge.refresh(target, source, "k", ["v"])
    assert got.columns == ["k", "name", "v"]
    assert sorted((r["name"], r["v"]) for r in got.collect()) == [("a", 9.0), ("b", 2.0), ("c", None), ("d", 4.0)]
