"""Matching of read names, resolutions, bad rows and closest candidates."""

import random

import pytest
from pyspark.sql import functions as F

from pricewren.operators import fuzzy, matching, rows

CATALOG = [
    (1, "acetaminofen", "tableta", "500 mg", True), (2, "acetaminofen", "tableta", "325mg", True), (3, "acetaminofen", "solucion oral", "500 mg", True), (4, "ABACAVIR SULFATO 702 MG EQUIVALENTE A ABACAVIR", "tableta recubierta", "A", True),
    (5, "ibuprofeno", "tableta", "400 mg", False), (6, "aciclovir", "unguento topico", "50 mg/g", True), (7, "diclofenacoo", "suspension inyectable", "75 mg", True), (8, "acetaminofen", "tableta", "500 mg", True), (9, None, None, None, True), (10, "naproxeno", "tableta", "", None),
]
NAMES = {
    20: ("Paracetamol 500mg Tableta", 1, "EXACT", None), 21: ("Acetaminofen 325 mg tableta", 2, "EXACT", None), 22: ("acetaminofen 0,5 mg tableta", None, "NO_MATCH", "CONCENTRATION_MISMATCH"),
    23: ("Abacavir 300mg tableta recubierta", 4, "EXACT", None), 24: ("ibuprofeno 400 mg tableta", None, "NO_MATCH", "CONCENTRATION_MISMATCH"), 25: ("Diclofenaco 75mg solucion oral", None, "NO_MATCH", "CONCENTRATION_MISMATCH"),
    26: ("Diclofenaco 75mg solucion inyectable", 7, "FUZZY_INN_SAFE", None), 27: ("Acetaminofen + Codeina 325mg + 15mg Tableta", None, "NO_MATCH", "NO_CANDIDATES"), 28: ("Acetaminofen + Codeina 325mg Tableta", None, "NO_MATCH", "INPUT_NOT_MATCHABLE"),
    29: ("naproxeno tableta", None, "NO_MATCH", "CONCENTRATION_MISMATCH"), 30: ("naproxeno 250 mg tableta", 10, "EXACT", None), 31: ("Aciclovir 5% [500mg/10g] Unguento topico", None, None, None), 32: ("zzqq 5 mg", None, "NO_MATCH", "NO_CANDIDATES"), 33: (None, None, None, None), 34: ("Paracetamol 500mg Tableta", 1, "EXACT", None),
}


def catalog(spark):
    return spark.createDataFrame(CATALOG, "item int, ingredient string, form string, concentration string, active boolean")


def test_stages_and_barriers(spark):
    q = spark.createDataFrame([(i, n[0]) for i, n in NAMES.items()], "id int, name string")
    got = {r["id"]: r for r in matching.match_names(q, catalog(spark)).collect()}
    assert set(got) == set(NAMES)
    for i, (name, item, stage, reason) in NAMES.items():
        if stage:
            assert (got[i]["item"], got[i]["stage"], got[i]["reason"]) == (item, stage, reason), name
    assert got[31]["item"] == 6 and got[31]["confidence"] == 1.0
    assert got[22]["closest"] == 1 and got[22]["closest_similarity"] == 1.0 and got[27]["closest"] is None
    assert 0.85 <= got[26]["confidence"] < 1
    assert "COMPONENT_COUNT_MISMATCH" in got[28]["warnings"]


def test_last_resolution_of_the_hospital_wins(spark):
    q = spark.createDataFrame([(1, "Zzqq  5 MG", "A"), (2, "zzqq 5 mg", "B"), (3, "Paracetamol 500mg Tableta", "A"), (4, "zzqq 5 mg", None), (5, "Acetaminofen + Codeina 325mg Tableta", "A")], "id int, name string, hospital string")
    first = matching.match_names(q, catalog(spark))
    assert {r["id"]: r["stage"] for r in first.collect()} == {1: "NO_MATCH", 2: "NO_MATCH", 3: "EXACT", 4: "NO_MATCH", 5: "NO_MATCH"}
    told = [("A", "zzqq 5 mg", 2, "2024-01-01", 1.0), ("A", "ZZQQ 5 mg ", 7, "2024-02-01", 0.9), ("A", "paracetamol 500mg tableta", 3, "2024-01-05", None), (None, "zzqq 5 mg", 6, "2024-01-05", None), ("A", "acetaminofen + codeina 325mg tableta", 1, "2024-01-01", None)]
    resolutions = spark.createDataFrame(told, "hospital string, name string, item int, resolved_at string, confidence double")
    got = {r["id"]: (r["item"], r["stage"], r["confidence"], r["reason"]) for r in matching.match_names(q, catalog(spark), resolutions).collect()}
    assert got == {
        1: (7, "SYNONYM_DICT", 0.9, None), 2: (None, "NO_MATCH", 0.0, "NO_CANDIDATES"), 3: (3, "SYNONYM_DICT", 1.0, None), 4: (6, "SYNONYM_DICT", 1.0, None), 5: (None, "NO_MATCH", 0.0, "INPUT_NOT_MATCHABLE"),
    }


def test_bad_rows_are_errors_among_good_ones(spark):
    lines = spark.createDataFrame([(1, '{"name": "Paracetamol 500mg Tableta", "amount": "1.234,50", "day": "31/12/2024"}'), (2, '{"name": "Paracetamol 500mg Tableta", "amount": "many"}'), (3, "{not json"), (4, '{"amount": "3", "day": "2024-02-30"}'), (5, None)], "id int, line string")
    read = rows.json_rows(lines, "line", {"name": "string", "amount": "decimal(18,4)", "day": "date"}, ("name",))
    out = {r["id"]: r for r in read.collect()}
    assert [out[i]["error"] for i in range(1, 6)] == [None, "bad_amount", "bad_line", "bad_day; no_name", "bad_line"]
    assert (float(out[1]["amount"]), str(out[1]["day"]), out[2]["name"], out[4]["amount"]) == (1234.5, "2024-12-31", "Paracetamol 500mg Tableta", 3)
    got = {r["id"]: (r["item"], r["stage"], r["reason"]) for r in matching.match_names(read, catalog(spark)).collect()}
    assert got == {1: (1, "EXACT", None), 2: (None, "ERROR", "bad_amount"), 3: (None, "ERROR", "bad_line"), 4: (None, "ERROR", "bad_day; no_name"), 5: (None, "ERROR", "bad_line")}


def names(n, seed=1):
    rng = random.Random(seed)
    syllables = [c + v for c in "b c d f g h j l m n p qu r s t v z cl pr tr br fl".split() for v in "a e i o u an en ol ina il".split()]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    words = [word() for _ in range(1500)]
    right = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + " " + rng.choice(("tableta recubierta", "solucion oral", "capsula blanda", ""))).strip() for _ in range(n)]
    left = []
    for i in range(n):
        w = rng.choice(right).split()
        if i % 10 < 5:
            w[rng.randrange(len(w))] = word()
        elif i % 10 < 7:
            w[0] = w[0][: len(w[0]) // 2] + "x" + w[0][len(w[0]) // 2 :]
        elif i % 10 < 9:
            w = [rng.choice(words), word(), "oral"]
        else:
            w = ["".join(rng.choice("qwxzkjvbg") for _ in range(rng.randint(4, 20))), word()[:3]]
        left.append(" ".join(w))
    return left + ["", None, "123"], right + ["", None]


def best_of_all(left, right):
    grams = lambda text: frozenset(f"  {w} "[i : i + 3] for w in (text or "").split() for i in range(len(w) + 1))
    held: dict[str, list[int]] = {}
    sets = [grams(t) for t in right]
    for j, s in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(j)
    out = {}
    for i, q in enumerate(map(grams, left)):
        counts: dict[int, int] = {}
        for g in q:
            for j in held.get(g, ()):
                counts[j] = counts.get(j, 0) + 1
        if counts:
            s, j = min((-c / (len(q) + len(sets[j]) - c), j) for j, c in counts.items())
            out[i] = (j, round(-s, 9))
    return out


@pytest.mark.parametrize("hot", [20_000, 7])
def test_nearest_is_the_best_of_all_pairs(spark, monkeypatch, hot):
    n = 1500 if hot > 100 else 200
    left, right = names(n)
    frames = [spark.createDataFrame(list(enumerate(x)), "key int, t string") for x in (left, right)]
    met, meet = [], fuzzy._meet

    def counted(*args):
        out = fuzzy.written(meet(*args), "met")
        met.append(out.count())
        return out

    monkeypatch.setattr(fuzzy, "HOT", hot)
    monkeypatch.setattr(fuzzy, "FEW_PAIRS", 0 if hot > 100 else 10**9)
    monkeypatch.setattr(fuzzy, "_meet", counted)
    got = {r["left_key"]: (r["right_key"], round(r["similarity"], 9)) for r in fuzzy.nearest(*frames, "key", "t").collect()}
    assert got == best_of_all(left, right)
    if hot > 100:
        assert sum(met) < n * n / 4
    assert fuzzy.nearest(frames[0], frames[1].limit(0), "key", "t").count() == 0
