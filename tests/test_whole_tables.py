"""Queries without SQL against plain Python over whole tables."""

import difflib
import hashlib
import re
import unicodedata
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricewren.functions import text
from pricewren.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def folded(value):
    return unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower()


def stripped(value):
    return "".join(c for c in unicodedata.normalize("NFD", re.sub("[®™]", "", value)) if not unicodedata.category(c).startswith("M"))


def test_folds_of_all_documents(spark):
    sha = lambda t: None if t is None else hashlib.sha1(t.encode()).hexdigest()
    of = lambda f, t: None if t is None else sha(f(t))
    want = {r["doc_id"]: (of(folded, r["text"]), of(stripped, r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"]: (r["folded"], r["stripped"]) for r in QUERIES["fold_texts"](spark, SF).collect()} == want


def test_folds_of_latin_letters_and_signs(spark):
    signs = [chr(i) for i in (*range(0x20, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2060), *range(0x2100, 0x2190)) if unicodedata.category(chr(i))[0] not in "CM"]
    values = [f"a{c}Z" for c in signs]
    rows = spark.createDataFrame([(v,) for v in values], "c string").select("c", text.ascii_fold(F.col("c")).alias("f"), text.strip_marks(F.col("c")).alias("s")).collect()
    assert {(r["c"], r["f"]) for r in rows} == {(v, folded(v)) for v in values}
    latin = {v for v, c in zip(values, signs, strict=True) if c.isalpha() and ord(c) < 0x250}
    assert {(r["c"], r["s"]) for r in rows if r["c"] in latin} == {(v, stripped(v)) for v in latin}


def test_documents_have_doses_to_find(spark):
    found = QUERIES["extract_doses"](spark, SF)
    assert found.count() > spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {"ml", "mg", "mcg", "ui", "g"} <= {r[0] for r in found.select(F.regexp_replace("dose", "^[0-9.]+", "")).distinct().collect()}


def test_margins_of_all_names(spark):
    names = sorted({r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect() if r["p_name"]})
    grams = {n: {f"  {w} "[i : i + 3] for w in re.findall(r"\w+", n.lower()) for i in range(len(w) + 1)} for n in names}
    # the five parts of a name's words: no doses and no maker count half, a search rank that is missing counts nothing
    words = {n: {w.upper() for w in n.split() if len(w) >= 4} for n in names}
    scores: dict[str, list[tuple[float, str]]] = {}
    for a, b in permutations(names, 2):
        if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.3:
            common = len(words[a] & words[b]) / max(len(words[a]), len(words[b])) if words[a] and words[b] else 0.0 if words[a] else 0.5
            ratio = difflib.SequenceMatcher(None, a, b).ratio()
            scores.setdefault(a, []).append((ratio * 0.45 + 0.5 * 0.25 + 0.5 * 0.15 + common * 0.10, b))
    got = {r["left_key"]: r for r in QUERIES["homologation_margin"](spark, SF).collect()}
    assert set(got) == set(scores)
    for name, found in scores.items():
        ranked = sorted(found, key=lambda x: (-x[0], x[1]))
        row, best = got[name], ranked[0][0]
        assert row["score"] == pytest.approx(best) and row["right_key"] in {b for s, b in ranked if s == pytest.approx(best)}
        margin = best - ranked[1][0] if len(ranked) > 1 else best
        assert row["margin"] == pytest.approx(margin)
        assert row["accepted"] == (row["score"] >= 0.93 and row["margin"] >= 0.10)
