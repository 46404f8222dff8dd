"""Trained models on hard rows, very long texts, fingerprints recomputed in plain Python, and the language stage."""

import hashlib
import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pricewren.llm import exact_dedup, fingerprints, language_id, lattice_lm, mixing, toxicity
from pricewren.llm.common import hash_mod
from pricewren.llm.queries import MIX, PIECES


def signature(text, samples=64):
    """Consistent weighted sampling of a text's words, as the docstring of the module states it."""
    words = Counter(w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text.lower()).split(" ") if w)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of_long = lambda x, seed=42: xxhash.xxh64(struct.pack("<q", signed(x)), seed=seed).intdigest()
    of_pair = lambda x, k: xxhash.xxh64(struct.pack("<i", k), seed=of_long(x)).intdigest()
    uniform = lambda h, part: (((h >> (21 * part)) & ((1 << 21) - 1)) + 0.5) * 2.0**-21
    out = []
    for k in range(samples):
        best = None
        for word, n in words.items():
            term = xxhash.xxh64(word.encode(), seed=42).intdigest()
            h, g = of_pair(term, 2 * k), of_pair(term, 2 * k + 1)
            r, log_c, b = -math.log(uniform(h, 0) * uniform(h, 1)), math.log(-math.log(uniform(g, 0) * uniform(g, 1))), uniform(h, 2)
            t = math.floor(math.log(n) / r + b)
            log_a = log_c - r * (t - b + 1.0)
            pair = (g ^ (t * 2_654_435_761)) & ((1 << 22) - 1)
            drawn = int((log_a + 128.0) * 2.0**32) << 22 | pair
            best = drawn if best is None else min(best, drawn)
        out.append(format((-1 if best is None else best) & 0xFFFFFFFF, "08x"))
    return out


def test_fingerprints_are_those_of_plain_python(spark):
    rng = random.Random(8)
    texts = {1: "one two two three", 2: "  One\ttwo\n\nTWO three ", 3: "", 4: None, 5: " ".join(rng.choice(("á", "b", "c", "dd", "日本")) for _ in range(300)), 6: "x" * 5000, 7: " ".join(f"w{rng.randrange(900)}" for _ in range(20_000))}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprints.edited_pairs(d).collect()}
    chunks = lambda s: [s[i : i + 8] for i in range(0, len(s), 8)]
    order = sorted(texts, reverse=True)
    for doc, text in texts.items():
        text = text or ""
        following = texts[order[(order.index(doc) + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert rows[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, body in (("fingerprint", text), ("edited_fingerprint", edited)):
            # a logarithm may differ in its last bit between libraries
            assert sum(a == b for a, b in zip(chunks(rows[doc][column]), signature(body), strict=True)) >= 63
        likeness = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 64
        assert abs(rows[doc]["near_edited"] - likeness(signature(text), signature(edited))) <= 2 / 64
        assert abs(rows[doc]["near_next"] - likeness(signature(text), signature(following))) <= 2 / 64


@pytest.fixture(scope="module")
def net(docs):
    return language_id.train(docs, F.lit(True), docs_a_language=20)


def test_trained_networks_meet_hard_rows(docs, clashing, no_docs, rows, net):
    assert net is not None
    found = lambda d: sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in language_id.predict(d, net).collect())
    got = found(docs)
    assert found(clashing) == got and len(got) == len(rows)
    assert language_id.predict(no_docs, net).count() == 0
    by_text = {}
    for r in language_id.predict(docs, net).collect():
        assert by_text.setdefault(r["text"], (r["lang_pred"], round(r["score"], 5))) == (r["lang_pred"], round(r["score"], 5))
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {"und", *net.classes}


def test_trained_lexicons_meet_hard_rows(spark, docs, clashing, no_docs, rows):
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows if r[0] is not None] + [(3, None), (3, 0), (None, 1)], "doc_id long, toxic int")
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" you zorbulent idiot"))).otherwise(F.col("text")))
    model = toxicity.train(marked, labels, F.lit(True))
    found = lambda d: sorted((str(r["doc_id"]), round(r["score"], 6), r["predicted"]) for r in toxicity.predict(d, model).collect())
    got = found(docs)
    assert found(clashing) == got and len(got) == len(rows)
    assert toxicity.predict(no_docs, model).count() == 0
    # of the rows learned from, toxic ones score higher than the others
    scores = {True: [], False: []}
    for r in toxicity.predict(marked, model).collect():
        if r["doc_id"] is not None:
            scores[r["doc_id"] % 3 == 0].append(r["score"])
    assert sum(s >= 0.5 for s in scores[True]) > 0.9 * len(scores[True]) and sum(s >= 0.5 for s in scores[False]) < 0.1 * len(scores[False])
    assert all(s == int(x) for x, _, s in [(score >= 0.5, doc, predicted) for doc, score, predicted in got])


def test_very_long_texts_of_the_other_operators(spark, net):
    rng = random.Random(4)
    long = " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) + str(rng.randrange(3000)) for _ in range(60_000))
    d = spark.createDataFrame([(1, long, "en", "src1"), (2, " " + long, "en", "src2"), (3, "word " * 100_000, "de", "src3"), (4, "idiot", None, None)], "doc_id long, text string, lang string, source string")
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.duplicate_groups(d).collect()}
    assert groups == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    mixed = {r["doc_id"]: r["mix_epochs"] for r in mixing.mix(d, **MIX).collect()}
    assert set(mixed) <= {1, 2, 3, 4} and all(n >= 1 for n in mixed.values())
    scored = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in lattice_lm.score(d, hash_mod("doc_id", 7) != 2, PIECES).collect()}
    assert {k: v[0] for k, v in scored.items()} == {1: 60_001, 2: 60_001, 3: 100_001, 4: 2} and all(math.isfinite(v[1]) and v[1] < 0 for v in scored.values())
    assert {r["doc_id"]: r["lang_pred"] in net.classes for r in language_id.predict(d, net).collect()} == dict.fromkeys((1, 2, 3, 4), True)
    model = toxicity.default_model()
    tail = d.withColumn("text", F.concat("text", F.lit(" you idiot")))
    before, after = ({r["doc_id"]: r["score"] for r in toxicity.predict(x, model).collect()} for x in (d, tail))
    assert after[1] > before[1] and before[4] > before[1]


def test_language_stage_on_hard_rows(spark, docs, no_docs, rows):
    """Null ids, repeated rows, clashing names and an empty table; texts without a letter go, and so do nulls."""
    stage = corpus_pipeline.STAGES[0][1]
    named = docs.unionByName(docs).select("*", *(F.lit("x").alias(c) for c in ("lang_pred", "score", "place", "bytes", "model")))
    out = stage(spark, named, None)
    assert out.columns == corpus_pipeline.COLUMNS
    kept = Counter(str((r["doc_id"], r["text"])) for r in out.collect())
    given = Counter(str((r[0], r[1])) for r in rows + rows)
    assert all(kept[k] <= given[k] for k in kept)
    assert not any(str((r[0], r[1])) in kept for r in rows if not any(c.isalpha() for c in r[1] or ""))
    assert stage(spark, no_docs, None).count() == 0
