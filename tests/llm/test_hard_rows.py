"""Clashing names, repeated rows, null ids, empty tables and very long texts; and what the other tests leave to brute force."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricewren.llm import bpe, exact_dedup, fingerprints, language_id, lattice_lm, mixing, ngram_join, suffix_dedup, token_io, toxicity
from pricewren.llm.common import hash_mod
from pricewren.llm.queries import MIX, PIECES, WORD_BPE



def model():
    return toxicity.default_model()


CALLS = {
    "suffix": lambda d: suffix_dedup.remove_repeats(d).select("doc_id", "n_bytes"),
    "exact": lambda d: exact_dedup.duplicate_groups(d).select("doc_id", "group_size"),
    "tokens": lambda d: token_io.round_trip(d, WORD_BPE, end_id=1).select("doc_id", "n_tokens"),
    "fingerprints": lambda d: fingerprints.edited_pairs(d).select("doc_id", "n_chars"),
    "join": lambda d: ngram_join.join_classes(d).select("doc_id", "n_shingles"),
    "lattice": lambda d: lattice_lm.score(d, hash_mod("doc_id", 7) != 2, PIECES).select("doc_id", "n_tokens"),
    "language": lambda d: language_id.predict(d, None).select("doc_id", "lang_pred"),
    "toxicity": lambda d: toxicity.predict(d, model()).select("doc_id", "predicted"),
    "bpe": lambda d: bpe.encode(d, WORD_BPE).select("doc_id", "n_tokens"),
}


@pytest.mark.parametrize("name", CALLS)
def test_one_row_each_whatever_the_columns(docs, clashing, no_docs, rows, name):
    got = sorted(map(str, CALLS[name](clashing).collect()))
    assert got == sorted(map(str, CALLS[name](docs).collect()))
    assert len(got) == len(rows)
    assert CALLS[name](no_docs).count() == 0


def test_mixing_takes_any_column_names(docs, no_docs):
    named = docs.select("*", *(F.lit("x").alias(c) for c in ("mix_domain", "_m", "_domain", "epochs", "rest", "slice", "key", "row", "tokens")))
    plain = sorted((str(r["doc_id"]), r["mix_domain"], r["mix_epochs"]) for r in mixing.mix(docs, **MIX).collect())
    assert plain == sorted((str(r["doc_id"]), r["mix_domain"], r["mix_epochs"]) for r in mixing.mix(named, **MIX).collect())
    assert mixing.mix(no_docs, **MIX).count() == 0


def test_dedup_keeps_rows_not_ids(spark):
    base = " ".join(f"word{i}" for i in range(60))
    data = [(1, base), (1, base), (2, base + " more"), (None, base), (None, None), (None, "alone in the world here now"), (3, ""), (3, ""), (4, "x y")]
    d = spark.createDataFrame(data, "doc_id long, text string").select("*", F.lit("z").alias("t"), F.lit(1).alias("key"))
    exact = sorted(map(str, ((r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(d).collect())))
    assert exact == sorted(map(str, [(1, base), (2, base + " more"), (None, "alone in the world here now"), (3, ""), (4, "x y")]))
    near = ngram_join.keep_one_a_class(d).collect()
    assert d.columns == list(near[0].asDict())
    # the null id comes first in the class of base; empty texts link with nothing, and repeats of one row go
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in near))) == sorted(map(str, [(None, base), (None, None), (None, "alone in the world here now"), (3, ""), (4, "x y")]))


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) + str(rng.randrange(5000)) for _ in range(15_000))
    d = spark.createDataFrame([(1, long), (2, long + " end"), (3, "q" * 70_000), (4, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_classes(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(d).collect()} == {1: 0, 2: len(long), 3: 70_000 - 1, 4: 0}
    ids = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(d, WORD_BPE).collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_io.round_trip(d, WORD_BPE).collect()}
    assert got == {k: (len(v) // 4, zlib.crc32(v)) for k, v in ids.items()}


def test_pivots_are_drawn_and_links_are_whole(spark, monkeypatch):
    """Form letters with few ways to fill ten places, and no pairs compared outright: pivots decide, and no component is lost."""
    monkeypatch.setattr(ngram_join, "PAIRS_A_POINT", 0)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, data = [word() for _ in range(100)], []
    for i in range(60):
        t = list(base)
        for k in range(10):
            t[10 * k + 5] = f"way{rng.choice((0, 0, 0, 1, 2))}"
        data.append((i, " ".join(t)))
    counts: dict[str, int] = {}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_classes(spark.createDataFrame(data, "doc_id long, text string"), counts).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for _, t in data]
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i] for i in range(60)] == label
    assert counts["first"] > 0 and counts["pivots"] > 0


def test_lattice_scores_of_documents(docs, rows):
    """The operator's score is the sum of its lattice over the words and the end."""
    got = lattice_lm.score(docs, hash_mod("doc_id", 7) != 2, PIECES).collect()
    sp = lattice_lm._processor(PIECES)
    words = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    used, ends = {}, 0
    for r in rows:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            ends += 1
            for w in words(r[1]):
                for i in sp.encode(w):
                    used[i] = used.get(i, 0) + 1
    end = sp.piece_to_id(lattice_lm.END)
    lattice = lattice_lm.Lattice.learned(PIECES, used | {end: used.get(end, 0) + ends})
    want = sorted((str(r[0]), round((sum(map(lattice.word, words(r[1]))) + lattice.scores[lattice_lm.END]) / math.log(10), 4)) for r in rows if len(r[1] or "") < 3000)
    have = [(str(r["doc_id"]), round(r["score"], 4)) for r in got]
    assert all(any(h[0] == w[0] and abs(h[1] - w[1]) < 1e-3 for h in have) for w in want)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(5, 7)))
    terms = {word() for _ in range(80)}
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), {})
    for _ in range(60):
        w = word()
        for k in (1, 2):
            assert dict(lexicon.intersect(w, k)) == {t: d for t in terms if (d := _distance(w, t)) <= k}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[1:4], ids=lambda s: s[0])
def test_stages_on_hard_rows(spark, docs, no_docs, stage):
    """Null ids, ties, repeated rows, clashing columns and empty tables."""
    named = docs.unionByName(docs).select("*", *(F.lit("x").alias(c) for c in ("mix_domain", "t", "key", "row", "keep_id", "component_id")))
    out = stage[1](spark, named, None)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(map(str, out.collect())) == sorted(map(str, stage[1](spark, docs.unionByName(docs), None).collect()))
    assert stage[1](spark, no_docs, None).count() == 0


def test_token_stage_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    whole.no_truncation()
    whole.no_padding()
    want = []
    for r in docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.tokens(spark, docs, None).collect()]
    assert sorted(got) == sorted(want)
