"""Operators 3, 4, 5, 8, 9, 10 and the pipeline: library, SQL, brute force, held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewren.llm import bpe, fingerprints, language_id, mixing, queries, token_io, toxicity
from pricewren.llm.common import hash_mod


@pytest.fixture(scope="module")
def library():
    return bpe.load(queries.WORD_BPE).full


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeth'!.,1<|ñßİΣé \ń", max_size=300))
def test_encoding_equals_the_library(text):
    coder = bpe.load(queries.WORD_BPE)
    want = coder.full.encode(text, add_special_tokens=False).ids
    ids, _ = coder.encode_batch(pa.array([text], pa.large_string()))
    assert ids.tolist() == want
    parts = [(coder.tokens(p, inside), inside) for p, inside in bpe.segments(text, 24)]
    assert coder.ids(bpe.join_segments(coder, parts)) == want
    assert coder.decode(np.array(want, np.uint32)).decode() == coder.full.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_bpe_rows(request, rows, library, which):
    got = bpe.digests(bpe.encode(request.getfixturevalue(which), queries.WORD_BPE, long_chars=2000)).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 31), st.data())
def test_packing(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=50)), np.uint32)
    assert token_io.unpack(token_io.pack(ids, bits), bits, len(ids)).tolist() == ids.tolist()


def test_token_file_random_access():
    rng = np.random.default_rng(1)
    lengths = [0, 5000, 1, 9000, 0]
    ids = rng.integers(0, 49408, sum(lengths)).astype(np.uint32)
    ends = np.cumsum(lengths)
    f = token_io.TokenFile(token_io.to_file([None, 1, 2, 3, 4], ends, ids, token_io.bits_for(49408)))
    assert f.bits == 16
    assert f.document(3).tolist() == ids[5001:14001].tolist()
    assert [(d, s, i.tolist()) for d, s, i in f] == [(d, int(e - n), ids[e - n : e].tolist()) for d, e, n in zip([None, 1, 2, 3, 4], ends, lengths, strict=True)]


def test_token_files(docs, rows, library):
    got = token_io.round_trip(docs, queries.WORD_BPE, end_id=1).collect()
    start, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_mixing_equals_sql(docs):
    got = mixing.mix(docs, **queries.MIX).select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epochs").alias("epochs")).collect()
    documents = docs.toArrow()  # noqa: F841  read by name
    want = duckdb.sql(queries.ORACLE_SQL["op4_mixing"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_mixing_moves_shortages_to_siblings_first(spark):
    # d0 is given half the budget; its source src0 is short, so src4 (the same domain) makes up for it, and d1 is unchanged
    data = [(i, "a b c d", "en", s) for i, s in enumerate(["src0"] * 2 + ["src4"] * 40 + ["src1"] * 42)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, target_share=(1, 2), max_epochs=1).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["source"]: r["n"] for r in out} == {"src0": 2, "src4": 19, "src1": 21}


def test_fingerprints(docs, rows):
    got = fingerprints.edited_pairs(docs).collect()
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
    texts = [r[1] or "" for r in ordered]
    want, true = [], {}
    for k, r in enumerate(ordered):
        n, nxt = len(texts[k]), texts[(k + 1) % len(texts)]
        edited = texts[k][: n - n // 2] + nxt[: n // 2]
        want.append((r[0], n, hashlib.sha256(edited.encode()).hexdigest()))
        a, b = (Counter(t.lower().split()) for t in (texts[k], edited))
        true[(r[0], n)] = sum((a & b).values()) / max(1, sum((a | b).values()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    errors = [r["near_edited"] - true[(r["doc_id"], r["n_chars"])] for r in got if r["n_chars"] > 20]
    assert abs(np.mean(errors)) < 0.04
    assert max(map(abs, errors)) < 0.3
    by_text = {}
    for r in got:
        by_text.setdefault(next(t for d, t, *_ in rows if d == r["doc_id"]) or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_language_model_learns(spark):
    import random

    rng = random.Random(0)
    parts = {"en": "the ing tion er of and".split(), "de": "sch ung keit ä der".split()}
    data = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(60)), lang) for i, lang in enumerate(["en", "de"] * 40)]
    data += [(100, None, "en"), (101, "123 !!", "de"), (102, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, hash_mod("doc_id", 5) != 0).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    held = [(i, lang) for i, _, lang in data[:80] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.identify(docs, F.lit(False)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = language_id.ByteBiGru(["a", "b"], seed=1)
    windows, labels = rng.integers(97, 100, (3, 6)).astype(np.uint8), np.array([0, 1, 0])
    _, grads = net.gradients(windows, labels)
    for name, at in (("ref", (1, 2)), ("reb", (0, 20)), ("inf", (98, 3)), ("out", (2, 1))):
        losses = []
        for step in (1e-2, -1e-2):
            net.w[name][at] += step
            losses.append(net.gradients(windows, labels)[0])
            net.w[name][at] -= step
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-2, abs=2e-3)


def test_automaton_equals_edit_distance():
    lexicon = toxicity.Lexicon({"idiot": 1.0, "trash": 1.0}, {})
    assert {t for t, _ in lexicon.intersect("idoit")} == set()
    for word in ("idiot", "idiots", "idot", "idxot", "ixdiot"):
        assert {t for t, _ in lexicon.intersect(word)} == {"idiot"}
    assert lexicon.look_up("1d1ot") == (1.0, 1)
    assert lexicon.look_up("harmless") is None


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_misspelled_words_reach_every_term():
    """Of any rank and from five letters on, as brute force finds them."""
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("bcdfglmnprstvz") for _ in range(rng.randint(a, b)))
    long_, short = sorted({word(8, 11) for _ in range(330)}), ["brank", "vogtig"]
    bad = [" ".join([*rng.sample(long_, 40), *rng.sample(short, 1), *(word(4, 9) for _ in range(20))]) for _ in range(300)]
    good = [" ".join(word(4, 9) for _ in range(60)) for _ in range(300)]
    lexicon = toxicity.learn_lexicon(bad + good, np.array([1] * 300 + [0] * 300))
    assert {*long_, *short} <= lexicon.terms.keys()
    for term in (*long_, *short):
        assert lexicon.look_up(term[0] + "w" + term[2:])[1] in (1, 2)
    assert lexicon.look_up("brxnk") == (lexicon.terms["brank"], 1)
    terms = {word(4, 7): float(i) for i in range(300)}
    lexicon = toxicity.Lexicon(terms, {})
    for probe in {word(4, 8) for _ in range(2000)} | {t[:2] + t[3:] for t in terms if len(t) > 4}:
        near = [w for t, w in terms.items() if len(t) >= 5 and _edits(t, probe) <= 1]
        assert lexicon.look_up(probe) == ((terms[probe], 0) if probe in terms else (max(near), 1) if near else None)


def test_terms_in_joined_and_masked_words():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "moron": 2.0, "trash": 1.0}, {"scumb": 4.0})
    for word in ("idiot's", "idiot’s", "idiot-you", "idiot—you", "you/idiot", "(idiot).", "idiot...you", "idiot,you", "idiot!you", "idiot*you", "l'idiot"):
        assert lexicon.hits(word) == [(3.0, 0)], word
    for word in ("id*ot", "id!ot", "idi?ot", "id*ot's", "you-id*ot", "1d10t", "1d10t's", "id#0t"):
        assert lexicon.hits(word) == [(3.0, 1)], word
    for word in ("mor-on", "mor'on", "mor–on", "mor-n", "mor-on's", "you-mor-on"):
        assert lexicon.hits(word) == [(2.0, 1)], word
    assert lexicon.hits("moron/idiot") == [(2.0, 0), (3.0, 0)]
    assert lexicon.hits("scumbags/idiots") == [(4.0, 2), (3.0, 1)]
    assert lexicon.look_up("moron/idiot") == (3.0, 0)
    for word in ("", "-", "--//", "it's", "i-d-i-o-t", "2024-01-01", "http://a.b/c?d=e", "don't/won't"):
        assert lexicon.hits(word) == [], word
    counts = toxicity.features(pa.array(["moron/idiot", "you", None], pa.large_string()).fill_null(""), lexicon)
    assert counts[0, 0] == pytest.approx(math.log(3))
    assert not counts[1:].any()
    texts = [f"{'grambol-you' if i < 60 else 'fine'} " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(9)) for i in range(120)]
    assert "grambol" in toxicity.learn_lexicon(texts, np.array([1] * 60 + [0] * 60)).terms


def test_toxicity(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" you stup1d idiot"))).otherwise(F.col("text")))
    model = toxicity.train(marked, labels, hash_mod("doc_id", 5) != 0)
    got = toxicity.predict(marked, model).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 60 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) >= 0.9
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.predict(no_docs, toxicity.train(no_docs, labels, F.lit(True))).count() == 0
    quoted, plain_ = toxicity.default_model().score(pa.array(['he said "you idiot" yesterday to them', "you idiot go away right now"], pa.large_string()))
    assert quoted < plain_


def test_empty_tables(no_docs):
    assert bpe.encode(no_docs, queries.WORD_BPE).count() == 0
    assert token_io.round_trip(no_docs, queries.WORD_BPE).count() == 0
    assert mixing.mix(no_docs, **queries.MIX).count() == 0
    assert fingerprints.edited_pairs(no_docs).count() == 0
    assert language_id.identify(no_docs, F.lit(True)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    """Every stage on what the one before kept; the last against the library."""
    import corpus_pipeline

    docs.where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out
    kept = {r["doc_id"] for r in out}
    assert not kept & {72, 74, 75, 76, 82}  # copies, empty texts and texts without a letter
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.WORD_BPE)
    whole.no_truncation()
    whole.no_padding()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        ids = whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = whole.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
