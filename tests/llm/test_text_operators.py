"""Operators 1, 2, 6 and 7 against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricewren.llm import exact_dedup, lattice_lm, ngram_join, suffix_dedup
from pricewren.llm.common import hash_mod
from pricewren.llm.queries import PIECES


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def brute_repeats(rows):
    seen, out = set(), []
    for doc, text, *_ in order(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_repeats(request, rows, which):
    got = suffix_dedup.remove_repeats(request.getfixturevalue(which)).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)


def test_repeats_kept_text_and_cover(docs):
    for row in suffix_dedup.remove_repeats(docs, with_text=True).collect():
        assert hashlib.sha256(row["kept"]).hexdigest() == row["kept_sha256"]
    assert {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.V))


def brute_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault("".join((r[1] or "").split(" ")).translate(str.maketrans("", "", "\t\n\v\f\r")), []).append(r)
    out = []
    for normal, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out += [(r[0], keep, len(members), r[0] == keep, hashlib.sha256(normal.encode()).hexdigest()) for r in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_exact_groups(request, rows, which):
    got = exact_dedup.duplicate_groups(request.getfixturevalue(which)).collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_quotient_filters_merge_without_loss():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b[:50], b[50:60] = a[:50], a[7]
    make = lambda x: exact_dedup.CountingQuotientFilter.of(x, 6)
    merged, whole = make(a).merge(make(b)), make(np.concatenate([a, b]))
    assert (merged.fingerprints() == whole.fingerprints()).all()
    assert (merged.counts == whole.counts).all()
    assert int(merged.counts.sum()) == 800
    assert set(merged.repeated().tolist()) == {k for k, n in Counter(np.concatenate([a, b]).tolist()).items() if n > 1}


def brute_classes(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(-(1 << 63) if r[0] is None else r[0], shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    real = lambda d: None if d == -(1 << 63) else d
    return sorted(((real(d), len(s), real(find(d))) for d, s in sets), key=str)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_classes(request, rows, which):
    got = ngram_join.join_classes(request.getfixturevalue(which)).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows)


def test_classes_of_a_large_group_through_regions(spark, monkeypatch):
    """Many near copies in chains, with regions split by pivots down to the last round."""
    import random

    monkeypatch.setattr(ngram_join, "PAIRS_A_POINT", 1)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, data = [word() for _ in range(80)], []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(80)] = word()
        data.append((i, " ".join(t)))
    got = ngram_join.join_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(data)


def test_language_model(docs, rows):
    learns = hash_mod("doc_id", 7) != 2
    got = lattice_lm.score(docs, learns, PIECES).collect()
    words = lambda r: (r[1] or "").encode().lower().decode().translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
    own = [(r[0], [w for w in words(r) if w], zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2) for r in rows]
    count, ends = Counter(w for _, ws, learn in own if learn for w in ws), sum(learn for *_, learn in own)
    total, norm = sum(count.values()) + ends, 0.0
    norm = math.log10(total + len(count) + 1 + 1)
    want = sorted((str(d), len(ws) + 1, sum(w in count for w in ws) + 1, total, round(sum(math.log10(count[w] + 1) - norm for w in ws) + math.log10(ends + 1) - norm, 5)) for d, ws, _ in own)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_lattice_sums_all_segmentations():
    scores = {"▁": -1.0, "▁a": -1.5, "a": -2.0, "b": -2.5, "ab": -1.2, "▁ab": -3.0}
    lattice = lattice_lm.Lattice(scores)

    def every(text):
        if not text:
            return 1.0
        return sum(math.exp(s) * every(text[len(p) :]) for p, s in scores.items() if text.startswith(p))

    assert lattice.word("abab") == pytest.approx(math.log(every("▁abab")))


def test_empty_tables(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert exact_dedup.duplicate_groups(no_docs).count() == 0
    assert ngram_join.join_classes(no_docs).count() == 0
    assert lattice_lm.score(no_docs, F.lit(True), PIECES).count() == 0
