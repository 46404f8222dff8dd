"""Ranked lexical search, hard negatives and page texts against brute force, and on hard rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewren.llm import hard_negatives, html_text, lexical
from pricewren.llm.pages import made_pages

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, k=10):
    terms = lambda text: TERM.findall((text or "").translate(UPPER))
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for doc, counts in own:
            m = 100 - 90 + (90 * sum(counts.values()) * n_docs) // total
            score = 0
            for term in set(terms(text)) & set(counts):
                df = sum(term in c for _, c in own)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * counts[term]) // (1000 * counts[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


ITEMS = [(1, "The er ing of AND tion"), (2, "ly bo mi"), (3, ""), (4, None), (5, "nothing-matches-this zzzz"), (6, "Ünï çödé 日本語 é"), (7, "the the the the"), (7, "bo"), (8, "one two"), (8, "one two")]


def test_lexical_ranks_are_those_of_brute_force(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = ranked([(r[0], r[1]) for r in rows], ITEMS)
    got = lambda d, i: sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in lexical.rank(d, i).collect())
    assert got(docs, items) == want
    # small shards, and one block of terms for each item
    monkeypatch.setattr(lexical, "SHARD", 9)
    monkeypatch.setattr(lexical, "POSTINGS", 40)
    monkeypatch.setattr(lexical, "TERM_BYTES", 12)
    odd = docs.select("*", *(F.lit("x").alias(c) for c in ("n", "terms", "shard", "place", "score", "term", "rank")))
    assert got(odd, items.select("*", F.lit("y").alias("words"), F.lit("y").alias("place"))) == want


def test_lexical_ties_and_empty_tables(spark, no_docs):
    docs = spark.createDataFrame([(i, "same words here") for i in range(40)] + [(100, "other text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words here")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical.rank(docs, items).orderBy("rank").collect()] == list(range(10))
    assert lexical.rank(no_docs, items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0


def test_tree_search_opens_few_ranges_and_all_ties(monkeypatch):
    rng = np.random.default_rng(3)
    term, doc = np.repeat(np.arange(5), 300), np.concatenate([np.sort(rng.choice(2000, 300, replace=False)) for _ in range(5)])
    share = rng.integers(1, 6, len(term)) * 100
    terms, keys, shares = lexical.tree(term, doc, share, 2000)
    weights = np.array([3, 1, 4, 1, 5])
    whole = np.zeros(2000, np.int64)
    np.add.at(whole, doc, share * weights[term])
    got = lexical.search_tree(keys, [s.astype(np.int64) for s in shares], 2000, np.arange(5), weights, 10, 1)
    kth = np.sort(whole)[-10]
    assert sorted(got) == sorted((int(whole[d]), int(d)) for d in np.flatnonzero(whole >= kth))
    assert lexical.search_tree(keys, shares, 2000, np.arange(5), weights, 10, int(whole.max()) + 1) == []


def mined(rows, every=100):
    took = []
    for vec, v, label in {(a, None if b is None else tuple(b), c) for a, b, c in rows}:
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        took.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for vec, label, q in took:
        if vec % every:
            continue
        near = sorted((-score(q, w), i) for i, own, w in took if own == label and i != vec)[:5]
        others = [(-score(q, w), i) for i, own, w in took if own != label]
        for s, positive in near:
            fit = sorted(x for x in others if 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(vec, positive, r, i, -s, -x) for r, (x, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(11)
    out = []
    for i in range(700):
        length = rng.choice((0.1, 1.0, 1.0, 3.0))
        out.append((i, [rng.gauss(0.2, 0.4) * length for _ in range(6)], rng.choice((0, 0, 0, 1, 2))))
    out += [(1000 + i, [0.5] * 6, 0) for i in range(60)] + [(1100, [0.5] * 6, 1), (1200, [0.5] * 6, 1), (1201, [0.5] * 6, 0)]
    out += [(2000, None, 1), (2100, [1.0, None, 0.0], 1), (2200, [float("nan")] * 6, 1), (2300, [float("inf"), 0.0], 0), (2400, [0.1] * 6, None), (None, [1.0] * 6, 0)]
    out += [out[5], (400, [0.3, 0.2], 2), (2500, [], 0), (2600, [0.0] * 6, 1), (2700, [-1.0] * 6, 3), (2800, [40000.0] * 6, 4), (2801, [40000.0] * 6, 4), (2802, [39000.0] * 6, 5)]
    return out


def test_hard_negatives_are_those_of_brute_force(spark, vectors, monkeypatch):
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(3)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = lambda df: sorted(tuple(r[c] for c in columns) for r in hard_negatives.mine(df).collect())
    want = mined(vectors)
    assert len(want) > 100
    assert got(d) == want
    for name, value in (("BUCKET", 16), ("STRIPE", 64), ("BLOCK", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    odd = d.select("*", *(F.lit("x").alias(c) for c in ("pack", "q", "norm", "anchor", "mark", "score", "id", "rank")))
    assert got(odd) == want
    assert hard_negatives.mine(d.limit(0)).count() == 0


def test_buckets_below_every_limit_are_left_out():
    block = {"norms": np.array([10.0]), "ids": np.array([0]), "labels": np.array([0]), "vectors": np.array([[10, 0]], np.int16)}
    rows = {"norms": np.array([9.0, 3.0]), "ids": np.array([1, 2]), "labels": np.array([0, 0]), "vectors": np.array([[9, 0], [3, 0]], np.int16)}
    search = hard_negatives.Search(block, np.array([0]), np.array([-(2**63)]), np.array([2**63 - 1]), True, 1)
    assert search.look({k: v[:1] for k, v in rows.items()}) and not search.look({k: v[1:] for k, v in rows.items()})
    assert (search.scored, search.id.tolist(), search.score.tolist()) == (1, [1], [90])


def test_products_are_exact_for_large_components():
    a = np.array([[2**40 + 1, 3]]), np.array([[2**21 + 1, 5], [2**40, 1]])
    assert hard_negatives.products(*a, 2.0**62).tolist() == [[(2**40 + 1) * (2**21 + 1) + 15, 2**63 - 1]]


PAGE = """<!doctype html><html><head><title>T</title><script>var t="</p><p>no</p>";</script><style>p{}</style></head><body>
<div id="cookie-notice"><p>We use cookies.</p></div><header><a href="/">Site</a></header><nav><ul><li><a href=/a>Home<li><a href=/b>News</ul></nav>
<div class="content"><h1>A title &amp; more</h1><p>First   paragraph,\n with a <a href="x">link</a> and <b>bold&nbsp;text</b>. It goes on for some words.
<p>Second one &lt;here&gt; &#233;, which is also long enough to look like a text. <!-- gone --> Yes.<div class="ad">Buy now</div>
<p>Third paragraph of this article, with a comma, and an end.</p></div><div class="comments"><h3>Comments</h3><div class="comment"><p>I like it. Very much so.</p></div></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside><footer>&copy; 2024 Site. All rights reserved.</footer>"""


def test_blocks_of_a_page_with_open_elements():
    blocks = html_text.blocks_of(PAGE)
    assert [b.text for b in blocks] == [
        "We use cookies.", "Site", "Home", "News", "A title & more", "First paragraph, with a link and bold text. It goes on for some words.",
        "Second one <here> é, which is also long enough to look like a text. Yes.", "Buy now", "Third paragraph of this article, with a comma, and an end.", "Comments", "I like it. Very much so.", "Related", "Other story", "© 2024 Site. All rights reserved.",
    ]
    assert [t for t, _ in blocks[3].path] == ["html", "body", "nav", "ul", "li"] and blocks[3].linked == 4
    assert blocks[5].path[-1][0] == blocks[6].path[-1][0] == "p" and blocks[5].path == blocks[6].path
    for odd in ("", " \n", "<", "<p", "a<b", "<p class='x>text", "</div></p>x", "<script>never ended", "<a b='" * 2000, "<p>" * 3000 + "x", "&#0;&#xFFFFFFF;&nope;"):
        html_text.features(html_text.blocks_of(odd))


@pytest.fixture(scope="module")
def held(spark):
    from pyspark.sql.types import StringType, StructField, StructType

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ba ne ti lo ru se".split()) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(4, 60))).capitalize() + "." for _ in range(200)]
    bodies = ["".join(f"<p>{t}</p>" for t in rng.sample(texts, 5)) for _ in range(60)]
    pages = [f"<html><body><nav><a href=/>{word()}</a></nav><div class=ad>{word()}</div><article><h1>{word()} {word()}</h1>{b}</article><footer>© {word()}</footer></body></html>" for b in bodies]
    return texts, html_text.train(spark.createDataFrame([(p,) for p in pages], StructType([StructField("html", StringType())])))


def test_articles_of_unseen_pages_are_found(spark, held):
    texts, model = held
    field = html_text.Field.from_json(model)
    right = wrong = missed = whole = 0
    pages = list(made_pages(texts, 150, 1234))
    for page, wanted in pages:
        got, want = Counter(html_text.main_text(page, field).split("\n")), Counter(wanted)
        right, wrong, missed, whole = right + sum((got & want).values()), wrong + sum((got - want).values()), missed + sum((want - got).values()), whole + (got == want)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95 and whole > 120
    assert html_text.main_text(PAGE, field).split("\n") == [b.text for b in html_text.blocks_of(PAGE)][4:7] + ["Third paragraph of this article, with a comma, and an end."]


def test_pages_of_any_kind_have_one_row(spark, held):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "u", "<p>" + "Long text, with words. " * 40000 + "</p>"), (4, "u", "<html><body></body></html>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(7).alias("text"), F.lit("z").alias("n_chars"), F.lit("w").alias("path"))
    got = html_text.extract(d, held[1])
    assert got.columns == ["page_id", "url", "html", "path", "text", "n_chars"]
    out = {(r["page_id"], r["html"]): r for r in got.collect()}
    assert got.count() == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert out[2, None]["text"] == out[3, ""]["text"] == out[4, rows[5][2]]["text"] == ""
    assert out[1, PAGE]["text"].startswith("A title & more\n")
    assert html_text.extract(d.limit(0), held[1]).count() == 0
    assert html_text.extract(d, html_text.train(d.limit(0))).count() == len(rows)


def test_marginals_decoding_and_gradient_are_those_of_all_labellings():
    from itertools import product

    rng = np.random.default_rng(5)
    names = [f"f{i}" for i in range(6)]
    pages = [[(tuple(rng.choice(names, 2)), ("bias",)) for _ in range(n)] for n in (4, 1, 3)]
    field = html_text.Field([*names, "bias"])
    field.weights, field.moves = rng.normal(size=7), rng.normal(size=(2, 2))

    def score(page, labels):
        own = sum(field.weights[field.place[f]] for groups, y in zip(page, labels, strict=True) if y for g in groups for f in g)
        return own + sum(field.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))

    for page in pages:
        assert tuple(field.decode(page)) == max(product((0, 1), repeat=len(page)), key=lambda y: score(page, y))
    labels = [rng.integers(0, 2, len(p)).tolist() for p in pages]
    want = sum(score(p, y) - np.log(sum(np.exp(score(p, z)) for z in product((0, 1), repeat=len(p)))) for p, y in zip(pages, labels, strict=True)) / 3
    at, feature, lengths = field._batch(pages)
    padded = np.array([y + [0] * (4 - len(y)) for y in labels], float)
    value, by_weight, by_move = field.gradient(at, feature, lengths, padded, 0.0)
    assert value == pytest.approx(want)
    for i in range(7):
        field.weights[i] += 1e-6
        assert (field.gradient(at, feature, lengths, padded, 0.0)[0] - value) / 1e-6 == pytest.approx(by_weight[i], abs=1e-4)
        field.weights[i] -= 1e-6
    for a, b in product((0, 1), repeat=2):
        field.moves[a, b] += 1e-6
        assert (field.gradient(at, feature, lengths, padded, 0.0)[0] - value) / 1e-6 == pytest.approx(by_move[a, b], abs=1e-4)
        field.moves[a, b] -= 1e-6
