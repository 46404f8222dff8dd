"""Toxicity scores from a lexicon that misspelled words still reach (operator 9).

The lexicon is a trie of a seed list and of terms and stems learned from labelled documents. A word is looked up by
intersecting a Levenshtein automaton of distance one with that trie. Each hit is judged in a window of words around
it: hits inside quotation marks or after a verb of speech are counted apart from those in running abuse. A logistic
regression, trained in numpy on a bounded sample of labelled rows, turns the counts into a score.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewren.llm.common import split_words, texts_of

#: Terms that count from the start.
SEED_TERMS = ("idiot", "idiots", "moron", "stupid", "loser", "losers", "pathetic", "scum", "worthless", "trash", "disgusting", "clown", "bastard", "filthy", "garbage", "vermin")
#: Words that report what somebody said.
SPEECH = frozenset(("said", "says", "called", "wrote", "quoted", "quote", "word", "term", "dijo", "dit", "sagte", "schrieb"))
QUOTES = "\"'`«»“”„‘’"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¿¡–—"
#: What joins words, and what is neither a letter nor a sign that may stand for one.
JOINTS = re.compile(r"[-\u2010-\u2015\u2212/\\|'`´‘’.,:;…+=&_~()\[\]{}<>\"«»“”„]+")
OTHERS = re.compile(r"[^\w@$]+")
LEET = str.maketrans("013457@$", "oieastas")
#: Words that may be near a term, which a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Words on either side of a hit that its window holds.
CONTEXT = 6
STEM_SIZES = (4, 5, 6, 7)
#: Labelled documents of each label that training takes at most, and code points of all of them together.
SAMPLE, SAMPLE_CHARS = 4000, 16_000_000
#: The least documents a learned entry is seen in, and its least likelihood ratio.
LEAST_DOCS, LEAST_RATIO = 4, 24.0
#: The shortest terms that misspelled words may reach.
FUZZY_CHARS = 5


class LevenshteinAutomaton:
    """Accepts the words within distance k of a word. A state is the sparse row of edit distances up to k."""

    def __init__(self, word: str, k: int = 1):
        self.word, self.k = word, k

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.k, len(self.word)) + 1))

    def step(self, state, sign: str):
        out: dict[int, int] = {}
        at = dict(state)
        if 0 in at and at[0] < self.k:
            out[0] = at[0] + 1
        for i, cost in state:
            if i < len(self.word):
                best = min(cost + (self.word[i] != sign), out.get(i, self.k + 1) + 1, at.get(i + 1, self.k + 1) + 1)
                if best <= self.k:
                    out[i + 1] = best
        return tuple(sorted(out.items()))

    def distance(self, state) -> int | None:
        return dict(state).get(len(self.word))


class Lexicon:
    """Terms and stems with weights; lookups go through the trie of the terms."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.terms, self.stems = terms, stems
        self.trie: dict = {}
        # a word within one edit of a term is the term, or shares a string that either becomes by losing one sign
        self.shortened: set[str] = set()
        fuzzy = [t for t in terms if len(t) >= FUZZY_CHARS]
        for term in fuzzy:
            node = self.trie
            for sign in term:
                node = node.setdefault(sign, {})
            node[""] = term
            self.shortened.update((term, *(term[:i] + term[i + 1 :] for i in range(len(term)))))
        self.longest = max(map(len, fuzzy), default=0) + 1
        self.seen: dict[str, tuple[float, int] | None] = {}

    def _may_be_near(self, word: str) -> bool:
        if len(word) > self.longest:
            return False
        return word in self.shortened or any(word[:i] + word[i + 1 :] in self.shortened for i in range(len(word)))

    def _near(self, word: str) -> tuple[float, int] | None:
        """The heaviest term at distance one, remembered for words that may be near one."""
        if word not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            near = [self.terms[t] for t, _ in self.intersect(word)]
            self.seen[word] = (max(near), 1) if near else None
        return self.seen[word]

    def intersect(self, word: str, k: int = 1) -> Iterator[tuple[str, int]]:
        """Terms within distance k of word, with their distance: the automaton of word walks the trie."""
        automaton = LevenshteinAutomaton(word, k)
        open_ = [(self.trie, automaton.start())]
        while open_:
            node, state = open_.pop()
            for sign, below in node.items():
                if sign == "":
                    if (d := automaton.distance(state)) is not None:
                        yield below, d
                elif nxt := automaton.step(state, sign):
                    open_.append((below, nxt))

    def _one(self, word: str) -> tuple[float, int] | None:
        """Weight and kind of a word without joints; a sign that isn't a letter is one edit, unless it stands for one."""
        if len(word) < 4:
            return None
        plain, read = word, word if word.isalpha() else word.translate(LEET)
        if read.isalpha():
            weight = self.terms.get(read)
            if weight is not None:
                return weight, 0 if plain is read else 1
            for k in STEM_SIZES:
                weight = self.stems.get(read[:k])
                if weight is not None and len(read) > k:
                    return weight, 2
        for form in dict.fromkeys((read, plain)):
            if self._may_be_near(form) and (hit := self._near(form)):
                return hit
        return None

    def hits(self, raw: str) -> list[tuple[float, int]]:
        """Weight and kind (0 exact, 1 misspelled, 2 a stem) of each term in a lower-case word and in the words joined in it."""
        word = raw.strip(EDGES)
        if word.isalpha():
            hit = self._one(word)
            return [hit] if hit else []
        pieces = [m.span() for m in re.finditer(r"\S+", JOINTS.sub(lambda m: " " * len(m[0]), word))]
        found: list[list[tuple[float, int]]] = []
        for start, end in pieces:
            piece = word[start:end]
            hit = self._one(piece)
            # a sign that is no edit of a term may still stand between two
            found.append([hit] if hit else [h for part in OTHERS.split(piece) if part != piece and (h := self._one(part))])
        out = [h for own in found for h in own]
        # a joint inside a term is one edit: neighbours that are nothing by themselves are looked up with it
        k = 0
        while k + 1 < len(pieces):
            pair = word[pieces[k][0] : pieces[k + 1][1]]
            if not found[k] and not found[k + 1] and self._may_be_near(pair) and (hit := self._near(pair)):
                out.append(hit)
                k += 1
            k += 1
        return out

    def look_up(self, raw: str) -> tuple[float, int] | None:
        """The heaviest hit in a lower-case word, or None."""
        return max(self.hits(raw), default=None)


#: Hits in running text: 0 to 2 counts by kind, 5 and 6 sum and greatest of weights, 7 with another hit near, 8 a hundred words, 9 weights of misspelled
#: words; 3 and 4 count and weights of quoted or reported hits.
FEATURES = 10


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    words, picks, offsets = split_words(pc.utf8_lower(texts))
    vocabulary = words.to_pylist()
    found = {i: hits for i, w in enumerate(vocabulary) if (hits := lexicon.hits(w))}
    out = np.zeros((len(offsets) - 1, FEATURES))
    if not found:
        return out
    is_hit = np.zeros(len(vocabulary), bool)
    is_hit[list(found)] = True
    at = np.flatnonzero(is_hit[picks])
    docs = np.searchsorted(offsets, at, side="right") - 1
    quotes = {}

    def marks(k: int) -> int:
        if k not in quotes:
            w = vocabulary[k]
            quotes[k] = sum(w.count(q) for q in QUOTES) if w[0] in QUOTES or w.rstrip(".,;:!?")[-1:] in QUOTES else 0
        return quotes[k]

    for i, (place, doc) in enumerate(zip(at.tolist(), docs.tolist(), strict=True)):
        hits = found[picks[place]]
        start, end = max(int(offsets[doc]), place - CONTEXT), min(int(offsets[doc + 1]), place + CONTEXT + 1)
        before, after = picks[start:place], picks[place + 1 : end]
        own = marks(int(picks[place]))
        quoted = own >= 2 or (sum(marks(int(k)) for k in before) + (own and vocabulary[picks[place]][0] in QUOTES)) % 2 == 1
        reported = any(vocabulary[k].strip(EDGES) in SPEECH for k in before[-3:])
        near = len(hits) > 1 or (i > 0 and docs[i - 1] == doc and place - at[i - 1] <= CONTEXT) or (i + 1 < len(at) and docs[i + 1] == doc and at[i + 1] - place <= CONTEXT)
        row = out[doc]
        for weight, kind in hits:
            if quoted or reported:
                row[3] += 1
                row[4] += weight
            else:
                row[kind] += 1
                row[5] += weight
                row[6] = max(row[6], weight)
                row[7] += near
                row[9] += weight * (kind == 1)
    lengths = np.diff(offsets)
    out[:, 8] = 100 * out[:, :3].sum(axis=1) / np.maximum(lengths, 20)
    return np.log1p(np.maximum(out, 0))


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(texts, self.lexicon) @ self.weights + self.bias, -30, 30)))

    def to_json(self) -> str:
        return json.dumps({"terms": self.lexicon.terms, "stems": self.lexicon.stems, "weights": self.weights.tolist(), "bias": self.bias})

    @classmethod
    def from_json(cls, text: str) -> ToxicityModel:
        got = json.loads(text)
        return cls(Lexicon(got["terms"], got["stems"]), np.array(got["weights"]), got["bias"])


def default_model() -> ToxicityModel:
    """What counts without any label: the seed terms, outside quotation."""
    weights = np.zeros(FEATURES)
    weights[[0, 1]] = 2.0, 1.0
    return ToxicityModel(Lexicon(dict.fromkeys(SEED_TERMS, 4.0), {}), weights, -2.0)


def _ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Likelihood ratio (G squared) of an entry in a of n1 toxic and b of n0 other documents, if toxic ones have more."""
    if a * n0 <= b * n1:
        return 0.0
    g = 0.0
    for k, n, other in ((a, n1, n0), (b, n0, n1)):
        for seen, total in ((k, a + b), (n - k, n1 + n0 - a - b)):
            if seen:
                g += seen * math.log(seen * (n + other) / (n * total))
    return 2 * g


def _family(words: set[str]) -> tuple[int, ...]:
    """The three least hashes of a document's words, which near copies share."""
    return tuple(sorted(xxhash.xxh3_64_intdigest(w) for w in words)[:3])


def parts(raw: str) -> list[str]:
    """The words that a word is made of, without the signs at their edges."""
    word = raw.strip(EDGES)
    return [word] if word.isalpha() else [x.strip(EDGES) for x in JOINTS.split(word)]


def learn_lexicon(texts: list[str], labels: np.ndarray) -> Lexicon:
    """Seed terms, and terms and stems that toxic documents have significantly more often.

    Of near copies only the first counts, so that a copied document's words don't look significant.
    """
    own_words = [{c for w in set(t.lower().split()) for c in parts(w) if len(c) >= 4 and c.isalpha()} for t in texts]
    families: dict[tuple, int] = {}
    for i, own in enumerate(own_words):
        families.setdefault((int(labels[i]), *_family(own)), i)
    kept = sorted(families.values())
    own_words, labels = [own_words[i] for i in kept], labels[kept]
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    terms, stems = (Counter(), Counter()), (Counter(), Counter())
    for own, label in zip(own_words, labels.tolist(), strict=True):
        terms[label].update(own)
        stems[label].update({w[:k] for w in own for k in STEM_SIZES if len(w) > k})

    def weigh(counts):
        for entry, a in counts[1].items():
            b = counts[0][entry]
            # an entry must mark toxic documents alone, or nearly so
            if a >= LEAST_DOCS and b * 20 * n1 <= a * n0 and (g := _ratio(a, b, n1, n0)) >= LEAST_RATIO:
                yield g, entry, math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))

    best_stems: dict[str, float] = {}
    for _, entry, w in sorted(weigh(stems), key=lambda x: (-x[0], x[1])):
        if not any(entry[:k] in best_stems for k in STEM_SIZES if k < len(entry)):
            best_stems[entry] = w
    best = {entry: w for _, entry, w in sorted(weigh(terms), key=lambda x: (-x[0], x[1]))}
    return Lexicon(dict.fromkeys(SEED_TERMS, 4.0) | best, best_stems)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 600, rate: float = 0.3, ridge: float = 1e-3) -> ToxicityModel:
    """Lexicon from half the documents and weights from the other half, then a lexicon from all of them."""
    if len(set(labels.tolist())) < 2:
        return default_model()
    half = np.arange(len(labels)) % 2 == 0
    x, y = [], []
    for mine in (half, ~half):  # each half's features come from the other half's lexicon
        lexicon = learn_lexicon([t for t, m in zip(texts, mine, strict=True) if m], labels[mine])
        x.append(features(pa.array([t for t, m in zip(texts, mine, strict=True) if not m], pa.large_string()), lexicon))
        y.append(labels[~mine])
    x, y = np.concatenate(x), np.concatenate(y).astype(float)
    w, bias = np.zeros(FEATURES), math.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    m = v = np.zeros(FEATURES + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        g = np.append((p - y) @ x / len(y) + ridge * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return ToxicityModel(learn_lexicon(texts, labels), w, float(bias))


def train(docs: DataFrame, labels: DataFrame, learnable: Column) -> ToxicityModel:
    """Fit on rows of docs where learnable holds and labels has a label (toxic 0 or 1); default_model() without any.

    The sample is bounded: SAMPLE documents of each label, the first by a hash of doc_id, of which those stay whose texts
    fit into SAMPLE_CHARS with all that come before them by length, the shortest first. A document with two different
    labels counts as toxic, a null text as empty, and a row that repeats as often as it comes. What is learned is bounded by
    the sample. Rows without a doc_id have no label.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    own = docs.where(learnable).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "size"))
    drawn = own.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size")).join(marked, "doc_id").withColumn("place", place).where(F.col("place") <= SAMPLE)
    through = F.sum(F.col("size").cast("long")).over(Window.partitionBy("label").orderBy("size", "place"))
    ids = drawn.withColumn("through", through).where(F.col("through") <= SAMPLE_CHARS).select("doc_id", "label").distinct()
    sample = own.join(ids, "doc_id")

    def one(table: pa.Table) -> pa.Table:
        got = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True))
        return pa.table({"model": [fit([t for _, t, _ in got], np.array([y for _, _, y in got])).to_json()]})

    model = sample.groupBy(F.lit(1).alias("one")).applyInArrow(one, "model string").first()
    return ToxicityModel.from_json(model["model"]) if model else default_model()


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) for every row of docs; null and empty texts score as a text without hits.

    Whole texts are scored, however long; rows that repeat get equal results. Only doc_id and text are read.
    """
    weights = model.to_json()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        known = ToxicityModel.from_json(weights)
        for batch in batches:
            score = known.score(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
