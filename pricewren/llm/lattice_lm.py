"""Language-model scores from a subword lattice (operator 7).

The pieces are those of an existing subword vocabulary; their unigram scores are learned from the training documents'
word counts. A word's probability is the sum over all its segmentations into pieces, by forward recursion in log
space; a document's is the product over its words and one end sign. A word-count score stands beside it.

Word counts and word scores are tables keyed by word, never held whole anywhere. Documents are dealt into chunks
whose number follows the input; each chunk asks for its distinct words once and gets their counts and scores back.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import cut, row_hash, split_words, text_bytes, texts_of

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 8 << 20
MARK = "▁"
END = "</s>"


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Natural-log unigram scores of pieces; signs outside the vocabulary are spelled in bytes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=-20.0)

    @classmethod
    def learned(cls, path: str, counts: dict[int, int]) -> Lattice:
        """Scores of the vocabulary's pieces from how often each was used, one added to each count."""
        sp = _processor(path)
        size = sp.get_piece_size()
        total = math.log(sum(counts.values()) + size)
        return cls({sp.id_to_piece(i): math.log(counts.get(i, 0) + 1) - total for i in range(size)})

    def sign(self, sign: str) -> float:
        return sum(self.scores.get(f"<0x{b:02X}>", self.floor) for b in sign.encode("utf-8", "replace"))

    def word(self, word: str) -> float:
        """Natural log of the sum over all segmentations of a word."""
        text = MARK + word
        get, longest = self.scores.get, self.longest
        alpha = [0.0]
        for j in range(1, len(text) + 1):
            ways = []
            for i in range(max(0, j - longest), j):
                score = get(text[i:j])
                if score is not None:
                    ways.append(alpha[i] + score)
            if text[j - 1] not in self.scores:
                ways.append(alpha[j - 1] + self.sign(text[j - 1]))
            best = max(ways)
            alpha.append(best if len(ways) == 1 else best + math.log(math.fsum([math.exp(w - best) for w in ways])))
        return alpha[-1]


def score(docs: DataFrame, learns: Column, vocabulary: str, chunks: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (both log10) for every row of docs.

    Counts and piece scores come from the rows where learns holds. Null texts count as empty: their only token is the
    end. Rows with the same doc_id each get a row. Only doc_id and text are read, so other columns can have any name.
    An empty table gives an empty result. A very long text is one chunk's; a very long word is scored whole.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), learns.alias("learns"), row_hash().alias("t"))
    n = chunks or max(4, -(-text_bytes(rows) // CHUNK_BYTES))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.withColumn("chunk", F.pmod("t", F.lit(n)).cast("int")).drop("t").repartition(n, "chunk")

    def own_words(table: pa.Table) -> pa.Table:
        words, picks, offsets = split_words(texts_of(table), lower=True)
        learned = np.repeat(np.asarray(table.column("learns").combine_chunks()).astype(bool), np.diff(offsets))
        counts = np.bincount(picks[learned], minlength=len(words))
        return pa.table({"chunk": pa.array(np.full(len(words), table.column("chunk")[0].as_py(), np.int32)), "word": words.cast(pa.string()), "n": pa.array(counts.astype(np.int64))})

    asked = cut(dealt.groupBy("chunk").applyInArrow(own_words, "chunk int, word string, n long"), "lm-words")
    counts = cut(asked.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")

    def use_pieces(batches):
        sp = _processor(vocabulary)
        held = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                for i in sp.encode(word):
                    held[i] += c
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"piece": used, "n": held[used]})

    totals = counts.agg(F.sum("c").alias("words"), F.count(F.when(F.col("c") > 0, 1)).alias("distinct")).first()
    ends = rows.where("learns").count()
    pieces = counts.where("c > 0").mapInArrow(use_pieces, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    used = {r["piece"]: r["n"] for r in pieces.collect()}  # a row a piece of the fixed vocabulary
    end_piece = _processor(vocabulary).piece_to_id(END)
    used[end_piece] = used.get(end_piece, 0) + ends
    lattice_scores = Lattice.learned(vocabulary, used).scores
    train_tokens = (totals["words"] or 0) + ends
    distinct = (totals["distinct"] or 0) + (ends > 0)
    per_ln = 1 / math.log(10)
    end_score = lattice_scores[END] * per_ln
    norm = math.log10(train_tokens + distinct + 1)
    shared = spark.sparkContext.broadcast(lattice_scores)  # a number for each piece of the fixed vocabulary

    def weigh(batches):
        lattice = Lattice(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array([lattice.word(w) * per_ln for w in batch.column("word").to_pylist()], pa.float64())], names=["word", "c", "lp"])

    weighed = cut(counts.mapInArrow(weigh, "word string, c long, lp double"), "lm-scores")
    answers = asked.select("chunk", "word").join(weighed, "word")

    def per_document(texts: pa.Table, answer: pa.Table) -> pa.Table:
        words, picks, offsets = split_words(texts_of(texts), lower=True)
        places = pc.index_in(words, value_set=answer.column("word").combine_chunks().cast(words.type)) if len(words) else pa.array([], pa.int32())
        at = np.asarray(places).astype(np.int64)
        c = np.asarray(answer.column("c")).astype(np.int64)[at]
        lp = np.asarray(answer.column("lp"))[at]
        docs_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        add = lambda values: np.bincount(docs_of, weights=values[picks], minlength=len(offsets) - 1)
        base = add(np.log10(c + 1.0) - norm) + (math.log10(ends + 1) - norm)
        size = len(offsets) - 1
        return pa.table({
            "doc_id": texts.column("doc_id"),
            "n_tokens": pa.array(np.diff(offsets) + 1),
            "n_known": pa.array(add((c > 0).astype(float)).astype(np.int64) + (ends > 0)),
            "train_tokens": pa.array(np.full(size, train_tokens, np.int64)),
            "base_score": pa.array(base),
            "score": pa.array(add(lp) + end_score),
        })

    out = f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(per_document, out)
