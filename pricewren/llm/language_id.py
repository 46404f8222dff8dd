"""Language identification with a bidirectional gated recurrent network over bytes (operator 8).

The network is trained in numpy by backpropagation through time, in one task, on windows of a bounded sample of
labelled rows. It then labels every position of every text: a text is cut into windows of ``WINDOW`` bytes that run
side by side, one pass forward and one backward, and a document's probabilities are the mean over its positions.
Gates are hard sigmoids and the candidate a clipped identity, which numpy does at memory speed.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewren.llm.common import release, texts_of

WINDOW = 64
HIDDEN = 8
#: Labelled documents a language, and windows of each, that training takes at most.
DOCS_A_LANGUAGE = 400
WINDOWS_A_DOC = 8
UNKNOWN = "und"


def _matrix(rng, *shape, scale):
    return (rng.standard_normal(shape) * scale).astype(np.float32)


class ByteBiGru:
    """Weights: by direction an input table (256 x 3H) and a recurrent matrix (H x 3H), and one output layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        h, c = HIDDEN, max(1, len(classes))
        self.w = {"out": _matrix(rng, 2 * h, c, scale=0.3), "bias": np.zeros(c, np.float32)}
        for d in "fb":
            self.w["in" + d] = _matrix(rng, 256, 3 * h, scale=0.3)
            self.w["in" + d][:, :h] += 1.0  # gates begin by keeping what they hold
            self.w["re" + d] = _matrix(rng, h, 3 * h, scale=0.3)

    # -- inference ------------------------------------------------------------------------------------------
    def _states(self, steps: np.ndarray, d: str, keep: bool = False):
        """Hidden states (T, B, H) for bytes (T, B) in the order of the direction; keep: also what training needs."""
        h = HIDDEN
        table, recur = self.w["in" + d], self.w["re" + d]
        time, batch = steps.shape
        states = np.empty((time, batch, h), np.float32)
        now = np.zeros((batch, h), np.float32)
        kept = []
        a = np.empty((batch, 3 * h), np.float32)
        x = np.empty((batch, 3 * h), np.float32)
        for t in range(time):
            np.take(table, steps[t], axis=0, out=x, mode="clip")
            np.dot(now, recur, out=a)
            gates = x[:, : 2 * h] + a[:, : 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0.0, 1.0, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            n = r * a[:, 2 * h :]
            n += x[:, 2 * h :]
            np.clip(n, -1.0, 1.0, out=n)
            nxt = states[t]
            np.subtract(now, n, out=nxt)
            nxt *= z
            nxt += n
            if keep:
                kept.append((now, gates, n, a[:, 2 * h :].copy()))
            now = nxt
        return (states, kept) if keep else states

    def _probabilities(self, states_f: np.ndarray, states_b: np.ndarray) -> np.ndarray:
        logits = states_f @ self.w["out"][:HIDDEN]
        logits += states_b @ self.w["out"][HIDDEN:]
        logits += self.w["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, C) of each position of windows (B, T)."""
        steps = np.ascontiguousarray(windows.T).astype(np.intp)
        return self._probabilities(self._states(steps, "f"), self._states(steps[::-1], "b")[::-1])

    def documents(self, data: np.ndarray, lengths: np.ndarray, block: int = 1024) -> np.ndarray:
        """Mean probabilities (docs, C) over the bytes of each document; data: all their bytes."""
        ends = np.cumsum(lengths)
        out = np.zeros((len(lengths), len(self.classes)))
        a = 0
        while a < len(lengths):  # some documents at a time, so what is held doesn't follow the batch
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - lengths[a] + (2 << 20), side="right")))
            out[a:b] = self._documents(data[ends[a] - lengths[a] : ends[b - 1]], lengths[a:b], block)
            a = b
        return out

    def _documents(self, data: np.ndarray, lengths: np.ndarray, block: int) -> np.ndarray:
        counts = -(-lengths // WINDOW)
        first = np.cumsum(counts) - counts
        windows = np.full((int(counts.sum()), WINDOW), 32, np.uint8)
        flat = windows.reshape(-1)
        for at, start, size in zip((first * WINDOW).tolist(), (np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), strict=True):
            flat[at : at + size] = data[start : start + size]
        sizes = np.full(len(windows), WINDOW)
        full = counts > 0
        sizes[(first + counts - 1)[full]] = lengths[full] - (counts[full] - 1) * WINDOW
        sums = np.zeros((len(windows), len(self.classes)), np.float64)
        for a in range(0, len(windows), block):
            p = self.positions(windows[a : a + block])
            size = sizes[a : a + block]
            if (size < WINDOW).any():
                p *= (np.arange(WINDOW)[:, None] < size)[:, :, None]
            sums[a : a + block] = p.sum(axis=0)
        out = np.zeros((len(lengths), len(self.classes)))
        if full.any():
            out[full] = np.add.reduceat(sums, first[full], axis=0) / lengths[full, None]
        return out

    # -- training -------------------------------------------------------------------------------------------
    def _back(self, steps, d, kept, grads_h):
        """Gradients of one direction's weights, from those of its states."""
        h = HIDDEN
        recur = self.w["re" + d]
        time, batch = steps.shape
        d_recur = np.zeros_like(recur)
        d_x = np.empty((time, batch, 3 * h), np.float32)
        carry = np.zeros((batch, h), np.float32)
        for t in range(time - 1, -1, -1):
            before, gates, n, a_n = kept[t]
            z, r = gates[:, :h], gates[:, h:]
            g = grads_h[t] + carry
            d_n = g * (1 - z) * (np.abs(n) < 1)
            d_gates = np.concatenate([g * (before - n), d_n * a_n], axis=1) * (0.25 * ((gates > 0) & (gates < 1)))
            d_a = np.concatenate([d_gates, d_n * r], axis=1)
            d_x[t, :, : 2 * h], d_x[t, :, 2 * h :] = d_gates, d_n
            d_recur += before.T @ d_a
            carry = g * z + d_a @ recur.T
        one_hot = np.zeros((time * batch, 256), np.float32)
        one_hot[np.arange(time * batch), steps.reshape(-1)] = 1
        return one_hot.T @ d_x.reshape(-1, 3 * h), d_recur

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients."""
        steps = np.ascontiguousarray(windows.T).astype(np.intp)
        back = np.ascontiguousarray(steps[::-1])
        (f, kept_f), (b, kept_b) = self._states(steps, "f", True), self._states(back, "b", True)
        b_in_order = b[::-1]
        p = self._probabilities(f, b_in_order)
        right = p[:, np.arange(len(labels)), labels]
        g = p.copy()
        g[:, np.arange(len(labels)), labels] -= 1
        g /= g.shape[0] * g.shape[1]
        flat = g.reshape(-1, g.shape[-1])
        grads = {"out": np.concatenate([f.reshape(-1, HIDDEN).T @ flat, b_in_order.reshape(-1, HIDDEN).T @ flat]), "bias": flat.sum(axis=0)}
        grads["inf"], grads["ref"] = self._back(steps, "f", kept_f, g @ self.w["out"][:HIDDEN].T)
        grads["inb"], grads["reb"] = self._back(back, "b", kept_b, (g @ self.w["out"][HIDDEN:].T)[::-1])
        return float(-np.log(np.maximum(right, 1e-9)).mean()), grads

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 350, batch: int = 128, rate: float = 0.02, seed: int = 7) -> float:
        """Adam on batches in which each class is as likely; returns the last losses' mean."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(by_class[c]) for c in rng.integers(len(self.classes), size=batch)])
            loss, grads = self.gradients(windows[pick], labels[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:])) if losses else 0.0

    def to_json(self) -> str:
        return json.dumps({"classes": self.classes, "w": {k: v.tolist() for k, v in self.w.items()}})

    @classmethod
    def from_json(cls, text: str) -> ByteBiGru:
        got = json.loads(text)
        out = cls(got["classes"])
        out.w = {k: np.array(v, dtype=np.float32) for k, v in got["w"].items()}
        return out


def _byte_lengths(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and each one's length in bytes."""
    lengths = np.asarray(pc.binary_length(texts)).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and lengths.sum() else np.zeros(0, np.uint8)
    return data, lengths


def train(docs: DataFrame, labelled: Column, docs_a_language: int = DOCS_A_LANGUAGE, seed: int = 7) -> ByteBiGru | None:
    """Fit on rows where labelled holds and text and lang aren't null; None where there are none.

    The sample is bounded: docs_a_language documents of each language, the first by a hash of doc_id, and
    WINDOWS_A_DOC windows of each. Only these windows and then the weights leave the tasks.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(labelled & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.select("doc_id", "lang").withColumn("place", place).where(F.col("place") <= docs_a_language).select("doc_id").distinct()

    def cut_windows(batches):
        for batch in batches:
            langs, data = [], []
            for lang, text, doc in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                rng = np.random.default_rng([seed, len(raw), hash(doc) & 0xFFFFFFFF])
                for at in {0, *rng.integers(0, max(1, len(raw) - WINDOW + 1), size=WINDOWS_A_DOC - 1).tolist()}:
                    langs.append(lang)
                    data.append(raw[at : at + WINDOW].ljust(WINDOW))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "bytes": pa.array(data, pa.binary())})

    def fit(table: pa.Table) -> pa.Table:
        got = sorted(zip(table.column("lang").to_pylist(), table.column("bytes").to_pylist(), strict=True))
        classes = sorted({lang for lang, _ in got})
        labels = np.array([classes.index(lang) for lang, _ in got])
        windows = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(-1, WINDOW)
        net = ByteBiGru(classes, seed)
        net.fit(windows, labels, seed=seed)
        release()
        return pa.table({"model": [net.to_json()]})

    sampled = rows.join(chosen, "doc_id", "left_semi").mapInArrow(cut_windows, "lang string, bytes binary")
    model = sampled.groupBy(F.lit(1).alias("one")).applyInArrow(fit, "model string").first()
    return ByteBiGru.from_json(model["model"]) if model else None


def predict(docs: DataFrame, net: ByteBiGru | None) -> DataFrame:
    """Every column of docs plus ``lang_pred`` and ``score``; a clashing column of docs is replaced.

    `und` and score 0 where the text is null, empty or has no letter, or nothing was learned.
    """
    weights = net.to_json() if net else None
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        model = ByteBiGru.from_json(weights) if weights else None
        for batch in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
            table = pa.Table.from_batches([batch])
            if model and batch.num_rows:
                texts = texts_of(batch)
                known = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
                p = model.documents(*_byte_lengths(texts))
                best = p.argmax(axis=1)
                names_ = np.array(model.classes, dtype=object)[best]
                table = table.set_column(table.column_names.index("lang_pred"), "lang_pred", pa.array(np.where(known, names_, UNKNOWN), pa.string()))
                score = np.where(known, np.minimum(1.0, p[np.arange(len(best)), best]), 0.0)
                table = table.set_column(table.column_names.index("score"), "score", pa.array(score, pa.float64()))
            yield from table.to_batches()
            release()

    return rows.mapInArrow(run, rows.schema)


def identify(docs: DataFrame, labelled: Column) -> DataFrame:
    """Train on the labelled rows of docs and predict all of them."""
    return predict(docs, train(docs, labelled))
