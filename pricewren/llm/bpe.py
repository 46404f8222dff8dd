"""BPE encoding and decoding (operator 10).

Texts are cut at ASCII white space, where no token crosses, and each distinct piece of a batch is encoded once.
An unsplit run that is long is encoded by tree concatenation: its halves are encoded apart, and growing windows
around each join are encoded again until both sides agree exactly. Documents above ``long_chars`` code points are
dealt out in segments, encoded by different tasks, and joined the same way.

A join is right when every pair of neighbouring tokens is itself what the merges make of the pair's text; that
condition on neighbours is both necessary and sufficient for a BPE encoding, so a window is enough.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import ragged_take, release, split_words, texts_of

#: Runs of more symbols than this are encoded by tree concatenation.
LEAF = 48
#: Documents of more code points than this are dealt out in segments.
LONG_CHARS = 65_536
#: Runs that a worker remembers before it starts anew.
REMEMBERED = 120_000
#: Pieces that need no library normalizer: printable signs below U+0250, of which none changes another's lower case.
_SIMPLE = regex.compile(r"[\x21-\x7E\xA1-\xAC\xAE-\u012F\u0131-\u0148\u014A-\u024F]+")
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class TreeBpe:
    """A tokenizers file with a normalizer, a regex splitter, byte-level symbols and a word-end suffix."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        spec = json.load(open(path, encoding="utf-8"))
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = dict(model["vocab"])
        self.closed_model = self.full.model
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._open_args = (self.vocab, merges)
        self._open_model = None
        self._models = models
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self._remembered: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self._bytes = str.maketrans({chr(b): chr(256 + k) for k, b in enumerate(others)})

    @property
    def vocabulary_size(self) -> int:
        return max(self.names) + 1

    @property
    def open_model(self):
        """The same merges without the word-end suffix, for what isn't the end of a run."""
        if self._open_model is None:
            self._open_model = self._models.BPE(vocab=self._open_args[0], merges=self._open_args[1])
        return self._open_model

    # -- one run of symbols ---------------------------------------------------------------------------------
    def _leaf(self, symbols: str, closed: bool) -> list[str]:
        model = self.closed_model if closed else self.open_model
        return [t.value for t in model.tokenize(symbols)]

    def _plain(self, token: str, closed: bool) -> str:
        return token[: len(token) - len(self.suffix)] if closed and self.suffix else token

    def _agree(self, a: str, b: str, b_closed: bool) -> bool:
        return self._leaf(a + self._plain(b, b_closed), b_closed) == [a, b]

    def join(self, left: list[str], right: list[str], closed: bool) -> list[str]:
        """The encoding of two neighbouring parts of a run; closed: right ends the run."""
        if not left or not right:
            return left or right
        width = 1
        last = lambda k: closed and k >= len(right)
        if self._agree(left[-1], right[0], last(1)):
            return left + right
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            end = closed and b == len(right)
            text = "".join(left[a:]) + "".join(right[:b])
            window = self._leaf(self._plain(text, end), end)
            ok_left = a == 0 or self._agree(left[a - 1], window[0], end and len(window) == 1)
            ok_right = b == len(right) or self._agree(window[-1], right[b], last(b + 1))
            if ok_left and ok_right:
                return left[:a] + window + right[b:]
            width *= 2

    def run(self, symbols: str, closed: bool = True) -> list[str]:
        """Tokens of one run of symbols, by halves."""
        if len(symbols) <= LEAF:
            return self._leaf(symbols, closed) if symbols else []
        half = len(symbols) // 2
        return self.join(self.run(symbols[:half], False), self.run(symbols[half:], closed), closed)

    # -- texts ----------------------------------------------------------------------------------------------
    def runs(self, text: str) -> list[str]:
        """Runs of byte-level symbols, as the tokenizer's normalizer and splitter make them."""
        return [s for s, _ in self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(text))]

    def tokens(self, text: str, open_end: bool = False) -> list[str]:
        """Tokens of a text; open_end: its last run goes on in the next segment."""
        parts = self._special_split.split(text) if self._special_split else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if part in self.special:
                out.append(part)
                continue
            runs = self.runs(part) if part else []
            for i, run in enumerate(runs):
                out += self.run(run, not (open_end and k == len(parts) - 1 and i == len(runs) - 1))
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        return [self.vocab[t] if t in self.vocab else self.special[t] for t in tokens]

    def _run_ids(self, run: str) -> bytes:
        """Ids of a run of lower-case letters or of other signs below U+0250, remembered."""
        got = self._remembered.get(run)
        if got is None:
            if len(self._remembered) >= REMEMBERED:
                self._remembered.clear()
            symbols = run if run.isascii() else run.encode().decode("latin-1").translate(self._bytes)
            if len(symbols) <= LEAF:
                ids = [t.id for t in self.closed_model.tokenize(symbols)]
            else:
                ids = self.ids(self.run(symbols))
            got = self._remembered[run] = np.array(ids, dtype="<u4").tobytes()
        return got

    def piece(self, text: str) -> bytes:
        """Ids (little-endian, 32 bits each) of a text without ASCII white space."""
        low = text.lower()
        got = self._remembered.get(low)
        if got is not None:
            return got
        if low[-1] in ".,":  # only runs are remembered, so what is left is a run of its own
            got = self._remembered.get(low[:-1])
            if got is not None and low[-2].isalpha():
                return got + self._run_ids(low[-1])
        if _SIMPLE.fullmatch(text) and "<|" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            if low.isalpha():
                return self._run_ids(low)
            return b"".join(map(self._run_ids, _RUNS.findall(low)))
        return np.array(self.ids(self.tokens(text)), dtype="<u4").tobytes()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts, and each text's end among them."""
        words, picks, offsets = split_words(texts)
        pieces = [self.piece(w) for w in words.to_pylist()]
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), dtype="<u4")
        places, ends = ragged_take(np.cumsum(lengths) - lengths, lengths, picks)
        return flat[places], np.concatenate([[0], ends])[offsets[1:]] if len(offsets) > 1 else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of decode(ids, skip_special_tokens=False) of a tokenizer without a decoder: names joined by spaces."""
        table, lengths, starts = self._name_table
        picks = ids.astype(np.int64)
        if len(picks) == 0:
            return b""
        places, _ = ragged_take(starts, lengths, picks)
        return table[places].tobytes()[:-1]

    @property
    def _name_table(self):
        got = self.__dict__.get("_names")
        if got is None:
            blobs = [(self.names[i].encode() + b" ") if i in self.names else b"" for i in range(self.vocabulary_size)]
            lengths = np.array([len(b) for b in blobs], dtype=np.int64)
            got = self.__dict__["_names"] = (np.frombuffer(b"".join(blobs), np.uint8), lengths, np.cumsum(lengths) - lengths)
        return got


@lru_cache(maxsize=4)
def load(path: str) -> TreeBpe:
    return TreeBpe(path)


# -- segments of long texts -----------------------------------------------------------------------------------
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_LETTERS = regex.compile(r"\p{L}{9,}|[^\s\p{L}\p{N}'<|>]{9,}")


def _cut_before(text: str, at: int, least: int) -> tuple[int, bool]:
    """A place in (least, at] where text can be cut, and whether the cut is inside a run."""
    for m in range(at, max(least, at - 4096), -1):
        if _SPACE.match(text, m):
            return m, False
    for m in range(at, max(least, at - 256), -1):
        near = text[max(0, m - 8) : m + 1].lower()
        around = text[max(0, m - 16) : m + 16]
        if len(near) == 9 and "<|" not in around and _LETTERS.fullmatch(near) and not any(map(unicodedata.combining, near)):
            whole = unicodedata.normalize("NFC", around)
            cut = min(16, m)
            if whole == unicodedata.normalize("NFC", around[:cut]) + unicodedata.normalize("NFC", around[cut:]):
                return m, True
    at = _SPACE.search(text, at)
    return (at.start(), False) if at else (len(text), False)


def segments(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """Parts of at most about size code points, each with whether its last run goes on in the next part."""
    start = 0
    while len(text) - start > size:
        at, inside = _cut_before(text, start + size, start)
        if at >= len(text):
            break
        yield text[start:at], inside
        start = at
    yield text[start:], False


def join_segments(bpe: TreeBpe, parts: list[tuple[list[str], bool]]) -> list[str]:
    """Tokens of a whole text from those of its segments, in pairs: halves first, then the joins."""
    while len(parts) > 1:
        paired = []
        for i in range(0, len(parts), 2):
            pair = parts[i : i + 2]
            if len(pair) == 1:
                paired += pair
                continue
            (a, inside), (b, ahead) = pair
            if inside and a and b:
                ends = lambda t: t.endswith(bpe.suffix) or t in bpe.special
                tail = len(a)
                while tail and not ends(a[tail - 1]):
                    tail -= 1
                head = next((k + 1 for k, t in enumerate(b) if ends(t)), len(b))
                closed = ends(b[head - 1])
                a = a[:tail] + bpe.join(a[tail:], b[:head], closed) + b[head:]
            else:
                a = a + b
            paired.append((a, ahead))
        parts = paired
    return parts[0][0] if parts else []


# -- DataFrames -----------------------------------------------------------------------------------------------
def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS) -> DataFrame:
    """Each document with ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` (binary, UTF-8).

    Null texts count as empty: no ids and an empty decoded text. Rows are kept as they come, so repeated rows give
    repeated results; only id_col and text_col are read, so other columns can have any name. A null id stays null.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_tokens long, ids binary, decoded binary"
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))

    def whole(batches):
        bpe = load(tokenizer)
        for batch in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):  # bounds the arrays of ids
            ids, ends = bpe.encode_batch(texts_of(batch))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            parts = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ends - starts, pa.int64()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()), pa.array([bpe.decode(p) for p in parts], pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )
            release()

    def deal(batches):
        for batch in batches:
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                for k, (part, inside) in enumerate(segments(text, long_chars)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], batch.schema.field("doc_id").type), pa.array([key]), pa.array([k]), pa.array([part]), pa.array([inside])], names=["doc_id", "row", "k", "part", "inside"])

    def part_tokens(batches):
        bpe = load(tokenizer)
        for batch in batches:
            tokens = [json.dumps(bpe.tokens(t, i)) for t, i in zip(batch.column("part").to_pylist(), batch.column("inside").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "k", "inside")), pa.array(tokens)], names=["doc_id", "row", "k", "inside", "tokens"])

    def joined(table: pa.Table) -> pa.Table:
        bpe = load(tokenizer)
        parts = sorted(zip(table.column("k").to_pylist(), table.column("tokens").to_pylist(), table.column("inside").to_pylist(), strict=True))
        ids = np.array(bpe.ids(join_segments(bpe, [(json.loads(t), i) for _, t, i in parts])), dtype="<u4")
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "n_tokens": pa.array([len(ids)]), "ids": pa.array([ids.tobytes()], pa.binary()), "decoded": pa.array([bpe.decode(ids)], pa.binary())})

    short = rows.where(~is_long).mapInArrow(whole, out)
    dealt = rows.where(is_long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(deal, f"doc_id {id_type}, row long, k long, part string, inside boolean")
    coded = dealt.repartition("row", "k").mapInArrow(part_tokens, f"doc_id {id_type}, row long, k long, inside boolean, tokens string")
    return short.unionByName(coded.groupBy("row").applyInArrow(joined, out))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 (lowercase hex) of the ids and of the decoded text."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
