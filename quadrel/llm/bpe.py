"""Operator 6, BPE encoding and decoding: merge ranks in a priority queue over a linked list of symbols."""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.tokens import byte_alphabet, id_lists

#: Words that a Python worker remembers in each of two generations; a full one takes the older's place.
REMEMBER = 250_000
#: Letters that every Unicode version knows.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: What str.split() takes for white space and Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Bpe:
    """A vocabulary file with merges and word ends; the file's own normalizer and word split go before the merges."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        front = Tokenizer.from_file(path)
        self.normalizer, self.splitter = front.normalizer, front.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(pairs)}
        self.joined = [c for _, _, c in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.cut_special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.seen: dict[str, tuple[bytes, str]] = {}
        self.shown = byte_alphabet()
        self.older: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token, given in the byte alphabet."""
        text = list(word)
        text[-1] += self.suffix
        ids = [self.vocab[s] for s in text if s in self.vocab]
        n, rank_of, joined = len(ids), self.ranks.get, self.joined
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        # an entry holds rank and place; it is stale when the pair now there has another rank
        queue = [rank * n + i for i in range(n - 1) if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), n)
            j = right[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j], right[i] = joined[rank], -1, right[j]
            h, k = left[i], right[i]
            if k < n:
                left[k] = i
                if (rank := rank_of(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(queue, rank * n + i)
            if h >= 0 and (rank := rank_of(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(queue, rank * n + h)
        return [x for x in ids if x >= 0]

    def _fresh(self, text: str) -> tuple[bytes, str]:
        ids = [i for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)) for i in self.merge(w)]
        return np.array(ids, "<i4").tobytes(), self.decode(ids)

    def _plain(self, word: str) -> tuple[bytes, str]:
        ids = self.merge(word)
        return struct.pack(f"<{len(ids)}i", *ids), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids (little-endian 32 bits) and decoded text of what stands between white space."""
        found = self.seen.get(chunk)
        if found is None:
            if len(self.seen) >= REMEMBER:
                self.older = self.seen
                self.seen = {}
            found = self.older.get(chunk)
            if found is None:
                if LETTERS.fullmatch(chunk):  # composed letters: one pre-token, whose lower case is its normal form
                    low = chunk.lower()
                    found = self._plain(low.encode().decode("latin-1").translate(self.shown)) if low == chunk else self._chunk(low)
                elif chunk[-1] in ".," and LETTERS.fullmatch(chunk, 0, len(chunk) - 1):  # two pre-tokens
                    (a, b), (c, d) = self._chunk(chunk[:-1]), self._chunk(chunk[-1])
                    found = a + c, f"{b} {d}"
                else:
                    found = self._fresh(chunk)
            self.seen[chunk] = found
        return found

    def encode_plain(self, text: str) -> list[tuple[bytes, str]]:
        """Neither the words nor the normal form reach across white space, so each word stands alone."""
        return [self._fresh(text)] if _SEPARATORS.search(text) else [self._chunk(c) for c in text.split()]

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """Ids, and what decode() makes of them."""
        parts = []
        for part in self.cut_special.split(text):
            if part in self.special:
                parts.append((np.array([self.special[part]], "<i4").tobytes(), part))
            elif part:
                parts += self.encode_plain(part)
        return b"".join(i for i, _ in parts), " ".join(s for _, s in parts if s)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_decode(text)[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in order; the file names no decoder, so one space stands between them."""
        return " ".join(self.strings[i] for i in ids)


_MODELS: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded of every document.

    Null text counts as empty: no ids, empty decoded text. Repeated rows are encoded each; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                ids, texts = zip(*(bpe.encode_decode(t or "") for t in part["text"].to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part["doc_id"], id_lists(list(ids)), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, decoded string")
