"""Token ids of whole documents, and operator 5: token-id output in ORC.

The ids are those of the tokenizers library. Pre-tokens never span a single white character between two
black ones, so a text is encoded word by word and the words' ids are kept in a bounded cache. Many texts are cut
into pre-tokens at once, and the merges of their distinct pre-tokens are made side by side.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrel.llm.base import scratch

END = 0
#: Parts whose bases are broadcast: 16 MB.
PARTS = 1_000_000
_ROW = "part int, at long, n long, ids array<int>"
#: Words whose ids a Python worker remembers in each of two generations; a full one takes the older's place.
REMEMBER = 500_000
_DOUBLE_WHITE = re.compile(r"\s\s|^\s|\s\Z")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Letters that every Unicode version knows, then at most one mark: one or two pre-tokens.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")

#: Bytes of text that are encoded at once, one text at least.
AT_ONCE = 4 << 20
#: Widths of the tables of pre-tokens that are merged side by side; longer ones go one by one.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48)
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_TOKEN, _WORD, _TEXT = range(3)
#: No symbol, and a symbol that went into the one before it.
_PAD, _GONE = 65535, 65534
_NEVER, _EMPTY = np.int32(2**31 - 1), np.uint32(2**32 - 1)


def _byte_classes() -> np.ndarray:
    """Byte -> its class. A to Z, digits and the letters from À to ÿ (0xC3 and a byte from 0x80 on) are told apart here."""
    kinds = np.full(256, _HARD, np.uint8)
    kinds[33:127] = _OTHER
    kinds[[*b"\t\n\r "]] = _SPACE
    kinds[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
    kinds[48:58] = _DIGIT
    kinds[39] = _HARD  # may begin a contraction
    return kinds


_CLASSES = _byte_classes()
#: White characters of three bytes.
_WHITE = np.array([int.from_bytes(chr(c).encode()) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


class _Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode, lead: str) -> None:
        self.encode, self.lead, self.older = encode, lead, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = self.encode(self.lead + word)
        self[word] = found
        return found


def byte_alphabet() -> dict[int, str]:
    """Byte -> its printable character: itself where it is printable Latin-1, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Pairs:
    """(symbol, symbol) -> rank of their merge, for arrays of pairs: hash tables, each for what met a taken slot before."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        keys, ranks, self.levels, factor = self._key(left, right), np.arange(len(left), dtype=np.int32), [], 0x9E3779B1
        while len(keys):
            slots, first = np.unique(self._slot(keys, np.uint32(factor)), return_index=True)
            own, found = np.full(1 << self.BITS, _EMPTY), np.full(1 << self.BITS, _NEVER, np.int32)
            own[slots], found[slots] = keys[first], ranks[first]
            self.levels.append((np.uint32(factor), own, found))
            keys, ranks, factor = np.delete(keys, first), np.delete(ranks, first), (factor * 0x85EBCA6B + 2) % 2**32 | 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)

    def _slot(self, keys: np.ndarray, factor: np.uint32) -> np.ndarray:
        return (keys * factor) >> np.uint32(32 - self.BITS)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        ranks, rest = np.full(len(keys), _NEVER), None
        for factor, own, found in self.levels:
            slots = self._slot(keys, factor)
            there = own[slots]
            hit = np.flatnonzero(there == keys)
            ranks[hit if rest is None else rest[hit]] = found[slots[hit]]
            on = np.flatnonzero((there != keys) & (there != _EMPTY))  # only those may stand in the next table
            keys, rest = keys[on], on if rest is None else rest[on]
        return ranks


class Merges:
    """The merges of a byte-level BPE model, made in many pre-tokens at once: in each the lowest pair, the leftmost of
    equal ones, until none is left."""

    def __init__(self, model: dict) -> None:
        vocab, pairs = model["vocab"], {}
        for k, m in enumerate(model["merges"]):
            pairs[tuple(m if isinstance(m, list) else m.split(" "))] = k
        ranked = sorted(pairs, key=pairs.get)
        left, right, made = (np.array([vocab[x] for x in xs], np.int32) for xs in ([a for a, _ in ranked], [b for _, b in ranked], [a + b for a, b in ranked]))
        self.made, self.rank, shown = made, _Pairs(left, right), byte_alphabet()
        self.symbols = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.first = self.rank(np.repeat(self.symbols, 256), np.tile(self.symbols, 256))  # of two bytes

    @staticmethod
    def fit(model: dict) -> bool:
        """Whether the model is one that this class can stand for."""
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        return max(model["vocab"].values(), default=_PAD) < _GONE and model["vocab"].keys() >= set(byte_alphabet().values())

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens that start there in data, one after another, and how many each has. At most WIDTHS[-1] bytes each."""
        order, counts, parts = np.argsort(sizes, kind="stable"), np.zeros(len(sizes), np.int64), []
        ends = np.searchsorted(sizes[order], WIDTHS, "right")
        for width, i, j in zip(WIDTHS, [0, *ends[:-1]], ends, strict=True):
            for k in range(i, j, 1 << 15):
                own = order[k : min(k + (1 << 15), j)]
                ids, counts[own] = self._table(data, starts[own], sizes[own], width)
                parts.append(ids)
        flat, n = np.concatenate([np.zeros(0, np.int32), *parts]), counts[order]
        at = np.empty(len(sizes), np.int64)
        at[order] = np.cumsum(n) - n
        return flat[_ranges(at, counts)], counts

    def _table(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A column for each pre-token. Its symbols stand in rows 1 to width, _PAD around them."""
        n, rows = len(starts), np.arange(width, dtype=np.int64)[:, None]
        inside = rows < sizes
        read = data[np.where(inside, starts + rows, 0)]
        symbols = np.full((width + 2, n), _PAD, np.int32)
        symbols[1:-1] = np.where(inside, self.symbols[read], _PAD)
        if width > 1:
            ranks = self.first[read[:-1].astype(np.int32) << 8 | read[1:]]
            ranks[~inside[1:]] = _NEVER
            keys = np.full((width + 2, n), _NEVER)  # rank and row of the left symbol
            keys[1:width] = self._keys(ranks, rows[:-1].astype(np.int32) + 1)
            self._run(symbols.reshape(-1), keys, n, width)
        stay = (symbols < _GONE).T
        return symbols.T[stay], np.count_nonzero(stay, axis=1)

    @staticmethod
    def _keys(ranks: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.where(ranks == _NEVER, _NEVER, ranks << 6 | rows)

    def _run(self, symbols: np.ndarray, keys: np.ndarray, n: int, width: int) -> None:
        after = np.repeat(np.arange(1, width + 3, dtype=np.int8), n)
        before = np.repeat(np.arange(-1, width + 1, dtype=np.int8), n)
        columns = np.arange(n)
        while True:
            lowest = keys.min(axis=0)
            live = np.flatnonzero(lowest != _NEVER)
            if not len(live):
                return
            if len(live) < 0.75 * len(columns):
                keys, columns, lowest = keys.take(live, axis=1), columns[live], lowest[live]
                live = np.arange(len(live))
            lowest, own, m = lowest[live], columns[live], len(columns)
            row, made = (lowest & 63).astype(np.int64), self.made[lowest >> 6]
            here = row * n + own
            gone = after[here].astype(np.int64)
            there = gone * n + own
            right, left = after[there].astype(np.int64), before[here].astype(np.int64)
            symbols[here], symbols[there] = made, _GONE
            after[here] = right
            before[right * n + own] = row
            flat = keys.reshape(-1)
            flat[gone * m + live] = _NEVER
            flat[row * m + live] = self._keys(self.rank(made, symbols[right * n + own]), row.astype(np.int32))
            flat[left * m + live] = self._keys(self.rank(symbols[left * n + own], made), left.astype(np.int32))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _cuts(data: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of the texts that start there begin, and what each is: _TOKEN, a pre-token, _WORD or _TEXT.

    Words are black ones with an apostrophe or a character that the classes don't know, with the space before
    them. Texts stay whole that are given by number or have control or white characters that the classes don't know.
    """
    kinds, size, begins = _CLASSES[data], len(data), np.zeros(len(data), bool)
    begins[starts[starts < size]] = True

    def byte(at: np.ndarray, k: int) -> np.ndarray:
        return data[np.minimum(at + k, size - 1)].astype(np.int64)

    two = np.flatnonzero(data == 0xC3)
    kinds[two[np.isin(byte(two, 1), (0x97, 0xB7))]] = _HARD  # no letters: × and ÷
    hard = kinds == _HARD
    if hard.any():
        two, three = np.flatnonzero(data == 0xC2), np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
        white = two[np.isin(byte(two, 1), (0x85, 0xA0))], three[np.isin(byte(three, 0) << 16 | byte(three, 1) << 8 | byte(three, 2), _WHITE)]
        odd = np.concatenate([*white, np.flatnonzero(hard & ((data < 32) | (data == 127)))])
        whole = np.union1d(whole, np.searchsorted(starts, odd, "right") - 1)
        words = np.flatnonzero(_changes(kinds == _SPACE, begins))
        own = np.flatnonzero(np.logical_or.reduceat(hard, words))
        kinds[_ranges(words[own], np.append(words, size)[own + 1] - words[own])] = _HARD
    cut, space = _changes(kinds, begins), kinds == _SPACE
    black = np.flatnonzero(cut & ~space & ~begins)
    black = black[space[black - 1]]  # behind a white run, of which the last character stands alone or, a space, goes with them
    cut[black - 1] = True
    cut[black[data[black - 1] == 32]] = False
    cut[_ranges(starts[whole] + 1, np.append(starts, size)[whole + 1] - starts[whole] - 1)] = False
    at = np.flatnonzero(cut)
    what = np.where(kinds[np.append(at, size)[1:] - 1] == _HARD, _WORD, _TOKEN)
    what[np.searchsorted(at, starts[whole])] = _TEXT
    return at, what


def _changes(kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    found = begins.copy()
    found[1:] |= kinds[1:] != kinds[:-1]
    return found


class Encoder:
    """Encodes like Tokenizer.encode(text, add_special_tokens=False) of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        front = json.loads(self.tokenizer.to_str())
        splits = front["pre_tokenizer"] or {}
        self.by_words = not front["normalizer"] and splits.get("type") == "ByteLevel" and splits["use_regex"] and not splits["add_prefix_space"]
        self.model, self.shown = self.tokenizer.model, byte_alphabet()
        self.marks = {m: self._whole(m) for m in ".,"}
        self.bare, self.spaced = _Words(self._word, ""), _Words(self._word, " ")
        self.newline = self._whole("\n")

    @cached_property
    def merges(self) -> Merges | None:
        """None where texts go one by one."""
        model = json.loads(self.tokenizer.to_str())["model"] if self.by_words else {}
        return Merges(model) if Merges.fit(model) else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A word with at most one space before it. Plain ones go straight to the merges."""
        plain = _PLAIN.fullmatch(word, word.startswith(" "))
        if not plain:
            return self._whole(word)
        if plain[2]:  # the word alone is likely known
            return (self.spaced if word[0] == " " else self.bare)[plain[1]] + self.marks[plain[2]]
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_words or any(s in text for s in self.special):
            return self._whole(text)
        bare, spaced = self.bare.__getitem__, self.spaced.__getitem__
        plain = text.replace("\n", "").isprintable() and not any(x in text for x in ("  ", "\n\n", " \n", "\n ")) and not (text[0].isspace() or text[-1].isspace())
        if not plain and _DOUBLE_WHITE.search(text):
            first, *rest = _LONE_SPACE.split(text)
            return bare(first) + b"".join(map(spaced, rest))
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(bare(first) + b"".join(map(spaced, rest)))
        return self.newline.join(lines)

    def many(self, texts: pa.Array, end_id: int) -> Iterator[pa.ListArray]:
        """The ids of all texts (strings; null: empty), each with end_id behind them. AT_ONCE bytes of text, or one text, are held at once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        end, k = np.array([end_id], "<u4"), 0
        while k < len(texts):
            j = max(k + 1, int(np.searchsorted(bounds, bounds[k] + AT_ONCE, "right")) - 1)
            if self.merges:
                special = np.zeros(j - k, bool)
                for s in self.special:
                    special |= pc.match_substring(texts[k:j], s).to_numpy(zero_copy_only=False)
                yield self._units(data[bounds[k] : bounds[j]], bounds[k : j + 1] - bounds[k], np.flatnonzero(special), end)
            else:
                yield id_lists([self.ids(t) + end.tobytes() for t in texts[k:j].to_pylist()])
            k = j

    def _units(self, data: np.ndarray, bounds: np.ndarray, whole: np.ndarray, end: np.ndarray) -> pa.ListArray:
        """The lists of ids of the texts in data between those bounds: distinct units are encoded, then looked up."""
        at, what = _cuts(data, bounds[:-1], whole)
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        index, units = coded.indices.to_numpy(), coded.dictionary
        ends = np.frombuffer(units.buffers()[1] or bytes(8), np.int64)[: len(units) + 1]
        sizes, kinds = np.diff(ends), np.zeros(len(units), np.uint8)
        kinds[index] = what
        simple = (kinds == _TOKEN) & (sizes <= WIDTHS[-1])
        others = [self.ids(u.decode()) if kind == _TEXT else self.bare[u.decode()] for u, kind in zip(units.filter(pa.array(~simple)).to_pylist(), kinds[~simple].tolist(), strict=True)]
        merged, n = self.merges(np.frombuffer(units.buffers()[2] or b"", np.uint8), ends[:-1][simple], sizes[simple])
        pool = np.concatenate([merged.astype("<i4"), np.frombuffer(b"".join(others), "<i4"), end.view("<i4")])
        counts = np.ones(len(units) + 1, np.int64)  # the last one is the end's
        counts[:-1][simple], counts[:-1][~simple] = n, [len(x) // 4 for x in others]
        place = np.append(np.append(np.flatnonzero(simple), np.flatnonzero(~simple)), len(units))
        starts = np.empty_like(counts)
        starts[place] = np.cumsum(counts[place]) - counts[place]
        until = np.searchsorted(at, bounds[1:])
        index = np.insert(index, until, len(units))
        total = np.cumsum(counts[index])[until + np.arange(len(until))]
        return pa.ListArray.from_arrays(pa.array(np.append(0, total).astype(np.int32)), pa.array(pool[_ranges(starts[index], counts[index])]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_lists(buffers: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(b) // 4 for b in buffers)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(buffers), "<i4")))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token files below path, in ascending doc_id order.

    path/ids: ORC files of doc_id, part (number of the stretch of doc_ids), at (ids of the part before this
    document), n and ids. Parts and rows within them ascend; stripes hold integer run lengths, row indexes
    and a Bloom filter on doc_id. path/parts: the ids of each part, a row for each. The ids end with end_id.
    doc_id may be of any type that sorts. Null text counts as empty, a null doc_id comes first, rows with one
    doc_id go by a hash of their text, repeated rows are written each, an empty table writes no rows. AT_ONCE
    bytes of text, or one text, however long, and their ids are held at once. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, before, own = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for b in batches:
            k = 0
            for ids in code.many(b["text"], end_id):
                sizes = np.diff(np.asarray(ids.offsets)).astype(np.int64)
                at = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                out = pa.RecordBatch.from_arrays([b["doc_id"].slice(k, len(ids)), pa.array(np.full(len(at), own, np.int32)), pa.array(at), pa.array(sizes), ids], ["doc_id", "part", "at", "n", "ids"])
                yield from (out.slice(i, 256) for i in range(0, len(ids), 256))  # long lists leave in small batches
                k += len(ids)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    (
        dealt.mapInArrow(run, f"doc_id {kind}, {_ROW}")
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", 2000)
        .option("orc.stripe.size", 32 << 20).option("orc.compress", "zstd").orc(f"{path}/ids")
    )
    spark = docs.sparkSession
    sizes = spark.read.schema(f"doc_id {kind}, {_ROW}").orc(f"{path}/ids").groupBy("part").agg(F.sum("n").alias("n"))  # reads two narrow columns
    sizes.write.orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, id_kind: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files alone. No shuffle of ids.

    A filter on doc_id skips stripes and row groups by their statistics and Bloom filters. The base of each
    part is broadcast while there are at most PARTS of them (16 bytes each), else joined.
    """
    rows = spark.read.schema(f"doc_id {id_kind}, {_ROW}").orc(f"{path}/ids")
    parts = spark.read.schema("part int, n long").orc(f"{path}/parts")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    bases = parts.select("part", before.alias("base"))
    bases = F.broadcast(bases) if parts.count() <= PARTS else bases
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids")


def with_checksum(rows: DataFrame) -> DataFrame:
    """rows of read_tokens with ids_crc32 instead of the ids, and n_tokens counted from the ids themselves."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            flat, ends = np.asarray(ids.values, "<i4"), np.asarray(ids.offsets)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the token files and returns what read_tokens finds in them."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path, dict(docs.dtypes)["doc_id"])
