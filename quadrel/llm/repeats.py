"""Operator 2, suffix-array dedup: bytes that 50-byte strings of earlier documents already hold.

Two steps keep the text from being multiplied. First, each 50-byte string is named by its minimizer (the
least hash of the 20-byte strings in it); only minimizers that two documents share can stand for a match.
Then runs of strings with one shared minimizer travel to that minimizer's bucket, and there a logarithmic
index family decides exactly, on the bytes: documents arrive in order of doc_id in batches, each batch gets
a suffix array (places in its text, suffixes compared as far as the match length), is merge-scanned against
the existing levels, and levels of about equal size merge geometrically.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.base import splittable, whole_text, written

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: Text for each bucket of minimizers, text hashed at once, and 50-byte strings of a batch of the index.
BUCKET_BYTES, SLICE_BYTES, BATCH = 16 << 20, 4 << 20, 400_000
#: Strings of a level that are looked at together.
SCAN = 1 << 16
#: Runs that a task remembers having sent on, and shared names that it remembers; once so many are known it starts afresh.
SENT, KNOWN = 20_000, 500_000
#: Buckets of names in a task, and shared names that it holds before it sends them on.
TOGETHER, ANSWER = 4, 4_000_000
#: Partitions of a shuffle at most; with more buckets, each holds several, one after the other.
PARTS = 50_000
#: Strings whose minimizers are computed at once.
STRETCH = 1 << 17
LOWEST = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def minimizers(data: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte string of the data, the least hash of the GRAM-byte strings in it. Stretch by stretch, for little memory."""
    n = len(data) - LENGTH + 1
    if n <= STRETCH:
        return _minimizers(data)
    return np.concatenate([_minimizers(data[k : k + STRETCH + LENGTH - 1]) for k in range(0, n, STRETCH)])


def _minimizers(data: np.ndarray) -> np.ndarray:
    size, need, gram, at = 1, GRAM, None, 0
    parts = {1: data.astype(np.uint64) + np.uint64(1)}
    powers = {2**k: np.uint64(pow(0x100000001B3, 2**k, 1 << 64)) for k in range(GRAM.bit_length())}
    while size * 2 <= GRAM:
        parts[size * 2] = parts[size][:-size] * powers[size] + parts[size][size:]
        size *= 2
    n = len(data) - GRAM + 1
    while need:  # GRAM as a sum of powers of two
        while size > need:
            size //= 2
        piece = parts[size][at : at + n]
        gram = piece.copy() if gram is None else gram * powers[size] + piece
        at, need = at + size, need - size
    low, width = _mixed(gram), 1
    while width * 2 <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = WINDOW - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _groups(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of each run of equal values; none of an empty array."""
    if len(x):
        cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        yield from zip(cut.tolist(), [*cut[1:].tolist(), len(x)], strict=True)


def _runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Maximal runs of strings with one minimizer: data, document, first string, last string + 1, minimizer, document starts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, empty, empty, empty, empty.astype(np.uint64), starts
    low = minimizers(data)
    doc = np.repeat(np.arange(len(texts)), sizes)
    whole = doc[: len(low)] == doc[LENGTH - 1 :]
    change = np.r_[True, (low[1:] != low[:-1]) | (doc[1 : len(low)] != doc[: len(low) - 1])]
    # a run also ends where strings begin to reach into the next document
    change |= np.r_[False, whole[1:] != whole[:-1]]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(low)]
    keep = whole[first]
    first, last = first[keep], last[keep]
    return data, doc[first], first, last, low[first], starts


def _code_of(low: np.ndarray) -> np.ndarray:
    return low.view(np.int64)


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """df with as many buckets in each of the partitions: by their numbers, as hashes of so few would meet."""
    parts = min(parts, PARTS)
    return df.repartitionById(parts, F.col("bucket") % F.lit(parts))


def _shared_names(docs: DataFrame, buckets: int) -> DataFrame:
    """owner, codes: minimizers of a document that another one has too, in packed lists."""
    names = ["bucket", "owner", "owners", "codes"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = np.zeros(0, np.int64)  # names that two documents of a slice had: their buckets know of both
        for b in batches:
            owners, texts = np.asarray(b["owner"]), [t.encode() for t in b["text"].to_pylist()]
            for i, j in _slices([len(t) for t in texts]):
                _, doc, _, _, low, _ = _runs(texts[i:j])
                own, code = owners[i:j][doc], _code_of(low)
                order = np.lexsort((own, code))
                own, code = own[order], code[order]
                fresh = np.r_[True, (code[1:] != code[:-1]) | (own[1:] != own[:-1])] if len(code) else np.zeros(0, bool)
                own, code = own[fresh], code[fresh]
                head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
                group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(code)]))
                several = np.bincount(group, minlength=len(head)) > 1
                told = several | np.isin(code[head], shared, assume_unique=True)
                fresh = several & ~np.isin(code[head], shared, assume_unique=True)
                many = told[group]
                rank = np.arange(len(code)) - head[group]
                rows: list[tuple] = []
                # of a name that several documents here share, two go on, once a task; all are told so at once
                send = (rank < 2) & (fresh | ~told)[group]
                shared = np.union1d(shared, code[head][fresh]) if len(shared) < KNOWN else code[head][fresh]
                part = (code[send].view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)
                at = np.argsort(part, kind="stable")
                o, c, p = own[send][at], code[send][at], part[at]
                for x, y in _groups(p):
                    by = np.argsort(o[x:y], kind="stable")
                    rows.append((int(p[x]), None, o[x:y][by].tobytes(), c[x:y][by].tobytes()))
                o, c = own[many], code[many]
                at = np.argsort(o, kind="stable")
                o, c = o[at], c[at]
                for x, y in _groups(o):
                    rows.append((int(o[x]) % buckets, int(o[x]), None, c[x:y].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple[np.ndarray, np.ndarray]] = []  # owners and their shared names, of several buckets

        def found(owners: list[bytes], codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            own, code = np.frombuffer(b"".join(owners), np.int64), np.frombuffer(b"".join(codes), np.int64)
            order = np.lexsort((own, code))
            own, code = own[order], code[order]
            head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            sizes = np.diff(np.r_[head, len(code)])
            differ = np.repeat(own[head] != own[head + sizes - 1], sizes)
            return own[differ], code[differ]

        def answer() -> pa.RecordBatch:
            """A row for each owner."""
            own, code = (np.concatenate(x) for x in zip(*told, strict=True))
            told.clear()
            order = np.argsort(own, kind="stable")
            own, code = own[order], code[order]
            each = list(_groups(own))
            return pa.RecordBatch.from_arrays([pa.array([own[x] for x, _ in each], pa.int64()), pa.array([code[x:y].tobytes() for x, y in each], pa.binary())], ["owner", "codes"])

        at, owners, codes, held = None, [], [], 0
        for b in batches:
            for bucket, owner, many, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at and owners:
                    told.append(found(owners, codes))
                    held += len(told[-1][0])
                    owners, codes = [], []
                if held >= ANSWER:
                    yield answer()
                    held = 0
                at = bucket
                if owner is not None:
                    told.append((np.full(len(code) // 8, owner), np.frombuffer(code, np.int64)))
                    held += len(code) // 8
                else:
                    owners.append(many)
                    codes.append(code)
        if owners:
            told.append(found(owners, codes))
        if told:
            yield answer()

    sent = docs.select("owner", "text").mapInArrow(emit, "bucket int, owner long, owners binary, codes binary")
    # several buckets meet in a task, so that an owner's shared names go on in few rows
    return _dealt(sent, max(-(-buckets // TOGETHER), min(buckets, 8))).sortWithinPartitions("bucket").mapInArrow(meet, "owner long, codes binary")


def _runs_to_check(docs: DataFrame) -> DataFrame:
    """code, owner, mark, start, to, bytes of every run of strings whose minimizer is shared. docs: owner, mark, text, codes.

    A run that a smaller owner has sent from this task, byte for byte, is covered already: it goes without
    its bytes, dealt out by owner. So a passage of very many documents comes to its bucket a few times a
    task (whenever a smaller owner turns up), not once a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for b in batches:
            owners, marks = np.asarray(b["owner"]), np.asarray(b["mark"])
            texts, lists = [t.encode() for t in b["text"].to_pylist()], b["codes"].to_pylist()
            for i, j in _slices([len(t) for t in texts], SLICE_BYTES // 2):
                data, doc, first, last, low, starts = _runs(texts[i:j])
                code, ends = _code_of(low), np.searchsorted(doc, np.arange(j - i + 1))
                keep = np.zeros(len(doc), bool)
                for k in range(j - i):
                    if ends[k] < ends[k + 1]:
                        keep[ends[k] : ends[k + 1]] = np.isin(code[ends[k] : ends[k + 1]], np.frombuffer(b"".join(lists[i + k]), np.int64))
                if not keep.any():
                    continue
                doc, first, last, code = doc[keep], first[keep], last[keep], code[keep]
                sizes = last - first + LENGTH - 1
                offsets = np.r_[0, np.cumsum(sizes)]
                flat = data[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)].tobytes()
                own, start = owners[i:j][doc], (first - starts[doc]).astype(np.int64)
                covered = np.zeros(len(own), bool)
                order = np.argsort(own, kind="stable")
                for k in order:
                    o = int(own[k])
                    before = sent.get(held := flat[offsets[k] : offsets[k + 1]])
                    if before is not None and before < o:
                        covered[k] = True
                    elif before != o:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent[held] = o
                code = np.where(covered, _code_of(_mixed(own.view(np.uint64))), code)
                held = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
                held = pa.compute.if_else(pa.array(covered), pa.scalar(None, pa.binary()), held)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(own), pa.array(marks[i:j][doc]), pa.array(start), pa.array(start + sizes, mask=~covered), held], ["code", "owner", "mark", "start", "to", "bytes"])

    return docs.select("owner", "mark", "text", "codes").mapInArrow(run, "code long, owner long, mark long, start long, to long, bytes binary")


class SuffixArray:
    """Places of distinct strings in a text, in the order of the LENGTH bytes that begin there. The bytes are stored once."""

    def __init__(self, text: np.ndarray, at: np.ndarray) -> None:
        self.text, self.at = text, at

    def __len__(self) -> int:
        return len(self.at)

    def strings(self, i: int, j: int) -> np.ndarray:
        return _strings(self.text, self.at[i:j])

    def places_of(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of these sorted strings, where it is or would be, and whether it is there: one scan of both, block by block."""
        place, there = np.zeros(len(strings), np.int64), np.zeros(len(strings), bool)
        low = 0
        for k in range(0, len(self), SCAN):
            last = min(k + SCAN, len(self))
            ends = len(strings) if last == len(self) else low + int(np.searchsorted(strings[low:], self.strings(last - 1, last)[0], "right"))
            if ends > low:
                block, own = self.strings(k, last), strings[low:ends]
                at = np.searchsorted(block, own)
                place[low:ends] = k + at
                there[low:ends] = block[np.minimum(at, len(block) - 1)] == own
                low = ends
        return place, there

    def merged(self, other: SuffixArray) -> SuffixArray:
        """Both in one order; no string is in both."""
        place = np.concatenate([self.places_of(other.strings(k, k + SCAN))[0] for k in range(0, len(other), SCAN)])
        return SuffixArray(np.concatenate([self.text, other.text]), np.insert(self.at, place, other.at + len(self.text)))


class IndexFamily:
    """Suffix arrays of distinct strings, each level at least twice as large as the next."""

    def __init__(self) -> None:
        self.levels: list[SuffixArray] = []

    def known(self, strings: np.ndarray) -> np.ndarray:
        """Which of these sorted strings some level holds."""
        found = np.zeros(len(strings), bool)
        for level in self.levels:
            found |= level.places_of(strings)[1]
        return found

    def add(self, new: SuffixArray) -> None:
        """A new level of strings that no level holds; levels as large merge with it."""
        while len(new) and self.levels and len(self.levels[-1]) < 2 * len(new):
            new = self.levels.pop().merged(new)
        if len(new):
            self.levels.append(new)


def _strings(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at]).view(f"S{LENGTH}").ravel()


def repeated(index: IndexFamily, owner: np.ndarray, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For one batch of runs in order of owner: each string's row, and whether a smaller owner has it. Adds the batch to the index."""
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    data = np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets -= offsets[0]
    count = np.diff(offsets) - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][row]
    strings, first, back = np.unique(_strings(data, at), return_index=True, return_inverse=True)
    known = index.known(strings)
    seen = known[back] | (owner[row] > owner[row[first]][back])
    index.add(SuffixArray(data, at[first[~known]]))
    return row, seen


def _covered(runs: DataFrame, buckets: int) -> DataFrame:
    """owner, mark, from, to: stretches covered by strings that a smaller owner has."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at, kept, held = IndexFamily(), None, [], 0

        def settle(part: pa.RecordBatch) -> pa.RecordBatch:
            owner, mark, start = (np.asarray(part[c]) for c in ("owner", "mark", "start"))
            row, seen = repeated(index, owner, part["bytes"])
            count = np.bincount(row, minlength=len(owner))
            place = start[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
            row, place = row[seen], place[seen]
            new = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)] if len(row) else np.zeros(0, bool)
            end = np.r_[np.flatnonzero(new)[1:] - 1, len(row) - 1] if len(row) else np.zeros(0, int)
            r = row[new]
            return pa.RecordBatch.from_arrays([pa.array(owner[r]), pa.array(mark[r]), pa.array(place[new]), pa.array(place[end] + LENGTH)], ["owner", "mark", "from", "to"])

        def flush() -> pa.RecordBatch:
            joined = pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept.clear()
            return settle(joined[0])

        for b in batches:
            known = pa.compute.is_null(b["bytes"])
            yield b.filter(known).select(["owner", "mark", "start", "to"]).rename_columns(["owner", "mark", "from", "to"])
            b = b.filter(pa.compute.invert(known))
            if not b.num_rows:
                continue
            bucket, owner = np.asarray(b["bucket"]), np.asarray(b["owner"])
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])) + 1
            cuts = np.r_[0, cuts, b.num_rows]
            weight = np.r_[0, np.cumsum(np.asarray(pa.compute.binary_length(b["bytes"])).astype(np.int64) - LENGTH + 1)]
            x = 0
            for k in range(len(cuts) - 1):  # a batch ends between two owners
                key = (bucket[cuts[k]], owner[cuts[k]])
                if at is not None and key != at and (key[0] != at[0] or held + weight[cuts[k]] - weight[x] >= BATCH):
                    if cuts[k] > x:
                        kept.append(b.slice(x, cuts[k] - x))
                    yield flush()
                    x, held = cuts[k], 0
                    if key[0] != at[0]:
                        index = IndexFamily()
                at = key
            if b.num_rows > x:
                kept.append(b.slice(x, b.num_rows - x))
                held += weight[-1] - weight[x]
        if kept:
            yield flush()

    dealt = runs.withColumn("bucket", F.pmod(F.shiftright("code", 8), F.lit(buckets)).cast("int")).select("bucket", "owner", "mark", "start", "to", "bytes")
    return _dealt(dealt, buckets).sortWithinPartitions("bucket", "owner").mapInArrow(check, "owner long, mark long, from long, to long")


def _finish(rows: DataFrame, with_spans: bool) -> DataFrame:
    """rows: owner, mark, text, spans, copy."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for owner, mark, text, spans, copy in zip(*(b[c].to_pylist() for c in ("owner", "mark", "text", "spans", "copy")), strict=True):
                raw = text.encode()
                cuts = [(0, len(raw))] if copy and len(raw) >= LENGTH else sorted((s["from"], s["to"]) for s in spans or () if s["mark"] == mark)
                merged: list[list[int]] = []
                for x, y in cuts:
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                ends = [0, *(y for _, y in merged)]
                kept = b"".join(raw[x:y] for x, y in zip(ends, [*(x for x, _ in merged), len(raw)], strict=True))
                more = (merged, kept) if with_spans else ()
                out.append((None if owner == LOWEST else owner, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), *more))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.list_(pa.int64())), pa.binary()] * with_spans
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<bigint>>, kept binary" * with_spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept with with_spans).

    doc_id is a whole number (or text that reads as one). Null text counts as empty. A null doc_id sorts below
    all others. Rows of one doc_id never match each other; repeated rows are judged alike. Texts under 50 bytes
    keep everything; a longer one, of any length, is held by one task. A text that equals one of a smaller
    doc_id byte for byte is settled by its digest and sent nowhere. An empty table gives no rows. Other columns of
    docs, whatever their names, are ignored.
    """
    owner = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    rows = docs.select(owner.alias("owner"), whole_text(text_col).alias("text"))
    marked = rows.select("owner", F.xxhash64("text").alias("mark"), "text")
    heads = written(marked.select("owner", "mark", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n")), "digests")
    firsts = heads.groupBy("digest").agg(F.min("owner").alias("first"), F.max("owner").alias("last")).filter("first < last").select("digest", "first")
    copies = heads.join(splittable(firsts, "digest"), "digest").filter("owner > first").groupBy("owner").agg(F.collect_set("mark").alias("copied"))
    copies = written(copies, "copies")
    total = heads.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    # One exchange by owner: the three uses below have the same plan up to it, so Spark runs it once.
    dealt = marked.repartition("owner")
    known = dealt.join(copies, "owner", "left").withColumn("copy", F.coalesce(F.array_contains("copied", F.col("mark")), F.lit(False))).drop("copied")
    originals = known.filter("not copy").drop("copy")
    names = _shared_names(originals, buckets).groupBy("owner").agg(F.collect_list("codes").alias("codes"))
    covered = _covered(_runs_to_check(originals.join(names, "owner")), buckets)
    spans = covered.groupBy("owner").agg(F.collect_list(F.struct("mark", "from", "to")).alias("spans"))
    return _finish(known.join(spans, "owner", "left").select("owner", "mark", "text", "spans", "copy"), with_spans)
