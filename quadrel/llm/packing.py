"""Operator 1, best-fit packing: best-two-fit, planned on the number of documents of each length.

A length is at most the sequence size, so the histogram is small at any input size. The plan fills bins
from it (many equal bins at a time) and says, for the r-th piece of each length, where it goes; the pieces
are only ranked and looked up. Nothing that grows with the corpus meets in one task or on the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.llm.base import written
from quadrel.llm.tokens import END, encoder, id_lists

SIZE = 2048
#: Pieces of one length are ranked in groups of about this many.
RANK_GROUP = 200_000


def _two(left: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """Of what is left, two lengths with the largest sum up to room, if it is over `above`."""
    at = np.arange(room + 1)
    have = left[: room + 1] > 0
    below = np.maximum.accumulate(np.where(have, at, 0))  # largest left of at most this length
    first = at[have]
    want = np.minimum(room - first, first)
    second = below[np.maximum(want, 0)]
    twin = (second == first) & (left[first] < 2)
    second = np.where(twin, below[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, 0)
    if not len(total) or total.max() <= above:
        return None
    k = int(total.argmax())
    return int(first[k]), int(second[k])


def best_two_fit(counts: np.ndarray, size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(bins, {length: how many in each of them}) until nothing is left. counts[n]: documents of length n.

    An exchange can use up lengths that later bins need, so it is also tried only where it closes the gap
    wholly, and not at all; the plan with the fewest bins is taken.
    """
    plans = [_fill(counts, size, most) for most in (size, 0, -1)]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def _fill(counts: np.ndarray, size: int, most_gap: int) -> list[tuple[int, dict[int, int]]]:
    """A bin takes the largest that fits until none does; then its smallest is exchanged for two others that
    fill the gap so gained better and leave most_gap at most, as long as there are such. A bin is used as
    often as its lengths last.
    """
    left, plan = counts.astype(np.int64).copy(), []
    while left.any():
        rest, room, own = left.copy(), size, {}
        while room and (fits := np.flatnonzero(rest[: room + 1])).size:
            n = int(fits[-1])
            k = min(int(rest[n]), room // n)
            own[n] = own.get(n, 0) + k
            rest[n] -= k
            room -= n * k
        while room and sum(own.values()) > 1:
            least = min(own)
            two = _two(rest, room + least, least) if most_gap >= 0 else None
            if not two or room + least - sum(two) > most_gap:
                break
            own[least] -= 1
            if not own[least]:
                del own[least]
            for n in two:
                own[n] = own.get(n, 0) + 1
                rest[n] -= 1
            rest[least] += 1
            room += least - sum(two)
        times = min(int(left[n]) // k for n, k in own.items())
        for n, k in own.items():
            left[n] -= times * k
        plan.append((times, own))
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, ...]]:
    """Rows length, rank_from, rank_to, per_bin, first_bin, first_offset."""
    rows, ranks, bins = [], {}, 0
    for times, own in plan:
        at = 0
        for n, k in sorted(own.items(), reverse=True):
            r = ranks.get(n, 0)
            rows.append((n, r, r + times * k, k, bins, at))
            ranks[n] = r + times * k
            at += n * k
        bins += times
    return rows


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces of at most `size` ids.

    A longer document is cut so that all pieces but the first are full. Null text counts as empty: one
    piece that holds end_id alone. Repeated rows are cut each; an empty table gives no rows; other columns,
    whatever their names, are ignored. One text's ids are held at once, however long.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for b in batches:
            for part in (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
                rows: list[tuple] = []
                for row, text in enumerate(part["text"].to_pylist()):
                    ids = code.ids(text or "") + end
                    n = len(ids) // 4
                    starts = [0, *range(n % size or size, n, size)]
                    for piece, (i, j) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        rows.append((row, piece, i, j - i, ids[4 * i : 4 * j]))
                row, piece, start, length, own = zip(*rows, strict=True)
                out = [part["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(map(zlib.crc32, own), pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [id_lists(own)] * with_ids, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with sequence_id and offset; sequences have no gaps and at most `size` ids.

    Repeated rows are packed each, null and empty texts as their end id. Pieces of one length are taken in order of a
    hash, then doc_id (nulls first). An empty table gives no rows. Other columns of docs, whatever their
    names, are ignored.
    """
    spark = docs.sparkSession
    found = written(pieces(docs, tokenizer, size, with_ids=with_ids, id_col=id_col, text_col=text_col), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for n, k in found.groupBy("length").count().collect():  # at most `size` rows
        counts[n] = k
    groups = max(16, math.ceil(int(counts.sum()) / RANK_GROUP))
    plan = spark.createDataFrame(places(best_two_fit(counts, size)), "length long, rank_from long, rank_to long, per_bin long, first_bin long, first_offset long")
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sums = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(sums.select("length", "part", ahead.alias("ahead")), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead"))
    # The plan's size depends on `size` alone: each of its bins uses up a length.
    put = ranked.join(F.broadcast(plan), (ranked.length == plan.length) & (ranked["rank"] >= plan.rank_from) & (ranked["rank"] < plan.rank_to)).drop(plan.length)
    nth = F.col("rank") - F.col("rank_from")
    return put.select(
        *found.columns,
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("per_bin")) * F.col("length")).alias("offset"),
    )
