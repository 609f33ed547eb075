"""Operator 7, n-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

Documents with the same n-gram set are one class and are joined once. Representatives that share a band
are connected (by stars, never by all pairs). Full sets are compared in blocks of bounded size, and links
are counted where they are found, so no pair becomes a row. A component that fits one block is sent there
once. A larger one goes the cheaper way of two: to blocks of the whole component (a group of copies that
share most bands), or to its band buckets (a chain of chance meetings), where a pair counts in the first
band that it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.llm.base import splittable, written
from quadrel.llm.graph import components

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 144
#: A component is compared in blocks of about so many documents and n-grams.
BLOCK_DOCS, BLOCK_GRAMS = 1024, 1 << 21
REMEMBER, SEED = 400_000, 7


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which a pair at the threshold shares a band with this probability."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("too few hashes for this recall")


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Grams:
    """Hashed n-gram sets of texts: lower-cased words between white space; a shorter text is one n-gram."""

    def __init__(self, n: int = WORDS) -> None:
        self.n, self.seen = n, _Words()
        self.factors = np.random.default_rng(SEED).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        n = min(self.n, len(words))
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        total = sum(h[k : len(h) - n + 1 + k] * self.factors[k] for k in range(n))
        return np.unique(_mixed(total + np.uint64(n)))


def _class_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n: int = WORDS, bands: int = 24, rows: int = 6) -> DataFrame:
    """docs' columns but text, key (of the n-gram set), size, bands (a hash for each band; none for an empty set)."""
    carry = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        odd = np.random.default_rng(SEED + 1).integers(1, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        weights = np.random.default_rng(SEED + 2).integers(1, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

        def sign(own: np.ndarray) -> np.ndarray:
            least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for k in range(0, len(own), 2048):
                product = own[None, k : k + 2048] * odd
                product ^= product >> np.uint64(32)
                least = np.minimum(least, product.min(1))
            return _mixed((least.reshape(bands, rows) * weights).sum(1, dtype=np.uint64)).view(np.int64)

        for b in batches:
            sets = [grams(t) for t in b["text"].to_pylist()]
            marks = [sign(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in carry), pa.array([_class_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                [*carry, "key", "size", "bands"],
            )

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carry) + ", key binary, size long, bands array<long>")


def candidate_components(reps: DataFrame) -> DataFrame:
    """node, comp of the representatives that share a band with another, directly or through others."""
    keys = reps.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = keys.groupBy("band", "hash").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("band", "hash", "least")
    stars = keys.join(splittable(buckets, "band", "hash"), ["band", "hash"]).filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return components(stars).select("node", F.col("root").alias("comp"))


def compare(nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node in the block, and the smallest node that it hangs together with there.

    across: only pairs of different sides count, else all pairs. earlier: a row of band hashes for each node;
    a pair that shares one of them counts elsewhere.
    """
    n, sizes = len(nodes), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    gram = np.empty(len(flat), np.int64)
    gram[order] = np.r_[0, np.cumsum(flat[order][1:] != flat[order][:-1])]
    count = np.bincount(gram)
    first, holders = np.r_[0, np.cumsum(count)[:-1]], owner[order]
    ends = np.cumsum(sizes)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for i in range(n):
        own = gram[ends[i] - sizes[i] : ends[i]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        run = count[own]
        at = np.arange(run.sum()) + np.repeat(first[own] - np.r_[0, np.cumsum(run)[:-1]], run)
        shared = np.bincount(holders[at], minlength=n)
        near = shared >= threshold * (sizes + sizes[i] - shared) - 1e-9
        near[i] = False
        if across:
            near &= sides != sides[i]
        if earlier is not None and near.any():
            near[near] = ~(earlier[near] == earlier[i]).any(1)
        links[i] = near.sum()
        if links[i]:
            near[i] = True
            met = np.unique(label[near])
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    return links, least[label]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with the same place, band, i, j."""
    key, rows = None, []
    for b in batches:
        for place, band, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (place, band, i, j):
                if rows:
                    yield key, rows
                key, rows = (place, band, i, j), []
            rows.append(row)
    if rows:
        yield key, rows


def _parts(n: Column, grams: Column) -> Column:
    """Into how many sides so many documents and n-grams go."""
    return F.greatest(F.ceil(n / F.lit(BLOCK_DOCS)), F.ceil(grams / F.lit(BLOCK_GRAMS))).cast("int")


def places(reps: DataFrame, comps: DataFrame, by_bucket: bool | None = None) -> DataFrame:
    """node and its places: place (a component, or a band bucket), band (-1 or the bucket's), parts (sides of the place).

    by_bucket: None chooses the cheaper way for each component of several blocks, by the n-grams sent.
    """
    sized = comps.join(reps.select("node", "size"), "node")
    total = sized.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    total = written(total.withColumn("parts", _parts(F.col("n"), F.col("grams"))), "components")
    whole = F.struct(F.col("comp").alias("place"), F.lit(-1).alias("band"), "parts")
    if by_bucket is False or total.filter("parts > 1").isEmpty():
        return comps.join(total, "comp").select("node", F.array(whole).alias("places"))
    large = comps.join(total.filter("parts > 1"), "comp").select("node", "comp")
    keys = large.join(reps.select("node", "size", F.posexplode("bands").alias("band", "hash")), "node")
    buckets = keys.groupBy("comp", "band", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).filter("n > 1")
    buckets = written(buckets.withColumn("parts", _parts(F.col("n"), F.col("grams"))), "buckets")
    cost = buckets.groupBy("comp").agg(F.sum(F.col("grams") * F.col("parts")).alias("cost"))
    cheaper = F.col("cost") < F.col("grams") * F.col("parts") if by_bucket is None else F.lit(True)
    split = total.join(cost, "comp").filter(cheaper).select("comp")
    own = keys.select("node", "band", "hash").join(splittable(buckets.join(split, "comp", "left_semi").select("band", "hash", "parts"), "band", "hash"), ["band", "hash"])
    place = F.struct(F.xxhash64("band", "hash").alias("place"), "band", "parts")
    split_places = own.groupBy("node").agg(F.collect_list(place).alias("places"))  # a place for each band at most
    kept = total.join(split, "comp", "left_anti")
    return comps.join(splittable(kept, "comp"), "comp").select("node", F.array(whole).alias("places")).unionByName(split_places)


def verified(docs: DataFrame, reps: DataFrame, comps: DataFrame, n: int, threshold: float, by_bucket: bool | None = None) -> DataFrame:
    """node, links, root from each block: full sets of the representatives, compared."""
    at = written(places(reps, comps, by_bucket), "places")
    wanted = at.join(reps.select("node", "rep_id", "key", "bands"), "node")
    # hashes tell whose pair it is where bands are buckets; else they are not sent on
    wanted = wanted.withColumn("bands", F.when(F.element_at("places", 1)["band"] >= 0, F.col("bands")))
    kept = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")))
    place = "array<struct<place:bigint,band:int,parts:int>>"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        for b in batches:
            sets = [grams(t) for t in b["text"].to_pylist()]
            right = np.array([_class_key(s) == k for s, k in zip(sets, b["key"].to_pylist(), strict=True)], bool)
            out = [b["places"], b["node"], b["bands"], pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["places", "node", "bands", "grams"]).filter(pa.array(right))

    filled = kept.select("places", "node", "bands", "key", "text").mapInArrow(fill, f"places {place}, node long, bands array<long>, grams binary")
    each = filled.select("node", "bands", "grams", F.explode("places").alias("p")).select("p.*", "node", "bands", "grams")
    sided = each.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = sided.select("place", "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "bands", "grams")
    order = ["place", "band", "i", "j"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, band, i, j), rows in _blocks(batches):
            once = {node: (side, bands, grams) for side, node, bands, grams in rows}  # repeated rows of a document meet here
            nodes = np.array(list(once), np.int64)
            sets = [np.frombuffer(g, np.uint64) for *_, g in once.values()]
            earlier = np.array([x[:band] for _, x, _ in once.values()], np.int64) if band > 0 else None
            links, root = compare(nodes, np.array([s for s, *_ in once.values()]), sets, threshold, i != j, earlier)
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(root[some])], ["node", "links", "root"])

    return dealt.mapInArrow(run, "node long, links long, root long")


def _classes(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs (doc_id, text, perhaps mark), and each n-gram set: key, root of its class, rep_id, n_copies, n_links.

    With mark, least is also given: the set's smallest doc_id (nulls last) and mark.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = written(signatures(docs, n, bands, rows), "signatures")
    least = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least")] if "mark" in docs.columns else []
    reps = signed.groupBy("key").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), *least)
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    comps = written(candidate_components(reps), "candidates")
    found = written(verified(docs, reps, comps, n, threshold), "links")
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    return signed, reps.drop("bands", "size").join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its class of near copies.

    doc_id; class_id, the smallest doc_id of all documents that links connect; n_links, the number of other
    n-gram sets at or over the threshold; set_id, the smallest doc_id with the very same n-gram set, and
    n_copies, how many documents have it. Null text counts as empty; texts without words form one set that
    links to nothing. Null doc_ids take part, but name a class only if it has no other. Repeated rows
    count as copies. A text of any length is one n-gram set, held by one task. An empty table gives no rows;
    other columns, whatever their names, are ignored.
    """
    signed, named = _classes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), n, threshold, recall)
    ids = named.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    named = named.join(ids, "root").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("rep_id").alias("set_id"), "n_copies")
    return signed.select("doc_id", "key").join(named, "key").drop("key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class, all columns: that of the smallest doc_id, nulls last, and of its texts the one with the smallest set key.

    Of repeated rows, doc_id and text alike, one stays. Texts without words, null ones too, are one class. An
    empty table gives no rows. Columns of any names but those that begin with __ are passed on.
    """
    own = F.col(id_col).cast("string")
    mark = F.sha2(F.concat(F.when(own.isNull(), "").otherwise(F.concat(F.char_length(own), F.lit(":"), own)), F.lit("|"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    marked = docs.withColumn("__mark", mark)
    named = _classes(marked.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col("__mark").alias("mark")), WORDS, THRESHOLD, RECALL)[1]
    first = named.groupBy("root").agg(F.min(F.struct("least.none", "least.doc_id", "key", "least.mark")).alias("first")).select(F.col("first.mark").alias("__mark"))
    one = Window.partitionBy("__mark").orderBy("__mark")  # dealt out as for the join
    found = marked.join(first, "__mark", "left_semi").withColumn("__n", F.row_number().over(one))
    return found.filter("__n = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
