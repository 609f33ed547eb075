"""Operator 10, quality rules: an isolation forest on rule statistics, its threshold set from labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.llm.base import written

#: Labelled documents go by a hash of their id to one of two halves. At most so many of one half, those with the lowest hashes,
#: fit the forest; all of the other half, which the forest has not seen, set its threshold.
SAMPLE = 4096
TREES, PER_TREE, SEED = 128, 256, 10
#: Scores are counted in so many bands.
BANDS = 4096
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more, and distinct words."""
    n, number = len(words), {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if n < 4 or k > 2_000_000:
        if n < 4:
            return 0, k
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        codes = pair[:-1] * k + ids[2:]
    else:
        codes = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    _, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    often = counts[back] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : shift + n - 2] |= often
    return int(inside.sum()), k


def statistics(text: str | None) -> tuple:
    """STATS, then lines with a word and distinct words."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at ASCII white space alone
    if not words:
        return 0, 0, sum(map(raw.count, (bytes([s]) for s in SYMBOLS))), 0, 0, 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)] if b"\n" in raw else [raw]
    symbols = sum(raw.count(s) for s in SYMBOLS)
    repeat, distinct = repeated_words(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat, len(lines), distinct


def features(s: np.ndarray) -> np.ndarray:
    """Size-free statistics of rows of statistics()."""
    n = np.maximum(s[:, 0], 1.0)
    return np.column_stack([
        np.log1p(s[:, 0]), s[:, 1] / n, s[:, 2] / n, s[:, 3] / np.maximum(s[:, 5], 1.0), s[:, 4] / n, s[:, 6] / n ** 0.8,
    ])


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])


def usual_depth(n: int) -> float:
    """Mean depth at which a search in n random points ends."""
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Random axis-parallel splits; the shorter a row's mean path, the higher its score."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        size = min(per_tree, len(rows))
        self.unit = max(usual_depth(size), 1.0)
        most = max(1, math.ceil(math.log2(max(size, 2))))
        self.trees = [self._grow(rows[draw.choice(len(rows), size, replace=False)], most, draw) for _ in range(trees)] if size else []

    def _grow(self, rows: np.ndarray, most: int, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []  # feature, cut, left, right, depth at a leaf

        def build(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, depth + usual_depth(len(part))])
            low, high = part.min(0), part.max(0)
            able = np.flatnonzero(high > low)
            if depth < most and len(able):
                f = int(draw.choice(able))
                cut = draw.uniform(low[f], high[f])
                left = part[:, f] <= cut
                nodes[at] = [f, cut, build(part[left], depth + 1), build(part[~left], depth + 1), 0.0]
            return at

        build(rows, 0)
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; about 0.5 for usual rows."""
        total, index = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(rows), int)
            while (inner := feature[at] >= 0).any():
                go = rows[index, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += depth[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / self.unit)


def best_threshold(scored: DataFrame) -> float:
    """The good score up to which the fewest rows are misjudged: bad ones over it are caught, good ones over it lost.

    scored: score, quality. Of equal choices the one that loses the fewest good rows; without good rows
    nothing is over it. Scores are counted in bands and then within each, so no task holds them all.
    """
    n = lambda q: F.sum((F.col("quality") == q).cast("long"))
    by = scored.groupBy("score").agg(n(0).alias("bad"), n(1).alias("good")).withColumn("band", F.floor(F.col("score") * BANDS))
    by = written(by, "scores")
    over = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # at most BANDS + 1 rows
    gain = F.col("bad") - F.col("good")
    bands = by.groupBy("band").agg(F.sum(gain).alias("own")).select("band", F.coalesce(F.sum("own").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    found = by.withColumn("inside", F.coalesce(F.sum(gain).over(within), F.lit(0))).join(F.broadcast(bands), "band")
    best = found.filter("good > 0").orderBy(F.desc(F.col("before") + F.col("inside")), F.desc("score")).select("score").first()
    return best[0] if best else 2.0


class Rules:
    """A forest fitted on rows of statistics(). Over its threshold, which fit_rules sets, a row counts as anomalous."""

    def __init__(self, stats: np.ndarray) -> None:
        self.forest = IsolationForest(features(stats)) if len(stats) else None
        self.threshold = 2.0

    def anomaly(self, stats: np.ndarray) -> np.ndarray:
        return self.forest.score(features(stats)) if self.forest and len(stats) else np.zeros(len(stats))


def held_out() -> Column:
    """Whether a label's document is of the half that sets the threshold."""
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)) == 1


def _stats_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()], float).reshape(len(texts), 7)


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Fits the forest on at most `sample` labelled documents of one half, and its threshold on all labelled rows of the other.

    The threshold costs bad documents that pass and good ones that go alike. Labels without id or quality say
    nothing, of several for one id one counts; ids that docs lack are ignored. Without rows in the one half nothing
    is anomalous, without good ones in the other neither.
    """
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().dropDuplicates(["doc_id"]).withColumn("held", held_out())
    chosen = marks.filter("not held").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    some = texts.join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    kind, names = "doc_id " + dict(docs.dtypes)["doc_id"], [f"s{i}" for i in range(7)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _stats_of(b["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"]} | {n: s[:, i] for i, n in enumerate(names)})

    found = some.mapInArrow(run, ", ".join([kind, *(n + " double" for n in names)])).orderBy(F.xxhash64("doc_id", *names), "doc_id", *names).limit(2 * sample).toPandas()
    found = found.sort_values(["doc_id", *names])  # repeated rows over the limit go by their hashes
    rules = Rules(found[names].to_numpy(float).reshape(len(found), 7))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _stats_of(b["text"])
            passed = ~base_failed(s)
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].filter(pa.array(passed)), "score": rules.anomaly(s[passed])})

    if rules.forest:
        scored = texts.mapInArrow(score, kind + ", score double").join(marks.filter("held"), "doc_id")  # scores are joined, never texts
        rules.threshold = best_threshold(scored.select("score", "quality"))
    return rules


def judge(docs: DataFrame, rules: Rules, carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """docs' `carry` columns with STATS, base_failed, anomaly and kept, their names after `prefix`.

    Null and empty texts have no words and so fail the base rules. Repeated rows are judged alike, each
    on its own; an empty table gives no rows. One very long text is one row of constant output.
    """
    names = [*carry, *(prefix + s for s in (*STATS, "base_failed", "anomaly", "kept"))]
    own = [F.col(f"`{c}`") for c in carry]
    kinds = [f.dataType.simpleString() for f in docs.select(*own).schema.fields] + ["long"] * len(STATS) + ["boolean", "double", "boolean"]
    out = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    at = carry.index("text") if "text" in carry else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _stats_of(b.column(at))
            failed, odd = base_failed(s), rules.anomaly(s)
            more = [s[:, i].astype(np.int64) for i in range(5)] + [failed, odd, ~failed & (odd <= rules.threshold)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], *map(pa.array, more)], names)

    return docs.select(*own, *([F.col("text").cast("string").alias("_judged")] if at == len(carry) else [])).mapInArrow(run, out)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, all columns, whatever their names but for those that begin with __.

    Null and empty texts go; repeated rows are judged alike; an empty table gives no rows.
    """
    judged = judge(docs, fit_rules(docs, labels), tuple(docs.columns), "__")
    return judged.filter("__kept").select(*(F.col(f"`{c}`") for c in docs.columns))
