"""The pipeline, stage by stage, against plain versions."""

import collections
import shutil
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from llm.conftest import rows
from llm.test_operators import LOWER, bag, plain_classes, plain_ids, plain_spans, plain_stats, texts
from quadrel.llm import pii, rules


def test_stages(spark, odd, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, before = odd, None
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["quality_rules", "exact_dedup", "near_dedup", "pii", "packing"]
    fitted = rules.fit_rules(odd, labels)
    judged = {(r.doc_id, r.n_words): r.kept for r in rules.judge(odd, fitted).collect()}
    for name, stage in named.items():
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        plain, left = [(r.doc_id, r.text) for r in docs.collect()], out.collect()
        got = sorted(((r.doc_id, r.text) for r in left), key=str) if name != "packing" else []
        if name != "packing":
            assert out.columns == odd.columns
        if name == "quality_rules":
            assert got == sorted(((i, t) for i, t in plain if judged[i, plain_stats(t)[0]]), key=str) and len(got) > 8
        elif name == "exact_dedup":
            groups = collections.defaultdict(list)
            for i, t in plain:
                groups[(t or "").translate(LOWER)].append((i is not None, i or 0, t))
            assert [i for i, _ in got] == [i for i, _ in sorted(((max(g)[1] if max(g)[0] else None, max(g)[2]) for g in groups.values()), key=str)]
        elif name == "near_dedup":
            assert sorted(str(i) for i, _ in got) == sorted({str(c[1]) for c in plain_classes(plain)})
        elif name == "pii":
            assert got == sorted(plain_redaction(docs), key=str) and len(got) == len(plain)
            for _, t in got:
                assert not any(plain_spans(t).values())
            assert all(r.n_chars == len(r.text) for r in left)
        else:
            check_packing(left, plain)
        docs, before = out, name
    assert before == "packing"


def plain_redaction(docs):
    """doc_id and text with the operator's spans cut out character by character."""
    out = []
    for r in pii.digest(docs.select("doc_id", "text", F.col("text").alias("own"))).collect():
        text, cuts = r.own, sorted((s["start"], s["end"], s["kind"], s["name"]) for s in r.span_list)
        groups = []
        for start, end, kind, name in cuts:
            if groups and start < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], end)
                groups[-1][2].append((end - start, -kind, name))
            else:
                groups.append([start, end, [(end - start, -kind, name)]])
        for start, end, names in reversed(groups):
            text = text[:start] + f"[{max(names)[2].upper()}]" + text[end:]
        out.append((r.doc_id, text))
    return out


def check_packing(found, plain):
    """All pieces are there, each sequence is gapless and short enough."""
    expected = []
    for i, t in plain:
        ids = plain_ids(t)
        starts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        expected += [(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    assert bag(tuple(r)[:5] for r in found) == bag(expected)
    held = collections.defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(e[3] for e in expected) // 2048) + 2


def test_run(spark, sf_dir):
    """The whole pipeline against plain versions of its stages, in a row."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in rules.judge(documents, rules.fit_rules(documents, labels)).filter("kept").collect()}
    plain = [(i, t) for i, t in texts(sf_dir) if i in kept]
    equal = {}
    for i, t in plain:
        key = (t or "").translate(LOWER)
        equal[key] = max(equal.get(key, (i, t)), (i, t))
    plain = list(equal.values())
    classes = {c[0]: c[1] for c in plain_classes(plain)}
    plain = [(i, t) for i, t in plain if classes[i] == i]
    clean = plain_redaction(spark.createDataFrame(plain, "doc_id long, text string"))
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), clean)
    assert corpus_pipeline.ORACLE_SQL is None and 50 < len(plain) < len(kept)


def test_empty(spark, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
    shutil.rmtree(tmp_path, ignore_errors=True)
    assert rows() and pii.KINDS
