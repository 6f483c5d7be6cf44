"""The pipeline's stages and its whole against plain restatements."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from glintframe.llm import langid, piece_codec, simhash, source_mix
from glintframe.llm.common import documents, staged


def accepted(model, text):
    """Language by convolution written out, a window at a time."""
    data = (text or "").encode()
    total = np.zeros(len(model.langs))
    for a in range(0, len(data), langid.WINDOW):
        codes = langid.CLASS[np.frombuffer(data[a : a + langid.WINDOW], np.uint8)]
        if not langid._LETTER[codes].any():
            p = np.eye(len(model.langs))[-1]
        else:
            x = np.zeros(langid.WINDOW + 3, int)
            x[: len(codes)] = codes
            top = np.concatenate([np.max([sum(f[j, x[i + j]] for j in range(len(f))) for i in range(langid.WINDOW)], axis=0) for f in model.filters])
            z = np.maximum(top + model.bias, 0) @ model.dense + model.dense_bias
            p = np.exp(z - z.max())
            p /= p.sum()
        total += p * len(codes)
    return len(data) > 0 and total[-1] / len(data) < langid.REJECT


def near_groups(rows):
    f, some = simhash.simhash(pa.array([r["text"] for r in rows]))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if some[i] and some[j] and np.bitwise_count(f[i] ^ f[j]).sum() <= simhash.RADIUS:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


@pytest.fixture(scope="module")
def expected(spark, sf):
    """Rows after the near-duplicate stage, by brute force."""
    docs = documents(spark, sf)
    model = langid.train(docs)
    rows = [r for r in sorted(docs.collect(), key=lambda r: r["doc_id"]) if accepted(model, r["text"])]
    first = {}
    for r in rows:
        first.setdefault(r["text"], r)
    return near_groups(list(first.values()))


def test_stages_are_declared():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mix", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_whole_pipeline(spark, sf, expected):
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]].append(r)
    by = {r["doc_id"]: r for r in expected}
    assert set(got) == set(by)  # mixing loses no document
    mass = collections.Counter()
    for r in expected:
        mass[r["source"]] += len(r["text"])
    raw = {s: m ** (source_mix.ALPHA - 1) for s, m in mass.items()}
    rate = {s: v / min(raw.values()) for s, v in raw.items()}
    copies = collections.Counter()
    for i, rows in got.items():
        s = by[i]["source"]
        assert len(rows) in (math.floor(rate[s]), math.floor(rate[s]) + 1)
        copies[s] += len(rows)
    for s, n in collections.Counter(r["source"] for r in expected).items():
        assert abs(copies[s] - n * rate[s]) < 1
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    for i, rows in got.items():
        assert all(r["ids"] == sp.encode(by[i]["text"]) and r["round_trip"] for r in rows)


def test_stages_take_effect_and_keep_columns(spark, sf):
    """Planted copies, near copies and junk, with nulls and a repeated row."""
    docs = documents(spark, sf).limit(60)
    long = next(r for r in docs.collect() if len(r["text"].split()) > 150)
    words = long["text"].split()
    words[40], words[90] = "changed", "words"
    planted = [(9001, long["text"], "en", "x", 1), (9002, " ".join(words), "en", "x", 1), (9003, "0a9f" * 200, None, "x", 1), (9004, None, None, None, None), (9005, "", "en", "x", 0), (None, long["text"] + " and more of it", "en", "x", 1)]
    d = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    d = d.unionByName(d.where("doc_id = 9002"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = staged(stage(spark, d, sf))
        assert d.columns == docs.columns and d.schema.simpleString() == docs.schema.simpleString()
        seen.append(collections.Counter(r["doc_id"] for r in d.collect()))
    assert {9001, 9002, None} <= set(seen[0]) and not {9003, 9004, 9005} & set(seen[0])
    assert 9001 not in seen[1] and seen[1][9002] == 1 and seen[1][long["doc_id"]] == 1
    assert 9002 not in seen[2] and seen[2][long["doc_id"]] == 1
    assert set(seen[3]) == set(seen[2]) and all(seen[3][i] >= n for i, n in seen[2].items())
    out = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert collections.Counter(r["doc_id"] for r in out.collect()) == seen[3]


def test_empty_table_through_all_stages(spark, sf, tmp_path):
    empty = documents(spark, sf).limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_texts_and_clashing_columns(spark, sf):
    """Very long texts go through whole, and columns with names of the operators' own stay."""
    docs = documents(spark, sf).limit(40)
    long = " ".join(r["text"] for r in docs.collect()) * 3
    d = docs.unionByName(spark.createDataFrame([(9001, long, "en", "x", len(long)), (9002, long, None, "x", len(long))], docs.schema))
    names = ["_drop", "_slot", "_cell", "_bitmap", "_key", "_place", "shard", "band", "_d", "_n", "a.b"]
    for n in names:
        d = d.withColumn(n, F.lit(7))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = staged(stage(spark, d, sf))
        assert {x for r in d.select(*[f"`{n}`" for n in names]).distinct().collect() for x in r} == {7}
    out = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, d, sf).collect()}
    assert 9001 in out and 9002 not in out
    assert out[9001]["ids"] == sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL).encode(long)
