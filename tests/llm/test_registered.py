"""The registered queries without SQL, as registered, against definitions."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from lagloom.llm import quality
from lagloom.llm.queries import QUERIES
from lagloom.llm.secret_scan import BASE
from pyspark.sql import functions as F
from test_operators import base_by_hand
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in docs}


def by_id(df):
    out = {r.doc_id: r for r in df.collect()}
    assert len(out) == df.count()
    return out


def test_op2(spark, texts):
    got = by_id(QUERIES["op2_language_id"](spark, SMALL))
    assert set(got) == set(texts)
    langs = {r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("lang").distinct().collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in langs if any(c.isalpha() for c in texts[i]) else r.lang_pred == "und"


def test_op3(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    got = by_id(QUERIES["op3_bpe"](spark, SMALL))
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_op4(spark, texts):
    """A rating by hand from the fitted weights."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    grade = quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade")
    graded = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", grade)
    model = quality.fit_grades(docs, graded)
    t = quality.thresholds(model["raw"])
    got = by_id(QUERIES["op4_quality_classifier"](spark, SMALL))
    assert set(got) == set(texts) and 0 < (model["weights"] != 0).sum() < 3000
    for i, text in texts.items():
        above = 1 / (1 + np.exp(t - model["weights"][quality.features(text)].sum()))
        assert got[i].tail_probability == pytest.approx(above[-1], abs=1e-9)
        assert got[i].expected_grade == pytest.approx(model["grades"][0] + above @ np.diff(model["grades"]), abs=1e-9)
        assert got[i].kept == (got[i].tail_probability >= 0.5)


def test_op5(spark, texts):
    out = QUERIES["op5_sharding"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    shards = defaultdict(list)
    for r in out:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op6(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op6_packing"](spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_op7(spark, texts):
    got = by_id(QUERIES["op7_secret_scan"](spark, SMALL))
    assert set(got) == set(texts)
    kinds = [r.kind for r in BASE]
    for i, text in texts.items():
        want = base_by_hand(text)
        joined = [f"{kinds[r]}:{a}:{b}" for a, r, b in want]
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert r.base_sha256 == sha(",".join(joined)) and set(joined) <= set(r.spans.split(","))


def test_clashing_columns_and_repeated_rows(spark):
    """Results replace columns of their names; equal rows have equal results."""
    from lagloom.llm import language
    from lagloom.llm.topk import top_k

    text = "the cat sat on the mat " * 4000
    rows = [(1, text, "en", 7), (1, text, "en", 7), (2, None, "en", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score int")
    out = language.predict(df, language.learn(df), keep_text=True)
    assert out.columns == ["doc_id", "lang", "text", "lang_pred", "score"]
    assert len({tuple(r) for r in out.collect()}) == 2 and out.count() == 3
    graded = spark.createDataFrame([(1, 2), (1, 2), (2, 0)], "doc_id long, grade int")
    rated = quality.rate(df.withColumnRenamed("Score", "Kept"), quality.fit_grades(df, graded))
    assert rated.columns == ["doc_id", "lang", "expected_grade", "tail_probability", "kept"] and rated.count() == 3
    vectors = spark.createDataFrame([(0, [1, 0], 3), (1, [2, 1], 4), (2, [0, 5], 5)], "vec_id long, vector array<long>, rank int")
    best = top_k(vectors, vectors.where("vec_id = 0"), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in best) == [(0, 1, 1, 2), (0, 2, 2, 0)]
