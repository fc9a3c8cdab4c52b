"""The pipeline's stages and the queries without SQL, against brute force."""

from __future__ import annotations

import glob
import os
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import connect, mismatch
from lagloom.llm.queries import ORACLE, QUERIES
from test_operators import BASE_RX, base_by_hand, lines_by_hand, near_by_hand
from tokenizers import Tokenizer

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    assert mismatch(spark, connect(MEDIUM), QUERIES[name], ORACLE[name], MEDIUM) is None


def test_every_operator_has_a_query():
    assert [f"op{n}" for n in range(1, 14)] == sorted({q.split("_")[0] for q in QUERIES} - {"pipeline"}, key=lambda q: int(q[2:]))
    assert "pipeline" in QUERIES and len(BASE_RX) == 3


def test_language_on_held_out(spark):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    out = [r for r in QUERIES["op2_language_id"](spark, MEDIUM).collect() if r.held_out]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in out]) > 0.97


def test_quality_on_unseen(spark):
    """Fitted without the documents it is tested on."""
    from lagloom.llm import quality
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    graded = spark.read.parquet(f"{MEDIUM}/labels.parquet").select(
        "doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade")
    )
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit_grades(docs, graded.where(~unseen))
    want = {r.doc_id: r.grade for r in graded.where(unseen).collect()}
    got = {r.doc_id: r.kept for r in quality.rate(docs, model).collect()}
    assert np.mean([got[i] == (g == 2) for i, g in want.items()]) > 0.95


def by_hand(docs):
    """The stages up to the secret scan, from the definitions."""
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    kept = {i: t for i, t, *_ in lines_by_hand([(d[0], d[1]) for d in docs])}
    leads = {i for i, _, _, lead in near_by_hand(list(kept.items())) if lead}
    out = {}
    for i in leads:
        text, parts, at = kept[i], [], 0
        for a, r, b in base_by_hand(text):
            if a >= at:
                parts += [text[at:a], ("<assign>", "<access>", "<hex>")[r]]
            at = max(at, b)
        out[i] = "".join(parts) + text[at:]
    return out


def test_pipeline_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got, used = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id].append((r.start, bytes(r.ids)))
        used[r.sequence_id].append((r.offset, r.length))
    want = by_hand(docs)
    assert set(got) == set(want)
    for i, text in want.items():
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(b for _, b in sorted(got[i])), dtype="<u4").tolist() == ids
    for parts in used.values():
        assert sum(n for _, n in parts) <= 2048 and sorted(parts)[0][0] == 0


def test_stages_on_odd_rows(spark):
    rows = [(None, "ok text", "en", None, 7), (1, None, "en", "s", None), (2, "", None, "s", 0), (2, "words here", "en", "s", 1)]
    rows += [(3, "same words again", "en", "s", 1), (3, "same words again", "en", "s", 1), (4, "!!! 12", "en", "s", 6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        docs = out
    left = docs.collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id is not None) == [(2, "words here"), (3, "same words again")]
    assert all(r.n_chars == len(r.text) for r in left) and len(left) == 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 3


def test_texts_under_one_id(spark):
    """Unique texts stay whatever other texts share their id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = b + " more"
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    for rows, want in (
        ([(5, a), (5, c), (1, a)], {(1, a), (5, c)}),
        ([(5, a), (5, b), (7, near), (1, a)], {(1, a), (5, b), (7, near)}),
        ([(5, a), (3, a + " z"), (5, b), (5, b)], {(3, a + " z"), (5, b), (5, a)}),
        ([(None, a), (2, c), (2, c)], {(None, a), (2, c)}),
    ):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
        got = [(r.doc_id, r.text) for r in stage(spark, docs, SMALL).collect()]
        assert len(got) == len(set(got)) and set(got) <= want
        # One of b and its near copy, one of a and its near copy.
        texts = {t for _, t in got}
        assert (a in texts) + (a + " z" in texts) == ((a in {t for _, t in rows}))
        assert (b in texts) + (near in texts) == (b in {t for _, t in rows})
        assert (c in texts) == (c in {t for _, t in rows})


def test_scratch_stays_in_the_shared_folder(spark):
    from lagloom.llm.shared import scratch, shared_folder

    scratch(spark.range(3), "x")
    assert glob.glob(os.path.join(shared_folder(spark), "x-*"))
