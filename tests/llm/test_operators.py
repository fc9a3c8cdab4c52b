"""The corpus operators on small frames: against brute force, and the defined
results for nulls, empty and long texts, ties, repeated rows, empty tables and
clashing columns."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lagloom.llm import language, quality
from lagloom.llm.automaton import Dfa
from lagloom.llm.bpe import Bpe, decode_ids, encode_texts
from lagloom.llm.components import components
from lagloom.llm.lines import dedup_lines
from lagloom.llm.neighbours import _audit, near_duplicate_vectors
from lagloom.llm.packing import fullest, pack_documents, patterns
from lagloom.llm.packing import encode_texts as packed_ids
from lagloom.llm.secret_scan import BASE, Scanner, find_secrets, masked
from lagloom.llm.shards import shuffled_shards
from lagloom.llm.sketches import linked_in_block, near_duplicates, shingle_set
from lagloom.llm.topk import top_k
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string"
WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [None, "", " ", "\n", "a", "a\n\nb", "née 日本 ½ Ⅷ", "x" * 5000, "two  spaces \n then", "\x1c \x85 tab\t", "it's I'LL"]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def frame(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], DOCS)


# Line dedup


def lines_by_hand(docs):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_against_hand(spark):
    common, rare = "the same long line of text in many documents", "another long line that only four documents hold"
    docs = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\nend") for i in range(7)]
    docs += [(10 + i, f"{rare}\n\n{common}\n{common}") for i in range(4)]
    docs += [(20, None), (21, ""), (22, "\n" * 200 + common), (23, common[:39])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(dedup_lines(df), "doc_id", "text", "n_lines", "n_dropped") == lines_by_hand(docs)


def test_lines_edge_rows(spark):
    line = "x" * 45
    docs = [(None, line), *[(i, line) for i in range(4)], (3, line)]
    df = spark.createDataFrame([(*d, 7, "h") for d in docs], "doc_id long, text string, n_lines int, h1 string")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "h1", "n_dropped"]
    # A null id is a holder, the smallest; two rows under the largest id both stay.
    assert rows(out, "doc_id", "text") == sorted([(None, ""), (0, ""), (1, ""), (2, ""), (3, line), (3, line)], key=repr)
    more = df.unionByName(spark.createDataFrame([(9, line, 7, "h")], df.schema))
    assert rows(dedup_lines(more).where("text <> ''"), "doc_id") == [(9,)]
    assert dedup_lines(df.limit(0)).count() == 0


# Components and near-duplicates


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_steps_stay_small(spark, monkeypatch):
    """No step of the contraction reads its edges more than twice."""
    from lagloom.llm import components as steps

    scans, write = [], steps.scratch

    def counted(df, name):
        scans.append((name, df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")))
        return write(df, name)

    monkeypatch.setattr(steps, "scratch", counted)
    hub = [(50, i) for i in range(100, 140)] + [(i, i + 1) for i in range(8)] + [(8, 120), (7, 7), (3, 2), (200, 201)]
    got = dict(rows(steps.components(spark.createDataFrame(hub, "a long, b long")), "node", "component"))
    assert got == {**{i: 0 for i in [*range(9), 50, *range(100, 140)]}, 200: 200, 201: 200}
    assert max(n for name, n in scans if name.endswith("stars")) == 2


def shingles_by_hand(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    if len(w) < 5:
        return {" ".join(w)} if w else set()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def near_by_hand(docs):
    sets = [(i, shingles_by_hand(t)) for i, t in docs]
    lead = {i: i for i, _ in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                lead[q] = p
    return sorted(((i, len(s), find(i), find(i) == i) for i, s in sets), key=repr)


def test_near_duplicates_against_hand(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]

    def text(n):
        return list(rng.choice(words, n))

    docs, passage = [], text(60)
    for base in [text(n) for n in (8, 30, 90, 130, 400)]:
        docs.append(base)
        for _ in range(12):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
                copy[int(rng.integers(len(copy)))] = "new" + str(rng.integers(10**6))
            docs.append(copy)
    docs += [text(50) + passage + text(50) for _ in range(40)] + [text(10) + passage for _ in range(20)]
    docs = [" ".join(d) for d in docs] + ODD + ["a b c", "A  b\tc", "a b d"]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = rows(near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_by_hand(docs)


def test_near_duplicates_edge_rows(spark):
    docs = [(None, "same text here"), (4, "same text here"), (4, "same text here"), (9, "SAME text  here"), (None, None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, node int")
    got = rows(near_duplicates(df), "doc_id", "component_id", "kept")
    assert got == sorted([(None, None, True), (None, None, True), (4, 4, True), (4, 4, True), (9, 4, False)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_move_only_the_sets_they_need(spark, monkeypatch):
    from lagloom.llm import sketches

    real, made = sketches.scratch, {}

    def noted(df, name):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(sketches, "scratch", noted)
    values = {i: list(range(1000 * i, 1000 * i + 200)) for i in range(30)}
    values[1] = list(range(5, 205))
    sets = spark.createDataFrame(list(values.items()), "doc long, set array<long>")
    heads = [(i, 200, v[: sketches.SKETCH]) for i, v in values.items()]
    heads = spark.createDataFrame(heads, "node long, n long, sketch array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 3)], "a long, b long")
    assert rows(sketches._verify(pairs, heads, sets), "a", "b") == [(0, 1)]
    assert rows(made["open-sets"], "doc") == [(0,), (1,)]
    # Members of groups come to the sets, which move to their blocks only.
    groups = spark.createDataFrame([(7, i) for i in (0, 1, 3)] + [(8, 5)], "g long, node long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = sketches._grouped_links(groups, sets)
        assert "SortMergeJoin" not in links._jdf.queryExecution().executedPlan().toString()
        assert rows(links, "a", "b") == [(0, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_groups_return_few_edges(spark, monkeypatch):
    """Whatever a group holds, its blocks return edges in proportion to its nodes."""
    from lagloom.llm import sketches

    monkeypatch.setattr(sketches, "BLOCK", 4)
    rng = np.random.default_rng(8)
    values = {}

    def copies(n, start):
        base = list(range(start, start + 60))
        for i in range(n):
            values[len(values)] = sorted([*base[: 57 + i % 4], start + 1000 + i])

    copies(240, 0)  # one cluster
    for c in range(40):  # many of the size of the number of blocks, and single texts
        copies(12, 10_000 * (c + 1))
    for c in range(30):
        values[len(values)] = list(range(10**6 + 100 * c, 10**6 + 100 * c + 60))
    names = rng.permutation(len(values)).tolist()
    for kinds in (range(270), range(240, 750), range(750)):
        kinds = [k if k < 240 or len(kinds) > 270 else 720 + k - 240 for k in kinds]
        sets = spark.createDataFrame([(names[k], values[k]) for k in kinds], "doc long, set array<long>")
        groups = spark.createDataFrame([(7, names[k]) for k in kinds], "g long, node long")
        links = rows(sketches._grouped_links(groups, sets), "a", "b")
        cluster = {names[k]: 0 if k < 240 else 1 + (k - 240) // 12 if k < 720 else k for k in kinds}
        assert all(cluster[a] == cluster[b] for a, b in links)
        lead = {}
        for k in sorted(cluster):
            lead.setdefault(cluster[k], k)
        got = dict(rows(components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
        assert all(got.get(k, k) == lead[cluster[k]] for k in cluster)
        assert len(links) < 6 * len(kinds)


def test_nodes_of_large_lists_meet_by_more_values(spark):
    """Pairs that met in no group must not grow with the square of their list."""
    from lagloom.llm.sketches import _drawn
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    nodes = [(i, sorted(rng.choice(60, 40, replace=False).tolist())) for i in range(120)]
    df = spark.createDataFrame(nodes, "node long, values array<long>")
    for size, most in ((64, 2), (4096, 14)):
        drawn = [set(r[0]) for r in df.select(_drawn(F.col("values"), F.lit(size))).collect()]
        assert max(map(len, drawn)) <= most
        apart = sum(not a & b for i, a in enumerate(drawn) for b in drawn[:i])
        # Each draw leaves about half of the 7,140 pairs apart.
        assert apart < 30 if size > 64 else apart > 500


def test_block_keeps_components():
    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(2**62, 300, replace=False).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[rng.random(300) > 0.1], np.array([i], dtype=np.uint64)])) for i in range(30)]
    links = linked_in_block(np.arange(30), sets, np.zeros(30, dtype=int))
    true = {
        (i, j)
        for i in range(30)
        for j in range(i)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    }
    assert true and all((max(p), min(p)) in true for p in links)
    assert len(shingle_set("a b c d e f")) == 2


# BPE


@pytest.fixture(scope="module")
def bpe():
    return Bpe(WORD)


def test_bpe_equals_library(bpe):
    t = Tokenizer.from_file(WORD)
    odd = [x for x in ODD if x is not None] + ["ΣΑΣ İx ǅ ﬁ", "a<|endoftext|>B <|startoftext|>", "é", "퟿\U0001f600 ‼"]
    for text in odd:
        ids = np.frombuffer(bpe.encode(text), dtype="<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids, text
        assert bpe.decode(ids) == t.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn"]), max_size=40))
def test_bpe_and_pieces_on_any_text(text):
    for own, path in ((lambda x: _word().encode(x), WORD), (lambda x: packed_ids(BYTE, [x])[0], BYTE)):
        ids = np.frombuffer(own(text), dtype="<u4").tolist()
        assert ids == _library(path).encode(text, add_special_tokens=False).ids


def _word():
    from lagloom.llm.bpe import loaded

    return loaded(WORD)


def _library(path, held={}):  # noqa: B006
    return held.setdefault(path, None) or held.update({path: Tokenizer.from_file(path)}) or held[path]


def test_bpe_frames(spark):
    df = frame(spark, ODD).withColumn("Decoded", df_lit("x"))
    out = decode_ids(encode_texts(df, WORD), WORD)
    assert out.columns == ["doc_id", "lang", "ids", "decoded"] and out.select("decoded").columns
    t = Tokenizer.from_file(WORD)
    for r in out.collect():
        assert r.ids == t.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded == t.decode(r.ids, skip_special_tokens=False)
    assert decode_ids(encode_texts(df.limit(0), WORD), WORD).count() == 0


def df_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


# Sharding


def test_shards(spark):
    texts = ODD + [f"text {i}" for i in range(200)] + ["again"] * 60
    df = frame(spark, texts).withColumn("slot", df_lit("x"))
    out = shuffled_shards(df, shards=7, bucket_bytes=500).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text == texts[r.doc_id]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len(by) == 7 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = shuffled_shards(df.repartition(9), shards=7, bucket_bytes=500).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in out}
    few = shuffled_shards(df.limit(3).unionByName(spark.createDataFrame([(None, None, None, "x")], df.schema)))
    assert few.count() == 4
    assert shuffled_shards(df.limit(0)).count() == 0


# Packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=6))
def test_fullest_is_best(stock):
    reach = {0}
    for size, n in stock.items():
        reach = {s + size * k for s in reach for k in range(n + 1) if s + size * k <= 31}
    got = fullest(stock, 31)
    assert sum(k * v for k, v in got.items()) == max(reach)
    assert all(v <= stock[k] for k, v in got.items())


def test_patterns_use_up_the_stock():
    stock = {700: 1000, 300: 5000, 2000: 30, 47: 900, 48: 31, 1: 10**9}
    used: Counter = Counter()
    for times, counts in patterns(stock, 2048):
        assert sum(k * v for k, v in counts.items()) <= 2048
        for k, v in counts.items():
            used[k] += v * times
    assert used == stock


def test_packing(spark):
    texts = ODD + ["word " * 3000, "equal words here"] + ["equal words here"] * 40
    out = pack_documents(frame(spark, texts), BYTE).collect()
    t = Tokenizer.from_file(BYTE)
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc].append((r.start, bytes(r.ids)))
        assert len(r.ids) == 4 * r.length
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(b for _, b in sorted(docs[i])), dtype="<u4").tolist() == ids
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(seqs) == list(range(len(seqs)))
    assert pack_documents(frame(spark, []), BYTE).count() == 0


# Secrets

BASE_RX = [
    re.compile(
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
]


def base_by_hand(text):
    out = []
    for r, (rx, least) in enumerate(zip(BASE_RX, (8, 16, 32), strict=True)):
        out += [(m.start(), r, m.end()) for m in rx.finditer(text or "") if len(m[2] if r == 0 else m[0]) >= least]
    return sorted(out)


@pytest.fixture(scope="module")
def scan():
    return Scanner()


PIECES = ["token", "Secret", "API_key", "=", ":", " ", '"', "'", "AKIA", "A1B2C3D4E5F6", "abcdef0123456789", "é", "\n"]
PIECES += ["pass", "PASSWD", "x", ".", "-", "日", "a.token", ":abcdefghij", "ghp_", "a" * 20]


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(PIECES), max_size=14))
def test_secrets_against_patterns(parts):
    text = "".join(parts)
    assert [s for s in _scan().spans(text) if s[1] < len(BASE)] == base_by_hand(text)


def _scan(held=[]):  # noqa: B006
    if not held:
        held.append(Scanner())
    return held[0]


def test_more_secrets_and_masks(spark, scan):
    texts = [*ODD, "x token: 'abcdefgh1' y", "ghp_" + "aB3" * 8 + " -----BEGIN RSA PRIVATE KEY----- é", "é token=" + "0a" * 20]
    found = find_secrets(frame(spark, texts).withColumn("spans", df_lit(1)))
    assert found.columns == ["doc_id", "lang", "text", "spans"]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}
    assert all(not got[i] for i in range(len(ODD)))
    assert [s[0] for s in got[len(ODD) + 1]] == ["github", "pem"]
    clean = dict(rows(masked(found), "doc_id", "text"))
    assert clean[len(ODD)] == "x <assign>' y" and clean[len(ODD) + 2] == "é <assign>"
    assert clean[len(ODD) + 1] == "<github> <pem> é" and clean[0] is None and clean[7] == ODD[7]
    assert find_secrets(frame(spark, [])).count() == 0


@pytest.mark.parametrize("pattern", ["a*b|c{2,3}d?", "(ab|a)+c", "[^a-c]x{2}", r"\d+\.\d*", "a{0,2}", "x(y|z){1,}"])
def test_automaton_against_re(pattern):
    rng = np.random.default_rng(1)
    dfa, rx = Dfa([(pattern, False)], search=False), re.compile(pattern)
    for _ in range(300):
        text = "".join(rng.choice(list("abcdxyz019."), 6))
        ends = [i for i in range(len(text) + 1) if rx.fullmatch(text, 0, i)]
        assert dfa.longest(text.encode(), 0) == (max(ends) if ends else -1)


# Languages and quality


def test_language(spark):
    docs = [(i, " ".join(["the cat sat", "on the mat"][j % 2] for j in range(5)), "en") for i in range(40)]
    docs += [(100 + i, "der hund liegt auf der matte im haus", "de") for i in range(40)]
    docs += [(200, None, "en"), (201, "123 ...", "de"), (202, "matten hunde", None), (203, "", None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", score string")
    model = language.learn(df)
    out = language.predict(df.drop("lang"), model)
    assert out.columns == ["doc_id", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].lang_pred == "en" and 0 <= got[i].score <= 1 for i in range(40))
    # An unseen word backs off to its character n-grams.
    assert got[202].lang_pred == "de"
    assert [(got[i].lang_pred, got[i].score) for i in (200, 201, 203)] == [("und", 0.0)] * 3
    nothing = language.learn(df.withColumn("lang", df_lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(df.drop("lang"), nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), language.learn(df.limit(0))).count() == 0


def test_quality_gradient():
    rng = np.random.default_rng(3)
    grade = np.array([0, 1, 2, 2, 1])
    slots = rng.integers(0, 6, 14).astype(np.int32)
    ends = np.array([0, 3, 6, 9, 12, 14])
    at = np.concatenate([[-0.3, 0.2], rng.normal(size=6)])

    def f(x):
        return quality.gradient(grade, ends, slots, x[2:], x[:2])

    slope = [(f(at + e)[0] - f(at - e)[0]) / 2e-6 for e in 1e-6 * np.eye(8)]
    assert np.allclose(slope, f(at)[1:], atol=1e-5)


def test_quality(spark):
    texts = [("good plain words", 2), ("junk ### text", 1), ("bad scum text", 0)]
    docs = [(i, f"{texts[i % 3][0]} n{i}") for i in range(90)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    graded = spark.createDataFrame([(i, texts[i % 3][1]) for i in range(60)] + [(60, None), (777, 1)], "doc_id long, grade int")
    model = quality.fit_grades(df, graded)
    assert (np.diff(quality.thresholds(model["raw"])) > 0).all()
    got = {r.doc_id: r for r in quality.rate(df, model).collect()}
    assert all(got[i].kept == (i % 3 == 0) for i in range(90)) and len(got) == 92
    assert got[60].expected_grade > got[61].expected_grade > got[62].expected_grade
    none = quality.rate(df, quality.fit_grades(df, graded.limit(0))).collect()
    assert all(r.expected_grade is None and not r.kept for r in none)
    assert quality.rate(df.limit(0), model).count() == 0


# Vectors


def test_top_k(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(-50, 50, (700, 6))
    m[100:400] = m[100]
    data = [(i, v.tolist()) for i, v in enumerate(m)] + [(9000, None), (9001, [1, None, 2, 3, 4, 5]), (9002, [1, 2])]
    data += [(9003, [2**28] * 6), (9003, [2**28] * 6)]
    df = spark.createDataFrame(data, "vec_id long, vector array<long>")
    good = {i: v for i, v in data if v is not None and None not in v}
    got = defaultdict(list)
    for r in top_k(df, df.where("vec_id % 3 = 0"), k=5, shard_rows=64).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q, v in good.items():
        if q % 3:
            continue
        want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v))
        want = [(n + 1, i, -s) for n, (s, i) in enumerate(want[:5])]
        assert sorted(got.get(q, [])) == want
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    data = []
    for i, b in enumerate(base):
        for _ in range(1 + (i % 3) * 2 + (i == 7) * 150):
            data.append((b + rng.normal(size=16) * rng.choice([0.01, 0.2])).tolist())
    data += [data[0]] * 4
    table = [(i, v, i % 2) for i, v in enumerate(data)]
    table += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 1), (5003, data[0], None), (5004, [1.0], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    unit = np.array(data) / np.linalg.norm(data, axis=1)[:, None]
    label = np.arange(len(data)) % 2
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    lead = list(range(len(data)))
    for _ in range(len(data)):
        before = list(lead)
        for i in range(len(data)):
            lead[i] = min([lead[i], *(lead[j] for j in np.flatnonzero(links[i]))])
        if lead == before:
            break
    want = [(i, int(links[i].sum()), lead[i], lead[i] == i) for i in range(len(data))]
    want += [(i, 0, i, True) for i in range(5000, 5005)]
    assert rows(near_duplicate_vectors(df), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=repr)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def linked_by_hand(vectors):
    """(vec_id, n_links, component_id) of vectors of one label."""
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    links = unit @ unit.T >= 0.93
    np.fill_diagonal(links, False)
    lead = np.arange(len(unit))
    while True:
        now = np.minimum(lead, np.where(links, lead[None, :], len(unit)).min(axis=1))
        if (now == lead).all():
            return [(i, int(links[i].sum()), int(lead[i])) for i in range(len(unit))]
        lead = now


def test_embedding_clumps_are_linked_to_each_other(spark):
    """Lists of 12 fill with the own clump of 30; links between clumps count."""
    rng = np.random.default_rng(3)
    data = []
    for _ in range(8):
        c, d = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for turn in (0.0, 0.31):
            centre = np.cos(turn) * c + np.sin(turn) * d
            data += [(centre + rng.normal(size=32) * 0.012).tolist() for _ in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(data)], "vec_id long, embedding array<double>, label int")
    want = linked_by_hand(data)
    assert len({c for _, _, c in want}) == 8
    assert rows(near_duplicate_vectors(df), "vec_id", "n_links", "component_id") == sorted(want, key=repr)


def test_embedding_audit_weighs_nodes_alike(spark):
    """A group whose many links are all found does not hide ten missed pairs."""
    rng = np.random.default_rng(11)
    far = rng.normal(size=(11, 64))
    data = [(far[0] + rng.normal(size=64) * 0.05).tolist() for _ in range(60)]
    data += [(v + rng.normal(size=64) * 0.05).tolist() for v in far[1:] for _ in range(2)]
    loose = spark.createDataFrame([(i, 0, v) for i, v in enumerate(data)], "node long, label int, v array<double>")
    links = spark.createDataFrame([(a, b) for b in range(60) for a in range(b)], "a long, b long")
    assert abs(_audit(loose, links) - 0.75) < 1e-9


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n"])
@pytest.mark.parametrize("headers", [[], ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", ""]])
def test_whole_key_blocks_are_secrets(end, headers):
    if end == "\\n" and headers:
        return
    lines = ["-----BEGIN RSA PRIVATE KEY-----", *headers, "MIIE+/aB" * 8, "cdEF09==", "-----END RSA PRIVATE KEY-----"]
    block = end.join(lines)
    assert Scanner().spans(f"a {block} b") == [(2, 5, 2 + len(block))]
    # No END line: the body goes all the same.
    cut = end.join(lines[:-1])
    assert Scanner().spans(f"a {cut} b") == [(2, 5, 2 + len(cut))]


def test_bpe_lists_are_decoded_together():
    import json
    import tempfile

    import pyarrow as pa

    from lagloom.llm.bpe import Bpe

    spec = {
        "model": {"vocab": {"a": 0, "b": 1, "ab</w>": 2, "é": 3}, "merges": [], "end_of_word_suffix": "</w>"},
        "added_tokens": [{"content": "<end>", "id": 4}],
        "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": r"\w+"}}]},
    }
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        json.dump(spec, f)
        f.flush()
        bpe = Bpe(f.name)
    lists = [[7], [0, 2], None, [], [4, 3, 1], [1], None]
    ids = pa.array(lists, pa.list_(pa.int32())).slice(1)
    want = [None if x is None else bpe.decode(x) for x in lists[1:]]
    assert bpe.decode_lists(ids).to_pylist() == want == ["a ab</w>", None, "", "<end> é b", "b", None]
