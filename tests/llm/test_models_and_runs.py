"""Language-model scores, periodic runs and centroid clusters on small frames:
against brute force, and the defined results for odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lagloom.llm import pitman_yor, restaurants
from lagloom.llm.pitman_yor import language_model_scores
from lagloom.llm.queries import QUERIES
from lagloom.llm.runs import Factors, WaveletTree, find_runs, runs_of_texts, tiled
from lagloom.llm.zones import assign_block, candidates, cluster_vectors, hilbert_keys
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def words_by_hand(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Periodic runs


def runs_by_hand(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            part = w[i : i + n]
            smaller = any(all(part[x] == part[x + p] for x in range(n - p)) for p in range(1, q))
            if j > i and n >= max(6, 4 * q) and not smaller:
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


block = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(block, max_size=6), min_size=1, max_size=5))
def test_runs_against_hand(parts):
    docs = [[x for b, n in doc for x in b * n] for doc in parts]
    runs, collapsed = runs_of_texts(pa.array([" \n" + "  ".join(d) + "\t" for d in docs]))
    for w, got, left in zip(docs, runs.to_pylist(), collapsed.to_pylist(), strict=True):
        want = runs_by_hand(w)
        assert [(r["start"], r["length"], r["period"]) for r in got] == want
        assert left == collapsed_by_hand(w, want)


def test_suffix_array_and_successor():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 40, 1, 200, 0, 7])
    codes = rng.integers(0, 3, lengths.sum())
    f = Factors(codes, lengths)
    ends = np.cumsum(lengths)
    suffix = lambda i: tuple(codes[i : ends[np.searchsorted(ends, i, "right")]])
    keys = [(int(f.doc[i]), suffix(i)) for i in f.order]
    assert keys == sorted(keys)
    values = rng.integers(0, 50, 300)
    tree = WaveletTree(values)
    left = rng.integers(0, 300, 200)
    right = left + rng.integers(0, 40, 200).clip(max=300 - left)
    bound = rng.integers(0, 60, 200)
    for a, b, x, got in zip(left, right, bound, tree.successor(left, right, bound), strict=True):
        some = [v for v in values[a:b] if v >= x]
        assert got == (min(some) if some else -1)


def test_runs_odd_rows(spark):
    rows = [(1, None, 5), (1, "", 5), (None, " \x0b\n ", 5), (2, "a " * 30000, 5), (2, "a " * 30000, 5), (3, "x\x1cy é " * 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs int")
    out = find_runs(df)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    want = [(1, [], ""), (1, [], ""), (2, [(0, 30000, 1)], "a"), (2, [(0, 30000, 1)], "a"), (3, [(0, 8, 2)], "x\x1cy é")]
    assert got == sorted([*want, (None, [], "")], key=repr)
    assert find_runs(df.limit(0)).count() == 0


def test_planted_text(spark):
    def by_hand(i, text):
        w, h = words_by_hand(text), zlib.crc32(str(i).encode())
        if h % 10 or not w:
            return text
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))

    rng = random.Random(4)
    rows = [(i, " \n".join(rng.choices("abcdefg", k=rng.randrange(0, 60)))) for i in range(200)] + [(7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = [(r.doc_id, r.t) for r in df.select("doc_id", tiled(F.col("text"), seed).alias("t")).collect()]
    assert got == [(i, by_hand(i, t)) for i, t in rows]


# Clusters


def clusters_by_hand(rows, k, rounds):
    import hashlib

    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in rows:
            members[nearest(v)[1]].append(v)
        for j, vs in members.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in rows]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), tuple(centres[c])) for i, c, d in out], key=repr)


@pytest.mark.parametrize("scale", [3, 40, 1 << 22])
def test_clusters_against_hand(spark, scale):
    rng = np.random.default_rng(scale)
    rows = [(i, rng.integers(-scale, scale, 5).tolist()) for i in range(300)]
    rows += [(None, rows[0][1]), (4, rows[4][1]), (5, rows[9][1])] + [(1000 + i, rows[7][1]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    out = cluster_vectors(df, k=7, rounds=3, dims=5)
    got = sorted(
        ((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out.collect()), key=repr
    )
    assert got == clusters_by_hand(rows, 7, 3)


def test_clusters_few_and_none(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [9, 9])], "id long, vector array<long>")
    got = cluster_vectors(df, k=16, dims=2).select("id", "distance").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0)]
    assert cluster_vectors(df.limit(0), dims=2).count() == 0
    with pytest.raises(ValueError, match="beyond"):
        cluster_vectors(spark.createDataFrame([(1, [1 << 27, 0])], df.schema), dims=2).count()


def test_box_candidates_hold_every_nearest():
    rng = np.random.default_rng(8)
    fewer = 0
    for _ in range(200):
        v = rng.integers(-50, 50, 6) + rng.integers(-6, 6, (40, 6))
        centres = rng.integers(-60, 60, (12, 6))
        low, high = v.min(axis=0), v.max(axis=0)
        d = ((v[:, None] - centres) ** 2).sum(axis=2)
        cluster, distance = assign_block(v, low, high, centres)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        fewer += 12 - len(candidates(low, high, centres))
    assert fewer > 1000


def test_hilbert_curve_moves_one_step():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    path = cells[np.argsort(hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# Language model


def test_gibbs_moves_reach_the_posterior():
    """Two dishes in one restaurant, against the exact distribution of tables."""
    d, s = 0.6, 2.0
    prob, c = np.array([0.3, 0.05]), np.array([5, 4])

    def seatings(n):
        w = {0: 1.0}
        for i in range(n):
            after = defaultdict(float)
            for t, x in w.items():
                after[t + 1] += x
                after[t] += x * (i - t * d)
            w = after
        return w

    weight = {
        (a, b): x * y * prob[0] ** a * prob[1] ** b * math.prod(s + d * k for k in range(1, a + b))
        for a, x in seatings(5).items()
        for b, y in seatings(4).items()
        if a and b
    }
    want = [sum(k[i] * w for k, w in weight.items()) / sum(weight.values()) for i in (0, 1)]
    many, rng = 3000, np.random.default_rng(1)
    cs, ps, own = np.tile(c, many), np.tile(prob, many), np.repeat(np.arange(many), 2)
    t, sizes = restaurants.seat_afresh(cs, s * ps, rng)
    tables = np.bincount(own, weights=t)
    for _ in range(12):
        t, sizes, tables = restaurants.gibbs_moves(cs, t, sizes, own, tables, ps, d, s, rng)
    assert (np.add.reduceat(sizes, np.cumsum(t) - t) == cs).all() and (np.bincount(own, weights=t) == tables).all()
    assert abs(t[::2].mean() - want[0]) < 0.06 and abs(t[1::2].mean() - want[1]) < 0.06


def test_log_gamma():
    x = np.array([0.02, 0.5, 1, 3, 10, 1e3, 1e6])
    assert np.allclose(restaurants.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1)))
def test_packed_numbers(values):
    assert pitman_yor.unpacked(pitman_yor.packed(np.array(values, np.int64))).tolist() == values


class OneByOne:
    """The same model with one customer moved after another, in dictionaries."""

    def __init__(self, texts, rng):
        self.rng, self.seen = rng, [w for t in texts for w in t]
        self.v = len(set(self.seen))
        self.tables = {}  # (restaurant, dish) -> sizes
        self.hyper = {0: (0.5, 1.0), 1: (0.5, 1.0)}
        self.places = [(u, w) for t in texts for u, w in zip([" ", *t], t, strict=False)]
        self.total, self.n_tables = Counter(), Counter()
        for u, w in self.places:
            self.add(u, w)

    def prob(self, u, w):
        d, s = self.hyper[u is not None]
        up = 1 / (self.v + 1) if u is None else self.prob(None, w)
        t = self.tables.get((u, w), [])
        return (sum(t) - d * len(t) + (s + d * self.n_tables[u]) * up) / (s + self.total[u])

    def add(self, u, w):
        d, s = self.hyper[u is not None]
        up = 1 / (self.v + 1) if u is None else self.prob(None, w)
        t = self.tables.setdefault((u, w), [])
        x = self.rng.random() * (sum(t) - d * len(t) + (s + d * self.n_tables[u]) * up)
        self.total[u] += 1
        for i, n in enumerate(t):
            x -= n - d
            if x < 0:
                t[i] += 1
                return
        t.append(1)
        self.n_tables[u] += 1
        if u is not None:
            self.add(None, w)

    def remove(self, u, w):
        t = self.tables[u, w]
        i = self.rng.choices(range(len(t)), t)[0]
        t[i] -= 1
        self.total[u] -= 1
        if not t[i]:
            t.pop(i)
            self.n_tables[u] -= 1
            if u is not None:
                self.remove(None, w)

    def sweep(self, draw):
        for u, w in self.places:
            self.remove(u, w)
            self.add(u, w)
        for level in (0, 1):
            rooms = [u for u in self.total if (u is not None) == bool(level) and self.total[u]]
            sizes = [(float(n), 1.0) for (u, _), t in self.tables.items() if u in rooms for n in t if n > 1]
            self.hyper[level] = restaurants.draw_strength(
                [(float(self.n_tables[u]), 1.0) for u in rooms], [(float(self.total[u]), 1.0) for u in rooms], sizes, draw
            )


@pytest.fixture(scope="module")
def corpus():
    """Texts in which a word tells much about the next one."""
    rng = random.Random(2)
    follow = {w: rng.choices("abcdefghijkl", k=3) for w in "abcdefghijklmnopq"}
    docs = []
    for i in range(160):
        w = [rng.choice("abcdefghijkl")]
        for _ in range(rng.randrange(4, 25)):
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else rng.choice("abcdefghijklmnopq"))
        docs.append((i, " ".join(w)))
    return docs


def lm_rows(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return sorted(language_model_scores(df, unseen, **more).collect(), key=lambda r: (r.doc is None, r.doc or 0, r.n_tokens))


def held_by_hand(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def check_counts(docs, out):
    low = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words_by_hand(t)] + ["\n"]
    counts = Counter(w for i, t in docs if not held_by_hand(i) for w in low(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        ((i, held_by_hand(i), low(t)) for i, t in docs), key=lambda r: (r[0] is None, r[0] or 0, len(r[2]))
    )
    for (i, held, w), r in zip(want, out, strict=True):
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.doc, r.held, r.n_tokens, r.n_known, r.train_tokens) == (i, held, len(w), sum(x in counts for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 1e-6
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


@pytest.mark.parametrize("spread", [False, True])
def test_scores_against_one_by_one(spark, corpus, spread):
    """Partitions and spread contexts, against a plain sampler."""
    more = {"part_tokens": 600, "spread_from": 100} if spread else {}
    out = lm_rows(spark, corpus, samples=6, **more)
    check_counts(corpus, out)
    texts = {i: [*t.split(), "\n"] for i, t in corpus}
    model = OneByOne([t for i, t in texts.items() if not held_by_hand(i)], random.Random(1))
    draw, probs = np.random.default_rng(1), defaultdict(list)
    for turn in range(12):
        model.sweep(draw)
        if turn >= 6:
            for i, t in texts.items():
                probs[i].append([model.prob(u, w) for u, w in zip([" ", *t], t, strict=False)])
    want = {i: float(np.log10(np.mean(p, axis=0)).sum()) for i, p in probs.items()}
    tokens = sum(r.n_tokens for r in out)
    gap = [(r.score - want[r.doc]) / r.n_tokens for r in out]
    assert abs(sum(r.score - want[r.doc] for r in out)) / tokens < 0.02 and max(map(abs, gap)) < 0.12
    unseen = [r for r in out if r.held]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) + 0.1 * sum(r.n_tokens for r in unseen)


def test_probabilities_add_up(spark):
    """What may follow a start or a word: the known words, the end and one
    unknown word. Texts of no, one and two words give all the conditionals."""
    learned, unseen = ([i for i in range(400) if held_by_hand(i) == h] for h in (False, True))
    train = list(zip(learned, ["a b", "b a", "a", "b b a b a"], strict=False))
    tests = ["", *"abz", *[x + " " + y for x in "abz" for y in "abz"]]
    out = lm_rows(spark, train + list(zip(unseen, tests, strict=False)), samples=2)
    score = {t: next(10**r.score for r in out if r.doc == i) for i, t in zip(unseen, tests, strict=False)}
    # With first-word probabilities a: score(x y) / score(y) = a(x) P(y | x) / a(y),
    # and sum over y of P(y | x) + P(end | x) = 1 gives a = M a + score(x).
    ratio = np.array([[score[f"{x} {y}"] / score[y] for y in "abz"] for x in "abz"])
    first = np.linalg.solve(np.eye(3) - ratio, [score[x] for x in "abz"])
    assert (first > 0).all() and abs(first.sum() + score[""] - 1) < 1e-5


def test_scores_odd_rows(spark):
    docs = [(0, None), (0, ""), (2, " \n\t "), (None, "Word word"), (None, None), (3, "x " * 20000), (3, "x " * 20000), (1, "WORD \x1c née")]
    check_counts(docs, lm_rows(spark, docs))
    assert lm_rows(spark, []) == []
    alone = next(i for i in range(99) if held_by_hand(i))
    (only,) = lm_rows(spark, [(alone, "a b")])
    assert only.train_tokens == only.n_known == 0 and only.base_score == 0


# The queries as registered


def test_scores_as_registered(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op11_lm_scoring"](spark, SMALL)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(i for i, _ in docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality_fit_leaves_no_file_per_step(spark):
    """Every step hands its weights over in a broadcast; its file goes with it."""
    import os

    from lagloom.llm import quality

    rows = [(i, f"{'good words here' if i % 2 else 'bad noise there'} {i % 7}", i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    graded = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    folder = spark.sparkContext._temp_dir
    before = len(os.listdir(folder))
    model = quality.fit_grades(docs, graded)
    assert model["grades"] == [0, 1] and np.any(model["weights"])
    assert len(os.listdir(folder)) - before < 10


def test_quality_steps_send_only_the_slots_of_their_rows():
    """The driver gets the sums of a partition for the slots that its rows have,
    not a vector of model size; added up they are the sums over all rows."""
    from types import SimpleNamespace

    from lagloom.llm import quality

    rng = np.random.default_rng(9)
    width, raw = 5_000, np.array([-0.2, 0.1])
    weights = np.where(rng.random(width) < 0.1, rng.normal(size=width), 0.0)
    kept = np.full(1 << quality.BITS, -1, np.int64)
    kept[7 : 7 + width] = np.arange(width)
    nonzero = np.flatnonzero(weights)
    shared = SimpleNamespace(value=[(nonzero, weights[nonzero], raw, out) for out in (0, -1)])
    grades, folds = [0, 1, 2, 1, 2, 0], [0, 1, 0, 2, 1, 0]
    lists = [np.sort(rng.choice(width + 20, 30, replace=False)).astype(np.int32) for _ in grades]
    parts = []
    for at in (slice(0, 4), slice(4, 6)):
        columns = [pa.array(grades[at], pa.int32()), pa.array(folds[at], pa.int32()), pa.array(lists[at], pa.list_(pa.int32()))]
        batch = pa.RecordBatch.from_arrays(columns, names=["grade", "fold", "slots"])
        parts += quality._summed(shared, SimpleNamespace(value=kept))(iter([batch]))
    assert sum(p.nbytes for p in parts) < 10_000
    got = quality._added(pa.Table.from_batches(parts), 2, len(raw), width)

    def by_hand(rows):
        known = [kept[lists[i]][kept[lists[i]] >= 0] for i in rows]
        ends = np.cumsum([0, *map(len, known)])
        return quality.gradient(np.array([grades[i] for i in rows]), ends, np.concatenate(known), weights, raw)

    for fit, out in zip(got, (0, -1), strict=True):
        assert np.allclose(fit[1:], by_hand([i for i in range(6) if folds[i] != out]))
        left_out = [i for i in range(6) if folds[i] == out]
        assert np.isclose(fit[0], by_hand(left_out)[0] if left_out else 0.0)
