"""Quality of documents by ordinal regression on graded ratings.

Grades share one weight per hashed token and differ by ordered thresholds:
P(grade > j) = sigmoid(w.x - t_j). The thresholds stay ordered because their
steps are exponentials. A text gets its expected grade and the probability of
the best grades, which selects documents.

The model is fitted on a bounded sample of rated documents (SAMPLE_DOCS in
expectation, by a hash of the id): each step sums the gradient over the
sample's partitions. A penalty on the size of the weights keeps all but telling
tokens at zero; how strong it is, is chosen by the loss on documents left out of
the fit. Every document is then rated over its whole text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.llm.shared import scratch

SAMPLE_DOCS = 6_000
BITS = 17
STEPS = 120
RATE = 0.3
# Penalties tried, on FOLDS parts of the sample, with fewer steps each.
PENALTIES = (8e-3, 4e-3, 2e-3, 1e-3, 5e-4, 2.5e-4)
FOLDS = 3
TRIAL_STEPS = 60
# Slots seen in fewer rated documents are left out.
LEAST_DOCS = 2
TAIL = 0.5
_PARTS = 4
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_HASHED: dict[str, int] = {}
_HASHED_KEPT = 300_000


def _slot(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) >> (64 - BITS)


def features(text: str | None) -> np.ndarray:
    """Distinct hash slots of the text's tokens (words and runs of symbols, in
    lower case) and of a few shapes: how often the commonest token comes back,
    the share of distinct tokens, of symbols and of digits, each in steps, and
    the length. The slot of the empty token is always there."""
    tokens = _TOKEN.findall((text or "").lower())
    if len(_HASHED) > _HASHED_KEPT:
        _HASHED.clear()
    distinct = set(tokens)
    slots = {_slot("")}
    for t in distinct:
        s = _HASHED.get(t)
        if s is None:
            s = _HASHED[t] = _slot(t)
        slots.add(s)
    n = len(tokens)
    if n:
        counts: dict[str, int] = {}
        for t in tokens:
            counts[t] = counts.get(t, 0) + 1
        shapes = {
            "top": max(counts.values()) / n,
            "distinct": len(distinct) / n,
            "symbols": sum(not t[0].isalnum() for t in tokens) / n,
            "digits": sum(t[0].isdigit() for t in tokens) / n,
        }
        slots.update(_slot(f"\0{k}{round(10 * v)}") for k, v in shapes.items())
    slots.add(_slot(f"\0length{n.bit_length()}"))
    return np.fromiter(slots, dtype=np.int32, count=len(slots))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            slots = [features(t.as_py()) for t in part.column(2)]
            ends = np.cumsum([0, *map(len, slots)]).astype(np.int32)
            flat = np.concatenate(slots) if slots else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["grade", "fold", "slots"])
    _HASHED.clear()


def thresholds(raw: np.ndarray) -> np.ndarray:
    """First threshold and log steps -> ordered thresholds."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gradient(grade: np.ndarray, ends: np.ndarray, slots: np.ndarray, weights, raw) -> np.ndarray:
    """Loss, gradient by weight and by raw threshold, summed over the rows."""
    t = thresholds(raw)
    owner = np.repeat(np.arange(len(grade)), np.diff(ends))
    score = np.bincount(owner, weights=weights[slots], minlength=len(grade))
    # P(grade) is the difference of two sigmoids around the score.
    padded = np.concatenate([[-np.inf], t, [np.inf]])
    low, high = _sigmoid(padded[grade] - score), _sigmoid(padded[grade + 1] - score)
    p = np.maximum(high - low, 1e-12)
    slope_low, slope_high = low * (1 - low), high * (1 - high)
    by_score = (slope_high - slope_low) / p
    by_t = np.zeros(len(t) + 2)
    np.add.at(by_t, grade + 1, -slope_high / p)
    np.add.at(by_t, grade, slope_low / p)
    by_t = by_t[1:-1]
    tail = np.cumsum(by_t[::-1])[::-1]
    by_raw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
    by_weight = np.bincount(slots, weights=by_score[owner], minlength=len(weights))
    return np.concatenate([[-np.log(p).sum()], by_raw, by_weight])


def _summed(shared, places):
    """Sums of loss and gradient of each fit over the rows it learns from, and
    the loss over the rows it leaves out: one row a partition, with the slots
    that its rows have. The gradient is zero in all others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sparse, kept = shared.value, places.value
        width = int(kept.max(initial=-1)) + 1
        fits = []
        for nonzero, values, raw, out in sparse:
            weights = np.zeros(width)
            weights[nonzero] = values
            fits.append((weights, raw, out))
        total, met = None, np.zeros(width, dtype=bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            at = kept[lists.flatten().to_numpy()]
            met[at[at >= 0]] = True
            slots = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            grade, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            got = []
            for weights, raw, out in fits:
                one = []
                for side in (fold != out, fold == out):
                    use = side[slots] & (at >= 0)
                    n = np.bincount(slots[use], minlength=len(grade))[side]
                    ends = np.concatenate([[0], np.cumsum(n)])
                    none = np.zeros(1 + len(raw) + len(weights))
                    one.append(gradient(grade[side], ends, at[use], weights, raw) if side.any() else none)
                got.append(np.concatenate([one[1][:1], one[0]]))
            got = np.stack(got)
            total = got if total is None else total + got
        if total is not None:
            places_met = np.flatnonzero(met).astype(np.int32)
            sums = np.concatenate([total[:, :-width], total[:, -width:][:, places_met]], axis=1) if width else total
            yield pa.RecordBatch.from_arrays(
                [pa.array([places_met.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())],
                names=["slots", "sum"],
            )

    return rows


def _added(parts: pa.Table, fits: int, own: int, width: int) -> np.ndarray:
    """The sums of all partitions, one row a fit: two losses, `own` thresholds,
    `width` weights."""
    head = 2 + own
    total = np.zeros((fits, head + width))
    for slots, sums in zip(parts.column("slots"), parts.column("sum"), strict=True):
        at = np.frombuffer(slots.as_buffer(), np.int32)
        got = np.frombuffer(sums.as_buffer()).reshape(fits, -1)
        total[:, :head] += got[:, :head]
        total[:, head + at] += got[:, head:]
    return total


def _descend(rows: DataFrame, kept: np.ndarray, raw: np.ndarray, folds: list[int], penalties: list[float], steps: int, sizes: dict):
    """Fits with one penalty each, all in the same passes, each without the rows
    of its fold (-1: with all). Returns weights, raw thresholds and the mean loss
    over the fold, per fit."""
    context = rows.sparkSession.sparkContext
    width = int(kept.max(initial=-1)) + 1
    fits = [(np.zeros(width), raw.copy()) for _ in folds]
    seen = [np.full(len(raw) + width, 1e-8) for _ in folds]
    everything = sum(sizes.values())
    places = context.broadcast(kept)
    for step in range(steps + 1):
        # The penalty leaves few weights, so only those travel.
        some = [np.flatnonzero(w) for w, _ in fits]
        shared = context.broadcast([(at, w[at], r, f) for at, (w, r), f in zip(some, fits, folds, strict=True)])
        # At most _PARTS vectors of model size a fit. As Arrow the driver hands
        # them on as they came; rows would be unpacked and pickled there.
        parts = rows.mapInArrow(_summed(shared, places), "slots binary, sum binary").toArrow()
        total = _added(parts, len(fits), len(raw), width)
        del parts
        shared.destroy()  # unpersisting alone leaves a file of every step on the driver's disk
        if step == steps:
            break
        for i, (weights, own) in enumerate(fits):
            slope = total[i, 2:] / (everything - sizes.get(folds[i], 0))
            seen[i] += slope**2
            pace = RATE / np.sqrt(seen[i])
            move = pace * slope
            weights = weights - move[len(own) :]
            # The penalty pulls a weight towards zero and stops there.
            weights = np.sign(weights) * np.maximum(np.abs(weights) - pace[len(own) :] * penalties[i], 0.0)
            fits[i] = (weights, own - move[: len(own)])
    places.destroy()
    losses = [total[i, 0] / max(1, sizes.get(f, 0)) for i, f in enumerate(folds)]
    return fits, losses


def fit_grades(
    docs: DataFrame, graded: DataFrame, text: str = "text", doc: str = "doc_id", sample_docs: int = SAMPLE_DOCS
) -> dict:
    """Weights, thresholds and grades (ascending) from `docs` and their ratings
    `graded` (doc, grade): a model of fixed size.

    Rows with a null grade are left out; of a document rated twice both rows
    count. With fewer than two grades every text is given the only one."""
    rated = graded.where("grade is not null")
    share = sample_docs / max(1, rated.count())
    chance = F.pmod(F.xxhash64(F.lit(11), F.col(f"`{doc}`")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rated.where(chance < share).select(F.col(f"`{doc}`").alias("_q_doc"), "grade")
    sample = docs.join(F.broadcast(chosen), F.col(f"`{doc}`") == F.col("_q_doc"))
    grades = sorted(r[0] for r in chosen.select("grade").distinct().collect())
    model = {"grades": grades, "weights": np.zeros(1 << BITS), "raw": np.zeros(max(0, len(grades) - 1))}
    if len(grades) < 2:
        return model
    index = F.array_position(F.array(*map(F.lit, grades)), F.col("grade")) - 1
    fold = F.pmod(F.xxhash64(F.lit(12), F.col(f"`{doc}`")), F.lit(FOLDS)).cast("int")
    rows = scratch(
        sample.select(index.cast("int").alias("grade"), fold.alias("fold"), F.col(f"`{text}`").alias("text")).mapInArrow(
            _hashed, "grade int, fold int, slots array<int>"
        ),
        "rated",
    ).coalesce(_PARTS)
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    n = sum(sizes.values())
    if not n:
        return model
    # One row per slot in use, at most 2^BITS.
    common = rows.select(F.explode("slots").alias("slot")).groupBy("slot").count().where(F.col("count") >= LEAST_DOCS)
    used = np.sort(np.array([r["slot"] for r in common.select("slot").collect()], np.int64))
    kept = np.full(1 << BITS, -1, np.int64)
    kept[used] = np.arange(len(used))
    counts = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    below = np.cumsum([counts.get(i, 0) for i in range(len(grades) - 1)]) / n
    below = np.clip(below, 1e-3, 1 - 1e-3)
    t = np.log(below / (1 - below))
    raw = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 0.05))])
    trials = [(f, p) for f in range(FOLDS) if sizes.get(f) and sizes[f] < n for p in PENALTIES]
    best = PENALTIES[0]
    if trials:
        _, losses = _descend(rows, kept, raw, [f for f, _ in trials], [p for _, p in trials], TRIAL_STEPS, sizes)
        loss = {p: sum(x * sizes[f] for (f, q), x in zip(trials, losses, strict=True) if q == p) for p in PENALTIES}
        best = min(PENALTIES, key=lambda p: loss[p])
    ((weights, raw),), _ = _descend(rows, kept, raw, [-1], [best], STEPS, sizes)
    model["weights"][used] = weights
    return {"grades": grades, "weights": model["weights"], "raw": raw, "penalty": best}


def _rated(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grades = np.array(model["grades"], dtype=float)
        t = thresholds(model["raw"]) if len(grades) > 1 else np.empty(0)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(part.num_columns - 1)
                score = np.array([model["weights"][features(x.as_py())].sum() for x in texts])
                above = _sigmoid(score[:, None] - t[None, :])
                expected = np.full(len(score), grades[0] if len(grades) else np.nan)
                if len(t):
                    expected = expected + above @ np.diff(grades)
                last = above[:, -1] if len(t) else np.full(len(score), float(len(grades) > 0))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(expected, from_pandas=True), pa.array(last)],
                    names=[*part.schema.names[:-1], "expected_grade", "tail_probability"],
                )
        _HASHED.clear()

    return rows


def rate(docs: DataFrame, model: dict, text: str = "text", tail: float = TAIL) -> DataFrame:
    """All columns of `docs` but `text`; expected_grade, tail_probability (of
    the best grade) and kept (it reaches `tail`).

    A null text is rated like an empty one. Without any rating the expected
    grade is null, the probability 0 and nothing is kept. Columns with the
    names of the result are replaced."""
    made = ("expected_grade", "tail_probability", "kept")
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), *made)]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("expected_grade"))
    schema = rows.drop("expected_grade").schema
    schema = schema.add("expected_grade", "double").add("tail_probability", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_rated(shared), schema).withColumn("kept", F.col("tail_probability") >= tail)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for toxic text, 1 for clean text of low quality, 2 for good text."""
    return F.when(toxic == 1, 0).when(quality == 1, 2).when(quality == 0, 1)
