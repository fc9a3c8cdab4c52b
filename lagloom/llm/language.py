"""Language identification by words first, characters as the fallback.

The model holds the frequency of words and of character n-grams by language.
A known word scores its log frequency in every language; an unseen word backs
off to the longest order of character n-grams of which it has a known one. The
scores of all words of a text add up; the winner's share is the confidence.

Statistics come from a bounded sample of labelled documents (SAMPLE_DOCS per
language in expectation, chosen by a hash of the id) and the model keeps the
MODEL_ROWS most frequent words and n-grams: it has one size for any corpus. It
is held as sorted 64-bit hashes beside a matrix of log frequencies. Every
document is then scored over its whole text, a thousand texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lagloom.llm.shared import scratch, small_side

SAMPLE_DOCS = 4_000
MODEL_ROWS = 400_000
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
_SMOOTH = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = "_"
# Fixed value: the seed of Spark's xxhash64.
_SEED = 42


def _hashes(tokens: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t.encode("utf-8", "surrogatepass"), _SEED) for t in tokens), np.uint64, len(tokens))


def held_out(doc: Column) -> Column:
    """The documents that no model learns from: one in four, by id."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch, already counted."""
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in _WORD.findall((text or "").lower()):
                counts[lang, w] = counts.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.string()),
                pa.array([k[1] for k in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            names=["lang", "word", "n"],
        )


def training_sample(
    docs: DataFrame, text: str, lang: str, doc: str, sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """(lang, text) of labelled documents that are not held out; about
    `sample_docs` of each language, all if there are fewer."""
    rows = docs.select(
        F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    ).where(F.col("lang").isNotNull() & ~held_out(F.col("doc")))
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), sample_docs / F.count("*")).alias("share"))
    chance = F.pmod(F.xxhash64(F.lit(5), "doc"), F.lit(1 << 20)) / float(1 << 20)
    # One row per language: a join that moved the texts would meet one hot key.
    shares = small_side(scratch(shares, "language-shares"), 100)
    return rows.join(shares, "lang").where(chance < F.col("share")).select("lang", "text")


def learn(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS,
    model_rows: int = MODEL_ROWS,
) -> dict:
    """The model: languages, log frequencies by word and by n-gram. Its size is
    bounded by `model_rows` words and as many n-grams of each order."""
    words = (
        training_sample(docs, text, lang, doc, sample_docs)
        .mapInArrow(_words, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .persist()
    )
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    model: dict = {"langs": langs, "words": None, "grams": []}
    if langs:
        model["words"] = _frequencies(words.select("lang", F.col("word").alias("token"), "n"), langs, model_rows)
        edged = F.concat(F.lit(_EDGE), "word", F.lit(_EDGE))
        for order in ORDERS:
            grams = words.where(F.length(edged) >= order).select(
                "lang",
                "n",
                F.explode(
                    F.transform(
                        F.sequence(F.lit(1), F.length(edged) - order + 1),
                        lambda i: F.substring(F.concat(F.lit(_EDGE), F.col("word"), F.lit(_EDGE)), i, F.lit(order)),
                    )
                ).alias("token"),
            )
            grams = grams.groupBy("lang", "token").agg(F.sum("n").alias("n"))
            model["grams"].append(_frequencies(grams, langs, model_rows))
    words.unpersist()
    return model


def _frequencies(counts: DataFrame, langs: list[str], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes, and rows of log frequencies by language, of the `rows`
    most frequent tokens."""
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    top = (
        counts.groupBy(F.xxhash64("token").alias("token"))
        .agg(
            F.sum("n").alias("all"),
            *[F.sum(F.when(F.col("lang") == v, F.col("n"))).alias(f"l{i}") for i, v in enumerate(langs)],
        )
        .orderBy(F.desc("all"), "token")
        .limit(rows)
        .drop("all")
        .toArrow()
    )
    hashes = top.column("token").to_numpy().view(np.uint64)
    table = np.stack(
        [np.nan_to_num(top.column(f"l{i}").to_numpy().astype(float)) for i in range(len(langs))], axis=1
    )
    size = np.array([totals.get(v, 0) for v in langs]) + _SMOOTH * max(1, len(table))
    order = np.argsort(hashes)
    known = hashes[order], np.log((table[order] + _SMOOTH) / size).astype(np.float32)
    # The driver keeps the model only, not the buffers it came in.
    del top, hashes, table
    pa.default_memory_pool().release_unused()
    return known


def _found(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes among the known ones, -1 where unknown."""
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return np.where(known[at] == hashes, at, -1) if len(known) else np.full(len(hashes), -1)


def word_scores(model: dict, words: list[str]) -> np.ndarray:
    """A row of log frequencies per word: its own if it is known, else the mean
    over its known character n-grams of the longest order that has any."""
    out = np.zeros((len(words), len(model["langs"])), np.float32)
    known, logs = model["words"]
    at = _found(known, _hashes(words))
    out[at >= 0] = logs[at[at >= 0]]
    left = np.flatnonzero(at < 0)
    for order, (known, logs) in zip(ORDERS, model["grams"], strict=True):
        if not len(left):
            break
        edged = [f"{_EDGE}{words[i]}{_EDGE}" for i in left]
        grams = [[w[i : i + order] for i in range(len(w) - order + 1)] for w in edged]
        owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
        at = _found(known, _hashes(list(chain.from_iterable(grams))))
        owner, at = owner[at >= 0], at[at >= 0]
        n = np.bincount(owner, minlength=len(left))
        sums = np.stack([np.bincount(owner, weights=x, minlength=len(left)) for x in logs[at].T], axis=1)
        some = n > 0
        out[left[some]] = sums[some] / n[some, None]
        left = left[~some]
    return out


def score_texts(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and share of the winner for each text. Without letters or
    without a model: `und`, 0. Ties go to the first language in alphabetical
    order."""
    langs = model["langs"]
    names, shares = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not langs:
        return names, shares
    found = [_WORD.findall((t or "").lower()) for t in texts]
    place: dict[str, int] = {}
    for words in found:
        for w in words:
            place.setdefault(w, len(place))
    if not place:
        return names, shares
    scores = word_scores(model, list(place))
    for i, words in enumerate(found):
        if words:
            rows = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            total = scores[rows].sum(axis=0, dtype=float)
            best = int(np.argmax(total))
            names[i], shares[i] = langs[best], 1.0 / np.exp(total - total[best]).sum()
    return names, shares


_SCORED = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def _score(shared):
    """Language and score of each text; the texts themselves do not come back."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            names, shares = [], []
            for at in range(0, len(batch), 500):
                n, s = score_texts(model, batch.slice(at, 500).to_pylist())
                names += n
                shares.append(s)
            values = [pa.array(names, pa.string()), pa.array(np.concatenate([np.empty(0), *shares]))]
            yield pa.StructArray.from_arrays(values, names=["lang_pred", "score"])

    # Called once per row: Spark must not repeat it where its fields are used.
    return F.arrow_udf(scored, _SCORED).asNondeterministic()


def predict(docs: DataFrame, model: dict, text: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of `docs`, with the text only on demand, and lang_pred and
    score (0 to 1).

    A text that is null or without a letter is `und` with score 0; so is every
    text if nothing was learned. Columns named lang_pred or score are replaced.
    The text goes to the workers once and does not come back."""
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "lang_pred", "score")]
    score = _score(docs.sparkSession.sparkContext.broadcast(model))
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))
    kept = [*rest, text] if keep_text else rest
    return rows.withColumn("_ll_p", score(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in kept], "_ll_p.lang_pred", "_ll_p.score"
    )
