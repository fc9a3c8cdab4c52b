"""Language-model scores by a hierarchical Pitman-Yor model.

The restaurant of a word's predecessor (or of a text's start) serves the words
that follow it; all of them share one parent, which serves all words and has a
uniform base. A table in a context restaurant is a customer of the parent. The
seating is sampled by Gibbs rounds: contexts given the parent, then the parent
given the contexts, then discount and concentration of both levels. After the
first rounds each round is a sample, and a word's probability is the average of
its predictive probabilities over the samples.

Spark holds everything in partitions that grow in number with the corpus:

- texts become chunks of whole documents (word numbers, sorted word hashes),
- a chunk's words go to the partition of their hash, its distinct pairs of
  neighbouring words to the partition of the first word; contexts with more than
  a quarter of a partition's tokens are spread over several by their second word,
- a partition counts its pairs over all chunks and remembers where each chunk's
  pairs are, so that seatings go back as bare numbers in the chunk's order,
- only pairs seen twice or more have a seating to sample; a pair seen once has
  one table. Words and parent probabilities travel between the levels per round.

The driver sees counts, histograms of bounded size and the frequent contexts, of
which there are at most four per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.llm.restaurants import MOVES, draw_strength, gibbs_moves, histogram, seat_afresh
from lagloom.llm.runs import word_lists
from lagloom.llm.shared import drop_scratch, scratch

# Tokens of a chunk, and tokens per partition of pairs.
CHUNK_TOKENS = 1 << 20
PART_TOKENS = 1 << 21
# Contexts with fewer tokens than this are never spread.
SPREAD_FROM = 1 << 16
BURN_IN = 2
SAMPLES = 3
SEED = 11

# No word: they hold characters that separate words.
_END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
_START = np.uint64(xxhash.xxh64_intdigest(b" "))
_SHORT = np.uint64(16)
_ZSTD = "zstd"


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on as compressed byte planes: small numbers cost little."""
    v = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(v).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec=_ZSTD, asbytes=True)


def unpacked(blob: bytes | None) -> np.ndarray:
    if blob is None:
        return np.empty(0, np.int64)
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    planes = pa.decompress(blob[9:], n * width, codec=_ZSTD, asbytes=True) if n else b""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T if n else 0
    return out.view("<u8").ravel().astype(np.int64)


def _rising(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return packed(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def _risen(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob).view(np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(8)


def _new(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the one before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _runs_of(flags: np.ndarray) -> np.ndarray:
    """Lengths of the stretches that begin at the flags."""
    return np.diff(np.append(np.flatnonzero(flags), len(flags)))


# Chunks


STREAM = (
    "chunk long, docs array<long>, held array<boolean>, lengths binary, tokens binary, hashes binary, counts binary"
)


def _stream(ids: list, held: list, words: list, lengths: list, chunk: int) -> pa.RecordBatch:
    sizes = np.concatenate(lengths)
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    hashes = np.unique(np.append(own, _END))
    tokens = np.full(int(sizes.sum()) + len(sizes), np.searchsorted(hashes, _END), np.int64)
    is_word = np.ones(len(tokens), bool)
    is_word[np.cumsum(sizes + 1) - 1] = False
    if len(own):
        tokens[is_word] = np.searchsorted(hashes, own)[coded.indices.to_numpy(zero_copy_only=False)]
    out_of = pa.concat_arrays(held).to_numpy(zero_copy_only=False)
    learned = np.repeat(~out_of, sizes + 1)
    counts = np.bincount(tokens[learned], minlength=len(hashes))
    values = [
        pa.array([chunk], pa.int64()),
        pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
        pa.array([out_of.tolist()], pa.list_(pa.bool_())),
        *[pa.array([b], pa.binary()) for b in (packed(sizes + 1), packed(tokens), _rising(hashes), packed(counts))],
    ]
    return pa.RecordBatch.from_arrays(values, names=["chunk", "docs", "held", "lengths", "tokens", "hashes", "counts"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, held, text) as chunks, numbered by task and place in it."""
    chunk, parts, n = TaskContext.get().partitionId() << 32, ([], [], [], []), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            words, lengths = word_lists(pc.ascii_lower(part.column(2)))
            for store, x in zip(parts, (part.column(0), part.column(1), words, lengths), strict=True):
                store.append(x)
            n += len(words) + len(lengths)
            if n >= CHUNK_TOKENS:
                yield _stream(*parts, chunk)
                chunk, parts, n = chunk + 1, ([], [], [], []), 0
    if n:
        yield _stream(*parts, chunk)


def _word_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a word, ascending with its hash."""
    return ((hashes >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _slices(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each number of an ascending array with its stretch."""
    if not len(part):
        return
    begins = np.flatnonzero(_new(part))
    for a, b in zip(begins, [*begins[1:], len(part)], strict=True):
        yield int(part[a]), slice(int(a), int(b))


class Pairs:
    """The distinct pairs of neighbouring tokens of a chunk in the order in
    which partitions see them; `of_token` is each token's pair."""

    def __init__(self, tokens, lengths, hashes, learned, parts: int, hot: dict[int, int]):
        firsts = np.cumsum(lengths) - lengths
        key = np.empty(len(tokens), np.int64)
        key[1:] = tokens[:-1]
        key[firsts] = len(hashes)
        key *= len(hashes) + 1
        key += tokens
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = _new(key)
        first = key[new]
        del key
        number = np.cumsum(new, dtype=np.int32) - 1
        counts = np.bincount(number[learned[order]], minlength=len(first))
        short = np.append(hashes, _START) >> _SHORT
        context, word = short[first // (len(hashes) + 1)], short[first % (len(hashes) + 1)]
        spread = np.zeros(len(first), np.uint64)
        for c, n in hot.items():
            mine = context == np.uint64(c)
            spread[mine] = _mix(word[mine]) % np.uint64(n) + np.uint64(1)
        part = (_mix(context + (spread << np.uint64(50))) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        self.part, self.context, self.word, self.counts = (x[by_part] for x in (part, context, word, counts))
        place = np.empty(len(first), np.int32)
        place[by_part] = np.arange(len(first), dtype=np.int32)
        self.of_token = np.empty(len(tokens), np.int32)
        self.of_token[order] = place[number]


def _chunk_rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in batch.to_pylist():
            lengths = unpacked(row["lengths"])
            learned = np.repeat(~np.array(row["held"], bool), lengths)
            yield row, unpacked(row["tokens"]), lengths, _risen(row["hashes"]), learned


def _word_messages(parts: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = _risen(row["hashes"]), unpacked(row["counts"])
                out = [
                    {"q": q, "chunk": row["chunk"], "hashes": _rising(hashes[s]), "counts": packed(counts[s])}
                    for q, s in _slices(_word_part(hashes, parts))
                ]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("q", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    return rows


_ASKS = "asks array<struct<chunk:long,places:binary>>"
WORDS = f"q int, hashes binary, counts binary, n long, v long, {_ASKS}"
_ASK_TYPE = pa.list_(pa.struct([("chunk", pa.int64()), ("places", pa.binary())]))


def _merge_words(key: tuple, rows: pa.Table) -> pa.Table:
    """One partition of the words: counts over all chunks, and where each
    chunk's words are."""
    got = rows.to_pylist()
    each = [_risen(r["hashes"]) for r in got]
    flat = np.concatenate(each)
    order = np.argsort(flat, kind="stable")
    new = _new(flat[order])
    place = np.empty(len(flat), np.int64)
    place[order] = np.cumsum(new) - 1
    counts = np.bincount(place, weights=np.concatenate([unpacked(r["counts"]) for r in got])).astype(np.int64)
    cuts = np.split(place, np.cumsum([len(e) for e in each])[:-1])
    asks = [{"chunk": r["chunk"], "places": _rising(p)} for r, p in zip(got, cuts, strict=True)]
    return pa.table(
        {
            "q": pa.array([int(key[0].as_py())], pa.int32()),
            "hashes": pa.array([_rising(flat[order][new])], pa.binary()),
            "counts": pa.array([packed(counts)], pa.binary()),
            "n": pa.array([int(counts.sum())], pa.int64()),
            "v": pa.array([int((counts > 0).sum())], pa.int64()),
            "asks": pa.array([asks], _ASK_TYPE),
        }
    )


def _frequent(least: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = unpacked(row["counts"])
                some = np.flatnonzero(counts >= least)
                short = _risen(row["hashes"])[some] >> _SHORT
                yield pa.RecordBatch.from_arrays(
                    [pa.array(short.astype(np.int64)), pa.array(counts[some])], names=["context", "n"]
                )

    return rows


# Contexts


_PAIR_SCHEMA = pa.schema(
    [("p", pa.int32()), ("chunk", pa.int64())] + [(c, pa.binary()) for c in ("contexts", "sizes", "words", "counts")]
)


def _pair_messages(parts: int, hot: dict[int, int]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, tokens, lengths, hashes, learned in _chunk_rows(batches):
            pairs = Pairs(tokens, lengths, hashes, learned, parts, hot)
            out = []
            for p, s in _slices(pairs.part):
                context = pairs.context[s]
                new = _new(context)
                out.append(
                    {
                        "p": p,
                        "chunk": row["chunk"],
                        # Ascending but for a text's start, which wraps around.
                        "contexts": _rising(context[new]),
                        "sizes": packed(_runs_of(new)),
                        "words": packed(pairs.word[s]),
                        "counts": packed(pairs.counts[s]),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, _PAIR_SCHEMA)

    return rows


_MESSAGES = "array<struct<q:int,words:binary,t:binary>>"
_MESSAGE_TYPE = pa.list_(pa.struct([("q", pa.int32()), ("words", pa.binary()), ("t", pa.binary())]))
# sizes, counts: of all pairs by context. place: the pairs seen more than once,
# where: the second word of each among their distinct words. once, often: for the
# parent, the words of the pairs seen once and their number, and the distinct
# words of the others.
PAIRS = (
    f"p int, sizes binary, counts binary, frequent_at array<int>, frequent array<long>, {_ASKS}, "
    f"once {_MESSAGES}, often {_MESSAGES}, place binary, where binary"
)


def _messages(words: np.ndarray, numbers: np.ndarray, parts: int) -> list[dict]:
    """Ascending words with a number each, cut by the parent's partitions."""
    part = _word_part(words.astype(np.uint64) << _SHORT, parts)
    return [{"q": q, "words": _rising(words[s]), "t": packed(numbers[s])} for q, s in _slices(part)]


def _merge_pairs(parts: int, hot: dict[int, int]) -> Callable:
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        words = [unpacked(r["words"]) for r in got]
        context = np.concatenate(
            [np.repeat(_risen(r["contexts"]).astype(np.int64), unpacked(r["sizes"])) for r in got]
        )
        word = np.concatenate(words)
        order = np.lexsort((word, context))
        new = _new(context[order], word[order])
        place = np.empty(len(word), np.int64)
        place[order] = np.cumsum(new) - 1
        counts = np.bincount(place, weights=np.concatenate([unpacked(r["counts"]) for r in got])).astype(np.int64)
        context, word = context[order][new], word[order][new]
        first = _new(context)
        names = context[first]
        frequent = np.flatnonzero(np.isin(names, np.array(list(hot), np.int64)))
        often = np.flatnonzero(counts > 1)
        distinct, where = np.unique(word[often], return_inverse=True)
        once = np.unique(word[counts == 1], return_counts=True)
        cuts = np.split(place, np.cumsum([len(w) for w in words])[:-1])
        # A chunk's pairs ascend here but for a text's start: keep them as they are.
        asks = [{"chunk": r["chunk"], "places": packed(np.diff(c, prepend=0) + len(word))} for r, c in zip(got, cuts, strict=True)]
        return pa.table(
            {
                "p": pa.array([int(key[0].as_py())], pa.int32()),
                "sizes": pa.array([packed(_runs_of(first))], pa.binary()),
                "counts": pa.array([packed(counts)], pa.binary()),
                "frequent_at": pa.array([frequent.tolist()], pa.list_(pa.int32())),
                "frequent": pa.array([names[frequent].tolist()], pa.list_(pa.int64())),
                "asks": pa.array([asks], _ASK_TYPE),
                "once": pa.array([_messages(*once, parts)], _MESSAGE_TYPE),
                "often": pa.array([_messages(distinct, np.zeros(len(distinct)), parts)], _MESSAGE_TYPE),
                "place": pa.array([_rising(often)], pa.binary()),
                "where": pa.array([packed(where)], pa.binary()),
            }
        )

    return merge


_HIST = "hist array<struct<kind:string,bin:long,n:long,s:long>>"
_HIST_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("bin", pa.int64()), ("n", pa.int64()), ("s", pa.int64())]))
_FIXED = ["c", "context", "where", "single", "total"]
_STATE_NAMES = ["p", *_FIXED, "frequent_at", "frequent", "cuts", "t", "sizes", "samples", "messages", "hist"]
_STATE_NAMES += ["frequent_t", "tables"]
_NUMBERS = "array<struct<q:int,t:binary>>"
_SAMPLE = pa.struct([("t", pa.binary()), ("tables", pa.binary())])
# c, t, sizes, context, where: of the pairs seen more than once; single, total:
# pairs seen once and customers of each context. cuts: words by parent partition.
STATE = (
    "p int, c binary, context binary, where binary, single binary, total binary, frequent_at array<int>, "
    "frequent array<long>, cuts array<struct<q:int,n:int>>, t binary, sizes binary, "
    f"samples array<struct<t:binary,tables:binary>>, messages {_NUMBERS}, {_HIST}, frequent_t array<long>, tables long"
)


def _hist_rows(kind: str, values: np.ndarray) -> list[dict]:
    values = values[values > 0]
    return [
        {"kind": kind, "bin": int(b), "n": int(n), "s": int(s)} for b, n, s in zip(*histogram(values), strict=True)
    ]


def _state_row(x: dict) -> pa.RecordBatch:
    """A partition of contexts after a round, as a row."""
    local = np.ones(len(x["total"]), bool)
    local[x["frequent_at"]] = False
    tables = x["all_tables"]
    hist = _hist_rows("tables", tables[local]) + _hist_rows("customers", x["total"][local])
    hist += _hist_rows("sizes", x["sizes"][x["sizes"] > 1])
    row = {c: packed(x[c]) for c in (*_FIXED, "t", "sizes")}
    row |= {c: x[c] for c in ("p", "frequent_at", "frequent", "cuts", "samples")}
    numbers = np.bincount(x["where"], weights=x["t"], minlength=sum(c["n"] for c in x["cuts"])).astype(np.int64)
    row["messages"], at = [], 0
    for c in x["cuts"]:
        row["messages"].append({"q": c["q"], "t": packed(numbers[at : at + c["n"]])})
        at += c["n"]
    row |= {
        "hist": hist,
        "frequent_t": tables[x["frequent_at"]].astype(np.int64).tolist(),
        "tables": int(tables.sum()),
    }
    kinds = {"p": pa.int32(), "frequent_at": pa.list_(pa.int32()), "frequent": pa.list_(pa.int64())}
    kinds |= {"cuts": pa.list_(pa.struct([("q", pa.int32()), ("n", pa.int32())])), "samples": pa.list_(_SAMPLE)}
    kinds |= {"messages": pa.list_(pa.struct([("q", pa.int32()), ("t", pa.binary())])), "hist": _HIST_TYPE}
    kinds |= {"frequent_t": pa.list_(pa.int64()), "tables": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [pa.array([row[c]], kinds.get(c, pa.binary())) for c in _STATE_NAMES], names=_STATE_NAMES
    )


def _first_state(hot_counts: dict[int, int]) -> Callable:
    """One table per pair, before the first round."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts, place = unpacked(r["counts"]), _risen(r["place"]).astype(np.int64)
                owner = np.repeat(np.arange(len(unpacked(r["sizes"]))), unpacked(r["sizes"]))
                n = int(owner[-1]) + 1 if len(owner) else 0
                total = np.bincount(owner, weights=counts, minlength=n).astype(np.int64)
                total[r["frequent_at"]] = [hot_counts[c] for c in r["frequent"]]
                single = np.bincount(owner[counts == 1], minlength=n)
                c, context = counts[place], owner[place]
                x = {
                    "p": r["p"], "c": c, "context": context, "where": unpacked(r["where"]), "single": single,
                    "total": total, "frequent_at": r["frequent_at"], "frequent": r["frequent"],
                    "cuts": [{"q": m["q"], "n": len(unpacked(m["t"]))} for m in r["often"]],
                    "t": np.ones(len(c), np.int64), "sizes": c, "samples": [],
                    "all_tables": single + np.bincount(context, minlength=n),
                }
                yield _state_row(x)

    return rows


def _context_round(level: dict, parent: dict, hot_tables: dict[int, int], turn: int, first: bool, sample: bool):
    """Seats the customers of the contexts of a partition once more."""
    d, strength = level["d"], level["s"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = {c: unpacked(r[c]) for c in (*_FIXED, "t", "sizes")}
                x |= {c: r[c] for c in ("p", "frequent_at", "frequent", "cuts", "samples")}
                # Answers come by partition of the parent, in the order of the words.
                told = sorted(r["answers"] or [], key=lambda a: a["q"])
                customers, seats = (
                    np.concatenate([np.empty(0, np.int64), *[unpacked(a[k]) for a in told]]) for k in ("c", "t")
                )
                prob = _probability(customers, seats, parent)[x["where"]]
                rng = np.random.default_rng([SEED, turn, r["p"]])
                n = len(x["total"])
                tables = x["single"] + np.bincount(x["context"], weights=x["t"], minlength=n)
                # Tables of a spread context in other partitions, as of the last round.
                others = np.zeros(n)
                others[r["frequent_at"]] = [hot_tables.get(c, 0) for c in r["frequent"]]
                others[r["frequent_at"]] -= tables[r["frequent_at"]] if hot_tables else 0
                tables = tables + np.maximum(others, 0)
                x["t"], x["sizes"], tables = seat_round(
                    x["c"], x["t"], x["sizes"], x["context"], tables, prob, d, strength, rng, first
                )
                x["all_tables"] = tables - np.maximum(others, 0)
                if sample:
                    seen = {"t": packed(x["t"]), "tables": packed(np.rint(tables))}
                    x["samples"] = [*x["samples"], seen]
                yield _state_row(x)

    return rows


def seat_round(c, t, sizes, restaurant, tables, prob, d, strength, rng, first: bool):
    """Seats dishes too large for single moves (in the first round all) anew,
    then moves customers of all dishes."""
    anew = np.ones(len(c), bool) if first else c > MOVES
    if anew.any():
        mass = (strength + d * tables[restaurant[anew]]) * prob[anew]
        own_t, own_sizes = seat_afresh(c[anew], mass, rng)
        owner = np.repeat(np.arange(len(c)), t)
        stay = ~anew[owner]
        whose = np.concatenate([owner[stay], np.repeat(np.flatnonzero(anew), own_t)])
        sizes = np.concatenate([sizes[stay], own_sizes])[np.argsort(whose, kind="stable")]
        tables = tables - np.bincount(restaurant, weights=t, minlength=len(tables))
        t = np.bincount(whose, minlength=len(c))
        tables = tables + np.bincount(restaurant, weights=t, minlength=len(tables))
    return gibbs_moves(c, t, sizes, restaurant, tables, prob, d, strength, rng)


# The parent


def _probability(customers: np.ndarray, tables: np.ndarray, parent: dict) -> np.ndarray:
    """Predictive probability in the parent of words with so many customers and
    tables there."""
    base = (parent["s"] + parent["d"] * parent["tables"]) / (parent["v"] + 1)
    return (customers - parent["d"] * tables + base) / (parent["s"] + parent["customers"])


_ANSWERS = "array<struct<p:int,c:binary,t:binary>>"
_ANSWER_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("c", pa.binary()), ("t", pa.binary())]))
_ASKED_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("places", pa.binary())]))
_SEAT = pa.struct([("c", pa.binary()), ("t", pa.binary())])
# asked: which words the pairs of each context partition have.
PARENT = (
    "q int, words binary, once binary, asked array<struct<p:int,places:binary>>, "
    f"samples array<struct<c:binary,t:binary>>, answers {_ANSWERS}, {_HIST}, tables long, customers long"
)


def _parent_row(q, words, once, asked, samples, answers, t, sizes, customers) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([q], pa.int32()),
            pa.array([_rising(words)], pa.binary()),
            pa.array([packed(once)], pa.binary()),
            pa.array([asked], _ASKED_TYPE),
            pa.array([samples], pa.list_(_SEAT)),
            pa.array([answers], _ANSWER_TYPE),
            pa.array([_hist_rows("sizes", sizes[sizes > 1])], _HIST_TYPE),
            pa.array([int(t.sum())], pa.int64()),
            pa.array([int(customers.sum())], pa.int64()),
        ],
        names=["q", "words", "once", "asked", "samples", "answers", "hist", "tables", "customers"],
    )


def _parent_round(parent: dict, turn: int, sample: bool, first: bool) -> Callable:
    """Seats the parent's customers of a partition of words anew."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if first:
                    words = _risen(r["hashes"])[unpacked(r["counts"]) > 0] >> _SHORT
                    # Words alike in the short hash are one here.
                    words = np.unique(words)
                    once, samples = np.zeros(len(words), np.int64), []
                    for m in r["static"] or []:
                        once[np.searchsorted(words, _risen(m["words"]))] += unpacked(m["t"])
                    asked = [
                        {"p": m["p"], "places": _rising(np.searchsorted(words, _risen(m["words"])))}
                        for m in r["often"] or []
                    ]
                else:
                    words, once, samples, asked = _risen(r["words"]), unpacked(r["once"]), r["samples"], r["asked"]
                at = {a["p"]: _risen(a["places"]).astype(np.int64) for a in asked}
                customers = once.copy()
                for m in r["told"] or []:
                    customers[at[m["p"]]] += unpacked(m["t"])
                rng = np.random.default_rng([SEED + 1, turn, r["q"]])
                prob = np.full(len(words), 1.0 / (parent["v"] + 1))
                whole = np.array([parent["tables"]], float)
                one = np.zeros(len(words), np.int64)
                mass = (parent["s"] + parent["d"] * whole[0]) * prob
                t, sizes = seat_afresh(customers, mass, rng)
                t, sizes, _ = gibbs_moves(customers, t, sizes, one, whole, prob, parent["d"], parent["s"], rng)
                if sample:
                    samples = [*samples, {"c": packed(customers), "t": packed(t)}]
                answers = [{"p": p, "c": packed(customers[w]), "t": packed(t[w])} for p, w in at.items()]
                yield _parent_row(r["q"], words, once, asked, samples, answers, t, sizes, customers)

    return rows


# Rounds and scores


def _gathered(rows: DataFrame, by: str, column: str, own: str, fields: list[str], name: str) -> DataFrame:
    """Messages in the array `column` of rows keyed by `own`, gathered by their
    receiver `by`."""
    sent = rows.select(F.col(own), F.explode(column).alias("m")).select(
        F.col(f"m.{by}").alias(by), F.struct(F.col(own), *[F.col(f"m.{f}").alias(f) for f in fields]).alias("m")
    )
    return sent.groupBy(by).agg(F.collect_list("m").alias(name))


def _levels(rows: DataFrame) -> dict[str, list[tuple[float, float]]]:
    """Histograms over all partitions as (mean value, number)."""
    out: dict[str, list[tuple[float, float]]] = {"tables": [], "customers": [], "sizes": []}
    cells = rows.select(F.explode("hist").alias("h")).select("h.*").groupBy("kind", "bin")
    for r in cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("kind", "bin").collect():
        out[r["kind"]].append((r["s"] / r["n"], float(r["n"])))
    return out


def _totals(rows: DataFrame, *columns: str) -> list[int]:
    return [int(x or 0) for x in rows.agg(*[F.sum(c) for c in columns]).first()]


def _context_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and partition: customers and, per sample, tables of each pair;
    then the same of each context."""
    for batch in batches:
        for r in batch.to_pylist():
            counts, sizes = unpacked(r["counts"]), unpacked(r["sizes"])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total, place = unpacked(r["total"]), _risen(r["place"]).astype(np.int64)
            tables = [unpacked(x["tables"]) for x in r["samples"]]
            seated = []
            for x in r["samples"]:
                t = np.minimum(counts, 1)
                t[place] = unpacked(x["t"])
                seated.append(t)
            for ask in r["asks"]:
                at = np.cumsum(unpacked(ask["places"]) - len(counts))
                mine = owner[at]
                mine = mine[_new(mine)]
                own = [x[at] for x in (counts, *seated)] + [x[mine] for x in (total, *tables)]
                yield _answer(ask["chunk"], 0, r["p"], own)


_ANSWER_SCHEMA = "chunk long, level int, part int, numbers array<binary>"


def _answer(chunk: int, level: int, part: int, numbers: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()))
    values = (chunk, level, part, [packed(x) for x in numbers])
    return pa.RecordBatch.from_arrays(
        [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["chunk", "level", "part", "numbers"]
    )


def _word_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and partition: the count of each word and, per sample, its
    customers and tables in the parent."""
    for batch in batches:
        for r in batch.to_pylist():
            hashes, counts, known = _risen(r["hashes"]) >> _SHORT, unpacked(r["counts"]), _risen(r["words"])
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            seen = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            numbers = [counts]
            for x in r["samples"]:
                for k in ("c", "t"):
                    values = np.zeros(len(hashes), np.int64)
                    values[seen] = unpacked(x[k])[at[seen]]
                    numbers.append(values)
            for ask in r["asks"]:
                mine = _risen(ask["places"]).astype(np.int64)
                yield _answer(ask["chunk"], 1, r["q"], [x[mine] for x in numbers])


SCORES = "doc long, held boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(parts: int, hot: dict[int, int], n: int, v: int, levels: list[dict], parents: list[dict]) -> Callable:
    s = len(levels)

    def score(key: tuple, streams: pa.Table, answers: pa.Table) -> pa.Table:
        got = sorted(answers.to_pylist(), key=lambda r: (r["level"], r["part"]))

        def numbers(level: int, i: int) -> np.ndarray:
            return np.concatenate([unpacked(r["numbers"][i]) for r in got if r["level"] == level])

        out = []
        for row, tokens, lengths, hashes, learned in _chunk_rows(streams.to_batches()):
            pairs = Pairs(tokens, lengths, hashes, learned, parts, hot)
            context = np.cumsum(_new(pairs.part, pairs.context), dtype=np.int32) - 1
            context, of_token = context[pairs.of_token], pairs.of_token
            del pairs
            c, total, p = numbers(0, 0), numbers(0, 1 + s), np.zeros(len(tokens))
            for i, (level, parent) in enumerate(zip(levels, parents, strict=True)):
                seated = c - level["d"] * numbers(0, 1 + i)
                left = level["s"] + level["d"] * numbers(0, 2 + s + i)
                up = _probability(numbers(1, 1 + 2 * i), numbers(1, 2 + 2 * i), parent)
                p += (seated[of_token] + left[context] * up[tokens]) / (level["s"] + total[context])
            counts = numbers(1, 0)
            base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
            firsts = np.cumsum(lengths) - lengths
            out.append(
                [
                    pa.array(row["docs"], pa.int64()),
                    pa.array(row["held"], pa.bool_()),
                    pa.array(lengths, pa.int64()),
                    pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), firsts)),
                    pa.array(np.add.reduceat(base[tokens], firsts)),
                    pa.array(np.add.reduceat(np.log10(p / s), firsts)),
                ]
            )
        names = ["doc", "held", "n_tokens", "n_known", "base_score", "score"]
        return pa.concat_tables([pa.table(dict(zip(names, o, strict=True))) for o in out])

    return score


def language_model_scores(
    docs: DataFrame,
    held_out: Column,
    text: str = "text",
    doc: str = "doc_id",
    burn_in: int = BURN_IN,
    samples: int = SAMPLES,
    part_tokens: int = PART_TOKENS,
    spread_from: int = SPREAD_FROM,
) -> DataFrame:
    """One row per row of `docs`: doc, held (not learned from), n_tokens (words
    and one end), n_known (seen in training), base_score (unigram log10, 0.5
    added), score (log10 probability under the sampled model), train_tokens and
    perplexity (of the text, by score).

    Words are separated by blanks, A to Z lower-cased. A null, empty or blank
    text is its end alone. Rows are learned and scored one by one, so repeated
    rows and ids count as often as they appear; null ids are allowed. Without a
    row to learn from, every word has probability 1 / (0 + 1). Other columns
    are ignored. An empty table gives an empty result. 48 bits of a word's hash
    tell words apart inside a context; counts use 64."""
    streams = scratch(
        docs.select(
            F.col(f"`{doc}`").cast("long").alias("doc"),
            F.coalesce(held_out, F.lit(False)).alias("held"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).mapInArrow(_streams, STREAM),
        "lm-streams",
    )
    rows, size = streams.agg(F.count("*"), F.sum(F.length("hashes"))).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], SCORES + ", train_tokens long, perplexity double")
    sent = streams.select("chunk", "hashes", "counts")
    # About 6 bytes a word of a chunk.
    word_parts = int(size) // (6 * part_tokens // 2) + 1
    words = scratch(
        sent.mapInArrow(_word_messages(word_parts), "q int, chunk long, hashes binary, counts binary")
        .groupBy("q")
        .applyInArrow(_merge_words, WORDS),
        "lm-words",
    )
    n, v = _totals(words, "n", "v")
    learned_docs = streams.select(F.explode("held").alias("h")).where("not h").count()
    parts = max(1, -(-n // part_tokens))
    least = max(n // (4 * parts), spread_from)
    seen = words.mapInArrow(_frequent(least), "context long, n long").collect()
    hot_counts = {r["context"]: r["n"] for r in seen if np.uint64(r["context"]) != _END >> _SHORT}
    if learned_docs >= least:
        hot_counts[int(_START >> _SHORT)] = learned_docs
    hot = {c: -(-k // least) for c, k in hot_counts.items()}
    pairs = scratch(
        streams.mapInArrow(
            _pair_messages(parts, hot), "p int, chunk long, contexts binary, sizes binary, words binary, counts binary"
        )
        .groupBy("p")
        .applyInArrow(_merge_pairs(word_parts, hot), PAIRS),
        "lm-pairs",
    )
    state = scratch(
        pairs.select("p", "sizes", "counts", "frequent_at", "frequent", "often", "place", "where").mapInArrow(
            _first_state(hot_counts), STATE
        ),
        "lm-contexts",
    )
    told = _gathered(state, "q", "messages", "p", ["t"], "told")
    often = _gathered(pairs, "q", "often", "p", ["words"], "often")
    static = _gathered(pairs, "q", "once", "p", ["words", "t"], "static")
    level = {"d": 0.5, "s": 1.0}
    parent = {"d": 0.5, "s": 1.0, "v": v, "tables": v, "customers": _totals(state, "tables")[0]}
    known = words.select("q", "hashes", "counts").join(static, "q", "left").join(often, "q", "left").join(told, "q", "left")
    top = scratch(known.mapInArrow(_parent_round(parent, 0, False, True), PARENT), "lm-parent")
    parent["tables"] = _totals(top, "tables")[0]
    rng = np.random.default_rng(SEED)
    levels, parents, hot_tables = [], [], {}
    for turn in range(1, burn_in + samples + 1):
        sample = turn > burn_in
        answers = _gathered(top, "p", "answers", "q", ["c", "t"], "answers")
        after = scratch(
            state.drop("messages", "hist", "frequent_t", "tables")
            .join(answers, "p", "left")
            .mapInArrow(_context_round(dict(level), dict(parent), hot_tables, turn, turn == 1, sample), STATE),
            "lm-contexts",
        )
        drop_scratch(state)
        state = after
        if sample:
            levels.append(dict(level))
        hot_tables = {
            r["c"]: r["t"]
            for r in state.select(F.explode(F.arrays_zip("frequent", "frequent_t")).alias("x"))
            .groupBy(F.col("x.frequent").alias("c"))
            .agg(F.sum("x.frequent_t").alias("t"))
            .collect()
        }
        seats = _levels(state)
        spread = [(float(t), 1.0) for t in hot_tables.values()]
        crowd = [(float(hot_counts[c]), 1.0) for c in hot_tables]
        level["d"], level["s"] = draw_strength(
            seats["tables"] + spread, seats["customers"] + crowd, seats["sizes"], rng
        )
        parent["customers"] = _totals(state, "tables")[0]
        told = _gathered(state, "q", "messages", "p", ["t"], "told")
        after = scratch(
            top.drop("answers", "hist", "tables", "customers")
            .join(told, "q", "left")
            .mapInArrow(_parent_round(dict(parent), turn, sample, False), PARENT),
            "lm-parent",
        )
        drop_scratch(top)
        top = after
        parent["tables"] = _totals(top, "tables")[0]
        if sample:
            parents.append(dict(parent))
        parent["d"], parent["s"] = draw_strength(
            [(float(parent["tables"]), 1.0)], [(float(parent["customers"]), 1.0)], _levels(top)["sizes"], rng
        )
    from_contexts = (
        pairs.select("p", "sizes", "counts", "asks", "place")
        .join(state.select("p", "total", "samples"), "p")
        .mapInArrow(_context_answers, _ANSWER_SCHEMA)
    )
    from_words = (
        words.select("q", "hashes", "counts", "asks")
        .join(top.select("q", "words", "samples"), "q")
        .mapInArrow(_word_answers, _ANSWER_SCHEMA)
    )
    scored = (
        streams.drop("counts")
        .groupBy("chunk")
        .cogroup(from_contexts.unionByName(from_words).groupBy("chunk"))
        .applyInArrow(_scores(parts, hot, n, v, levels, parents), SCORES)
    )
    return scored.select(
        "*", F.lit(n).cast("long").alias("train_tokens"), F.expr("pow(10, -score / n_tokens)").alias("perplexity")
    )
