"""Packing token streams into fixed-length sequences by minimum bin slack.

Documents are tokenised where they lie and cut into full sequences and one
remainder. Only the histogram of remainder lengths (at most `capacity` - 1
numbers, whatever the corpus) is solved: a bitset of subset sums over the
lengths still in stock finds the multiset that fills a sequence closest to
capacity, the counts are traced back, and the pattern is laid out as many times
as the stock allows. The pieces then find their sequence by length and rank in
a distributed join; no piece passes through the driver."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.bpe import byte_letters
from lagloom.llm.shared import scratch

CAPACITY = 2048
# Fixed value: the pre-tokenizer's published pattern for byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 1

# Token ids by piece of text, per worker; forgotten when full.
_CHUNKS: dict[str, bytes] = {}
_CHUNKS_KEPT = 300_000
_LOADED: dict[str, object] = {}
_FIRST = "\ud800"


def _tokenizer(path: str):
    """The file's tokenizer, a faster encoder of short pieces built from the
    same file, and a pattern of added tokens."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        # Strings of added tokens may span what is split at spaces below.
        added = [a.content for a in t.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in model["vocab"].items()}
        merged = [model["vocab"][a + b] for a, b in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        pieces = tiktoken.Encoding(
            os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        _LOADED[path] = (t, pieces, regex.compile("|".join(map(regex.escape, added))) if added else None)
    return _LOADED[path]


def _whole(t, text: str) -> bytes:
    return np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _parts(chunk: str) -> list[str] | None:
    """Chunks whose ids make up those of `chunk`, or None if white space at an
    edge ties it to its surroundings. The pre-tokenizer sets a single line break
    between other characters, and a full stop or comma after letters, apart."""
    lines = chunk.split("\n")
    out = []
    for i, line in enumerate(lines):
        if not line or line == _FIRST or line[0].isspace() or line[-1].isspace():
            return None
        if i:
            out.append("\n")
            line = _FIRST + line
        if line[-1] in ".," and line[line[0] == _FIRST : -1].isalpha():
            out += [line[:-1], line[-1] + _FIRST]
        else:
            out.append(line)
    return out


def _learn(pieces, fresh: dict[str, None]) -> None:
    """Ids of the chunks in `fresh` where they do not depend on surroundings."""
    known = _CHUNKS
    for chunk in fresh:
        parts = _parts(chunk)
        if parts is None:
            continue
        for p in parts:
            if p not in known:
                text = p if p == "\n" else p.replace(_FIRST, "") if _FIRST in p else " " + p
                known[p] = array("I", pieces(text)).tobytes()
        if len(parts) > 1:
            known[chunk] = b"".join([known[p] for p in parts])


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, as the tokenizer file
    gives them for the whole text.

    The file's pre-tokenizer never joins a character with what stands before a
    single space, so texts are split there and each distinct chunk (with its
    space) is encoded once per worker. Texts where white space runs touch the
    split, or that hold strings of added tokens, are encoded whole."""
    t, pieces, added = _tokenizer(path)
    if len(_CHUNKS) > _CHUNKS_KEPT:
        _CHUNKS.clear()
    split: list[list[str] | None] = []
    fresh: dict[str, None] = {}
    for text in texts:
        if added is not None and added.search(text):
            split.append(None)
            continue
        chunks = text.split(" ")
        # The first chunk has no space before it; the mark occurs in no text.
        chunks[0] = _FIRST + chunks[0]
        split.append(chunks)
        fresh.update(dict.fromkeys(c for c in chunks if c not in _CHUNKS))
    _learn(pieces, fresh)
    out = []
    get = _CHUNKS.__getitem__
    for text, chunks in zip(texts, split, strict=True):
        try:
            out.append(b"".join(map(get, chunks)) if chunks is not None else _whole(t, text))
        except KeyError:
            out.append(_whole(t, text))
    return out


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                owner, start, length, crc, whole, data = [], [], [], [], [], []
                for i, ids in enumerate(encode_texts(path, texts)):
                    ids += end
                    for a in range(0, len(ids), step):
                        piece = ids[a : a + step]
                        owner.append(i)
                        start.append(a // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        whole.append(len(ids) // 4)
                        data.append(piece)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int64()))]
                    + [pa.array(c, pa.int64()) for c in (start, length, crc, whole)]
                    + [pa.array(data, pa.binary())],
                    names=["doc", "start", "length", "crc", "doc_tokens", "ids"],
                )

    return rows


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    doc: str = "doc_id",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """(doc, start, length, crc, doc_tokens, ids): each document's ids and the
    end id, cut every `capacity` ids; ids are packed 32-bit integers. A null or
    empty text is the end id alone."""
    rows = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(
        _pieces(tokenizer, capacity, end_id),
        f"doc {kind}, start long, length long, crc long, doc_tokens long, ids binary",
    )


def fullest(stock: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to `capacity`, counts
    within `stock`.

    Reachable sums are the bits of one integer; each length adds its count in
    binary portions, longest first, and the portions are traced back."""
    window = (1 << (capacity + 1)) - 1
    sums, trail = 1, []
    for size in sorted(stock, reverse=True):
        left = min(stock[size], capacity // size)
        portion = 1
        while left:
            take = min(portion, left)
            trail.append((sums, size, take))
            sums |= (sums << (size * take)) & window
            left -= take
            portion *= 2
        if sums >> capacity:
            break
    best = sums.bit_length() - 1
    counts: dict[int, int] = {}
    for before, size, take in reversed(trail):
        if not before >> best & 1:
            best -= size * take
            counts[size] = counts.get(size, 0) + take
    return counts


def patterns(stock: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, counts by length) until the stock is used up. The longest piece
    left is always placed, the rest fills its slack."""
    stock = dict(stock)
    out = []
    while stock:
        longest = max(stock)
        rest = dict(stock)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        fill = fullest({k: v for k, v in rest.items() if k <= capacity - longest}, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min(stock[k] // v for k, v in fill.items())
        for k, v in fill.items():
            stock[k] -= v * times
            if not stock[k]:
                del stock[k]
        out.append((times, fill))
    return out


def _layout(spark: SparkSession, plan: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """One row per length: arrays of the first rank, copies per sequence, first
    sequence and offset of each pattern that uses it."""
    used: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, counts in plan:
        at = 0
        for size in sorted(counts, reverse=True):
            n = counts[size]
            used.setdefault(size, []).append((taken.get(size, 0), n, sequence, at))
            taken[size] = taken.get(size, 0) + n * times
            at += n * size
        sequence += times
    rows = [(size, *map(list, zip(*parts, strict=True))) for size, parts in used.items()]
    return spark.createDataFrame(
        rows,
        "length long, firsts array<long>, copies array<long>, bases array<long>, offsets array<long>",
    )


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with doc, start, length) and sequence_id, offset. A sequence
    that is padded is filled as closely as the remaining lengths allow; the ids
    of sequences are dense. No pieces give an empty result."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    stock = {r["length"]: r["count"] for r in counts}
    full = stock.pop(capacity, 0)
    layout = _layout(spark, patterns(stock, capacity) + ([(full, {capacity: 1})] if full else []))
    # Ranks inside a length in two levels: a length may hold a third of all rows.
    bucket = F.pmod(F.xxhash64("doc"), F.lit(1024))
    # One column for both keeps an exchange by length alone from serving either.
    cells = pieces.withColumn("_cell", F.col("length") * 1024 + bucket)
    sizes = cells.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_cell").orderBy("doc", "start", "crc")
    ranked = (
        cells.withColumn("_r", F.row_number().over(inside) - 1)
        .join(starts, "_cell")
        .withColumn("_r", F.col("_r") + F.col("_before"))
        .join(F.broadcast(layout), "length")
    )
    # The last pattern that starts at or before the rank.
    i = F.expr("size(filter(firsts, f -> f <= _r)) - 1")
    ranked = ranked.withColumn("_i", i).withColumn("_d", F.expr("_r - firsts[_i]"))
    return ranked.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        F.expr("bases[_i] + _d div copies[_i]").alias("sequence_id"),
        F.expr("offsets[_i] + (_d % copies[_i]) * length").alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    doc: str = "doc_id",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc, start, length, crc, doc_tokens, ids (unless
    `keep_ids` is false), sequence_id, offset. Every id of every document lies
    in one piece; equal ids or repeated rows are packed like any others, other
    columns of `docs` are ignored."""
    pieces = token_pieces(docs, tokenizer, text, doc, capacity, end_id)
    if not keep_ids:
        pieces = pieces.drop("ids")
    return packed(scratch(pieces, "pieces"), capacity)
