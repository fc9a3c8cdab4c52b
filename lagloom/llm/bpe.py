"""BPE encoding and decoding with a word-level vocabulary file.

A word's symbols are a doubly linked list; adjacent pairs with a merge rank sit
in a priority queue by (rank, position). The best pair is merged, its
neighbours queue up again, and entries whose symbols changed meanwhile are
skipped as stale. Decoding concatenates vocabulary strings, with the single
space between tokens that the file's missing decoder asks for."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# What the pattern engine of the vocabulary file takes as blank;
# str.isspace also holds U+001C to U+001F, which are ordinary symbols there.
_NOT_BLANK = regex.compile(r"[\x1c-\x1f]")
_WORDS_KEPT = 500_000
# A merge is its rank above _SHIFT bits of the merged id; a queue entry has the
# position there instead.
_SHIFT = 32
_PLACE = (1 << _SHIFT) - 1
_RANK = ~_PLACE
category = unicodedata.category


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 characters stand
    for themselves, the others are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file: NFC, blanks, lower case,
    pieces by the file's pattern, byte letters with an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.strings = [""] * size
        for s, i in [*vocab.items(), *self.added.items()]:
            self.strings[i] = s
        self.table = pa.array(self.strings, pa.string())
        letters = byte_letters()
        self.letter = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + self.end) for c in letters]
        # (left id, right id) as one number -> rank and merged id as one number.
        self.merge: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merge.setdefault(vocab[a] << 20 | vocab[b], rank << _SHIFT | vocab[a + b])
        pre = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pieces = regex.compile(pre["pattern"]["Regex"])
        self.special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
            if self.added
            else None
        )
        self.words: dict[str, bytes] = {}

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of text."""
        data = piece.encode("utf-8", "surrogatepass")
        ids = [self.letter[b] for b in data]
        ids[-1] = self.last[data[-1]]
        # A letter outside the vocabulary has no token and is dropped.
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        get = self.merge.get
        # Queue entries are one number: rank, then position.
        queue = []
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            hit = get(left << 20 | right)
            if hit is not None:
                queue.append(hit & _RANK | (i - 1))
            left = right
        if not queue:
            return ids
        heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & _PLACE
            j = after[i]
            if j >= n:
                continue
            # Stale: the pair at this position has another rank since, or none.
            # A symbol merged away is -1, which is in no pair.
            hit = get(ids[i] << 20 | ids[j])
            if hit is None or (hit ^ entry) & _RANK:
                continue
            merged = ids[i] = hit & _PLACE
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                hit = get(merged << 20 | ids[k])
                if hit is not None:
                    heappush(queue, hit & _RANK | i)
            k = before[i]
            if k >= 0:
                hit = get(ids[k] << 20 | merged)
                if hit is not None:
                    heappush(queue, hit & _RANK | k)
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> bytes:
        """Packed ids of text without blanks."""
        ids: list[int] = []
        if word.isascii() and word.isalpha():
            ids = self.encode_piece(word)
        elif word.isascii():
            for piece in self.pieces.findall(word):
                ids += self.encode_piece(piece)
        else:
            # Characters this Python's tables do not know are symbols to the
            # file's pattern engine; a private-use mark stands in for them.
            marked = "".join("\ue000" if category(c) == "Cn" else c for c in word)
            for m in self.pieces.finditer(marked):
                ids += self.encode_piece(word[m.start() : m.end()])
        return array("I", ids).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Ids of words not met before. The file's pattern sets a run of letters
        and the mark after it apart, so both are looked up on their own."""
        known = self.words
        for word in words:
            stem, mark = word[:-1], word[-1]
            if mark in ".," and stem.isalpha():
                for part in (stem, mark):
                    if part not in known:
                        known[part] = self._word(part)
                known[word] = known[stem] + known[mark]
            elif word not in known:
                known[word] = self._word(word)

    def _plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower case character by character: no rule for a final sigma.
        text = text.replace("Σ", "σ").lower()
        if _NOT_BLANK.search(text):
            words = [w for w in regex.split(r"[^\S\x1c-\x1f]+", text) if w]
        else:
            words = text.split()
        known = self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > _WORDS_KEPT:
                known.clear()
            self._learn(set(words).difference(known))
            return b"".join(map(known.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Packed little-endian 32-bit ids of a whole text; null is empty."""
        text = text or ""
        if self.special is None or "<" not in text or not self.special.search(text):
            return self._plain(text)
        out = []
        for part in self.special.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """`decode` of every list, without a Python object per id; null stays null."""
        ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(ids), 0).to_numpy()]))
        ends = pa.array(ends.astype(np.int32))
        words = self.table.take(ids.flatten())
        lists = pa.ListArray.from_arrays(ends, words)
        return pc.if_else(pc.is_valid(ids), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


# Rows whose texts are turned at once.
_AT_ONCE = 500


def _encoded(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                coded = [bpe.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    return rows


def _decoded(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                texts = bpe.decode_lists(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return rows


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """The columns of `docs` but `text`, and ids (array<int>).

    A null or empty text, or one of blanks, has no ids. Strings of the file's
    added tokens become their ids. A column named ids is replaced."""
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "ids")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("ids"))
    head = rows.drop("ids").schema
    return rows.mapInArrow(_encoded(vocabulary), head.add("ids", ArrayType(IntegerType())))


def decode_ids(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """All columns of `encoded` (with `ids` last) and decoded; null ids decode
    to null, no ids to an empty text. A column named decoded, in upper or lower
    case, is replaced."""
    rest = [c for c in encoded.columns if c.lower() not in (ids.lower(), "decoded")]
    rows = encoded.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids}`"))
    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    return rows.mapInArrow(_decoded(vocabulary), schema)
