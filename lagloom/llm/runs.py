"""Periodic runs of words by internal pattern matching.

A run is a maximal stretch of words with smallest period q and a length of
`MIN_LENGTH` words and `MIN_POWER` periods at least. The words of a batch of
documents become one sequence of numbers. Prefix doubling gives its suffix
array and, for each power of two, the names of all factors of that length: a
factor's name is its first place in the suffix array, so equal factors are one
interval of it. Blocks of the dyadic lengths 1, 2, 4 ... are laid over every
document, close enough that each run holds a block and its next occurrence, and
each block asks a wavelet tree over the suffix array for its next occurrence in
the window that follows (range successor). Inside a run the occurrences of a
block of at least one period form a progression, whose difference is the
candidate period; the names, compared by halving lengths, stretch it to both
sides.

Batches keep whole documents together, are cut at `BATCH_WORDS` words, and are
handled as numpy arrays; a document is never cut, so memory grows with the
longest one only. Nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
MIN_POWER = 4
BATCH_WORDS = 1 << 18
RUN_TYPE = "array<struct<start:long,length:long,period:long>>"
# Fixed value: the characters between words.
BLANKS = r"[\x20\x09-\x0D]+"


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after another, and the number of words of
    each text; a null text has none."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    # Blanks at either end of a text leave an empty word.
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    places = np.concatenate([[0], np.cumsum(full)])[ends - ends[0]]
    return (words if full.all() else words.filter(pa.array(full))), np.diff(places)


class Factors:
    """Suffix array of documents laid end to end and the names of their factors
    of every dyadic length; factors of different documents never match."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        n = len(codes)
        self.n = n
        doc = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        self.doc = doc
        self.begin, self.end = (ends - lengths)[doc], ends[doc]
        key = doc * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        names = np.empty(n, np.int64)
        names[order] = self._starts(key[order], np.arange(n))
        self.names = [names]
        width = 1
        # Slots of the suffix array whose place is not final yet.
        while True:
            shared = self._shared(names, order)
            slots = np.flatnonzero(shared)
            if not len(slots):
                break
            at = order[slots]
            after = at + width
            inside = after < self.end[at]
            key = names[at] * (n + 1)
            key[inside] += names[after[inside]] + 1
            turn = np.argsort(key, kind="stable")
            order[slots] = at = at[turn]
            names = names.copy()
            names[at] = self._starts(key[turn], slots)
            self.names.append(names)
            width *= 2
        self.order = order

    @staticmethod
    def _starts(key: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """For sorted keys, the slot where the run of each key begins."""
        if not len(key):
            return np.empty(0, np.int64)
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        return slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]

    @staticmethod
    def _shared(names: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Slots of the suffix array whose name is not theirs alone."""
        sorted_names = names[order]
        same = np.zeros(len(order) + 1, bool)
        np.equal(sorted_names[1:], sorted_names[:-1], out=same[1:-1])
        return same[1:] | same[:-1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j > i on (one document)."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, width = self.names[level], 1 << level
            same = j + width <= self.end[i - out]
            a, b = i[same], j[same]
            same[same] = names[a] == names[b]
            i[same] += width
            j[same] += width
            out[same] += width
        return out

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words that end before i and before j > i."""
        least = self.begin[i]
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, width = self.names[level], 1 << level
            same = i - width >= least
            a, b = i[same] - width, j[same] - width
            same[same] = names[a] == names[b]
            i[same] -= width
            j[same] -= width
            out[same] += width
        return out


class WaveletTree:
    """Bits of a sequence of numbers, the highest first, each level reordered
    stably by the bits above it."""

    def __init__(self, values: np.ndarray):
        values = values.copy()
        self.zeros, self.bits = [], int(values.max(initial=0)).bit_length()
        for bit in range(self.bits - 1, -1, -1):
            low = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            values = np.concatenate([values[low], values[~low]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values in slots left to right - 1 are below bound."""
        out = np.zeros(len(left), np.int64)
        over = bound >> self.bits > 0
        out[over] = (right - left)[over]
        for level, zeros in enumerate(self.zeros):
            one = (bound >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[left], zeros[right]
            out += np.where(one & ~over, b - a, 0)
            left = np.where(one, zeros[-1] + left - a, a)
            right = np.where(one, zeros[-1] + right - b, b)
        return out

    def nth(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The value of rank `place` (from 0) in slots left to right - 1."""
        out, place = np.zeros(len(left), np.int64), place.copy()
        for zeros in self.zeros:
            a, b = zeros[left], zeros[right]
            one = place >= b - a
            place -= np.where(one, b - a, 0)
            left = np.where(one, zeros[-1] + left - a, a)
            right = np.where(one, zeros[-1] + right - b, b)
            out = out * 2 + one
        return out

    def successor(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of at least `bound` in slots left to right - 1, -1
        where there is none."""
        place = self.below(left, right, bound)
        out = np.full(len(left), -1, np.int64)
        some = place < right - left
        out[some] = self.nth(left[some], right[some], place[some])
        return out


def _step(level: int) -> int:
    """Distance of blocks of length 2^level. A run of q words a period (half a
    block < q <= a block) and four periods must hold, from the first block that
    starts in it, that block and its occurrence one period later; of six words
    at least for a block of one."""
    width = 1 << level
    least = width // 2 + 1
    most = max(MIN_LENGTH, MIN_POWER * least) - width - least + 1
    return 1 << (most.bit_length() - 1)


def batch_runs(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """All runs of documents given as numbers laid end to end: document, start
    in it, length, period; in that order."""
    factors = Factors(codes, lengths)
    tree = WaveletTree(factors.order - factors.begin[factors.order])
    found = []
    for level, names in enumerate(factors.names):
        width, step = 1 << level, _step(level)
        starts = np.flatnonzero((np.arange(factors.n) - factors.begin) % step == 0)
        size = np.bincount(names, minlength=factors.n)
        starts = starts[size[names[starts]] > 1]
        if not len(starts):
            continue
        left = names[starts]
        at = starts - factors.begin[starts]
        following = tree.successor(left, left + size[left], at + 1)
        gap = following - at
        # Smaller gaps belong to runs that shorter blocks find.
        near = (following >= 0) & (gap <= width) & (gap > width // 2)
        found.append((starts[near], gap[near]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))
    before = factors.common_before(at, at + period)
    length = before + factors.common(at, at + period) + period
    start = at - before
    long = length >= np.maximum(MIN_LENGTH, MIN_POWER * period)
    rows = np.unique(np.stack([start[long], period[long], length[long]], axis=1), axis=0)
    start, period, length = rows.T
    doc = factors.doc[start]
    return doc, start - factors.begin[start], length, period


def _cuts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of whole documents with about `most` words each."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


def runs_of_texts(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """For each text the list of its runs and the text without the words that a
    run repeats, its words joined by single spaces."""
    words, lengths = word_lists(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.cumsum(lengths) - lengths
    parts = []
    for a, b in _cuts(lengths, BATCH_WORDS):
        low = int(firsts[a])
        span = slice(low, low + int(lengths[a:b].sum()))
        # Small numbers again, so that they order with the document as one.
        _, small = np.unique(codes[span], return_inverse=True)
        doc, *run = batch_runs(small, lengths[a:b])
        parts.append((doc + a, *run))
    doc, start, length, period = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 4
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(lengths)))]).astype(np.int32)
    fields = [pa.array(x, pa.int64()) for x in (start, length, period)]
    runs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)
    return lists, _collapsed(words, lengths, firsts[doc] + start + period, firsts[doc] + start + length)


def _collapsed(words: pa.Array, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The texts of all words but those in one of the stretches low to high."""
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, low, 1)
    np.add.at(cover, high, -1)
    stay = np.cumsum(cover)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], np.cumsum(lengths)])]
    kept = words if stay.all() else words.filter(pa.array(stay))
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), kept)
    return pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            runs, collapsed = runs_of_texts(part.column(part.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], runs, collapsed], names=[*part.schema.names[:-1], "runs", "collapsed"]
            )


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` but `text`, and `runs` (start, length and period in
    words, by start, then period) and `collapsed` (the words that are not
    repeated by a run, joined by one space).

    A null, empty or blank text has no words: no runs and an empty text. Every
    row is handled alone, so repeated rows and ids give equal rows and null ids
    do no harm. Runs may overlap and share words; all are returned. Columns
    named runs or collapsed are replaced, all others kept. An empty table gives
    an empty result."""
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "runs", "collapsed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("collapsed"))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("collapsed").schema.fields]
        + [f"runs {RUN_TYPE}", "collapsed string"]
    )
    return rows.mapInArrow(_rows, schema)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def tiled(text: Column, seed: Column) -> Column:
    """A text of which one in ten, by `seed`, repeats a stretch of its own words
    from some word on: planted runs of three to ten periods. With g = seed div 10
    the words from a = g mod n on become words a to a + p - 1 over and over,
    p = 1 + (n - a) div (3 + g mod 8). A null seed changes nothing."""

    def of_words(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(seed / 10).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int")))
        return F.array_join(again, " ")

    planted = F.transform(F.array(words_of(text)), lambda w: F.when(F.size(w) > 0, of_words(w)).otherwise(text))
    return F.when(seed % 10 == 0, planted[0]).otherwise(text)
