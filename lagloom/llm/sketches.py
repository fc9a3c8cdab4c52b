"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function gives every shingle a 64-bit value; a document's sketch is
its `SKETCH` smallest values. Documents with equal shingle sets are one node.
Inverted lists of retained values propose pairs: a pair at the wanted similarity
shares most of its sketch, so only the rarest values of each sketch are listed
(enough of them that such a pair must share one), which keeps passages that many
documents quote out of the lists. Lists are not paired out: each node first
joins the largest of its lists, whose members are compared in blocks, where the
sketches' overlap filters and the full sets confirm, and a block returns only
links that connect it. Blocks of a large group meet in rounds, and from the second
on only what earlier rounds left apart is compared. Lists that still span components are grouped again by
their members' smallest hashed values; pairs that met in no group are joined at
their smallest common value, rated by the sketch of the union and confirmed on
the full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.components import components
from lagloom.llm.shared import drop_scratch, scratch, small_batches, small_side

WORDS = 5
SIMILAR = (75, 100)
# Values kept per document, and the smallest of them used for the first look.
SKETCH = 128
HEAD = 16
# Of the 16 values of the head, a pair at similarity 0.75 shares a quarter at
# least but for a chance of 1e-5.
HEAD_SHARED = 0.25
# Standard deviations that the overlap of two sketches may stay below its mean.
DEVIATIONS = 4.6
# The estimate from the union's sketch may fall short by this much.
SLACK = 0.2
# Nodes compared at once inside a group.
BLOCK = 512
# Groups of up to WIDE blocks meet in one round, larger ones in several.
WIDE = 16
# A round compares blocks up to this many times as far apart as the one before.
WIDER = 4
# Nodes in a list of up to FEW are grouped again by two values, others by more.
FEW = 64
# Texts that a worker holds as sets at once.
SLICE = 500

# Odd multipliers that mix five word hashes into one.
_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
    dtype=np.uint64,
)
_LOWER = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     "
)
_SHIFT = np.uint64(29)
# Words hashed before, per worker; forgotten when full.
_WORDS: dict[bytes, int] = {}
_WORDS_KEPT = 150_000


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_WORDS) > _WORDS_KEPT:
        _WORDS.clear()
    get, h64 = _WORDS.get, xxhash.xxh64_intdigest
    found = list(map(get, words))
    if None in found:
        for i, v in enumerate(found):
            if v is None:
                found[i] = _WORDS[words[i]] = h64(words[i])
    return np.array(found, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; one hash of the whole
    sequence for fewer than WORDS words, none without words."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ") if w]
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64)
    one = _word_hashes(words)
    n = len(one) - WORDS + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(WORDS):
        h += one[j : j + n]
        h *= _MIX[j]
        h ^= h >> _SHIFT
    h.sort()
    keep = np.empty(n, dtype=bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            sizes, marks, heads, sketches = [], [], [], []
            for text in part.column(1):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                marks.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                # A view would hold the whole set.
                sketches.append(s[:SKETCH].copy())
                heads.append(sketches[-1][:HEAD])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(marks, pa.binary()),
                    _longs(heads),
                    _longs(sketches),
                ],
                names=["doc", "n", "mark", "head", "sketch"],
            )
    _free()


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            sets = _longs([shingle_set(t.as_py()) for t in part.column(1)])
            yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["doc", "set"])
    _free()


def _free() -> None:
    """A worker outlives its task: it keeps neither words nor Arrow's buffers."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    """Hashes as an Arrow list of signed longs."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _hashes(lists: pa.ListArray) -> list[np.ndarray]:
    flat = lists.values.to_numpy().view(np.uint64)
    ends = lists.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values in both sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def needed_overlap(n: np.ndarray) -> np.ndarray:
    """Values that the sketch of a set of size `n` shares at least with that of
    any partner: 0.75 of the set while both sketches hold whole sets, otherwise
    the mean of the draw from the union less DEVIATIONS."""
    share = SIMILAR[0] / SIMILAR[1]
    k = np.minimum(n, SKETCH)
    spread = np.sqrt(k * share * (1 - share) * np.maximum(0.0, 1 - k * share / np.maximum(n, 1)))
    drawn = np.floor(share * k - DEVIATIONS * spread)
    return np.where(n <= share * SKETCH, np.ceil(share * n), drawn)


def _needed(n: Column) -> Column:
    """`needed_overlap` in SQL functions."""
    share = SIMILAR[0] / SIMILAR[1]
    k = F.least(n, F.lit(SKETCH))
    spread = F.sqrt(k * share * (1 - share) * F.greatest(F.lit(0.0), 1 - k * share / n))
    drawn = F.floor(share * k - DEVIATIONS * spread)
    return F.when(n <= share * SKETCH, F.ceil(share * n)).otherwise(drawn)


def _reaches(common, na, nb):
    return SIMILAR[1] * common >= SIMILAR[0] * (na + nb - common)


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common sketch values of every left with every right set, as products of
    indicator matrices over a slice of the values at a time."""
    parts = [s[:SKETCH] for s in sets]
    owner = np.repeat(np.arange(len(sets)), [len(p) for p in parts])
    _, column, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twice = counts[column] > 1
    owner, column = owner[twice], column[twice]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(column):
        return out
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 2048
    for at in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        out += has[left] @ has[right].T
    return out


def linked_in_block(
    nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, component: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that connect what is similar: between the two sides if there are
    two, else among all. Pairs already connected, here or by `component`, are not
    looked at again."""
    across = side.min() != side.max()
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    n = np.array([len(s) for s in sets])
    common = _overlaps(sets, left, right)
    need = needed_overlap(n)
    na, nb = n[left][:, None], n[right][None, :]
    ok = common >= np.maximum(need[left][:, None], need[right][None, :])
    ok &= SIMILAR[1] * np.minimum(na, nb) >= SIMILAR[0] * np.maximum(na, nb)
    whole = (na <= SKETCH) & (nb <= SKETCH)
    ok &= ~whole | _reaches(common, na, nb)
    if not across:
        ok = np.triu(ok, 1)
    leader = list(range(len(nodes)))
    if component is not None:
        _, first, member = np.unique(component, return_index=True, return_inverse=True)
        leader = first[member].tolist()
        ok &= component[left][:, None] != component[right][None, :]
    i, j = np.nonzero(ok)
    best = np.argsort(-common[i, j] / (n[left[i]] + n[right[j]]), kind="stable")

    def lead(x: int) -> int:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    links = []
    for x, y, sure in zip(left[i[best]].tolist(), right[j[best]].tolist(), whole[i, j][best].tolist(), strict=True):
        p, q = lead(x), lead(y)
        if p != q and (sure or _reaches(_common(sets[x], sets[y]), n[x], n[y])):
            leader[q] = p
            links.append((int(nodes[x]), int(nodes[y])))
    return links


def _compare_block(key: tuple, rows: pa.Table) -> pa.Table:
    links = []
    if len(rows) > 1:
        links = linked_in_block(
            rows.column("node").to_numpy(),
            _hashes(rows.column("set").combine_chunks()),
            rows.column("block").to_numpy(),
            rows.column("component").to_numpy(),
        )
    a, b = zip(*links, strict=True) if links else ([], [])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compared(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between `block` and `other` of (g, node, component, block, other)."""
    # The sets then move once, to their blocks.
    return (
        small_side(cells, 48)
        .join(sets.select(F.col("doc").alias("node"), "set"), "node")
        .select(
            "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "block", "node", "component", "set",
        )
        .groupBy("g", "i", "j")
        .applyInArrow(_compare_block, "a long, b long")
    )


def _dealt(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, node, block, few, k, span): the nodes of groups that still span
    components, dealt anew. Blocks 0 to few - 1 hold what lies outside the group's
    largest component, the others up to k - 1 that component, whose nodes need not
    meet each other. `span` is the farthest that blocks to compare lie apart, 0
    if the first `few` are one and a single round returns few links."""
    named = blocks.join(labels, "node", "left").select("g", "node", F.coalesce("component", "node").alias("component"))
    per = named.groupBy("g", "component").agg(F.count("*").alias("n"))
    parts = (
        per.groupBy("g")
        .agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select(
            "g",
            F.col("most.component").alias("largest"),
            F.ceil((F.col("size") - F.col("most.n")) / BLOCK).cast("int").alias("few"),
            F.ceil(F.col("most.n") / BLOCK).cast("int").alias("rest"),
        )
    )
    lot = F.xxhash64(F.lit(3), "node")
    inside = F.col("component") == F.col("largest")
    return named.join(parts, "g").select(
        "g",
        "node",
        F.when(inside, F.col("few") + F.pmod(lot, F.col("rest"))).otherwise(F.pmod(lot, F.col("few"))).cast("int").alias("block"),
        "few",
        (F.col("few") + F.col("rest")).alias("k"),
        F.when(F.col("few") > 1, F.expr("(few + rest) div 2")).otherwise(0).cast("int").alias("span"),
    )


def _grouped_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges that connect what is similar inside the groups (g, node), by blocks
    of about BLOCK nodes.

    If every two blocks returned links of their own, a group would return them in
    proportion to its square. So in a group of more than WIDE blocks (others return
    WIDE / 2 edges a node at most) each block first meets itself and its neighbours
    on a ring; then the components so far are a star each, nodes outside the
    largest one meet all others in rounds of ever farther blocks, and a pair
    connected by an earlier round is passed over. As blocks are drawn by hash, a
    round samples the group's pairs, and of those in the next that are WIDER times
    as many about WIDER times the nodes still connect anything, whatever the group."""
    sizes = groups.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    ring = F.array("block", F.expr("pmod(block + 1, blocks)"), F.expr("pmod(block + blocks - 1, blocks)"))
    cut = (
        groups.join(sizes, "g")
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.when(F.col("blocks") > WIDE, F.array_distinct(ring)).otherwise(every)))
    )
    cut = scratch(cut.select("g", "node", F.col("node").alias("component"), "block", "other", "blocks"), "blocks")
    links = _compared(cut.drop("blocks"), sets)
    wide = cut.where((F.col("blocks") > WIDE) & (F.col("block") == F.col("other"))).select("g", "node")
    if wide.isEmpty():
        return links
    labels, dealt, low, high = components(links), None, 0, 2
    while True:
        star = labels.select(F.col("component").alias("a"), F.col("node").alias("b"))
        if dealt is None:
            dealt = scratch(_dealt(wide, labels), "dealt")
        farthest = dealt.agg(F.max("span")).first()[0]
        if farthest is None or farthest < low:
            return star
        last = F.when(F.col("block") < F.col("few"), F.col("k")).otherwise(F.col("few")) - 1

        def met_now(other: Column) -> Column:
            apart = F.abs(F.col("block") - other)
            apart = F.least(apart, F.col("k") - apart)
            return ((apart >= low) & (apart < high)) | (F.col("span") == 0)

        cells = (
            dealt.where(F.col("span") >= low)
            .withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), last), met_now)))
            .join(labels, "node", "left")
            .select("g", "node", F.coalesce("component", "node").alias("component"), "block", "other")
        )
        links = star.unionByName(_compared(scratch(cells, "cells"), sets))
        if farthest < high:
            return links
        labels, low, high = components(links), high, high * WIDER


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity by the sketch of the union; exact where both sketches are
    the whole sets."""
    for batch in batches:
        na, nb = (batch.column(i).to_numpy() for i in (2, 3))
        est = np.zeros(batch.num_rows)
        for i, (a, b) in enumerate(zip(_hashes(batch.column(4)), _hashes(batch.column(5)), strict=True)):
            if na[i] > SKETCH or nb[i] > SKETCH:
                k = min(SKETCH, len(a), len(b))
                union = np.union1d(a, b)[:k]
                a, b = a[: np.searchsorted(a, union[-1], "right")], b[: np.searchsorted(b, union[-1], "right")]
                est[i] = _common(a, b) / len(union)
            else:
                c = _common(a, b)
                est[i] = 2.0 if _reaches(c, len(a), len(b)) else 0.0
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(est)], names=["a", "b", "est"]
        )


def sketch_documents(docs: DataFrame, text: str, doc: str) -> DataFrame:
    return docs.select(
        F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")
    ).mapInArrow(_sketch_rows, "doc long, n long, mark binary, head array<long>, sketch array<long>")


def _inverted_lists(nodes: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, node, n, size): the rarest retained values of every node that may
    have a partner, and (node, mark, n, sketch). A node that shares too few values with
    others is in no list."""
    heads = nodes.select("node", F.size("head").alias("k"), F.explode("head").alias("value"))
    twice = heads.groupBy("value").count().where("count > 1").select("value")
    suspects = (
        heads.join(twice.hint("merge"), "value", "left_semi")
        .groupBy("node")
        .agg(F.count("*").alias("hits"), F.first("k").alias("k"))
        .where(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.lit(HEAD_SHARED) * F.col("k"))))
        .select("node")
    )
    suspects = scratch(suspects, "suspects")
    held = scratch(nodes.join(small_side(suspects, 16), "node", "left_semi").select("node", "mark", "n"), "suspect-nodes")
    drop_scratch(suspects)
    # The only join that may shuffle all sketches. Texts under one id stay apart,
    # so each gets a number of its own.
    kept = scratch(
        small_side(held, 64)
        .join(
            sketches.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "sketch"),
            (F.col("mark") == F.col("_mark")) & (F.col("node") == F.col("_doc")),
        )
        .groupBy("node", "mark")
        .agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("id", F.monotonically_increasing_id()),
        "node-sketches",
    )
    # Two longs a row through both exchanges; sizes are looked up by number.
    values = kept.select("id", F.explode("sketch").alias("value"))
    known = values.groupBy("value").count().where("count > 1")
    by_rarity = Window.partitionBy("id")
    # Both sides grow with the documents: the same plan at every size.
    ranked = values.join(known.hint("merge"), "value").select(
        "id",
        "value",
        F.row_number().over(by_rarity.orderBy("count", "value")).alias("place"),
        F.count("*").over(by_rarity).alias("shared"),
    )
    # Values that no other node retains come first in the order by rarity; they
    # are not here, so places are counted from the common end.
    names = kept.select("id", "node", "n")
    listed = ranked.join(names, "id").where(F.col("place") <= F.col("shared") - _needed(F.col("n")) + 1)
    listed = scratch(listed.select("value", "node", "n"), "prefixes")
    sizes = listed.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    lists = scratch(listed.join(sizes.hint("merge"), "value"), "lists")
    for done in (listed, held):
        drop_scratch(done)
    return lists, kept.drop("id")


def _drawn(values: Column, size: Column) -> Column:
    """The values that group a node again: the smallest of its own by a hash, by
    as many hashes as the logarithm of its largest list asks for. Each halves, or
    nearly so, the pairs that share most values and yet met nowhere, so they grow
    like the list and not like its square."""
    draws = F.lit(2) + F.ceil(2 * F.log2(F.greatest(size, F.lit(FEW)) / FEW)).cast("int")

    def smallest(seed: Column) -> Column:
        rated = F.transform(values, lambda v: F.struct(F.xxhash64(seed, v).alias("hash"), v.alias("value")))
        return F.array_min(rated).getField("value")

    return F.array_distinct(F.transform(F.sequence(F.lit(1), draws), smallest))


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc, n_shingles, component_id (the smallest
    id reachable over links at similarity 0.75 or more, itself included) and
    kept (it is that id).

    A null or empty text, or one of blanks only, has no shingles and links with
    nothing; fewer than five words are one shingle. Rows that share an id are
    one document with the links of each; a null id is a component of its own
    (component_id null, kept true) but its text still stands for equal texts.
    An empty table gives an empty result; other columns are ignored."""
    with small_batches(docs.sparkSession):
        base = scratch(sketch_documents(docs, text, doc), "sketches")
    nodes = scratch(
        base.where("n > 0 and doc is not null")
        .groupBy("mark")
        .agg(F.min("doc").alias("node"), F.first("n").alias("n"), F.first("head").alias("head")),
        "nodes",
    )
    lists, sketches = _inverted_lists(nodes, base)
    listed = small_side(scratch(lists.select("node").distinct(), "listed"), 16)
    sketches = sketches.join(listed, "node", "left_semi").drop("mark")
    # A set of up to SKETCH values is whole in its sketch; the longer ones are
    # built from the text again, for listed nodes only.
    long_ones = sketches.where(F.col("n") > SKETCH).select("node").distinct()
    whole = docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    sets = (
        whole.join(small_side(long_ones.withColumnRenamed("node", "doc"), 16), "doc", "left_semi")
        .mapInArrow(_set_rows, "doc long, set array<long>")
        .unionByName(
            sketches.where(F.col("n") <= SKETCH).select(
                F.col("node").alias("doc"), F.col("sketch").alias("set")
            )
        )
    )
    with small_batches(docs.sparkSession):
        sets = scratch(sets, "sets")

    # The largest list of each node first, then what still spans components.
    largest = lists.groupBy("node").agg(F.max(F.struct("size", "value")).getField("value").alias("g"))
    largest = scratch(largest, "groups")
    links = scratch(_grouped_links(largest, sets), "links")
    joined = components(links)
    open_ = lists.join(joined, "node", "left").join(largest, "node")
    open_ = open_.withColumn("component", F.coalesce("component", "node"))
    spans = (
        open_.groupBy("value")
        .agg(F.min("component") < F.max("component"), F.min("g") < F.max("g"))
        .toDF("value", "components", "groups")
        .where("components and groups")
        .select("value")
    )
    open_ = open_rows = scratch(
        open_.join(spans, "value").select("value", "size", "node", "n", "g", "component"), "open-lists"
    )
    per_node = scratch(
        open_.groupBy("node").agg(
            F.collect_set("value").alias("values"), F.max("size").alias("size")
        ).withColumn("again", _drawn(F.col("values"), F.col("size"))),
        "open-groups",
    )
    # 32 bits of each retained value are enough to count what two nodes share.
    short = sketches.groupBy("node").agg(
        F.first(F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int"))).alias("short"),
        F.max(_needed(F.col("n"))).alias("need"),
    )
    known = per_node.join(short, "node")
    again = per_node.select("node", F.explode("again").alias("g"))
    # What these groups connect is no pair any more.
    joined = components(links.unionByName(_grouped_links(again, sets)))
    open_ = (
        open_.drop("component")
        .join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    x, y = (open_.join(known, "node").alias(c) for c in ("x", "y"))
    met = (F.col("x.g") == F.col("y.g")) | F.arrays_overlap("x.again", "y.again")
    first = F.array_min(F.array_intersect("x.values", "y.values"))
    pairs = x.join(
        y,
        (F.col("x.value") == F.col("y.value"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.least("x.n", "y.n") * SIMILAR[1] >= F.greatest("x.n", "y.n") * SIMILAR[0])
        & ~met
        & (F.col("x.value") == first)
        & (F.size(F.array_intersect("x.short", "y.short")) >= F.greatest("x.need", "y.need")),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = _verify(pairs.distinct(), sketches, sets)
    labels = components(joined.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    for done in (lists, sets, largest, links, open_rows, per_node):
        drop_scratch(done)
    named = nodes.select("mark", "node").join(labels, "node", "left").select(
        "mark", F.coalesce("component", "node").alias("component")
    )
    return (
        base.select("doc", "n", "mark")
        .join(named, "mark", "left")
        .select(
            F.col("doc").alias(doc),
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(doc) == F.col("component_id"), F.lit(True)))
    )


def _verify(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets reach the similarity."""

    def side(c: str) -> DataFrame:
        return sketches.select(
            F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")
        )

    close = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", "na", "nb", "sa", "sb")
    )
    rated = scratch(close.mapInArrow(_estimates, "a long, b long, est double"), "estimates")
    sure = rated.where("est >= 1.5").select("a", "b")
    open_ = rated.where((F.col("est") < 1.5) & (F.col("est") >= SIMILAR[0] / SIMILAR[1] - SLACK)).select("a", "b")
    ends = scratch(open_.select(F.col("a").alias("doc")).union(open_.select("b")).distinct(), "open-ends")
    # Both joins move only the sets of open pairs.
    asked = scratch(sets.join(small_side(ends, 16), "doc", "left_semi"), "open-sets")
    full = (
        open_.join(asked.select(F.col("doc").alias("a"), F.col("set").alias("x")), "a")
        .join(asked.select(F.col("doc").alias("b"), F.col("set").alias("y")), "b")
        .withColumn("both", F.size(F.array_intersect("x", "y")))
        .where(_reaches(F.col("both"), F.size("x"), F.size("y")))
    )
    return sure.unionByName(full.select("a", "b")).distinct()
