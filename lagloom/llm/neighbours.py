"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node. Sorted random signatures give a first
neighbour graph; then neighbours of a node's neighbours are compared with each
other and every node keeps its best, turn by turn, until little changes. Lists
in which every neighbour is a near-duplicate are saturated. Saturated nodes are
put into balls, and each block of them is compared with all nodes of its label
that the radius bound cannot rule out, in and outside its component: every link
with a saturated end is found. For the links between other nodes an audit
against brute force decides whether another pass with longer lists is needed.
Candidates are rated on 8-bit vectors; links are confirmed on the full vectors
in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.components import components
from lagloom.llm.shared import partitions_for, scratch, small_side
from lagloom.llm.topk import valid

SIMILAR = 0.93
NEIGHBOURS = 12
TABLES = 5
BITS = 48
SPAN = 5
TURNS = 5
STILL = 0.01
AUDITED = 200
SEEN = 500
RECALL = 0.99
BLOCK = 512
CHUNK = 4096
# Cosine within which saturated nodes share a ball.
BALL = 0.96
# Ratings on 8-bit vectors are off by less than this.
COARSE = 0.02


def _small(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as 8-bit integers and their scales."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _rows(lists: pa.ListArray) -> list[np.ndarray]:
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
    ends = lists.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node: its 8-bit vector, and one signature of random hyperplanes per
    table."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        nodes, kinds, tables, marks, smalls, scales = [], [], [], [], [], []
        vectors = _rows(batch.column(2))
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dim.setdefault(len(v), []).append(i)
        for dim, at in by_dim.items():
            if dim not in planes:
                planes[dim] = np.random.Generator(np.random.PCG64(dim)).normal(size=(dim, TABLES * BITS))
            m = np.array([vectors[i] for i in at])
            small, scale = _small(m)
            bits = np.packbits((m @ planes[dim] > 0).reshape(len(at) * TABLES, BITS), axis=1)
            for j, i in enumerate(at):
                for t in range(TABLES):
                    nodes.append(ids[i])
                    kinds.append(f"{dim}:{labels[i]}")
                    tables.append(t)
                    marks.append(bits[j * TABLES + t].tobytes())
                    smalls.append(small[j].tobytes())
                    scales.append(float(scale[j]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(nodes, pa.int64()),
                pa.array(kinds, pa.string()),
                pa.array(tables, pa.int32()),
                pa.array(marks, pa.binary()),
                pa.array(smalls, pa.binary()),
                pa.array(scales, pa.float32()),
            ],
            names=["node", "kind", "turn", "mark", "small", "scale"],
        )


_PAIRS = "a long, b long, sim float"


def _pair_batch(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float32())], names=["a", "b", "sim"]
    )


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted run with the SPAN rows before it."""
    held: list[tuple] = []
    for batch in batches:
        a, b, sim = [], [], []
        cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
        for node, kind, turn, small, scale in zip(*cols, strict=True):
            v = np.frombuffer(small, dtype=np.int8).astype(np.float32) * scale
            if held and held[-1][1] != (turn, kind):
                held = []
            for other, _, w in held:
                a.append(node)
                b.append(other)
                sim.append(float(v @ w))
            held = [*held[-(SPAN - 1) :], (node, (turn, kind), v)]
        yield _pair_batch(a, b, sim)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among the neighbours of one node (rows in runs of the node) that
    would enter one of the two lists."""
    rest: list[pa.RecordBatch] = []

    def joined(rows: pa.Table, v: np.ndarray) -> pa.RecordBatch:
        u = rows.column("u").to_numpy()
        kth = rows.column("kth").to_numpy()
        fresh = rows.column("fresh").to_numpy()
        scale = rows.column("scale").to_numpy()
        small = [np.frombuffer(x, dtype=np.int8) for x in rows.column("small").to_pylist()]
        cuts = np.flatnonzero(np.diff(v)) + 1
        found: list[tuple] = []
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(v)]]), strict=True):
            if hi - lo < 2 or not fresh[lo:hi].any():
                continue
            m = np.array(small[lo:hi], dtype=np.float32) * scale[lo:hi, None]
            sims = m @ m.T
            wanted = sims > np.minimum(kth[lo:hi, None], kth[None, lo:hi])
            wanted &= fresh[lo:hi, None] | fresh[None, lo:hi]
            i, j = np.nonzero(np.triu(wanted, 1))
            if len(i):
                found.append((u[lo + i], u[lo + j], sims[i, j]))
        if not found:
            return _pair_batch([], [], [])
        return _pair_batch(*(np.concatenate(c) for c in zip(*found, strict=True)))

    for batch in batches:
        rest.append(batch)
        rows = pa.Table.from_batches(rest).combine_chunks()
        v = rows.column("v").to_numpy()
        # The last run may go on in the next batch.
        whole = int(np.searchsorted(v, v[-1])) if len(v) else 0
        if whole:
            yield joined(rows.slice(0, whole).combine_chunks(), v[:whole])
        rest = rows.slice(whole).combine_chunks().to_batches()
    if rest:
        rows = pa.Table.from_batches(rest)
        yield joined(rows, rows.column("v").to_numpy())


def _best(pairs: DataFrame, keep: int) -> DataFrame:
    """(a, b, sim, fresh): the `keep` best of each node, from pairs in either
    direction; fresh marks what was in no list before."""
    both = pairs.unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "fresh")
    )
    once = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def _turn(lists: DataFrame, smalls: DataFrame, keep: int, turn: int) -> DataFrame:
    """One round: neighbours of neighbours compete for the lists."""
    kth = lists.groupBy("a").agg(
        F.when(F.count("*") >= keep, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("kth")
    )
    known = smalls.join(kth, F.col("node") == F.col("a"), "left").select(
        F.col("node").alias("u"), "small", "scale", F.coalesce("kth", F.lit(-2.0).cast("float")).alias("kth")
    )
    # Nodes that name v, as many of them at random as v has places; others get
    # their turn with another hash, and through the lists of their neighbours.
    pick = Window.partitionBy("b").orderBy(F.xxhash64(F.lit(turn), "a"))
    back = (
        lists.withColumn("_r", F.row_number().over(pick))
        .where(F.col("_r") <= keep)
        .select(F.col("b").alias("v"), F.col("a").alias("u"), "fresh")
    )
    around = (
        lists.select(F.col("a").alias("v"), F.col("b").alias("u"), "fresh")
        .unionByName(back)
        .groupBy("v", "u")
        .agg(F.max("fresh").alias("fresh"))
    )
    found = (
        around.join(known, "u")
        .repartition(partitions_for(lists.sparkSession), "v")
        .sortWithinPartitions("v")
        .select("v", "u", "fresh", "small", "scale", "kth")
        .mapInArrow(_local, _PAIRS)
    )
    old = lists.select("a", "b", "sim", F.lit(False).alias("fresh"))
    return _best(old.unionByName(found.withColumn("fresh", F.lit(True))), keep)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = [
            float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)))
            for x, y in zip(_rows(batch.column(2)), _rows(batch.column(3)), strict=True)
        ]
        good = pa.array(np.array(sims) >= SIMILAR, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(good)


def _links(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct linked pairs a < b of the neighbour lists."""
    near = (
        lists.where(F.col("sim") >= SIMILAR - COARSE)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    return (
        near.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("x")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("v").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_cosines, "a long, b long")
    )


def _units(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors of each length."""
    vectors = _rows(column.combine_chunks()) if len(column) else []
    by_dim: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_dim.setdefault(len(v), []).append(i)
    out = {}
    for dim, at in by_dim.items():
        m = np.array([vectors[i] for i in at])
        out[dim] = np.array(at), m / np.sqrt((m * m).sum(axis=1))[:, None]
    return out


def _chunks(nodes: DataFrame, rows: int) -> DataFrame:
    """`nodes` with the number of a chunk of about `rows` rows in its label."""
    sizes = nodes.groupBy("label").agg(F.ceil(F.count("*") / rows).cast("int").alias("chunks"))
    return nodes.join(small_side(sizes, 64), "label").withColumn(
        "chunk", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("chunks")).cast("int")
    )


def _in_balls(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
    """Centres and radii (angles) of balls that cover a block of nodes."""
    centres, radii = [], []
    for _, m in _units(members.column("v")).values():
        while len(m):
            sims = m @ m[0]
            near = sims >= BALL
            near[0] = True
            centres.append(m[0].tolist())
            radii.append(float(np.arccos(np.clip(sims[near].min(), -1, 1))))
            m = m[~near]
    n = len(centres)
    return pa.table(
        [
            pa.array([key[0].as_py()] * n, pa.int64()),
            pa.array([key[1].as_py()] * n, pa.int32()),
            pa.array(centres, pa.list_(pa.float64())),
            pa.array(radii, pa.float64()),
        ],
        names=["component", "block", "centre", "radius"],
    )


def _in_reach(key, balls: pa.Table, chunk: pa.Table) -> pa.Table:
    """Nodes of a chunk that may be linked to a node of a block."""
    parts, blocks, nodes = [], [], []
    ids, component = chunk.column("node").to_numpy(), balls.column("component").to_numpy()
    block, radius = balls.column("block").to_numpy(), balls.column("radius").to_numpy()
    right = _units(chunk.column("v"))
    for dim, (at, centres) in _units(balls.column("centre")).items():
        if dim not in right:
            continue
        rows, y = right[dim]
        # Angles are a metric: a link leads no farther than its own angle.
        reach = np.cos(np.minimum(np.arccos(SIMILAR) + radius[at] + 1e-6, np.pi))
        for lo in range(0, len(at), BLOCK):
            i, j = np.nonzero(centres[lo : lo + BLOCK] @ y.T >= reach[lo : lo + BLOCK, None])
            parts.append(component[at[lo + i]])
            blocks.append(block[at[lo + i]])
            nodes.append(ids[rows[j]])
    empty = [np.zeros(0, dtype=np.int64)]
    return pa.table(
        [
            pa.array(np.concatenate(parts or empty), pa.int64()),
            pa.array(np.concatenate(blocks or empty), pa.int32()),
            pa.array(np.concatenate(nodes or empty), pa.int64()),
        ],
        names=["component", "block", "other"],
    ).group_by(["component", "block", "other"]).aggregate([])


def _block_links(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """(a, null, n): copies linked to a node, itself left out, of saturated left
    nodes and of right nodes that are not saturated; (a, b, null): edges that
    connect what the links between left and right connect."""
    if not len(left) or not len(right):
        return pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "n"])
    (_, x), (_, y) = (*_units(left.column("v")).values(), *_units(right.column("w")).values())
    ids, others = left.column("node").to_numpy(), right.column("other").to_numpy()
    linked = x @ y.T >= SIMILAR
    # Least id that is reached, over and back until nothing changes.
    lead, led, most = ids, others, np.iinfo(np.int64).max
    while True:
        led_now = np.minimum(led, np.where(linked, lead[:, None], most).min(axis=0))
        lead_now = np.minimum(lead, np.where(linked, led_now[None, :], most).min(axis=1))
        if (led_now == led).all() and (lead_now == lead).all():
            break
        lead, led = lead_now, led_now
    ends = np.concatenate([ids, others])
    leads = np.concatenate([lead, led])
    moved = ends != leads
    linked &= ids[:, None] != others[None, :]
    loose = ~right.column("saturated").to_numpy(zero_copy_only=False)
    counted = np.concatenate([ids, others[loose]])
    n = np.concatenate([linked @ right.column("copies").to_numpy(), left.column("copies").to_numpy() @ linked[:, loose]])
    some = n > 0
    return pa.table(
        [
            pa.array(np.concatenate([counted[some], ends[moved]]), pa.int64()),
            pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(leads[moved], pa.int64())]),
            pa.concat_arrays([pa.array(n[some], pa.int64()), pa.nulls(int(moved.sum()), pa.int64())]),
        ],
        names=["a", "b", "n"],
    )


def _saturated_links(nodes: DataFrame, full: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, n) of `_block_links` for all links with an end in `full`."""
    members = nodes.join(full, "node").join(labels, "node")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = scratch(
        members.join(sizes, "component").withColumn(
            "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        ),
        "saturated",
    )
    balls = members.groupBy("component", "block").applyInArrow(
        _in_balls, "component long, block int, centre array<double>, radius double"
    )
    # All nodes of a component have one label.
    of = members.groupBy("component").agg(F.first("label").alias("label"))
    cut = _chunks(nodes.join(members.select("label").distinct(), "label", "left_semi"), CHUNK)
    chunks = cut.select("label", "chunk").distinct()
    held = balls.join(of, "component").join(chunks, "label")
    near = scratch(
        held.toDF(*[f"b_{c}" if c in ("label", "chunk") else c for c in held.columns])
        .groupBy("b_label", "b_chunk")
        .cogroup(
            cut.select("label", "chunk", "node", "v").toDF("nl", "nc", "node", "v").groupBy("nl", "nc")
        )
        .applyInArrow(_in_reach, "component long, block int, other long"),
        "in-reach",
    )
    cuts = near.groupBy("component", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    left = members.join(cuts, ["component", "block"]).select(
        "component", "block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "node", "v", "copies"
    )
    right = (
        near.join(cuts, ["component", "block"])
        .join(nodes.select(F.col("node").alias("other"), F.col("v").alias("w"), "copies"), "other")
        .join(full.select(F.col("node").alias("other"), F.lit(True).alias("saturated")), "other", "left")
        .select(
            F.col("component").alias("rc"),
            F.col("block").alias("rb"),
            F.pmod(F.xxhash64(F.lit(7), "other"), F.col("cuts")).cast("int").alias("ru"),
            "other",
            "w",
            "copies",
            F.coalesce("saturated", F.lit(False)).alias("saturated"),
        )
    )
    return (
        left.groupBy("component", "block", "cut")
        .cogroup(right.groupBy("rc", "rb", "ru"))
        .applyInArrow(_block_links, "a long, b long, n long")
    )


def _true_links(key, probes: pa.Table, chunk: pa.Table) -> pa.Table:
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    ids, others = probes.column("node").to_numpy(), chunk.column("node").to_numpy()
    right = _units(chunk.column("v"))
    for dim, (at, x) in _units(probes.column("v")).items():
        if dim in right:
            rows, y = right[dim]
            i, j = np.nonzero(x @ y.T >= SIMILAR)
            apart = ids[at[i]] != others[rows[j]]
            a.append(ids[at[i]][apart])
            b.append(others[rows[j]][apart])
    return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in (a, b)], names=["a", "b"])


def _audit(loose: DataFrame, links: DataFrame) -> float:
    """Mean share of its links that a node has found, over nodes drawn by hash
    from `loose` (those not saturated) and links among `loose`, against brute
    force. The draw starts at AUDITED nodes and grows until SEEN true links were
    seen or every node was drawn."""
    total = loose.count()
    share = AUDITED / max(total, 1)
    while True:
        drawn = loose.where(
            F.pmod(F.xxhash64(F.lit(23), "node"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))
        )
        left = _chunks(drawn, BLOCK).withColumnRenamed("chunk", "part")
        right = _chunks(loose, CHUNK)
        left = left.join(right.select("label", "chunk").distinct(), "label")
        right = right.join(left.select("label", "part").distinct(), "label")
        truth = scratch(
            left.select("label", "part", "chunk", "node", "v")
            .toDF("pl", "pp", "pc", "node", "v")
            .groupBy("pl", "pp", "pc")
            .cogroup(
                right.select("label", "part", "chunk", "node", "v")
                .toDF("cl", "cp", "cc", "node", "v")
                .groupBy("cl", "cp", "cc")
            )
            .applyInArrow(_true_links, "a long, b long"),
            "true-links",
        )
        if share >= 1 or truth.count() >= SEEN:
            break
        share *= 8
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = truth.join(both.withColumn("listed", F.lit(1.0)), ["a", "b"], "left")
    recall = (
        found.groupBy("a")
        .agg(F.avg(F.coalesce("listed", F.lit(0.0))).alias("recall"))
        .agg(F.avg("recall").alias("recall"))
        .first()["recall"]
    )
    return 1.0 if recall is None else recall


def near_duplicate_vectors(
    vectors: DataFrame,
    id_: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """One row per row of `vectors`: id_, n_links (other rows linked directly:
    equal label, cosine of SIMILAR or more), component_id (smallest id reachable,
    itself included), kept (it is that id).

    Rows whose vector is null, zero, empty or has a null or non-finite
    component, or whose label or id is null, link with nothing; a null id is
    kept. Vectors of different lengths do not link. Equal vectors link with each
    other; a repeated id with an equal vector is one row in the counts. An empty
    table gives an empty result; other columns are ignored."""
    rows = vectors.select(
        F.col(f"`{id_}`").cast("long").alias("id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"),
    )
    rows = rows.withColumn(
        "ok",
        valid(F.col("v"))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
        & F.col("label").isNotNull()
        & F.col("id").isNotNull(),
    )
    good = rows.where("ok")
    nodes = scratch(
        good.groupBy("label", "v").agg(F.min("id").alias("node"), F.countDistinct("id").alias("copies")), "nodes"
    )
    signed = scratch(nodes.select("node", "label", "v").mapInArrow(
        _signed, "node long, kind string, turn int, mark binary, small binary, scale float"
    ), "signatures")
    smalls = signed.where("turn = 0").select("node", "small", "scale")
    start = (
        signed.repartitionByRange(partitions_for(vectors.sparkSession), "turn", "kind", "mark")
        .sortWithinPartitions("turn", "kind", "mark")
        .mapInArrow(_along, _PAIRS)
        .withColumn("fresh", F.lit(True))
    )
    size = nodes.count()
    keep = neighbours
    lists = scratch(_best(start, keep), "lists")
    while True:
        for turn in range(TURNS):
            lists = scratch(_turn(lists, smalls, keep, turn), "lists")
            if lists.where("fresh").count() <= STILL * keep * size:
                break
        links = scratch(_links(lists, nodes), "links")
        # Saturated: the whole list is near, so links may be missing from it.
        full = scratch(
            lists.groupBy("a")
            .agg(F.count("*").alias("n"), F.min("sim").alias("low"))
            .where((F.col("n") >= keep) & (F.col("low") >= SIMILAR - COARSE))
            .select(F.col("a").alias("node")),
            "full",
        )
        loose = nodes.select("node", "label", "v").join(full, "node", "left_anti")
        if keep >= size or _audit(scratch(loose, "loose"), links) >= RECALL:
            break
        keep *= 2
        lists = lists.withColumn("fresh", F.lit(True))
    # A node may be full of ratings just below a link and have none.
    lone = full.select("node", F.col("node").alias("component"))
    first = components(links)
    groups = first.unionByName(lone.join(first, "node", "left_anti"))
    exact = scratch(_saturated_links(nodes, full, groups), "saturated-links")
    counted = exact.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = scratch(
        components(links.unionByName(exact.where("b is not null").select("a", "b"))), "vector-components"
    )
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = (
        both.join(full.select(F.col("node").alias("a")), "a", "left_anti")
        .join(full.select(F.col("node").alias("b")), "b", "left_anti")
        .join(nodes.select(F.col("node").alias("b"), "copies"), "b")
        .groupBy(F.col("a").alias("node"))
        .agg(F.sum("copies").alias("m"))
    )
    per_node = (
        nodes.select("node", "label", "v", "copies")
        .join(labels, "node", "left")
        .join(counted, "node", "left")
        .join(listed, "node", "left")
        .select(
            "label",
            "v",
            F.coalesce("component", "node").alias("component"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    linked = good.select("id", "label", "v").join(per_node, ["label", "v"]).select("id", "links", "component")
    alone = rows.where("not ok").select("id", F.lit(0).alias("links"), F.col("id").alias("component"))
    return (
        linked.unionByName(alone)
        .select(
            F.col("id").alias(id_),
            F.col("links").cast("long").alias("n_links"),
            F.col("component").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_) == F.col("component_id"), F.lit(True)))
    )
