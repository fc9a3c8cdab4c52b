"""Conditional logistic regression on matched sets.

A set with m cases contributes the probability that its cases are those and no
other m members. Its denominator is an elementary symmetric polynomial of the
members' exp(eta): the coefficient of z^m in the product of 1 + z exp(eta). It is
read off that product on a circle in the complex plane, whose radius makes m the
mean number of members drawn. On it the logarithm of the product is a sum over the
members, and so are the logarithm's derivatives: parts of a set add up, equal
members count as one, and few points of the circle matter, however many cases
there are.

Members are counted by set and x first. A set that fits in _VALUES numbers is one
row, and a step is one pass over these rows; the members of larger sets stay apart
and are summed by set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.models.fitted import Fitted
from lagloom.models.moments import as_vector, grouped_sums, keep, pack, solve_information, sum_vectors, unpack, whole

# Numbers that a set in one row has at most.
_VALUES = 1024
# Elements of the members' matrices that a worker holds at a time.
_CHUNK = 1 << 18
# The circle's points leave out what is below exp(-_FAR) of the whole.
_FAR = 45.0
# Cells of eta in which the members of a large set are counted to find its circle.
_PER_ETA = 32


def clogit_design(df: DataFrame, set_col: str, case: str, parts: list[Column], count: str | None = None) -> DataFrame:
    """Rows as (set, case, x, many); rows with a missing array or element are
    left out by the fit. With `count`, a set stands for that many equal sets;
    the column is the same in all its rows."""
    rows = df.select(
        F.col(set_col).alias("set"), F.col(case).cast("double").alias("case"),
        F.concat(*parts).alias("x"), (F.col(count) if count else F.lit(1.0)).cast("double").alias("many"),
    )
    return rows.where(F.col("set").isNotNull() & F.col("case").isNotNull())


def _odds(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a log odds and its complement."""
    small = np.exp(-np.abs(theta))
    less, more = small / (1 + small), 1 / (1 + small)
    return np.where(theta > 0, more, less), np.where(theta > 0, less, more)


def _circles(eta, n, first, owner, size, cases):
    """Per set the shift of eta at which members drawn by their log odds are
    `cases` on average, an odd number of points on the circle of that radius, and
    the last of them in its upper half that matters. With an odd number no point
    is a zero of the product's factors."""
    at = np.log(cases / (size - cases))
    low, high = at - np.maximum.reduceat(eta, first), at - np.minimum.reduceat(eta, first)
    shift = (low + high) / 2
    for _ in range(60):
        drawn, left = _odds(eta + shift[owner])
        off = np.add.reduceat(n * drawn, first) - cases
        spread = np.add.reduceat(n * drawn * left, first)
        if np.all(np.abs(off) <= 1e-3 * np.sqrt(spread)):
            break
        low, high = np.where(off < 0, shift, low), np.where(off > 0, shift, high)
        with np.errstate(all="ignore"):
            step = shift - off / spread
        shift = np.where((low < step) & (step < high), step, (low + high) / 2)
    # Numbers drawn farther from the mean than this are that rare (Bernstein).
    reach = _FAR / 3 + np.sqrt(_FAR**2 / 9 + 2 * _FAR * spread)
    points = np.minimum(size + 1, np.ceil(reach) + 1)
    points += 1 - points % 2
    # The product falls at least as exp(-spread (1 - cos angle)).
    angle = np.arccos(np.maximum(1 - _FAR / np.maximum(spread, 1e-300), -1.0))
    last = np.minimum((points - 1) / 2, np.floor(angle / (2 * np.pi) * points))
    return shift, points, last


def _at_point(theta, n, x, first, angle, owner):
    """Sums over the members of each set at its point of the circle: logarithm
    of the product over its value at angle 0, and its derivatives."""
    drawn, _ = _odds(theta)
    turn = np.exp(1j * angle)[owner]
    part = drawn * (turn - 1)
    share = drawn * turn / (1 + part)
    log = np.add.reduceat(n * np.log1p(part), first)
    one = np.add.reduceat((n * share)[:, None] * x, first)
    two = np.add.reduceat((n * share * (1 - share))[:, None, None] * x[:, :, None] * x[:, None, :], first)
    return log, one, two


class _Circle:
    """Sums over the points of the circles of some sets."""

    def __init__(self, sets: int, p: int):
        self.total, self.mean, self.second = np.zeros(sets), np.zeros((sets, p)), np.zeros((sets, p, p))

    def add(self, use, point, log, one, two, angle, cases) -> None:
        """A point of the upper half stands for its mirror image as well."""
        c = np.exp(log - 1j * angle * cases) * (2.0 if point else 1.0)
        self.total[use] += c.real
        self.mean[use] += (c[:, None] * one).real
        self.second[use] += (c[:, None, None] * (one[:, :, None] * one[:, None, :] + two)).real

    def moments(self, points):
        """Log probability of the number of cases, and mean and covariance of
        their sum of x."""
        mean = self.mean / self.total[:, None]
        spread = self.second / self.total[:, None, None] - mean[:, :, None] * mean[:, None, :]
        return np.log(self.total / points), mean, spread


def _one_case(eta, n, x, first, owner):
    """Log denominator, mean and covariance of the sets' x with one case."""
    top = np.maximum.reduceat(eta, first)
    w = n * np.exp(eta - top[owner])
    s0 = np.add.reduceat(w, first)
    share = w / s0[owner]
    mean = np.add.reduceat(share[:, None] * x, first)
    off = x - mean[owner]
    spread = np.add.reduceat(share[:, None, None] * off[:, :, None] * off[:, None, :], first)
    return top + np.log(s0), mean, spread


def _several_cases(eta, n, x, first, owner, size, cases):
    """The same with several cases, of their sum of x."""
    shift, points, last = _circles(eta, n, first, owner, size, cases)
    theta = eta + shift[owner]
    drawn, _ = _odds(theta)
    centre = np.add.reduceat((n * drawn)[:, None] * x, first) / np.add.reduceat(n * drawn, first)[:, None]
    off = x - centre[owner]
    found = _Circle(len(first), x.shape[1])
    for k in range(int(last.max()) + 1):
        use = np.flatnonzero(last >= k)
        angle = 2 * np.pi * k / points[use]
        some, begin, of = _subset(use, first, owner)
        found.add(use, k, *_at_point(theta[some], n[some], off[some], begin, angle, of), angle, cases[use])
    chance, mean, spread = found.moments(points)
    base = np.add.reduceat(n * np.logaddexp(0.0, theta), first) - cases * shift
    return base + chance, cases[:, None] * centre + mean, spread


def _subset(use, first, owner):
    """Members of some sets, where each set begins among them, and their sets."""
    keep_set = np.zeros(len(first), bool)
    keep_set[use] = True
    some = np.flatnonzero(keep_set[owner])
    of = (np.cumsum(keep_set) - 1)[owner[some]]
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    return some, begin, of


def _sums(beta: np.ndarray, n, hits, x, owner, size, cases, many) -> np.ndarray:
    """Log likelihood, score, information, members and number of some sets, whose
    members stand one set after the other."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    eta = x @ beta
    parts = np.zeros(3 + len(beta) + len(beta) ** 2)
    for single in (True, False):
        use = np.flatnonzero((cases == 1) == single)
        if not len(use):
            continue
        some, begin, of = _subset(use, first, owner)
        given = eta[some], n[some], x[some], begin, of
        below, mean, spread = _one_case(*given) if single else _several_cases(*given, size[use], cases[use])
        own = np.add.reduceat((hits[some])[:, None] * x[some], begin)
        k = many[use]
        parts += pack(
            k @ (np.add.reduceat(hits[some] * eta[some], begin) - below), k @ (own - mean),
            np.tensordot(k, spread, 1), k @ size[use], k.sum(),
        )
    return parts


def _small_sets(blocks: DataFrame, beta: np.ndarray) -> DataFrame:
    """(model, vec): the sums of the sets that are one row each."""
    p = len(beta)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 + p + p * p)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            size, cases, many = (as_vector(batch.column(c)) for c in ("size", "cases", "many"))
            n, hits, x = (as_vector(batch.column(c).flatten()) for c in ("n", "hits", "x"))
            x = x.reshape(-1, p)
            ends = np.cumsum(batch.column("n").value_lengths().to_numpy(zero_copy_only=False))
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            a = 0
            while a < len(ends):
                start = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, start + _CHUNK // p**2, side="right")))
                at = slice(start, ends[b - 1])
                total += _sums(beta, n[at], hits[at], x[at], owner[at] - a, size[a:b], cases[a:b], many[a:b])
                a = b
        yield pa.RecordBatch.from_arrays(
            [pa.array(["model"]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["model", "vec"]
        )

    return blocks.mapInArrow(values, "model string, vec array<double>")


def _large_sets(rows: DataFrame, beta: np.ndarray) -> DataFrame:
    """(model, vec) of each larger set from its members (key, n, hits, x, size,
    cases, many), which are never in one task together."""
    p = len(beta)
    eta = " + ".join(f"x[{i}] * {float(b)!r}D" for i, b in enumerate(beta))
    rows = rows.withColumn("eta", F.expr(eta))
    counted = rows.groupBy("key", F.floor(F.col("eta") * _PER_ETA).alias("cell")).agg(
        *[F.first(c).alias(c) for c in ("size", "cases", "many")],
        F.sum("n").alias("n"), (F.sum(F.expr("n * eta")) / F.sum("n")).alias("eta"),
        F.array(*[F.sum(F.expr(f"n * x[{i}]")) for i in range(p)]).alias("x"),
    )

    def circle(key: tuple, table: pa.Table) -> pa.Table:
        n, eta, size, cases, many = (as_vector(table.column(c)) for c in ("n", "eta", "size", "cases", "many"))
        x = as_vector(table.column("x").combine_chunks().flatten()).reshape(-1, p)
        first, owner = np.zeros(1, int), np.zeros(len(n), int)
        shift, points, last = _circles(eta, n, first, owner, size[:1], cases[:1])
        drawn, _ = _odds(eta + shift)
        out = {"_key": [key[0].as_py()], "shift": shift, "points": points, "last": last, "centre": [(drawn @ x / (drawn @ n)).tolist()]}
        return pa.table(out | {"_size": size[:1], "_cases": cases[:1], "_many": many[:1]})

    def members(_: str, c: dict[str, np.ndarray]) -> np.ndarray:
        theta, first, owner = c["eta"] + c["shift"], np.zeros(1, int), np.zeros(len(c["eta"]), int)
        off = c["x"] - c["centre"]
        out = [c["n"] @ np.logaddexp(0.0, theta), c["hits"] @ c["eta"], c["hits"] @ c["x"]]
        for k in range(int(c["last"][0]) + 1):
            angle = 2 * np.pi * k / c["points"][:1]
            for v in _at_point(theta, c["n"], off, first, angle, owner):
                out += [v.real, v.imag]
        return pack(*out)

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = []
            for r in batch.to_pylist():
                points, size, cases, many = (np.array([r[c]]) for c in ("points", "_size", "_cases", "_many"))
                base, ee, ex, *rest = unpack(np.array(r["sums"]), (), (), (p,), *[(1,), (1,), (1, p), (1, p), (1, p, p), (1, p, p)] * (int(r["last"]) + 1))
                found = _Circle(1, p)
                for k in range(int(r["last"]) + 1):
                    log, one, two = (rest[6 * k + i] + 1j * rest[6 * k + i + 1] for i in (0, 2, 4))
                    found.add(slice(None), k, log, one, two, 2 * np.pi * k / points, cases)
                chance, mean, spread = found.moments(points)
                below = base - cases * r["shift"] + chance
                mean = cases[:, None] * np.array(r["centre"]) + mean
                vecs.append((many * pack(ee - below, ex - mean, spread, size, 1.0)).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(["model"] * len(vecs), pa.string()), pa.array(vecs, pa.list_(pa.float64()))], names=["model", "vec"]
            )

    circles = counted.groupBy("key").applyInArrow(
        circle, "_key string, shift double, points double, last double, centre array<double>, _size double, _cases double, _many double"
    )
    near = rows.join(circles, F.col("key") == F.col("_key")).sortWithinPartitions("key")
    near = near.select(F.col("key").alias("model"), "eta", "n", "hits", "x", "shift", "points", "last", "centre")
    sums = grouped_sums(near, members, "sums").withColumnRenamed("model", "key")
    return sums.join(circles, F.col("key") == F.col("_key")).drop("key", "_key").mapInArrow(
        whole_sets, "model string, vec array<double>"
    )


def _as_rows(members: DataFrame) -> DataFrame:
    """Each set with cases and controls as one row; other sets say nothing about
    the coefficients."""
    sets = members.groupBy("set").agg(
        F.sum("n").alias("size"), F.sum("hits").alias("cases"), F.max("many").alias("many"),
        F.collect_list(F.struct("n", "hits", "x")).alias("c"),
    )
    return sets.where("cases >= 1 and cases < size").select(
        "size", "cases", "many", F.expr("c.n").alias("n"), F.expr("c.hits").alias("hits"), F.flatten(F.expr("c.x")).alias("x")
    )


def _apart(members: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The members of sets of up to `most` different ones, and those of larger
    sets with what is known of the set."""
    sets = members.groupBy(F.col("set").alias("_set")).agg(
        F.count("*").alias("cells"), F.sum("n").alias("size"), F.sum("hits").alias("cases"), F.max("many").alias("_many")
    )
    large = sets.where(F.col("cells") > most)
    on = F.col("set") == F.col("_set")
    rows = members.join(large.where("cases >= 1 and cases < size"), on).select(
        F.to_json(F.struct("set")).alias("key"), "n", "hits", "x", "size", "cases", F.col("_many").alias("many")
    )
    return members.join(large, on, "left_anti"), rows


def fit_clogit(
    design: DataFrame, labels: list[str], name: str = "clogit", tol: float = 1e-10,
    max_iter: int = 30,
) -> Fitted:
    """Newton steps, each one pass over the sets; sets with several cases enter
    with the exact conditional likelihood. A set of n different members costs
    some 30 n p^2 a step, whatever its number of cases."""
    p = len(labels)
    most = _VALUES // (p + 2)
    members = keep(design.groupBy("set", "x").agg(
        F.count("*").cast("double").alias("n"), F.sum("case").alias("hits"), F.max("many").alias("many")
    ))
    kept = [members]

    def step(beta: np.ndarray):
        total = np.zeros(3 + p + p * p)
        for sets, of in parts:
            total += sum_vectors(of(sets, beta), lambda _, c: c["vec"].sum(0)).get("model", 0.0)
        ll, score, info, n, k = unpack(total, (), (p,), (p, p), (), ())
        if not k:
            raise ValueError("no matched set has a case and a control")
        return ll, score, info, int(n), int(k)

    try:
        whole_rows = members.where(whole("x"))
        cells = whole_rows.groupBy("set").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
        small, large = _apart(whole_rows, most) if cells > most else (whole_rows, None)
        parts = [(keep(_as_rows(small)), _small_sets)]
        if large is not None:
            parts.append((keep(large), _large_sets))
        kept += [sets for sets, _ in parts]
        beta = np.zeros(p)
        ll, score, info, n, sets = step(beta)
        for iteration in range(1, max_iter + 1):
            move, inv = solve_information(info, score)
            while True:
                trial = step(beta + move)
                if trial[0] >= ll - tol * abs(ll) or np.max(np.abs(move)) < 1e-12:
                    break
                move = move / 2.0
            beta = beta + move
            settled = abs(trial[0] - ll) <= tol * (abs(ll) + 1e-3)
            ll, score, info, n, sets = trial
            if settled:
                break
        else:
            raise ValueError(f"no convergence in {max_iter} steps")
        _, inv = solve_information(info, score)
    finally:
        for df in kept:
            df.unpersist()
    return Fitted(
        name, labels, beta, inv, n, ll, n_event=sets, iterations=iteration, converged=settled
    )
