"""Linear quantile regression.

The check loss is minimised as a bounded linear program by a primal-dual
interior-point path. Equal rows are counted first, so ties cost one row each and
their count is the bound of their dual variable. A row's duals follow from the
few numbers of the steps taken so far, so nothing is kept per row: each pass
replays the steps, and only sums reach the driver. The path ends when the loss
of the coefficients and the lower bound from the duals agree; a fit that does
not get there is an error.

A row on a known side of the fit adds a linear term to the loss, so of many rows
only those near the fit need the path: Newton steps on a smoothed loss over all
rows come near it, rows farther away than a band enter as their sums, and after
the path a pass over all rows confirms that each is on its side. Where one is
not, the band is widened and the path is run again, at last over all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.tails import normal_quantile
from lagloom.models.fitted import Fitted
from lagloom.models.moments import as_matrix, as_vector, keep, pack, solve_information, sum_vectors, unpack

# Relative gap between loss and lower bound at which a fit is accepted.
GAP = 1e-9
# Weight, in rows, on a small first coefficient: of several minima it picks the
# one at the lower end.
_LEAN = 1e-3
_STEPS = 200
# Up to this many counted rows the path runs over all of them; of more, it gets
# about _NEAR rows per quantile.
_WHOLE = 200_000
_NEAR = 100_000
# Elements of the design of a band that one task holds.
_TASK = 2_000_000
# Half width of a band in widths of the smoothed loss, and passes that look for it.
_REACH = 4.0
_LOOKS = 60
# Step lengths tried, and the share of the way to the boundary that is taken.
_LENGTHS = np.concatenate([np.linspace(1.0, 0.05, 96), 0.05 * 0.7 ** np.arange(1, 30)])
_INSIDE = 0.98


class _Sides:
    """What is known of the rows outside a band: sums of their rows and responses
    (weighted), above and below the fit."""

    def __init__(self, p: int):
        self.x_above, self.x_below = np.zeros(p), np.zeros(p)
        self.y_above = self.y_below = 0.0

    def loss(self, beta: np.ndarray, tau: float) -> float:
        above, below = self.y_above - self.x_above @ beta, self.y_below - self.x_below @ beta
        return tau * above + (tau - 1) * below


class _Path:
    """One quantile's steps: (direction, centring, primal and dual length). With
    `sides` its rows are those of a band, and duals start at the share of the
    band that lies above."""

    def __init__(self, tau: float, start: np.ndarray, offset: float, sides: _Sides | None = None, share: float = 0.0):
        self.tau, self.start, self.offset, self.sides = tau, start, offset, sides
        self.share = 1 - tau if sides is None else share
        self.steps: list[tuple[np.ndarray, float, float, float]] = []
        self.beta = start.copy()
        self.gap = self.loss = math.inf
        self.settled = False

    def state(self, c: dict[str, np.ndarray]):
        """Duals a (and their slack s) and multipliers z, v of a block of rows.
        A block that stays in memory, of one path alone, has a place for them,
        `held`, from which the next steps go on."""
        x, y, w = c["x"], c["y"], c["w"]
        held = c.get("held")
        if held:
            done, (a, s, z, v) = held
        else:
            a = self.share * w
            s = w - a
            r = x @ self.start - y
            z = np.maximum(r, 0.0) + self.offset
            done, v = 0, z - r
        for move, centre, primal, dual in self.steps[done:]:
            da, dz, dv = _direction(x, a, s, z, v, move, centre)
            a, s, z, v = a + primal * da, s - primal * da, z + dual * dz, v + dual * dv
        if "held" in c:
            c["held"] = len(self.steps), (a, s, z, v)
        return a, s, z, v


def _direction(x, a, s, z, v, move, centre):
    da = (x @ move + centre * (1 / a - 1 / s) - (z - v)) / (z / a + v / s)
    return da, (centre - z * da) / a - z, (centre + v * da) / s - v


def _solve(rows: DataFrame, paths: dict[float, _Path], scale, total, response, p, in_tasks=False) -> None:
    """All quantiles at once, two passes a step. Rows belong to every path, or to
    the one whose quantile they name as their model if it has `sides`; with
    `in_tasks` those of such a path are few enough for one task."""
    if in_tasks:
        return _solve_in_tasks(rows, paths, scale, total, response, p)
    _follow(lambda of: sum_vectors(rows, of), paths, scale, total, response, p)


def _solve_in_tasks(rows: DataFrame, paths: dict[float, _Path], scale, total, response, p) -> None:
    """A task takes all steps of its path."""

    def solved(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        cols = {"x": as_matrix(table.column("x")), "held": None}
        cols |= {c: as_vector(table.column(c)) for c in ("y", "w")}
        mine = {t: path for t, path in paths.items() if repr(t) == name}
        _follow(lambda of: {name: of(name, cols)}, mine, scale, total, response, p)
        ((t, path),) = mine.items()
        return pa.table({"tau": [t], "beta": [path.beta.tolist()], "gap": [path.gap], "loss": [path.loss], "settled": [path.settled]})

    found = rows.groupBy("model").applyInArrow(solved, "tau double, beta array<double>, gap double, loss double, settled boolean")
    for r in found.collect():  # one row per quantile
        path = paths[r.tau]
        path.beta, path.gap, path.loss, path.settled = np.array(r.beta), r.gap, r.loss, r.settled


def _follow(summed, paths: dict[float, _Path], scale, total, response, p) -> None:
    """The steps of the paths. `summed` gives the sums of a block function over
    all rows; `total` and `response` are the sums of all rows and responses."""
    open_ = list(paths)
    banded = any(path.sides for path in paths.values())
    lean = np.zeros(p)
    lean[0] = _LEAN

    def gather(block, chosen, size):
        """The sums of `block(path, columns)` of each chosen quantile."""

        def of(model: str, c):
            mine = [t for t in chosen if not banded or model == repr(t)]
            return pack(*[v for t in mine for v in block(paths[t], c)]) if mine else np.zeros(0)

        found = summed(of)
        if banded:
            return {t: found.get(repr(t), np.zeros(size)) for t in chosen}
        return dict(zip(chosen, np.split(next(iter(found.values())), len(chosen)), strict=True))

    def sums(path: _Path, c):
        t = path.tau
        a, s, z, v = path.state(c)
        q = 1 / (z / a + v / s)
        r = c["y"] - c["x"] @ path.beta
        loss = np.sum(c["w"] * r * (t - (r < 0)))
        return [
            (c["x"] * q[:, None]).T @ c["x"], c["x"].T @ (q * (z - v)),
            c["x"].T @ (q * (1 / a - 1 / s)), c["x"].T @ a,
            np.sum(a * z + s * v), loss, np.sum(c["y"] * a), 2 * len(a),
        ]

    shapes = [(p, p), (p,), (p,), (p,), (), (), (), ()]
    for _ in range(_STEPS):
        got = gather(sums, tuple(open_), p * p + 3 * p + 4)
        moves = {}
        for t in list(open_):
            curve, pull, push, xa, slack, loss, ya, count = unpack(got[t], *shapes)
            path = paths[t]
            bound = ya - (1 - t) * response
            if path.sides:
                loss += path.sides.loss(path.beta, t)
                bound += path.sides.y_above
                xa = xa + path.sides.x_above
            left = (1 - t) * total + lean - xa
            path.loss = loss
            before, path.gap = path.gap, loss + _LEAN * path.beta[0] - bound
            fine = min(GAP * abs(loss), 1e-2 * _LEAN * scale)
            # In a band the duals start off their constraints: until they meet
            # them, the bound does not hold.
            held = not path.sides or np.abs(left) @ np.abs(path.beta) <= fine
            # Beyond the wanted gap, steps go on while they still gain.
            if held and (path.gap <= fine or path.gap <= GAP * abs(loss) and path.gap > 0.7 * before):
                open_.remove(t)
                path.settled = True
                continue
            last = min(path.steps[-1][2:]) if path.steps else 0.55
            centre = min(0.8, max(0.05, (1 - last) ** 2)) * slack / max(count, 1.0)
            move, _ = solve_information(curve, pull - centre * push + left)
            moves[t] = (move, centre)
        if not open_:
            return

        def reach(path: _Path, c, moves=moves):
            move, centre = moves[path.tau]
            a, s, z, v = path.state(c)
            da, dz, dv = _direction(c["x"], a, s, z, v, move, centre)
            parts = []
            for use in (np.maximum(-da / a, da / s), np.maximum(-dz / z, -dv / v)):
                # The first length that this row allows.
                fits = np.searchsorted(-_LENGTHS * 1.0, -_INSIDE / np.maximum(use, 1e-300))
                parts.append(np.bincount(fits, minlength=len(_LENGTHS) + 1))
            return parts

        got = gather(reach, tuple(moves), 2 * len(_LENGTHS) + 2)
        for t, (move, centre) in moves.items():
            counts = got[t].reshape(2, -1)
            if not counts.any(axis=1).all():
                return  # no row in the band
            at = [int(np.flatnonzero(c)[-1]) for c in counts]
            if max(at) == len(_LENGTHS):
                return
            path = paths[t]
            primal, dual = float(_LENGTHS[at[0]]), float(_LENGTHS[at[1]])
            path.steps.append((move, centre, primal, dual))
            path.beta = path.beta - dual * move


def _near(rows: DataFrame, taus, start, scale, gram, n) -> dict[float, tuple[np.ndarray, float]]:
    """Coefficients close to each fit and the half width of the band around them
    that holds about _NEAR rows: Newton steps on the check loss smoothed by a
    logistic curve whose width shrinks as they settle."""
    p = len(start)
    width = dict.fromkeys(taus, scale)
    trial = {t: start.copy() for t in taus}
    base: dict[float, tuple] = {}
    found: dict[float, tuple[np.ndarray, float]] = {}
    for _ in range(_LOOKS):
        chosen = tuple(t for t in taus if t not in found)
        if not chosen:
            break

        def smooth(_: str, c, chosen=chosen):
            parts = []
            for t in chosen:
                h, r = width[t], c["y"] - c["x"] @ trial[t]
                side = 0.5 * (1 + np.tanh(0.5 * r / h))
                k = c["w"] * side * (1 - side) / h
                parts += [
                    (c["x"] * k[:, None]).T @ c["x"], c["x"].T @ (c["w"] * (t - 1 + side)),
                    c["w"] @ (t * r + h * np.logaddexp(0.0, -r / h)), np.sum(np.abs(r) <= _REACH * h),
                ]
            return pack(*parts)

        vec = next(iter(sum_vectors(rows, smooth).values()))
        pieces = unpack(vec, *([(p, p), (p,), (), ()] * len(chosen)))
        for i, t in enumerate(chosen):
            curve, slope, loss, inside = pieces[4 * i : 4 * i + 4]
            if t in base and loss > base[t][1] * (1 + 1e-12):
                at, best, step = base[t]
                base[t] = (at, best, 0.25 * step)
                trial[t] = at + 0.25 * step
                continue
            step, _ = solve_information(curve, slope)
            base[t] = (trial[t], loss, step)
            if math.sqrt(max(step @ gram @ step, 0.0) / n) <= 0.25 * width[t]:
                if inside <= _NEAR or width[t] <= 1e-6 * scale:
                    found[t] = (trial[t], _REACH * width[t])
                    continue
                width[t] /= 4
                del base[t]
            trial[t] = trial[t] + step
    for t in taus:
        found.setdefault(t, (trial[t], _REACH * width[t]))
    return found


def _solve_near(rows: DataFrame, taus, start, scale, gram, total, response, n, p) -> dict[float, _Path]:
    """The paths of all quantiles, each over the rows of a band and the sums of
    the rows on both sides of it."""
    bands = _near(rows, taus, start, scale, gram, n)
    done: dict[float, _Path] = {}
    while len(done) < len(taus):
        open_ = tuple(t for t in taus if t not in done)

        def outside(_: str, c, open_=open_):
            parts = []
            for t in open_:
                at, half = bands[t]
                r = c["y"] - c["x"] @ at
                above, below = c["w"] * (r > half), c["w"] * (r < -half)
                parts += [c["x"].T @ above, c["x"].T @ below, c["y"] @ above, c["y"] @ below, np.sum(np.abs(r) <= half)]
            return pack(*parts)

        pieces = unpack(next(iter(sum_vectors(rows, outside).values())), *([(p,), (p,), (), (), ()] * len(open_)))
        paths, most = {}, 0
        for i, t in enumerate(open_):
            sides = _Sides(p)
            sides.x_above, sides.x_below, sides.y_above, sides.y_below, inside = pieces[5 * i : 5 * i + 5]
            most = max(most, inside)
            # Rows of the band above the fit, by the first column.
            first = total[0] - sides.x_above[0] - sides.x_below[0]
            share = ((1 - t) * total[0] - sides.x_above[0]) / first if first else 0.5
            at, half = bands[t]
            paths[t] = _Path(t, at, 0.5 * half, sides, min(0.9, max(0.1, share)))

        band = rows.mapInArrow(_in_bands({t: bands[t] for t in open_}), "model string, y double, x array<double>, w double")
        small = most * p <= _TASK
        band = band if small else keep(band)
        try:
            _solve(band, paths, scale, total, response, p, small)
        finally:
            band.unpersist()

        def strayed(_: str, c, open_=open_, paths=paths):
            parts = []
            for t in open_:
                at, half = bands[t]
                before, after = c["y"] - c["x"] @ at, c["y"] - c["x"] @ paths[t].beta
                parts.append(np.sum((before > half) & (after < 0) | (before < -half) & (after > 0)))
            return pack(*parts)

        counts = next(iter(sum_vectors(rows, strayed).values()))
        for t, lost in zip(open_, counts, strict=True):
            path, (at, half) = paths[t], bands[t]
            if lost == 0 and path.gap <= GAP * abs(path.loss) and path.settled:
                done[t] = path
            elif math.isinf(half):
                raise ValueError(f"quantile fit at {t} did not reach its lower bound")
            else:
                wider = 8 * half
                bands[t] = (at, wider if wider < 8 * scale else math.inf)
    return done


def _in_bands(bands: dict[float, tuple[np.ndarray, float]]):
    """Rows (model, y, x, w) of each band, with the quantile as their model."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = as_matrix(batch.column("x")), as_vector(batch.column("y"))
            for t, (at, half) in bands.items():
                inside = pa.array(np.abs(y - x @ at) <= half)
                part = batch.filter(inside)
                names = pa.array([repr(t)] * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [names, part.column("y"), part.column("x"), part.column("w")], names=["model", "y", "x", "w"]
                )

    return rows


def fit_quantile(
    design: DataFrame,
    labels: list[str],
    taus: list[float],
    name: str = "quantile",
) -> list[Fitted]:
    """Fit a design (model, y, x) at several quantiles. Errors come from the
    kernel sandwich with the Hall-Sheather bandwidth.

    Where the minimum is not unique, the fit leans to the smallest first
    coefficient."""
    p = len(labels)
    counted = design.groupBy("model", "y", "x").agg(F.count("*").cast("double").alias("w"))
    kept = keep(counted.select("model", "y", "x", "w"))
    try:
        def least_squares(_: str, c):
            x, y, w = c["x"], c["y"], c["w"]
            xw = x * w[:, None]
            return pack(xw.T @ x, xw.T @ y, w @ (y * y), w.sum(), xw.sum(0), w @ y, len(y))

        sums = sum_vectors(kept, least_squares)
        if not sums:
            raise ValueError("no complete rows to fit")
        gram, xy, yy, n, total, response, size = unpack(
            next(iter(sums.values())), (p, p), (p,), (), (), (p,), (), ()
        )
        start, inv = solve_information(gram, xy)
        if not np.all(np.isfinite(np.diag(inv))):
            raise ValueError("the columns of the design are linearly dependent")
        scale = math.sqrt(max(yy - start @ xy, 0.0) / max(n, 1.0)) or 1.0
        if size > _WHOLE:
            paths = _solve_near(kept, taus, start, scale, gram, total, response, n, p)
        else:
            paths = {t: _Path(t, start, 0.5 * scale) for t in taus}
            _solve(kept, paths, scale, total, response, p)
            lost = [t for t in taus if not paths[t].settled]
            if lost:
                raise ValueError(f"quantile fits at {lost} did not reach their lower bound")
        betas = {t: paths[t].beta for t in taus}

        def residual_size(_: str, c):
            r = [c["y"] - c["x"] @ betas[t] for t in taus]
            return pack(*[c["w"] @ np.minimum(np.abs(v), 3 * scale) for v in r])

        spread = next(iter(sum_vectors(kept, residual_size).values())) / n
        spread = np.maximum(spread * 1.2533, 1e-12)
        width = [_bandwidth(t, s, n) for t, s in zip(taus, spread, strict=True)]

        def curvature(_: str, c):
            out = []
            for t, h in zip(taus, width, strict=True):
                u = (c["y"] - c["x"] @ betas[t]) / h
                k = c["w"] * np.exp(-0.5 * u * u) / (math.sqrt(2 * math.pi) * h)
                out.append((c["x"] * k[:, None]).T @ c["x"])
            return pack(*out)

        curves = unpack(
            next(iter(sum_vectors(kept, curvature).values())), *([(p, p)] * len(taus))
        )
    finally:
        kept.unpersist()
    fits = []
    for t, d in zip(taus, curves, strict=True):
        _, inv = solve_information(d, np.zeros(p))
        cov = t * (1 - t) * inv @ gram @ inv
        fits.append(
            Fitted(f"{name}_q{t:g}", labels, betas[t], cov, int(n), loglik=-paths[t].loss,
                   converged=True)
        )
    return fits


def _bandwidth(t: float, spread: float, n: float) -> float:
    z = normal_quantile(t)
    f = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    q = normal_quantile(0.975)
    h = n ** (-1 / 3) * q ** (2 / 3) * (1.5 * f * f / (2 * z * z + 1)) ** (1 / 3)
    h = min(h, 0.999 * min(t, 1 - t))
    return spread * (normal_quantile(t + h) - normal_quantile(t - h)) / 2.0
