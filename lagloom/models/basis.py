"""Basis functions of one variable.

Every basis is held as a table of polynomial pieces: on each interval between
breaks, each column is a polynomial in (x - origin). One evaluator then serves
all kinds: as a Spark expression that computes only the piece a row falls in,
and in numpy for small grids. The constants are frozen when the basis is made,
so training rows and prediction grids use the same functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.operators.scans import exact_percentiles


def _num(v: float) -> str:
    return repr(float(v)) + "D"


@dataclass(frozen=True)
class Basis:
    """`coefs[piece, column, power]`, powers of (x - origins[piece]); a value
    equal to a break belongs to the piece above it."""

    kind: str
    breaks: np.ndarray
    origins: np.ndarray
    coefs: np.ndarray
    about: dict = field(default_factory=dict)

    @property
    def width(self) -> int:
        return self.coefs.shape[1]

    def values(self, x) -> np.ndarray:
        """Rows of basis values for a small array of x."""
        x = np.asarray(x, float)
        piece = np.searchsorted(self.breaks, x, side="right")
        u = x - self.origins[piece]
        c = self.coefs[piece]
        out = np.zeros(c.shape[:2])
        for power in range(c.shape[2] - 1, -1, -1):
            out = out * u[:, None] + c[:, :, power]
        return out

    def sql(self, x: str) -> str:
        """Spark SQL for the array of basis values at the column or variable
        `x`; a null x gives null. Runs of zero columns are array_repeat terms,
        so a spline with many knots stays a short expression."""
        arms = []
        for piece in range(len(self.origins)):
            arms.append(self._piece_sql(piece, x))
        if len(arms) == 1:
            return f"CASE WHEN {x} IS NOT NULL THEN {arms[0]} END"
        text = f"CASE WHEN {x} IS NULL THEN NULL"
        for cut, arm in zip(self.breaks, arms, strict=False):
            text += f" WHEN {x} < {_num(cut)} THEN {arm}"
        return f"{text} ELSE {arms[-1]} END"

    def column(self, x: str) -> Column:
        return F.expr(self.sql(f"cast({x} as double)"))

    def _piece_sql(self, piece: int, x: str) -> str:
        c = self.coefs[piece]
        used = np.flatnonzero(np.any(c != 0.0, axis=1))
        if not len(used):
            return f"array_repeat(0D, {self.width})"
        first, last = used[0], used[-1]
        origin = self.origins[piece]
        u = x if origin == 0.0 else f"({x} - {_num(origin)})"
        terms = ", ".join(self._poly_sql(c[j], u) for j in range(first, last + 1))
        parts = [f"array({terms})"]
        if first > 0:
            parts.insert(0, f"array_repeat(0D, {first})")
        if last < self.width - 1:
            parts.append(f"array_repeat(0D, {self.width - 1 - last})")
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    @staticmethod
    def _poly_sql(c: np.ndarray, u: str) -> str:
        top = len(c) - 1
        while top > 0 and c[top] == 0.0:
            top -= 1
        text = _num(c[top])
        for power in range(top - 1, -1, -1):
            text = f"({_num(c[power])} + {u} * {text})"
        return text


# --- kinds -----------------------------------------------------------------


def _single_piece(kind: str, columns: list[list[float]], about: dict, origin: float = 0.0) -> Basis:
    size = max(len(c) for c in columns)
    coefs = np.array([[c + [0.0] * (size - len(c)) for c in columns]], float)
    return Basis(kind, np.array([]), np.array([origin]), coefs, about)


def linear(intercept: bool = False) -> Basis:
    columns = ([[1.0]] if intercept else []) + [[0.0, 1.0]]
    return _single_piece("lin", columns, {"intercept": intercept})


def polynomial(degree: int, scale: float, intercept: bool = False) -> Basis:
    powers = range(0 if intercept else 1, degree + 1)
    columns = [[0.0] * d + [scale ** -float(d)] for d in powers]
    return _single_piece(
        "poly", columns, {"degree": degree, "scale": scale, "intercept": intercept}
    )


def chebyshev(degree: int, lo: float, hi: float, intercept: bool = False) -> Basis:
    """Chebyshev polynomials over the range of the variable. Beside the constant
    they span the same functions as the powers, but stay apart from each other
    when the range is narrow and far from zero."""
    middle, half = (lo + hi) / 2.0, (hi - lo) / 2.0
    if not half > 0:
        raise ValueError("Chebyshev polynomials need a variable that is not constant")
    columns = []
    for d in range(0 if intercept else 1, degree + 1):
        powers = np.polynomial.chebyshev.cheb2poly([0.0] * d + [1.0])
        columns.append([float(c) * half ** -float(k) for k, c in enumerate(powers)])
    about = {"degree": degree, "boundary": [lo, hi], "intercept": intercept}
    return _single_piece("cheb", columns, about, middle)


def threshold(at: Sequence[float], side: str = "h", intercept: bool = False) -> Basis:
    """'h': max(x - c, 0); 'l': max(c - x, 0); 'd': the low line below the first
    value and the high line above the last."""
    at = [float(v) for v in at]
    low_cut, high_cut = at[0], at[-1]
    if side == "l":
        breaks, lines = [low_cut], [("low", low_cut)]
    elif side == "h":
        breaks, lines = [high_cut], [("high", high_cut)]
    elif side == "d":
        breaks = sorted({low_cut, high_cut})
        lines = [("low", low_cut), ("high", high_cut)]
    else:
        raise ValueError("side must be 'h', 'l' or 'd'")
    edges = [-np.inf, *breaks, np.inf]
    origins = np.array([0.0] * (len(breaks) + 1))
    width = len(lines) + int(intercept)
    coefs = np.zeros((len(origins), width, 2))
    if intercept:
        coefs[:, 0, 0] = 1.0
    for j, (name, cut) in enumerate(lines, start=int(intercept)):
        for piece in range(len(origins)):
            if name == "high" and edges[piece] >= cut:
                coefs[piece, j] = [-cut, 1.0]
            if name == "low" and edges[piece + 1] <= cut:
                coefs[piece, j] = [cut, -1.0]
    about = {"side": side, "values": at, "intercept": intercept}
    return Basis("thr", np.array(breaks), origins, coefs, about)


def strata(breaks: Sequence[float], intercept: bool = False) -> Basis:
    """Interval indicators, closed on the left; without an intercept the first
    interval is the reference."""
    cuts = sorted(float(b) for b in breaks)
    coefs = np.eye(len(cuts) + 1)[:, :, None]
    if not intercept:
        coefs = coefs[:, 1:]
    about = {"breaks": cuts, "intercept": intercept}
    return Basis("strata", np.array(cuts), np.zeros(len(cuts) + 1), coefs, about)


def _bspline_pieces(degree: int, interior: Sequence[float], lo: float, hi: float):
    """Polynomial pieces of the full B-spline basis, by the recursion on
    coefficients inside each knot interval."""
    if not lo < hi:
        raise ValueError("a spline needs a variable that is not constant")
    interior = sorted(float(k) for k in interior)
    if interior and not (lo < interior[0] and interior[-1] < hi):
        raise ValueError("interior knots must lie inside the boundary knots")
    if len(set(interior)) != len(interior):
        raise ValueError("interior knots must be distinct")
    knots = np.array([lo] * (degree + 1) + interior + [hi] * (degree + 1))
    starts = np.array([lo, *interior])
    size = len(interior) + degree + 1
    coefs = np.zeros((len(starts), size, degree + 1))
    for piece, left in enumerate(starts):
        home = piece + degree
        level = np.zeros((len(knots) - 1, degree + 1))
        level[home, 0] = 1.0
        for k in range(1, degree + 1):
            nxt = np.zeros_like(level)
            for i in range(len(knots) - 1 - k):
                up, down = knots[i + k] - knots[i], knots[i + k + 1] - knots[i + 1]
                poly = np.zeros(degree + 1)
                if up > 0:
                    poly += (left - knots[i]) / up * level[i]
                    poly[1:] += level[i][:-1] / up
                if down > 0:
                    poly += (knots[i + k + 1] - left) / down * level[i + 1]
                    poly[1:] -= level[i + 1][:-1] / down
                nxt[i] = poly
            level = nxt
        coefs[piece] = level[:size]
    return starts, coefs


def bspline(
    degree: int, interior: Sequence[float], lo: float, hi: float, intercept: bool = False
) -> Basis:
    """B-splines; outside the boundary the end pieces continue. Without an
    intercept the first column is left out."""
    starts, coefs = _bspline_pieces(degree, interior, lo, hi)
    if not intercept:
        coefs = coefs[:, 1:]
    about = {
        "degree": degree, "knots": list(starts[1:]), "boundary": [lo, hi], "intercept": intercept
    }
    return Basis("bs", starts[1:], starts, coefs, about)


def natural(
    interior: Sequence[float], lo: float, hi: float, intercept: bool = False
) -> Basis:
    """Natural cubic splines: B-splines combined so that the second derivative
    is zero at both boundary knots, continued as straight lines outside.

    Two B-spline columns, one near each boundary, are eliminated; every other
    column keeps its local support."""
    starts, coefs = _bspline_pieces(3, interior, lo, hi)
    if not intercept:
        coefs = coefs[:, 1:]
    size = coefs.shape[1]
    span = hi - starts[-1]
    bend = np.vstack([2.0 * coefs[0, :, 2], 2.0 * coefs[-1, :, 2] + 6.0 * span * coefs[-1, :, 3]])
    left = 2 if intercept else 1
    right = size - 3
    if right == left:
        right = size - 2
    if right < left:
        left, right = right, left
    solved = [left, right]
    free = [j for j in range(size) if j not in solved]
    combine = np.zeros((size, len(free)))
    combine[free, range(len(free))] = 1.0
    combine[solved] = -np.linalg.solve(bend[:, solved], bend[:, free])
    combine[np.abs(combine) < 1e-14] = 0.0
    inner = np.einsum("pcd,cf->pfd", coefs, combine)
    powers = span ** np.arange(4)
    end_value = inner[-1] @ powers
    end_slope = inner[-1][:, 1:] @ (np.arange(1, 4) * span ** np.arange(3))
    zero = np.zeros(inner.shape[1])
    low_line = np.stack([inner[0, :, 0], inner[0, :, 1], zero, zero], axis=1)
    high_line = np.stack([end_value, end_slope, zero, zero], axis=1)
    full = np.concatenate([low_line[None], inner, high_line[None]])
    full[np.abs(full) < 1e-300] = 0.0
    about = {"knots": list(starts[1:]), "boundary": [lo, hi], "intercept": intercept}
    return Basis(
        "ns", np.array([*starts, hi]), np.array([lo, *starts, hi]), full, about
    )


# --- specifications and fitting ---------------------------------------------


@dataclass(frozen=True)
class BasisSpec:
    """What to build. Knots follow from `df` at equally spaced percentiles of
    the training values unless `knots` is given."""

    fun: str
    df: int | None = None
    degree: int = 3
    knots: tuple[float, ...] | None = None
    breaks: tuple[float, ...] = ()
    at: tuple[float, ...] = ()
    side: str = "h"
    scale: float | None = None
    boundary: tuple[float, float] | None = None
    intercept: bool = False

    def interior_count(self) -> int:
        if self.knots is not None or self.fun not in {"bs", "ns"}:
            return 0
        fixed = self.degree if self.fun == "bs" else 1
        count = (self.df or fixed + int(self.intercept)) - fixed - int(self.intercept)
        if count < 0:
            raise ValueError(f"df={self.df} is too small for {self.fun}")
        return count

    def probs(self) -> list[float]:
        n = self.interior_count()
        return [(i + 1) / (n + 1) for i in range(n)]


_CUSTOM: dict[str, Callable[[BasisSpec, float, float, list[float]], Basis]] = {}


def register_basis(name: str, build: Callable) -> None:
    """Add a kind of basis: `build(spec, lo, hi, knots)` returns a `Basis`."""
    _CUSTOM[name] = build


def build_basis(spec: BasisSpec, lo: float, hi: float, knots: Sequence[float]) -> Basis:
    """A basis from the range of the variable and its percentile knots."""
    knots = list(spec.knots) if spec.knots is not None else list(knots)
    if spec.boundary is not None:
        lo, hi = spec.boundary
    if spec.fun in _CUSTOM:
        return _CUSTOM[spec.fun](spec, lo, hi, knots)
    if spec.fun == "lin":
        return linear(spec.intercept)
    if spec.fun == "poly":
        return polynomial(spec.degree, spec.scale or max(abs(lo), abs(hi)), spec.intercept)
    if spec.fun == "cheb":
        return chebyshev(spec.degree, lo, hi, spec.intercept)
    if spec.fun == "thr":
        return threshold(spec.at, spec.side, spec.intercept)
    if spec.fun == "strata":
        return strata(spec.breaks, spec.intercept)
    if spec.fun == "bs":
        return bspline(spec.degree, knots, lo, hi, spec.intercept)
    if spec.fun == "ns":
        return natural(knots, lo, hi, spec.intercept)
    raise ValueError(f"unknown basis {spec.fun!r}")


def fit_basis(df: DataFrame, col: str, spec: BasisSpec) -> Basis:
    """Basis with constants from a column: its range and percentile knots."""
    return fit_bases(df, col, {"": spec}, None)[""]


def fit_bases(
    df: DataFrame, col: str, specs: dict[str, BasisSpec], group: str | None
) -> dict[str, Basis]:
    """One basis per population of the `group` column, constants computed
    within each population. The populations are those named in `specs`, so the
    result on the driver is as large as the specification."""
    keys = [group] if group else []
    rows = df.where(F.col(group).isin(list(specs))) if group else df
    probs = sorted({0.0, 1.0, *(p for s in specs.values() for p in s.probs())})
    found: dict[str, dict] = {}
    if len(probs) == 2:
        ends = rows.groupBy(*keys).agg(
            F.min(col).cast("double").alias("q0"), F.max(col).cast("double").alias("q1")
        )
    else:
        ends = exact_percentiles(rows, keys, col, {f"q{i}": p for i, p in enumerate(probs)})
    for r in ends.collect():  # one row per named population
        found[r[group] if group else ""] = {p: r[f"q{i}"] for i, p in enumerate(probs)}
    out = {}
    for name, spec in specs.items():
        if name not in found or found[name][0.0] is None:
            raise ValueError(f"no values of {col!r} for population {name!r}")
        f = found[name]
        out[name] = build_basis(spec, f[0.0], f[1.0], [f[p] for p in spec.probs()])
    return out


_PIECES = "model string, breaks array<double>, origins array<double>, coefs array<array<array<double>>>"


def basis_table(df: DataFrame, col: str, group: str, models: DataFrame, fun: str, dfs: Sequence[int]) -> DataFrame:
    """Bases as rows (model, breaks, origins, coefs), one per row of `models`
    (model, `group`, df), with constants from the model's population in `df`.

    Percentiles are searched for all populations together and the pieces are
    built where the rows are, so the number of models may grow with the data.
    `dfs` lists the sizes that occur."""
    specs = {d: BasisSpec(fun, df=d) for d in dfs}
    probs = sorted({0.0, 1.0, *(p for s in specs.values() for p in s.probs())})
    names = {p: f"_q{i}" for i, p in enumerate(probs)}
    found = exact_percentiles(df, [group], col, {n: p for p, n in names.items()}).select(
        group, F.array(*names.values()).alias("_q")
    )

    def build(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                at = dict(zip(probs, r.q, strict=True))
                b = build_basis(specs[r.df], at[0.0], at[1.0], [at[p] for p in specs[r.df].probs()])
                coefs = [[c.tolist() for c in piece] for piece in b.coefs]
                out.append((r.model, b.breaks.tolist(), b.origins.tolist(), coefs))
            yield pd.DataFrame(out, columns=["model", "breaks", "origins", "coefs"])

    rows = models.join(found, group).select("model", "df", F.col("_q").alias("q"))
    return rows.mapInPandas(build, _PIECES)


def piece_values_sql(x: str) -> str:
    """SQL for the basis values at `x` by the columns of a `basis_table`."""
    piece = f"size(filter(breaks, b -> {x} >= b))"
    return (
        f"transform(coefs[{piece}], c -> aggregate(reverse(c), 0D, "
        f"(s, a) -> s * ({x} - origins[{piece}]) + a))"
    )


def lag_basis(spec: BasisSpec, max_lag: int) -> Basis:
    """Basis over the lags 0..max_lag; lag bases carry an intercept."""
    spec = replace(spec, intercept=True)
    knots = np.quantile(np.arange(max_lag + 1.0), spec.probs()) if spec.probs() else []
    return build_basis(spec, 0.0, float(max_lag), knots)
