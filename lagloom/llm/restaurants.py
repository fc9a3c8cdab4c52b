"""Seating in Chinese restaurants, for many dishes at once as numpy arrays.

A restaurant holds customers grouped by dish; the customers of a dish sit at one
or more tables. With discount d and concentration s, a new customer of a dish
opens a table with weight (s + d * tables in the restaurant) * probability of the
dish in the parent, or joins a table of n customers with weight n - d. Seatings
are a number of tables per dish and the tables' sizes, dish by dish."""

from __future__ import annotations

import numpy as np

# Customers of one dish that one round takes out and seats again. Every customer
# of a dish of up to so many is moved in each round; larger dishes are seated
# anew before so many of theirs move.
MOVES = 16
# Values tried for the discount and the concentration.
_DISCOUNTS = np.linspace(0.02, 0.98, 33)
_STRENGTHS = np.exp(np.linspace(np.log(1e-2), np.log(1e7), 64))


def seat_afresh(c: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seats `c` customers of each dish one after another, a new table having
    weight `mass` against the number already seated. The table of the first
    customer takes a beta-binomial share, the first of the others again, so a
    dish costs as many draws as it has tables. Returns tables per dish, sizes."""
    dish, left = np.arange(len(c)), c.astype(np.int64).copy()
    mass = np.maximum(mass, 1e-300)
    whose, sizes = [], []
    while len(dish):
        n = 1 + rng.binomial(left - 1, rng.beta(1.0, mass[dish]))
        whose.append(dish)
        sizes.append(n)
        left = left - n
        dish, left = dish[left > 0], left[left > 0]
    if not whose:
        return np.zeros(len(c), np.int64), np.empty(0, np.int64)
    whose, sizes = np.concatenate(whose), np.concatenate(sizes)
    return np.bincount(whose, minlength=len(c)), sizes[np.argsort(whose, kind="stable")]


def gibbs_moves(
    c: np.ndarray,
    t: np.ndarray,
    sizes: np.ndarray,
    restaurant: np.ndarray,
    tables: np.ndarray,
    prob: np.ndarray,
    d: float,
    strength: float,
    rng: np.random.Generator,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Takes customers out, one of each dish at a time, and seats them again by
    their conditional probabilities; `tables` are those of each restaurant and
    `prob` is the parent's for each dish. Returns t, sizes and tables anew."""
    moves = np.minimum(c, MOVES)
    # Dishes with more moves first, so that a step works on a prefix.
    order = np.argsort(-moves, kind="stable")
    back = np.argsort(order, kind="stable")
    starts = np.cumsum(t) - t
    room = (t + moves)[order]
    begin = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()), np.int64)
    owner = np.repeat(np.arange(len(c)), room)
    inside = np.arange(len(flat)) - begin[owner]
    held = inside < t[order][owner]
    flat[held] = sizes[(starts[order][owner] + inside)[held]]
    c, used, now = c[order], t[order].copy(), t[order].copy()
    restaurant, prob, tables = restaurant[order], prob[order], tables.astype(np.float64).copy()
    ends = begin + room
    for step in range(int(moves.max(initial=0))):
        k = int(np.searchsorted(-moves[order], -step, "left"))  # dishes with more moves than `step`
        stop = int(ends[k - 1])
        seats = flat[:stop]
        total = np.cumsum(seats)
        before = np.where(begin[:k] > 0, total[begin[:k] - 1], 0)
        seat = before + np.floor(rng.random(k) * c[:k]).astype(np.int64) + 1
        taken = np.searchsorted(total, seat, "left")
        seats[taken] -= 1
        gone = seats[taken] == 0
        now[:k] -= gone
        tables -= np.bincount(restaurant[:k], weights=gone, minlength=len(tables))
        fresh = (strength + d * np.maximum(tables[restaurant[:k]], 0)) * prob[:k]
        stay = np.maximum(c[:k] - 1 - d * now[:k], 0.0)
        # Without a table left, the customer opens one.
        opens = (rng.random(k) * (fresh + stay) < fresh) | (now[:k] == 0)
        weight = np.cumsum(np.where(seats > 0, seats - d, 0.0))
        before = np.where(begin[:k] > 0, weight[begin[:k] - 1], 0.0)
        place = np.searchsorted(weight, before + rng.random(k) * stay, "right")
        place = np.clip(place, begin[:k], ends[:k] - 1)
        # Rounding may point past the last table; then the new one is taken.
        opens |= seats[np.minimum(place, stop - 1)] == 0
        place = np.where(opens, begin[:k] + used[:k], place)
        seats[place] += 1
        used[:k] += opens
        now[:k] += opens
        tables += np.bincount(restaurant[:k], weights=opens, minlength=len(tables))
    full = flat > 0
    t = np.bincount(owner[full], minlength=len(c))[back]
    by_dish = np.argsort(order[owner[full]], kind="stable")
    return t, flat[full][by_dish], tables


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive numbers, by Stirling's series from x + 8 on."""
    x = np.asarray(x, float)
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - low


def bins_of(values: np.ndarray) -> np.ndarray:
    """Bin of each value from 1 on: one per number up to 64, then bins of 2 %."""
    v = np.maximum(values, 1).astype(float)
    return np.where(v <= 64, v, 64 + np.ceil(np.log(v / 64) / np.log(1.02))).astype(np.int64)


def histogram(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of positive values with their numbers and sums."""
    at = bins_of(values)
    n = np.bincount(at)
    some = np.flatnonzero(n)
    return some, n[some], np.bincount(at, weights=values)[some].astype(np.int64)


def draw_strength(
    tables: list[tuple[float, float]],
    customers: list[tuple[float, float]],
    sizes: list[tuple[float, float]],
    rng: np.random.Generator,
) -> tuple[float, float]:
    """A discount and a concentration from their posterior on a grid, flat in
    the discount and in the logarithm of the concentration. The arguments are
    (value, how often): tables per restaurant, customers per restaurant and
    customers per table."""
    d, s = _DISCOUNTS[:, None], _STRENGTHS[None, :]
    log = np.zeros((len(_DISCOUNTS), len(_STRENGTHS)))
    for v, n in tables:
        log += n * ((v - 1) * np.log(d) + log_gamma(s / d + v) - log_gamma(s / d + 1))
    for v, n in customers:
        log -= n * (log_gamma(s + v) - log_gamma(s + 1))
    for v, n in sizes:
        log += n * (log_gamma(v - d) - log_gamma(1 - d))
    chance = np.exp(log - log.max()).ravel()
    at = rng.choice(len(chance), p=chance / chance.sum())
    return float(_DISCOUNTS[at // len(_STRENGTHS)]), float(_STRENGTHS[at % len(_STRENGTHS)])
