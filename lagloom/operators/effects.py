"""Effect sizes of studies as column arithmetic: each adds `yi` and `vi`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions.tails import normal_quantile


def _out(df: DataFrame, yi: Column, vi: Column) -> DataFrame:
    return df.withColumns({"yi": yi, "vi": vi})


def mean_effect(df: DataFrame, n="n", mean="mean", sd="sd") -> DataFrame:
    """A mean and its sampling variance."""
    return _out(df, F.col(mean).cast("double"), F.col(sd) * F.col(sd) / F.col(n))


def proportion_effect(df: DataFrame, n="n", event="event", logit: bool = True) -> DataFrame:
    """A proportion, on the logit scale by default; 0.5 is added to both cells
    when one is empty."""
    add = F.when((F.col(event) == 0) | (F.col(event) == F.col(n)), 0.5).otherwise(0.0)
    a, b = F.col(event) + add, F.col(n) - F.col(event) + add
    if logit:
        return _out(df, F.ln(a / b), 1 / a + 1 / b)
    p = a / (a + b)
    return _out(df, p, p * (1 - p) / (a + b))


def correlation_effect(df: DataFrame, n="n", cor="cor") -> DataFrame:
    """Fisher z of a correlation."""
    return _out(
        df, F.atanh(F.col(cor)), F.when(F.col(n) > 3, 1.0 / (F.col(n) - 3))
    )


def mean_difference(
    df: DataFrame, n_e="n_e", mean_e="mean_e", sd_e="sd_e", n_c="n_c", mean_c="mean_c", sd_c="sd_c"
) -> DataFrame:
    return _out(
        df,
        F.col(mean_e) - F.col(mean_c),
        F.col(sd_e) * F.col(sd_e) / F.col(n_e) + F.col(sd_c) * F.col(sd_c) / F.col(n_c),
    )


def standardised_difference(
    df: DataFrame, n_e="n_e", mean_e="mean_e", sd_e="sd_e", n_c="n_c", mean_c="mean_c", sd_c="sd_c"
) -> DataFrame:
    """Hedges' g with the small-sample factor 1 - 3 / (4 N - 9)."""
    ne, nc = F.col(n_e), F.col(n_c)
    total = ne + nc
    pooled = F.sqrt(
        ((ne - 1) * F.col(sd_e) * F.col(sd_e) + (nc - 1) * F.col(sd_c) * F.col(sd_c)) / (total - 2)
    )
    g = (1 - 3 / (4 * total - 9)) * (F.col(mean_e) - F.col(mean_c)) / pooled
    return _out(df, g, total / (ne * nc) + g * g / (2 * (total - 3.94)))


def ratio_effect(
    df: DataFrame, measure: str = "RR", n_e="n_e", event_e="event_e", n_c="n_c", event_c="event_c"
) -> DataFrame:
    """Log risk ratio or log odds ratio; 0.5 is added to every cell of a table
    with an empty cell."""
    a, c = F.col(event_e), F.col(event_c)
    b, d = F.col(n_e) - a, F.col(n_c) - c
    add = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    a, b, c, d = a + add, b + add, c + add, d + add
    if measure == "OR":
        return _out(df, F.ln(a * d / (b * c)), 1 / a + 1 / b + 1 / c + 1 / d)
    if measure == "RR":
        return _out(
            df,
            F.ln(a / (a + b)) - F.ln(c / (c + d)),
            1 / a - 1 / (a + b) + 1 / c - 1 / (c + d),
        )
    raise ValueError("measure must be 'RR' or 'OR'")


def rate_ratio(
    df: DataFrame, event_e="event_e", time_e="time_e", event_c="event_c", time_c="time_c"
) -> DataFrame:
    """Log incidence rate ratio; 0.5 is added when an arm has no event."""
    add = F.when((F.col(event_e) == 0) | (F.col(event_c) == 0), 0.5).otherwise(0.0)
    a, c = F.col(event_e) + add, F.col(event_c) + add
    return _out(df, F.ln(a / F.col(time_e)) - F.ln(c / F.col(time_c)), 1 / a + 1 / c)


def hazard_ratio(
    df: DataFrame, log_hr: str | None = None, se: str | None = None, hr: str | None = None,
    low: str | None = None, high: str | None = None, level: float = 0.95,
) -> DataFrame:
    """Log hazard ratio with its error, or both from a ratio and its interval."""
    if log_hr and se:
        return _out(df, F.col(log_hr), F.col(se) * F.col(se))
    if hr and low and high:
        s = (F.ln(high) - F.ln(low)) / (2 * normal_quantile(0.5 + level / 2.0))
        return _out(df, F.ln(hr), s * s)
    raise ValueError("give log_hr and se, or hr, low and high")
