import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators import scans
from lagloom.operators.clean import first_rows, group_size_filter, semi, wide
from lagloom.operators.cohort import exposure_histories, history_wide, summarise_subjects


def test_running_sums_same_with_and_without_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(t), float(rng.integers(0, 9))) for k in "ab" for t in range(0, 200, 3)]
    df = spark.createDataFrame(rows + [(None, 1, 2.0)], "k string, t long, v double")
    for reverse in (False, True):
        plain = scans.running_sums(df, ["k"], "t", {"s": "v"}, reverse=reverse)
        split = scans.running_sums(
            df, ["k"], "t", {"s": "v"}, bucket=F.floor(F.col("t") / 16), reverse=reverse
        )
        assert sorted(map(str, plain.collect())) == sorted(map(str, split.select(*plain.columns).collect()))


def test_numbered_is_row_number_for_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        ((F.col("id") * 7919) % 5000).alias("t"),
    )
    out = scans.numbered(df, ["k"], ["t"], F.floor(F.col("t") / 100)).collect()
    seen = {}
    for r in sorted(out, key=lambda r: (r.k, r.t)):
        assert r.lag == seen.get(r.k, 0)
        seen[r.k] = r.lag + 1
    assert len(out) == 5000


@pytest.mark.parametrize("kind", ["lognormal", "signed", "close"])
def test_exact_percentiles(spark, kind):
    rng = np.random.default_rng(5)
    n = 60_000
    x = {
        "lognormal": lambda: np.round(rng.lognormal(size=n), 3),
        "signed": lambda: rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n) * rng.integers(0, 2, n),
        "close": lambda: 1000 + 1e-9 * rng.random(n),
    }[kind]()
    key = np.where(rng.random(n) < 0.7, "hot", "cold")
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"k": key, "x": x}))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    for r in scans.exact_percentiles(df, ["k"], "x", probs).collect():
        want = np.quantile(x[key == r.k], list(probs.values()))
        np.testing.assert_allclose([r[c] for c in probs], want, rtol=1e-12)
    whole = scans.exact_percentiles(df, [], "x", probs).first()
    np.testing.assert_allclose(list(whole), np.quantile(x, list(probs.values())), rtol=1e-12)


def test_value_cells_rise_with_the_value(spark):
    values = [0.0, 5e-324, 1e-300, 0.1, 0.5, 1 - 2**-53, 1.0, 1 + 2**-52, 8 - 2**-50, 8.0, 1e300, float("inf")]
    for n in range(-60, 60):
        values += [2.0**n * (1 - 2**-53), 2.0**n, 2.0**n * (1 + 2**-52)]
    values = sorted({*values, *[-v for v in values]})
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for per_octave in (2**8, 2**26):
        cells = df.select("x", scans.value_cell(F.col("x"), per_octave).alias("c")).orderBy("x").collect()
        assert all(a.c <= b.c for a, b in zip(cells, cells[1:], strict=False))


def test_percentiles_send_no_rows_by_key_alone(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(1000)], "k int, x double")
    out = scans.exact_percentiles(df, ["k"], "x", {"p": 0.5})
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert {r.k: r.p for r in out.collect()} == {0: 499.0, 1: 500.0}
    scan = [line for line in plan.splitlines() if "keys=[k" in line and "_x" in line]
    assert scan, plan


def test_exact_percentiles_small_null_and_constant(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", 4.0), (None, 7.0), ("c", 2.0), ("c", 2.0), ("n", None)],
        "k string, x double",
    )
    got = {r.k: (r.p, r.q) for r in scans.exact_percentiles(df, ["k"], "x", {"p": 0.5, "q": 0.9}).collect()}
    assert got == {"a": (2.5, pytest.approx(3.7)), None: (7.0, 7.0), "c": (2.0, 2.0)}


PERIODS = [
    # subject, month, event, exposure, covariate; rows are out of order on purpose
    ("z", 3, 0, 3.0, "z3"), ("z", 1, 0, 1.0, "z1"), ("z", 2, 1, None, "z2"),
    ("a", 1, None, 5.0, None), ("a", 2, 1, 6.0, "a2"),
    ("m", 1, 0, 9.0, "m1"),
    (None, 1, 1, 2.0, "n1"), (None, 2, 0, 4.0, "n2"),
]
SCHEMA = "id string, month int, event int, x double, c string"


def test_subject_summary_nulls_and_first(spark):
    df = spark.createDataFrame(PERIODS, SCHEMA)
    out = {r.id: r for r in summarise_subjects(df, "id", ["month"], F.col("event"), ["c"]).collect()}
    assert out["a"].event is None  # one missing event makes the maximum missing
    assert out["a"].c is None  # the first row's value, although it is null
    assert out["z"].event == 1 and out["z"].c == "z1" and out["z"].n_periods == 3
    assert out[None].n_periods == 2
    skip = summarise_subjects(df, "id", ["month"], F.col("event"), na="skip", low=2, high=21)
    assert {r.id: r.event for r in skip.collect()} == {"a": 1, "z": 1, None: 1}


def test_histories_keep_nulls_and_both_directions(spark):
    df = spark.createDataFrame(PERIODS, SCHEMA).repartition(3)
    fwd = {r.id: r for r in exposure_histories(df, "id", ["month"], "x", 3).collect()}
    assert fwd["z"].history == [1.0, None, 3.0] and not fwd["z"].history_complete
    assert fwd["a"].history == [5.0, 6.0, None]
    back = {
        r.id: r.history
        for r in exposure_histories(df, "id", ["month"], "x", 2, direction="before_end").collect()
    }
    assert back["z"] == [3.0, None] and back["a"] == [6.0, 5.0]
    capped = exposure_histories(df, "id", ["month"], "x", 2, min_rows=2, max_rows=2)
    assert {r.id for r in capped.collect()} == {"a", None}
    cols = history_wide(exposure_histories(df, "id", ["month"], "x", 3), "id", 3)
    assert cols.columns == ["id", "lag0", "lag1", "lag2"]


def test_histories_cut_a_hot_subject_before_the_exchange(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"),
        F.col("id").alias("t"), F.col("id").cast("double").alias("x"),
    )
    plan = exposure_histories(df, "id", ["t"], "x", 4)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    out = {r.id: r.history for r in exposure_histories(df, "id", ["t"], "x", 4).collect()}
    assert out[-1] == [0.0, 3.0, 6.0, 9.0]


def test_semi_join_null_keys(spark):
    df = spark.createDataFrame(PERIODS, SCHEMA)
    other = spark.createDataFrame([("m",), (None,)], "id string")
    assert semi(df, other, "id").count() == 1
    assert semi(df, other, "id", null_safe=True).count() == 3


def test_group_filter_first_rows_and_wide(spark):
    df = spark.createDataFrame(PERIODS, SCHEMA)
    assert {r.id for r in group_size_filter(df, ["id"], 2, 2).collect()} == {"a", None}
    first = first_rows(df, ["id"], ["month"], 1)
    assert {(r.id, r.c, r.lag) for r in first.collect()} == {
        ("z", "z1", 0), ("a", None, 0), ("m", "m1", 0), (None, "n1", 0)
    }
    table = wide(first_rows(df, ["id"], ["month"], 3), "id", "lag", "x", range(3), "lag")
    row = table.where("id = 'a'").first()
    assert (row.lag0, row.lag1, row.lag2) == (5.0, 6.0, None)
