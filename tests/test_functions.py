import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.functions import dates, factors, tails, text
from lagloom.operators import clean, describe, exposure, survival


def test_tails_against_tables():
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.chi2_upper([0.0, 1e3], [4, 4])[0] == 1.0
    assert tails.f_upper(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-10)
    np.testing.assert_allclose(
        tails.t_quantile(0.975, [1, 10, 1e6]), [12.706204736, 2.2281388520, 1.9599663], rtol=1e-6
    )
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    # Chi-square with 2 df is exponential; t with 1 df is Cauchy.
    q = np.array([0.1, 1.0, 5.0, 60.0])
    np.testing.assert_allclose(tails.chi2_upper(q, 2), np.exp(-q / 2), rtol=1e-12)
    np.testing.assert_allclose(
        tails.t_two_sided(q, 1), 1 - 2 * np.arctan(q) / np.pi, rtol=1e-9
    )


def test_tail_columns(spark):
    df = spark.createDataFrame([(2.0, 10.0), (None, 3.0)], "t double, d double")
    out = df.select(
        tails.t_p(F.col("t"), F.col("d")).alias("p"), tails.chi2_p(F.col("t"), F.col("d")).alias("c"),
        tails.t_crit(0.95, F.col("d")).alias("q"), tails.normal_p(F.col("t")).alias("n"),
        tails.f_p(F.col("t"), F.col("d"), F.col("d")).alias("f"),
    ).collect()
    assert out[0].p == pytest.approx(0.0733880, abs=1e-6) and out[1].p is None
    assert out[0].q == pytest.approx(2.2281388)


def test_weeks_start_on_sunday(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 15)] + [None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for r in df.select("d", dates.floor_date("d").alias("w")).collect():
        if r.d is None:
            assert r.w is None
        else:
            assert r.w.isoweekday() == 7 and 0 <= (r.d - r.w).days < 7
    got = df.select(
        dates.floor_date("d", "month").alias("m"), dates.floor_date("d", "week", "monday").alias("w")
    ).first()
    assert got.m == dt.date(2024, 1, 1) and got.w == dt.date(2024, 1, 1)
    with pytest.raises(ValueError):
        dates.floor_date("d", "fortnight")


def test_date_arithmetic(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31), dt.date(2025, 3, 1))], "a date, b date")
    r = df.select(
        dates.add_units("a", 1, "month").alias("m"), dates.add_units("a", 2, "week").alias("w"),
        dates.elapsed("a", "b", "month").alias("em"), dates.elapsed("a", "b", "week").alias("ew"),
        dates.elapsed("a", "b", "year").alias("ey"), dates.season("a").alias("s"),
    ).first()
    assert r.m == dt.date(2024, 2, 29) and r.w == dt.date(2024, 2, 14)
    assert (r.em, r.ew, r.ey, r.s) == (13, 56, 1, "December-February")


def test_factors(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 28.0), ("b", 36.9), (None, None), (" ", 37.0)],
                               "f string, x double")
    cls = factors.classify("x", [28, 37], ["low", "mid", "top"], missing="Missing")
    assert [r[0] for r in df.select(cls).collect()] == ["low", "mid", "mid", "Missing", "top"]
    right = factors.classify("x", [28, 37], ["low", "mid", "top"], right=True)
    assert [r[0] for r in df.select(right).collect()] == ["low", "low", "mid", None, "mid"]
    lev = [r[0] for r in df.select(factors.missing_as_level("f")).collect()]
    assert lev == ["a", "b", "b", "Missing", "Missing"]
    one = df.where("f in ('a', 'b') or f is null").select(*factors.indicators("f", ["a", "b"]))
    assert [r[0] for r in one.collect()] == [0.0, 1.0, 1.0, None]
    with pytest.raises(Exception, match="outside the level list"):
        df.select(*factors.indicators("f", ["a", "b"])).collect()
    lumped = factors.lump_levels(df, "f", 1)
    assert sorted(str(r.f) for r in lumped.collect()) == ["None", "Other", "Other", "b", "b"]
    order = df.select(factors.level_order("f", ["b", "a"], reverse=True)).collect()
    assert [r[0] for r in order] == [1, 2, 2, None, None]


def test_text_and_names(spark):
    df = spark.createDataFrame([("ab12",), ("zz",), (None,)], "s string")
    r = df.select(text.str_detect("s", "[0-9]+").alias("d"), text.str_extract("s", "[0-9]+").alias("e"))
    assert [tuple(x) for x in r.collect()] == [(True, "12"), (False, None), (None, None)]
    messy = spark.createDataFrame([(" x ", "")], "`Patient ID (%)` string, patientId string")
    out = clean.clean_text(clean.clean_names(messy))
    assert out.columns == ["patient_id_percent", "patient_id"]
    assert tuple(out.first()) == ("x", None)


def test_correlation_with_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.2)], "a double, b double")
    r = describe.correlations(df, ["a", "b"]).first()
    assert r.n == 3 and r.r == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.1, 8.2])[0, 1])
    assert describe.correlations(df, ["a", "b"], na="propagate").first().r is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.9,), (10.0,), (None,)], "x double")
    h = {r.bin: r.n for r in describe.histogram(df, "x", bins=5).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 0, 4: 2}
    w = describe.histogram(df, "x", width=4.0).collect()
    assert [(r.bin_start, r.n) for r in sorted(w)] == [(0.0, 2), (4.0, 0), (8.0, 2)]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert sum(r.n for r in describe.histogram(flat, "x", bins=4).collect()) == 2


def test_survival_edges(spark):
    df = spark.createDataFrame(
        [("a", 1, 1), ("a", 2, 1), ("b", 1, 0), ("b", 3, 0), ("a", None, 1), ("b", 2, None)],
        "g string, t int, e int",
    )
    km = survival.kaplan_meier(survival.life_table(df, "t", "e", "g"), "g")
    rows = {(r.g, r.time): r for r in km.collect()}
    assert rows[("a", 2)].survival == 0.0 and rows[("a", 2)].cumhaz is None
    assert rows[("b", 3)].survival == 1.0 and rows[("a", 1)].survival == pytest.approx(0.5)
    split = survival.kaplan_meier(
        survival.life_table(df, "t", "e", "g", F.floor(F.col("time") / 2)), "g",
        F.floor(F.col("time") / 2),
    )
    assert {(r.g, r.time): r.survival for r in split.collect()} == {k: v.survival for k, v in rows.items()}
    test = survival.logrank_test(df, "t", "e", "g")
    assert test["df"] == 1 and 0 < test["p"] < 1
    alone = survival.logrank_test(df.where("g = 'a'"), "t", "e", "g")
    assert alone == {"statistic": 0.0, "df": 0, "p": 1.0}


def test_series_check_and_calendar(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 4, 4, 7)]
    df = spark.createDataFrame([(d, float(i) if i else None) for i, d in enumerate(days)], "day date, x double")
    r = exposure.series_check(df, [], "day", ["x"]).first()
    assert (r.n_rows, r.n_days, r.span_days, r.missing_days, r.repeated_days, r.null_values) == (
        5, 4, 7, 3, 1, 1
    )
    full = exposure.complete_calendar(df.dropDuplicates(["day"]), "day")
    assert [x.time for x in full.orderBy("day").collect()] == list(range(1, 8))
    gaps = exposure.gap_list(df, "day").orderBy("gap_start").collect()
    assert [(g.gap_start.day, g.gap_end.day, g.gap_days) for g in gaps] == [(3, 3, 1), (5, 6, 2)]


def test_controls_stay_in_month_and_weekday(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 2, 29)), (2, dt.date(2024, 2, 1))], "id int, d date")
    rows = exposure.time_stratified_controls(df, "d").collect()
    assert len(rows) == 10 and sum(r.is_case for r in rows) == 2
    assert all(r.ref_day.month == 2 and r.ref_day.weekday() == 3 for r in rows)


def test_followup_windows(spark):
    df = spark.createDataFrame([(24.0,), (30.0,), (40.0,)], "ga double")
    w = [("early", 22, 28), ("late", 28, 37)]
    rows = {(r.ga, r.window): (r.entry, r.exit, r.event)
            for r in exposure.followup_windows(df, F.col("ga") + 1, w).collect()}
    assert rows == {
        (24.0, "early"): (22.0, 25.0, 1), (30.0, "early"): (22.0, 28.0, 0),
        (30.0, "late"): (28.0, 31.0, 1), (40.0, "early"): (22.0, 28.0, 0),
        (40.0, "late"): (28.0, 37.0, 0),
    }


def test_scatter_and_profile(spark):
    df = spark.range(5000).select("id", (F.col("id") * 2.0).alias("x"))
    assert describe.scatter_points(df, "id", ["x"]).count() == 5000
    cells = describe.binned_scatter(df, F.col("id"), F.col("x"), 100, 1000.0).collect()
    assert {(r.x, r.y): r.n for r in cells} == {(100.0 * i, 1000.0 * (i // 5)): 100 for i in range(50)}
    rows = {r.column: r for r in describe.profile(df, distinct="exact").collect()}
    assert rows["id"].n_distinct == 5000 and rows["x"].max == "9998.0"
