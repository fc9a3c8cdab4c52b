"""The supplied tables in the roles of cohort, series, linelist, births and
studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions.dates import season
from lagloom.functions.factors import classify
from lagloom.operators.cohort import summarise_subjects
from lagloom.operators.exposure import complete_calendar
from lagloom.operators.scans import numbered
from lagloom.sources.readers import load_named

ORDER = ("o_orderdate", "o_orderkey")
LOW, HIGH = 2, 21
# Rows of a full history: lags 0 to 20.
HISTORY = 21
# Fixed value: an error event of this value or more is the outcome of a visit.
SEVERE = 50

# Preterm classes and their cut points in completed weeks.
PRETERM_CUTS = [28, 32, 37]
PRETERM_CLASSES = ["extremely", "very", "moderately", "term"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_named(spark, folder, name)


def person_period(spark: SparkSession, folder: str) -> DataFrame:
    """One row per subject and period: orders of a customer in date order."""
    return table(spark, folder, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderdate",
        "o_orderpriority",
        (F.col("o_totalprice") / 10000).alias("exposure"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).alias(
            "had_event"
        ),
    )


def subject_attributes(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    customer = table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"
    )
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("c_custkey").alias("o_custkey"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
        )
    )


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects with 2 to 21 periods. Rows are summed to subjects before the
    attributes are joined, so the join never sees the periods."""
    people = summarise_subjects(
        person_period(spark, folder), "o_custkey", ORDER, F.col("had_event"),
        first=["o_orderpriority"], low=LOW, high=HIGH,
    ).withColumnRenamed("o_orderpriority", "first_priority")
    return people.join(subject_attributes(spark, folder), "o_custkey")


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Person-period rows: the events of a user in time order, cut into episodes
    of up to HISTORY rows; `subject` is the episode, `place` the row in it."""
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = numbered(e, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "_row")
    return rows.select(
        (F.col("user_id") * 1_000_000 + F.expr(f"_row div {HISTORY}")).alias("subject"),
        (F.col("_row") % HISTORY).alias("place"),
        "user_id",
        "event_type",
        F.col("value").alias("exposure"),
        ((F.col("event_type") == "error") & (F.col("value") >= SEVERE)).alias("had_event"),
    )


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per episode followed for 2 periods or more: rows up to its first
    severe error, or all of them, with the user's attributes."""
    v = visits(spark, folder)
    people = v.groupBy("subject").agg(
        F.first("user_id").alias("o_custkey"),
        F.coalesce(F.min(F.when(F.col("had_event"), F.col("place") + 1)), F.count("*")).alias("n_periods"),
        F.max(F.col("had_event").cast("long")).alias("event"),
        F.min_by("event_type", "place").alias("first_type"),
    )
    people = people.where(F.col("n_periods") >= LOW)
    return people.join(subject_attributes(spark, folder), "o_custkey")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Completed daily series: count y, exposures x and z."""
    day = F.to_date("o_orderdate").alias("day")
    per_day = table(spark, folder, "orders").groupBy(day).agg(
        F.count("*").alias("y"),
        (F.avg("o_totalprice") / 10000).alias("x"),
        (F.max("o_totalprice") / 10000).alias("z"),
    )
    return complete_calendar(per_day, "day", fill_zero=["y"])


def linelist(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        F.to_date("ts").alias("date_onset"),
        F.col("event_type").alias("hospital"),
        F.col("value").alias("age_years"),
        "user_id",
    )


def births(spark: SparkSession, folder: str) -> DataFrame:
    area = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("area")
    )
    line = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("l_quantity").alias("ga"),
        F.to_date("l_shipdate").alias("birth"),
        F.col("l_linestatus").alias("sex"),
        F.col("l_returnflag").alias("birth_type"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    return line.join(area, "l_suppkey")


def eligible_births(spark: SparkSession, folder: str) -> DataFrame:
    """Births above 22 and up to 44 completed weeks."""
    b = births(spark, folder)
    return b.where((F.col("ga") > 22) & (F.col("ga") <= 44))


def preterm():
    return classify("ga", PRETERM_CUTS, PRETERM_CLASSES)


def area_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean exposure of each area."""
    return (
        births(spark, folder).groupBy("area", F.col("birth").alias("day"))
        .agg(F.avg("discount").alias("x"))
    )


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct user-days with an error event."""
    e = table(spark, folder, "events").where("event_type = 'error'")
    return e.select("user_id", F.to_date("ts").alias("day")).distinct()


def event_exposure(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean value of the other event types."""
    e = table(spark, folder, "events").where("event_type <> 'error'")
    return e.groupBy(F.to_date("ts").alias("ref_day")).agg(F.avg("value").alias("exposure"))


def study_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Persons of the studies: outcome p_type, study s_nationkey, arm line status."""
    line = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag",
        "l_quantity", "l_extendedprice", "l_discount",
    )
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("outcome")
    )
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("study")
    )
    return line.join(part, "l_partkey").join(supplier, "l_suppkey")


def arms(spark: SparkSession, folder: str) -> DataFrame:
    """Study arm summaries."""
    rows = study_lines(spark, folder)
    return rows.groupBy("outcome", "study", F.col("l_linestatus").alias("arm")).agg(
        F.count("*").alias("n"),
        F.avg("l_extendedprice").alias("mean"),
        F.stddev_samp("l_extendedprice").alias("sd"),
        F.count_if(F.col("l_returnflag") == "R").alias("event"),
        F.sum("l_quantity").alias("time"),
        F.sum("l_discount").alias("s_discount"),
        F.corr("l_quantity", "l_extendedprice").alias("cor"),
    )


def studies(spark: SparkSession, folder: str) -> DataFrame:
    """Both arms of a study in one row, with the study's moderators."""
    def arm(value: str, name: str):
        return F.max(F.when(F.col("arm") == value, F.col(name)))

    wide = arms(spark, folder).groupBy("outcome", "study").agg(
        *[
            arm(value, name).alias(f"{name}_{tag}")
            for value, tag in (("O", "e"), ("F", "c"))
            for name in ("n", "mean", "sd", "event", "time")
        ],
        (F.sum("s_discount") / F.sum("n")).alias("mod_discount"),
        (F.sum("time") / F.sum("n")).alias("mod_quantity"),
    )
    return wide.where("n_e >= 2 and n_c >= 2")


def birth_season():
    return season("birth")
