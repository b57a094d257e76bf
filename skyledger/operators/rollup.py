"""Sums and counts by year, month and city, from which every figure of the dashboard follows.

They add up: the sums of two loads are those of both together, and a load that is taken back is
subtracted. So figures over all readings cost a look at one row per month and city, however many
readings there are. Measures are summed as decimals with nine digits behind the point, so neither the
order of loads nor a subtraction leaves a trace; a value that is no number of that range counts as
missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import nan_to_null
from ..schema import BASELINE_MEASURES, LABEL
from . import analytics

KEYS = ["year", "month", "city"]
_SUM = "decimal(38,9)"
_MEASURES = list(BASELINE_MEASURES)

ROLLUP_SCHEMA = T.StructType(
    [T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()), T.StructField("city", T.StringType())]
    + [T.StructField(name, T.LongType()) for name in ("n_readings", "n_label", "label_sum")]
    + [T.StructField(f"n_{name}", T.LongType()) for name in _MEASURES]
    + [T.StructField(f"sum_{name}", T.DecimalType(38, 9)) for name in _MEASURES]
)
_ADDED = [field.name for field in ROLLUP_SCHEMA if field.name not in KEYS]


def rollup(readings: DataFrame) -> DataFrame:
    """Sums and counts of clean readings; readings without a city have one row of their own, and a
    measure that is no column is missing everywhere."""
    lacking = {name: F.lit(None).cast("string") for name in ("city", *_MEASURES) if name not in readings.columns}
    readings = readings.withColumns(lacking)
    values = {name: nan_to_null(F.col(name).try_cast("double")).try_cast("decimal(28,9)") for name in _MEASURES}
    found = readings.groupBy(*KEYS).agg(
        F.count("*").alias("n_readings"),
        F.count(LABEL).alias("n_label"),
        F.coalesce(F.sum(LABEL), F.lit(0)).cast("long").alias("label_sum"),
        *(F.count(value).alias(f"n_{name}") for name, value in values.items()),
        *(F.coalesce(F.sum(value), F.lit(0)).cast(_SUM).alias(f"sum_{name}") for name, value in values.items()),
    )
    return found.select([F.col(field.name).cast(field.dataType).alias(field.name) for field in ROLLUP_SCHEMA])


def signed(sums: DataFrame, sign: int) -> DataFrame:
    return sums if sign > 0 else sums.withColumns({name: -F.col(name) for name in _ADDED})


def added_up(sums: DataFrame) -> DataFrame:
    """One row per month and city; those whose readings were all taken back are gone."""
    totals = sums.groupBy(*KEYS).agg(*(F.sum(name).alias(name) for name in _ADDED)).where("n_readings <> 0")
    return totals.select([F.col(field.name).cast(field.dataType).alias(field.name) for field in ROLLUP_SCHEMA])


def _mean(name: str) -> Column:
    total = F.sum(f"sum_{name}").cast("double")
    return F.try_divide(total, F.sum(f"n_{name}").cast("double"))


def _mean_class() -> Column:
    return F.try_divide(F.sum("label_sum").cast("double"), F.sum("n_label").cast("double")).alias("mean_aqi")


def baselines(sums: DataFrame, model_accuracy: float | None = None) -> DataFrame:
    """The means of the dataset."""
    means = sums.agg(*(_mean(name).alias(name) for name in _MEASURES))
    return means.withColumn("model_accuracy", F.lit(model_accuracy).cast("double"))


def monthly_means(sums: DataFrame) -> DataFrame:
    months = sums.where(F.col("year").isNotNull() & F.col("month").isNotNull()).groupBy("year", "month")
    return months.agg(_mean_class(), _mean("components_pm2_5").alias("mean_pm2_5"))


def overall_index(sums: DataFrame) -> DataFrame:
    return analytics.index_of(sums.agg(_mean_class()))


def city_leaderboard(sums: DataFrame) -> DataFrame:
    cities = sums.where(F.col("city").isNotNull()).groupBy("city")
    return analytics.board_of(cities.agg(_mean_class(), F.sum("n_readings").alias("n_readings")))


def dashboard(sums: DataFrame) -> DataFrame:
    """The row that `analytics.dashboard` gives, from sums."""
    timeline = analytics.series_of(monthly_means(sums))
    place = F.struct((-F.col("mean_aqi")).alias("order"), "city", F.col("city_index").alias("index"))
    board = city_leaderboard(sums).agg(F.array_sort(F.collect_list(place)).alias("board"))
    return overall_index(sums).select(
        F.lit("success").alias("status"),
        timeline.select(F.col("labels")).scalar().alias("labels"),
        timeline.select(F.col("real_pm25")).scalar().alias("real_pm25"),
        "overall_index",
        board.select(F.col("board.city")).scalar().alias("cities"),
        board.select(F.col("board.index")).scalar().alias("city_index"),
    )
