"""Timeline and leaderboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import nan_to_null, round_shown
from ..functions.timestamps import month_label
from ..schema import AQI_INDEX_SCALE, LABEL


def monthly_means(readings: DataFrame) -> DataFrame:
    """Mean class and mean PM2.5 per year and month; rows without either key are left out."""
    return (
        readings.where(F.col("year").isNotNull() & F.col("month").isNotNull())
        .groupBy("year", "month")
        .agg(
            F.avg(LABEL).alias("mean_aqi"),
            F.avg(nan_to_null(F.col("components_pm2_5"))).alias("mean_pm2_5"),
        )
    )


def in_time_order(monthly: DataFrame) -> DataFrame:
    return monthly.orderBy("year", "month")


def monthly_timeline(readings: DataFrame) -> DataFrame:
    """``MM/YYYY`` and mean PM2.5, in time order."""
    return timeline_of(monthly_means(readings))


def timeline_of(monthly: DataFrame) -> DataFrame:
    """The timeline from monthly means."""
    return in_time_order(monthly).select(
        month_label(F.col("year"), F.col("month")).alias("label"),
        round_shown(F.col("mean_pm2_5"), 2).alias("real_pm25"),
    )


def _timeline_point() -> Column:
    return F.struct(
        "year",
        "month",
        month_label(F.col("year"), F.col("month")).alias("label"),
        round_shown(F.col("mean_pm2_5"), 2).alias("value"),
    )


def timeline_series(readings: DataFrame) -> DataFrame:
    """The timeline as one row of two parallel arrays.

    What is collected is one entry per month, so its size follows the calendar, not the data.
    """
    return series_of(monthly_means(readings))


def series_of(monthly: DataFrame) -> DataFrame:
    """Both arrays from monthly means."""
    collected = F.array_sort(F.collect_list(_timeline_point()))
    points = monthly.agg(collected.alias("points"))
    return points.select(
        F.col("points.label").alias("labels"), F.col("points.value").alias("real_pm25")
    )


def _index(mean_class: Column) -> Column:
    return round_shown(mean_class * AQI_INDEX_SCALE, 1)


def overall_index(readings: DataFrame) -> DataFrame:
    """Mean class of the dataset on the index scale."""
    return index_of(readings.agg(F.avg(LABEL).alias("mean_aqi")))


def index_of(mean: DataFrame) -> DataFrame:
    """``overall_index`` from a row with the mean class."""
    return mean.select(_index(F.col("mean_aqi")).alias("overall_index"))


def city_leaderboard(readings: DataFrame) -> DataFrame:
    """Mean class per city on the index scale, highest first, ties by name."""
    means = readings.where(F.col("city").isNotNull()).groupBy("city")
    return board_of(means.agg(F.avg(LABEL).alias("mean_aqi"), F.count("*").alias("n_readings")))


def board_of(cities: DataFrame) -> DataFrame:
    """The leaderboard from ``city, mean_aqi`` and other columns."""
    return cities.withColumn("city_index", _index(F.col("mean_aqi"))).orderBy(F.desc("mean_aqi"), "city")


DASHBOARD_SCHEMA = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("real_pm25", T.ArrayType(T.DoubleType())),
        T.StructField("overall_index", T.DoubleType()),
        T.StructField("cities", T.ArrayType(T.StringType())),
        T.StructField("city_index", T.ArrayType(T.DoubleType())),
    ]
)


def dashboard(readings: DataFrame) -> DataFrame:
    """Timeline arrays, overall index and city leaderboard of a dataset as one row, from one pass.

    Cities come in the order of the leaderboard; there are none where readings have no city.
    """
    if "city" not in readings.columns:
        readings = readings.withColumn("city", F.lit(None).cast("string"))
    sums = readings.groupingSets([["year", "month"], ["city"]], "year", "month", "city").agg(
        F.avg(nan_to_null(F.col("components_pm2_5"))).alias("mean_pm2_5"),
        F.sum(LABEL).alias("label_sum"),
        F.count(LABEL).alias("label_count"),
        F.grouping("city").alias("monthly"),
    )
    of_month, of_city = F.col("monthly") == 1, F.col("monthly") == 0
    dated = of_month & F.col("year").isNotNull() & F.col("month").isNotNull()
    mean = F.col("label_sum") / F.col("label_count")
    place = F.struct((-mean).alias("order"), "city", _index(mean).alias("index"))
    whole = sums.agg(
        F.array_sort(F.collect_list(F.when(dated, _timeline_point()))).alias("points"),
        F.array_sort(F.collect_list(F.when(of_city & F.col("city").isNotNull(), place))).alias("board"),
        (F.sum(F.when(of_month, F.col("label_sum"))) / F.sum(F.when(of_month, F.col("label_count")))).alias("mean_aqi"),
    )
    return whole.select(
        F.lit("success").alias("status"),
        F.col("points.label").alias("labels"),
        F.col("points.value").alias("real_pm25"),
        _index(F.col("mean_aqi")).alias("overall_index"),
        F.col("board.city").alias("cities"),
        F.col("board.index").alias("city_index"),
    )


def empty_dashboard(spark: SparkSession) -> DataFrame:
    """What is shown while there is no dataset: the same columns, no figures."""
    return spark.createDataFrame([("fallback", [], [], None, [], [])], DASHBOARD_SCHEMA)
