"""The readings view over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Every 50th reading id is present twice.
COPY_EVERY = 50
TEST_EVERY = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _city_of_order(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("city"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "city")


def readings_view(spark: SparkSession, folder: str) -> DataFrame:
    """Raw readings with city, copies, missing labels and some odd labels.

    Small tables join first, by whatever join their size allows. The last join is a merge join:
    both sides grow with the data, and it leaves rows partitioned by reading id, which is all that
    removing copies needs, so no second shuffle follows. The copies come from one pass that emits
    some rows twice, not from a union that would read and join everything twice.
    """
    item = table(spark, folder, "lineitem")
    hours = F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
    label = (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 10 == 0), None)
        .when(F.col("l_partkey") % 11 == 0, 1 + (F.col("l_suppkey") % 5).cast("int"))
        .when(F.col("l_quantity") > 30, 5)
        .when(F.col("l_quantity") > 20, 4)
        .when(F.col("l_quantity") > 10, 3)
        .when(F.col("l_quantity") > 5, 2)
        .otherwise(1)
    )
    once, twice = F.array(F.lit(0)), F.array(F.lit(0), F.lit(1))
    city = _city_of_order(spark, folder).hint("merge")
    joined = item.join(city, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("reading_id"),
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_shipdate") + hours).alias("datetime"),
        "city",
        (F.col("l_extendedprice") / 50).alias("components_co"),
        (F.col("l_tax") * 500).alias("components_no2"),
        (F.col("l_discount") * 800).alias("components_o3"),
        (F.col("l_quantity") * 5).alias("components_pm2_5"),
        (F.col("l_quantity") * 6).alias("components_pm10"),
        (F.col("l_suppkey") % 40).cast("double").alias("components_so2"),
        (F.col("l_discount") * 300 + 5).alias("temperature_2m"),
        (F.col("l_partkey") % 100).cast("double").alias("relative_humidity_2m"),
        (F.col("l_suppkey") % 25).cast("double").alias("wind_speed_10m"),
        label.alias("main_aqi"),
        F.explode(
            F.when(F.col("l_orderkey") % COPY_EVERY == 0, twice).otherwise(once)
        ).alias("__copy"),
    ).drop("__copy")


def train_split(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("reading_id") % TEST_EVERY != 0)


def test_split(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("reading_id") % TEST_EVERY == 0)
