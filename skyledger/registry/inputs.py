"""Variants of the readings view that the registered queries run on."""

from __future__ import annotations

from functools import cache

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import clean_readings
from ..operators.features import assemble
from ..operators.forest import fit_forest
from ..plans.loads import add_load, remove_load
from ..session import scratch_folder, tune
from ..sources.csv_files import typed_readings
from ..sources.driver_tables import readings_view, test_split, train_split
from ..sources.models import load_model, save_model
from ..sources.tables import read_features, write_features

KEYS = ["reading_id", "line_no"]
KEY_FIELDS = T.StructType([T.StructField("reading_id", T.LongType()), T.StructField("line_no", T.IntegerType())])
# Makes the registered fit repeat whatever the layout of its rows.
FIT_PARTITIONS = 8
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return readings_view(tune(spark), folder)


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_readings(readings(spark, folder))


def _missing_every(value: Column, modulus: int, rest: int) -> Column:
    return F.when(F.col("reading_id") % modulus != rest, value)


def _datetime_text() -> Column:
    """The reading's time in a format that changes from row to row, some of it junk or missing."""
    moment = F.col("datetime")
    year, month, day = F.year(moment), F.month(moment), F.day(moment)
    hour, minute = F.hour(moment), F.minute(moment)
    half = F.when(hour < 12, "AM").otherwise("PM")
    clock = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month)
    return (
        F.when(F.col("reading_id") % 12 == 1, F.format_string("%d/%d/%d %d:%02d", month, day, year, hour, minute))
        .when(F.col("reading_id") % 12 == 2, "junk")
        .when(F.col("reading_id") % 12 == 3, F.format_string("%04d-%02d-%02dT%02d:%02d:00", year, month, day, hour, minute))
        .when(F.col("reading_id") % 12 == 4, F.format_string("%s %d, %d %d:%02d %s", name, day, year, clock, minute, half))
        .when(F.col("reading_id") % 12 == 5, F.format_string("%04d%02d%02d %02d:%02d", year, month, day, hour, minute))
        .when(F.col("reading_id") % 12 == 6, F.format_string("%02d %s %d %02d:%02d", day, name, year, hour, minute))
        .when(F.col("reading_id") % 12 == 7, F.lit(None))
        .when(F.col("reading_id") % 12 == 8, F.format_string("%d/%d/%d %d:%02d", year, month, day, hour, minute))
        .when(F.col("reading_id") % 12 == 9, F.format_string("%d/%d/%d %d:%02d %s", month, day, year, clock, minute, half))
        .when(F.col("reading_id") % 12 == 10, F.format_string("%04d-%02d-%02d", year, month, day))
        .otherwise(moment.cast("string"))
    )


def text_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as a raw file holds them: all text, mixed dates, several spellings of missing."""
    source = readings(spark, folder)
    text = source.select(
        *[F.col(name).cast("string").alias(name) for name in source.columns if name != "datetime"],
        _datetime_text().alias("datetime"),
        F.col("reading_id").alias("__id"),
    )
    so2 = (
        F.when(F.col("__id") % 10 == 3, "NA")
        .when(F.col("__id") % 10 == 5, "")
        .when(F.col("__id") % 10 == 7, "nan")
        .otherwise(F.col("components_so2"))
    )
    city = F.when(F.col("__id") % 11 == 0, "N/A").otherwise(F.col("city"))
    label = F.concat("main_aqi", F.lit(".0"))
    return text.withColumns({"components_so2": so2, "city": city, "main_aqi": label}).drop("__id")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring requests of all readings, with fields missing here and there and some NaN."""
    moment = F.col("datetime")
    temperature = F.when(F.col("reading_id") % 9 == 4, float("nan")).otherwise(F.col("temperature_2m"))
    return readings(spark, folder).select(
        *KEYS,
        _missing_every(F.col("city"), 7, 0).alias("city"),
        _missing_every(F.col("components_pm2_5"), 5, 1).alias("components_pm2_5"),
        _missing_every(F.col("components_co"), 6, 2).alias("components_co"),
        _missing_every(F.col("components_no2"), 4, 3).alias("components_no2"),
        temperature.alias("temperature_2m"),
        _missing_every(F.hour(moment), 3, 0).alias("hour"),
        _missing_every(F.month(moment), 8, 5).alias("month"),
    )


@cache
def _forest_path(application: str, folder: str) -> str:
    spark = SparkSession.active()
    root = scratch_folder(spark, "forest")
    write_features(assemble(train_split(clean(spark, folder))), f"{root}/features")
    rows = read_features(spark, f"{root}/features")
    save_model(fit_forest(rows, repeatable_partitions=FIT_PARTITIONS), f"{root}/model")
    return f"{root}/model"


def training_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a folder's training split, as its forest was trained on."""
    return read_features(spark, _forest_path(spark.sparkContext.applicationId, folder).removesuffix("model") + "features")


def forest(spark: SparkSession, folder: str) -> RandomForestClassificationModel:
    """The forest of a folder's training split; trained once per application, then loaded."""
    return load_model(spark, _forest_path(spark.sparkContext.applicationId, folder))


def test_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return assemble(test_split(clean(spark, folder)), keep=KEYS)


def stored(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Rows written once and read from there, where several passes start from them."""
    rows.write.parquet(path, compression="zstd")
    return spark.read.schema(rows.schema).parquet(path)


@cache
def _loads_path(application: str, folder: str) -> str:
    spark = SparkSession.active()
    root = scratch_folder(spark, "loads")
    raw = stored(spark, typed_readings(text_readings(spark, folder)), f"{root}/raw")
    line = F.col("line_no").cast("int")
    assert add_load(spark, root, "first", raw.where(line <= 3))
    assert add_load(spark, root, "mistaken", raw.where(line >= 6))
    # It overlaps the first, its columns come in another order, and it is sent twice.
    second = raw.select(*reversed(raw.columns)).where((line >= 2) & (line <= 5))
    assert add_load(spark, root, "second", second)
    assert not add_load(spark, root, "second", second)
    assert remove_load(spark, root, "mistaken")
    assert add_load(spark, root, "third", raw.where(line >= 5))
    return root


def loads(spark: SparkSession, folder: str) -> str:
    """A table that took all raw readings in three overlapping loads, one of them sent twice, and a
    load that was taken back; made once per application."""
    tune(spark)
    return _loads_path(spark.sparkContext.applicationId, folder)
