"""Parquet tables of readings and of model features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .paths import EmptySourceError, path_exists, replace_folder

# What became of a row in cleaning, and how many rows of the input it stands for: all of them, those
# that were short, those with a label that is none. The text of a rejected row's date.
OUTCOME = "cleaning_outcome"
CLEAN = "clean"
TALLIES = ["_copies", "_short_copies", "_bad_label_copies"]
REJECTED_TEXT = "_datetime_text"
_NOT_OF_READINGS = [*TALLIES, REJECTED_TEXT, "_malformed"]


def write_readings(readings: DataFrame, path: str) -> None:
    """Write clean readings by year and month.

    The rebalance hint brings rows of a month together so that it gets few files, and lets
    adaptive execution split a month that is far larger than the others.
    """
    (
        readings.hint("rebalance", "year", "month")
        .write.mode("overwrite")
        .partitionBy("year", "month")
        .parquet(path)
    )


def write_outcomes(rows: DataFrame | list[DataFrame], path: str) -> None:
    """Write sorted-out rows in one pass: clean ones by year and month, rejected ones beside them.

    Of several frames each is written in turn, so that what one shuffles is gone before the next; the
    folder gets its name when all are there.
    """
    keys = [OUTCOME, "year", "month"]
    parts = [rows] if isinstance(rows, DataFrame) else rows
    place = path if len(parts) == 1 else f"{path}-draft"
    for number, part in enumerate(parts):
        mode = "append" if number else "overwrite"
        part.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(place)
    if place != path:
        replace_folder(parts[0].sparkSession, place, path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """All rows that `write_outcomes` wrote, with what became of them."""
    if not path_exists(spark, path):
        raise EmptySourceError(f"no readings table at {path}")
    return spark.read.parquet(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Clean readings; of a table that holds rejected rows too, only the clean ones are read."""
    clean = f"{path}/{OUTCOME}={CLEAN}"
    found = clean if path_exists(spark, clean) else path
    if not path_exists(spark, found):
        raise EmptySourceError(f"no readings table at {path}")
    return spark.read.parquet(found).drop(*_NOT_OF_READINGS)


def write_features(features: DataFrame, path: str) -> None:
    """Write the vector and label of each row."""
    features.write.mode("overwrite").parquet(path, compression="zstd")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise EmptySourceError(f"no feature table at {path}")
    return spark.read.parquet(path)
