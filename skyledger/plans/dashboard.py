"""Figures of the dashboard from the table of clean readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.analytics import dashboard, empty_dashboard
from ..operators.baselines import dataset_baselines, default_baselines
from ..sources.paths import path_exists
from ..sources.tables import read_readings


def live_dashboard(spark: SparkSession, readings_table: str) -> DataFrame:
    """Dashboard of a table, or the empty one with status ``fallback`` while it is absent."""
    if not path_exists(spark, readings_table):
        return empty_dashboard(spark)
    return dashboard(read_readings(spark, readings_table))


def current_baselines(
    spark: SparkSession, readings_table: str, model_accuracy: float | None = None
) -> DataFrame:
    """Means of a table, or the default baselines while it is absent."""
    if not path_exists(spark, readings_table):
        return default_baselines(spark)
    return dataset_baselines(read_readings(spark, readings_table), model_accuracy)
