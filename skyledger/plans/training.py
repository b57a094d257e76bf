"""Feature tables to a saved forest and its test metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession

from ..operators.forest import evaluate, fit_forest, predict
from ..sources.models import save_model
from ..sources.tables import read_features


@dataclass(frozen=True)
class TrainedForest:
    model: RandomForestClassificationModel
    accuracy: float
    weighted_f1: float


def train_and_evaluate(
    spark: SparkSession,
    train_features: str,
    test_features: str,
    model_path: str,
    repeatable_partitions: int | None = None,
) -> TrainedForest:
    """Fit on one feature table, measure on the other, save the model."""
    model = fit_forest(
        read_features(spark, train_features), repeatable_partitions=repeatable_partitions
    )
    metrics = evaluate(predict(model, read_features(spark, test_features))).first()
    save_model(model, model_path)
    return TrainedForest(model, metrics.accuracy, metrics.weighted_f1)
