"""Model inputs: feature list, request defaults, derived features, vector."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import lenient_number, nan_to_null
from ..functions.timestamps import date_parts
from ..schema import (
    BASELINE_MEASURES,
    CONSTANT_FEATURES,
    DATETIME,
    FEATURES,
    LABEL,
    PM10_PER_PM25,
    REQUEST_DEFAULTS,
)

VECTOR = "features"


def available_features(*frames: DataFrame) -> list[str]:
    """The features that every frame has, in model order."""
    kept = [name for name in FEATURES if all(name in frame.columns for frame in frames)]
    if not kept:
        raise ValueError("no feature column is in every frame")
    return kept


def assemble(
    readings: DataFrame,
    features: list[str] | None = None,
    keep: list[str] | None = None,
    handle_invalid: str = "skip",
) -> DataFrame:
    """Collect features into a vector and project to it, the label and ``keep``.

    ``handle_invalid`` says what a missing feature does: ``skip`` drops the row, ``keep`` puts
    NaN, ``error`` fails.
    """
    features = features or available_features(readings)
    missing = [name for name in features if name not in readings.columns]
    if missing:
        raise ValueError(f"feature columns missing: {', '.join(missing)}")
    assembler = VectorAssembler(inputCols=features, outputCol=VECTOR, handleInvalid=handle_invalid)
    kept = list(keep or [])
    label = [LABEL] if LABEL in readings.columns and LABEL not in kept else []
    needed = readings.select(*dict.fromkeys(features + kept + label))
    return assembler.transform(needed).select(*kept, VECTOR, *label)


def count_incomplete(readings: DataFrame, features: list[str] | None = None) -> DataFrame:
    """How many rows ``skip`` would drop."""
    features = features or available_features(readings)
    incomplete = F.lit(False)
    for name in features:
        incomplete = incomplete | F.col(name).isNull() | F.isnan(F.col(name).cast("double"))
    return readings.agg(
        F.count("*").alias("n_rows"), F.count_if(incomplete).alias("incomplete_rows")
    )


def requests_from_form(forms: DataFrame) -> DataFrame:
    """Requests from typed-in text: each number is what the text starts with, or 0."""
    numbers = [name for name in BASELINE_MEASURES if name in forms.columns]
    return forms.withColumns({name: lenient_number(F.col(name)) for name in numbers})


def fill_request_defaults(requests: DataFrame) -> DataFrame:
    """Replace a missing, NULL or NaN request field by its default.

    Hour and month come from ``datetime`` where only that is given.
    """
    types = dict(requests.dtypes)
    dated = date_parts(F.col(DATETIME)) if types.get(DATETIME, "").startswith("timestamp") else {}

    def filled(name: str, default):
        sources = []
        if name in types:
            is_real = types[name] in ("double", "float")
            sources.append(nan_to_null(F.col(name)) if is_real else F.col(name))
        if name in dated:
            sources.append(dated[name])
        return F.coalesce(*sources, F.lit(default))

    return requests.withColumns(
        {name: filled(name, default) for name, default in REQUEST_DEFAULTS.items()}
    )


def derive_features(requests: DataFrame) -> DataFrame:
    """Features that a request does not carry: PM10 from PM2.5, the others constant."""
    derived = {name: F.lit(value) for name, value in CONSTANT_FEATURES.items()}
    derived["components_pm10"] = F.col("components_pm2_5") * F.lit(PM10_PER_PM25)
    return requests.withColumns(derived)
