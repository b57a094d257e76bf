"""Rules that turn PM2.5 into a class, and a class into shown values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import nan_to_null, repeatable_uniform

# A PM2.5 level strictly above the limit belongs to the class.
PM25_LIMITS = [(150, 5), (100, 4), (50, 3), (25, 2)]
LOWEST_CLASS = 1

# Range of the rule's confidence per class.
RULE_CONFIDENCE = {
    1: (0.94, 0.94),
    2: (0.92, 0.98),
    3: (0.89, 0.95),
    4: (0.88, 0.94),
    5: (0.91, 0.97),
}

# Index shown for each class.
DISPLAY_INDEX = {1: 25, 2: 45, 3: 78, 4: 135, 5: 240}
DEFAULT_DISPLAY_INDEX = 25

# The two-way rule used when no scoring service answers.
FALLBACK_LIMIT = 100
FALLBACK_HIGH = {
    "aqi_code": 4,
    "health_status": "UNHEALTHY",
    "label_prefix": "Smog Vector Risk",
    "color_theme": "#d9bca7",
    "precautions": ["Wear a protective N95 mask outside.", "Curtail heavy training exercises."],
}
FALLBACK_LOW = {
    "aqi_code": 2,
    "health_status": "HEALTHY",
    "label_prefix": "Optimal Air Index",
    "color_theme": "#10b981",
    "precautions": ["Atmosphere is stable. Safe to proceed with standard tasks."],
}
FALLBACK_DESC = "Data compiled using static regional fallback evaluation matrices."
FALLBACK_CONFIDENCE = 91.5


def pm25_class(pm25: Column) -> Column:
    """Class 1 to 5. A level on a limit belongs to the lower class; a missing one to class 1."""
    level = nan_to_null(pm25)
    chain = F
    for limit, code in PM25_LIMITS:
        chain = chain.when(level > limit, code)
    return chain.otherwise(LOWEST_CLASS)


def rule_confidence(code: Column, *keys: Column) -> Column:
    """A confidence inside the class's range, the same for the same keys on every run."""
    draw = repeatable_uniform(*keys)
    chain = F
    for value, (low, high) in RULE_CONFIDENCE.items():
        chain = chain.when(code == value, F.lit(low) + draw * F.lit(high - low))
    return chain.otherwise(F.lit(None).cast("double"))


def city_label(prefix: Column, city: Column) -> Column:
    return F.concat(prefix, F.lit(" ("), city, F.lit(")"))


def fallback_result(pm25: Column, city: Column) -> Column:
    """The two-way rule as one struct."""

    def result(values: dict) -> Column:
        return F.struct(
            F.lit(values["aqi_code"]).alias("aqi_code"),
            F.lit(values["health_status"]).alias("health_status"),
            city_label(F.lit(values["label_prefix"]), city).alias("aqi_label"),
            F.lit(FALLBACK_DESC).alias("aqi_desc"),
            F.array(*[F.lit(text) for text in values["precautions"]]).alias("precautions"),
            F.lit(values["color_theme"]).alias("color_theme"),
            F.lit(FALLBACK_CONFIDENCE).alias("prediction_confidence"),
            city.alias("city"),
        )

    return F.when(nan_to_null(pm25) > FALLBACK_LIMIT, result(FALLBACK_HIGH)).otherwise(
        result(FALLBACK_LOW)
    )


def display_index(code: Column) -> Column:
    """A fixed number per class, for display; it is not computed from the reading."""
    chain = F
    for value, index in DISPLAY_INDEX.items():
        chain = chain.when(code == value, index)
    return chain.otherwise(DEFAULT_DISPLAY_INDEX)
