"""Column names, types and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and their order, feature order of the model.
POLLUTANTS = [
    "components_co",
    "components_no2",
    "components_o3",
    "components_pm2_5",
    "components_pm10",
    "components_so2",
]
WEATHER = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m"]
MEASURES = POLLUTANTS + WEATHER
FEATURES = MEASURES + ["hour", "month"]
LABEL = "main_aqi"
DATETIME = "datetime"
BASELINE_MEASURES = ["components_co", "components_no2", "components_pm2_5", "temperature_2m"]

# File names and patterns of the raw data folders.
CONCATENATED_FILE = "concatenated_dataset_Aug_2021_to_July_2024.csv"
TRAIN_PIECES = "*_complete_data.csv"
TRAIN_WORKBOOKS = "*.xlsx"
TEST_PIECES = "*.csv"

# What a scoring request falls back to when a field is missing.
REQUEST_DEFAULTS = {
    "city": "Karachi",
    "components_pm2_5": 101.0,
    "components_co": 1795.0,
    "components_no2": 38.0,
    "temperature_2m": 25.0,
    "hour": 12,
    "month": 6,
}
PM10_PER_PM25 = 1.2
CONSTANT_FEATURES = {
    "components_o3": 40.0,
    "components_so2": 12.0,
    "relative_humidity_2m": 60.0,
    "wind_speed_10m": 10.0,
}

# Baselines reported when there is no dataset to average.
DEFAULT_BASELINES = {
    "components_co": 1795.7,
    "components_no2": 38.6,
    "components_pm2_5": 101.0,
    "temperature_2m": 21.5,
    "model_accuracy": 92.4,
}

# Multiplier from mean class to the index on the leaderboard.
AQI_INDEX_SCALE = 40

READINGS_SCHEMA = T.StructType(
    [T.StructField(DATETIME, T.TimestampNTZType()), T.StructField(LABEL, T.IntegerType())]
    + [T.StructField(name, T.DoubleType()) for name in MEASURES]
    + [T.StructField(name, T.IntegerType()) for name in ("hour", "month", "year")]
)

SCORE_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("components_pm2_5", T.DoubleType()),
        T.StructField("components_co", T.DoubleType()),
        T.StructField("components_no2", T.DoubleType()),
        T.StructField("temperature_2m", T.DoubleType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

BASELINES_TYPE = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in BASELINE_MEASURES + ["model_accuracy"]]
)
