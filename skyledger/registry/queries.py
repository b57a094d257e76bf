"""One query per operator, each over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import (
    RULE_CONFIDENCE,
    city_label as label_with_city,
    display_index as index_of_class,
    fallback_result,
    pm25_class as class_of_pm25,
    rule_confidence as confidence_of_rule,
)
from ..functions.numbers import lenient_number as number_at_start
from ..functions.numbers import to_percent
from ..functions.timestamps import month_label, parse_mixed_timestamp
from ..operators import advice, analytics, baselines, clean as cleaning, features, forest, rollup, scoring
from ..plans.dashboard import live_dashboard
from ..plans.loads import loaded_baselines, loaded_dashboard, loaded_readings, loaded_sums
from ..schema import BASELINE_MEASURES, FEATURES, MEASURES, REQUEST_DEFAULTS
from ..session import scratch_folder
from ..sources import csv_files, models, requests as request_files, tables
from ..sources.driver_tables import test_split, train_split
from ..sources.paths import EmptySourceError, remove_folder
from ..streaming.scoring import MODEL_VERSION, start_scoring, start_versioned_scoring
from . import inputs
from .inputs import KEYS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# A compressed file is read by one task, so none holds more lines than this.
_LINES_PER_FILE = 500_000


def _write_lines(lines: DataFrame, path: str) -> None:
    """Add lines to a folder of text files, a tenth of the size that they have as plain text."""
    lines.write.mode("append").option("maxRecordsPerFile", _LINES_PER_FILE).text(path, compression="gzip")


# Raw rows are judged for copies in so many parts, each of which reads them all.
_PARTS = 4


def _typed_keys() -> list[Column]:
    return [F.col("reading_id").cast("long"), F.col("line_no").cast("int")]


# Sources and sinks


@query
def csv_scan(spark, folder):
    path = scratch_folder(spark, "csv")
    csv_files.write_csv(inputs.text_readings(spark, folder), path)
    return csv_files.read_csv(spark, path).select(*_typed_keys(), "city", "main_aqi", *MEASURES)


@query
def preferred_source(spark, folder):
    """One folder has the concatenated file and pieces, the other only pieces."""
    whole, pieces = scratch_folder(spark, "whole"), scratch_folder(spark, "pieces")
    text = inputs.text_readings(spark, folder)
    even = F.col("line_no").cast("int") % 2 == 0
    csv_files.write_csv(text, f"{whole}/{csv_files.CONCATENATED_FILE}")
    for root in (whole, pieces):
        csv_files.write_csv(text.where(even), f"{root}/even_complete_data.csv")

    def summary(root: str, name: str) -> DataFrame:
        return (
            csv_files.read_training(spark, root)
            .groupBy("main_aqi")
            .agg(F.count("*").alias("n_rows"), F.sum("components_pm2_5").alias("total_pm2_5"))
            .select(F.lit(name).alias("source"), "*")
        )

    return summary(whole, "concatenated").unionByName(summary(pieces, "pieces"))


@query
def concat_by_name(spark, folder):
    """Two pieces whose columns differ in number and order."""
    root = scratch_folder(spark, "mixed")
    text = inputs.text_readings(spark, folder)
    asia = F.col("city").eqNullSafe("ASIA")
    csv_files.write_csv(
        text.where(asia).select(*reversed(text.columns)).drop("components_so2"),
        f"{root}/asia_complete_data.csv",
    )
    csv_files.write_csv(text.where(~asia), f"{root}/other_complete_data.csv")
    return csv_files.read_csv_glob(spark, f"{root}/*_complete_data.csv").select(
        *_typed_keys(), "city", "main_aqi", "components_so2", "components_pm2_5"
    )


@query
def empty_input_guard(spark, folder):
    root = scratch_folder(spark, "guard")
    csv_files.write_csv(inputs.text_readings(spark, folder), f"{root}/found/all.csv")
    answers = None
    for name in ("found", "absent"):
        try:
            rows = csv_files.read_testing(spark, f"{root}/{name}")
            answer = rows.agg(F.lit("read").alias("outcome"), F.count("*").alias("n_rows"))
        except EmptySourceError:
            answer = spark.range(1).select(
                F.lit("empty").alias("outcome"), F.lit(0).cast("long").alias("n_rows")
            )
        answer = answer.select(F.lit(name).alias("source"), "outcome", "n_rows")
        answers = answer if answers is None else answers.unionByName(answer)
    return answers


@query
def csv_sink(spark, folder):
    path = scratch_folder(spark, "clean-csv")
    csv_files.write_csv(inputs.clean(spark, folder), path)
    stored = cleaning.parse_datetime(csv_files.read_csv(spark, path))
    return stored.select(
        *_typed_keys(), "datetime", "city", "main_aqi", "hour", "month", "year", *MEASURES
    )


@query
def readings_table(spark, folder):
    path = scratch_folder(spark, "readings")
    tables.write_readings(inputs.clean(spark, folder), path)
    return (
        tables.read_readings(spark, path)
        .groupBy("year", "month")
        .agg(F.count("*").alias("n_rows"), F.sum("components_pm2_5").alias("total_pm2_5"))
    )


@query
def feature_table(spark, folder):
    path = scratch_folder(spark, "features")
    tables.write_features(features.assemble(inputs.clean(spark, folder)), path)
    return tables.read_features(spark, path).select(*_vector_columns(), "main_aqi")


def _vector_columns() -> list[Column]:
    values = vector_to_array(F.col("features"))
    return [values[place].alias(f"f_{name}") for place, name in enumerate(FEATURES)]


@query
def rows_to_frame(spark, folder):
    counts = inputs.clean(spark, folder).groupBy("main_aqi").agg(F.count("*").alias("n_readings"))
    records = F.broadcast(advice.advice_table(spark))
    return counts.join(records, F.col("main_aqi") == F.col("advice_class")).select(
        "advice_class", "health_status", "label_prefix", "color_theme", "n_readings"
    )


@query
def model_store(spark, folder):
    """Each test row is scored by the model and by its saved and loaded copy."""
    model = inputs.forest(spark, folder)
    path = scratch_folder(spark, "model")
    models.save_model(model, path)
    models.save_model(model, path)
    loaded = models.load_model(spark, path)
    loaded.setPredictionCol("again").setProbabilityCol("odds_again").setRawPredictionCol("votes_again")
    scored = loaded.transform(model.transform(inputs.test_vectors(spark, folder)))
    same = (F.col("prediction") == F.col("again")) & (
        vector_to_array("probability") == vector_to_array("odds_again")
    )
    return scored.groupBy("main_aqi").agg(
        F.count("*").alias("n_rows"), F.count_if(same).alias("n_same")
    )


# Projections, filters and scalar functions


@query
def drop_null_label(spark, folder):
    return cleaning.drop_unlabelled(inputs.readings(spark, folder)).select(
        *KEYS, "datetime", "city", "main_aqi", "components_pm2_5"
    )


@query
def full_row_dedup(spark, folder):
    return cleaning.drop_copies(inputs.readings(spark, folder))


@query
def mixed_timestamp_parse(spark, folder):
    text = inputs.text_readings(spark, folder)
    return parse_mixed_timestamp(text, "datetime", "moment").select(*_typed_keys(), "moment")


@query
def timestamp_shapes(spark, folder):
    """Less usual shapes: weekdays, two-digit years, digits alone, months without a day, time first,
    the year before a name or between name and day."""
    moment = F.col("datetime")
    shapes = [
        "d-MMM-yy", "EEE MMM d yyyy", "EEEE, MMMM d, yyyy", "yyyyMMddHHmm", "yyyyMMddHHmmss",
        "MM/yyyy", "MMM yyyy", "H:mm yyyy-MM-dd", "M/d/yy H:mm", "yyyyMMdd'T'HHmm", "yyyy/MM", "yyyy-MMM-dd",
        "yyyy MMM dd", "h:mm a M/d/yyyy", "MMMM yyyy dd",
    ]
    text = F
    for rest, shape in enumerate(shapes):
        text = text.when(F.col("reading_id") % len(shapes) == rest, F.date_format(moment, shape))
    rows = inputs.readings(spark, folder).select(*KEYS, text.alias("text"))
    return parse_mixed_timestamp(rows, "text", "moment").select(*KEYS, "moment")


@query
def drop_bad_datetime(spark, folder):
    dated = cleaning.drop_undated(cleaning.parse_datetime(inputs.text_readings(spark, folder)))
    return dated.select(*_typed_keys(), "datetime")


@query
def date_parts(spark, folder):
    return cleaning.add_date_parts(inputs.readings(spark, folder)).select(
        *KEYS, "datetime", "hour", "month", "year"
    )


@query
def clean_readings(spark, folder):
    return inputs.clean(spark, folder)


@query
def feature_projection(spark, folder):
    """The test frame lacks one feature, so neither frame may use it."""
    rows = inputs.clean(spark, folder)
    train, test = train_split(rows), test_split(rows).drop("components_so2")
    names = features.available_features(train, test)
    totals = train.select(names).unionByName(test.select(names)).agg(
        *[F.count(name).alias(f"n_{name}") for name in names],
        *[F.avg(F.col(name).cast("double")).alias(f"mean_{name}") for name in names],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(place).alias("place"),
                F.lit(name).alias("feature"),
                F.col(f"n_{name}").alias("n_values"),
                F.round(f"mean_{name}", 4).alias("mean_value"),
            )
            for place, name in enumerate(names)
        ]
    )
    return totals.select(F.inline(rows))


def _with_gaps(spark, folder) -> DataFrame:
    gap = F.when(F.col("reading_id") % 97 != 0, F.col("wind_speed_10m"))
    return inputs.clean(spark, folder).withColumn("wind_speed_10m", gap)


@query
def feature_vector(spark, folder):
    """Rows with a missing feature are skipped."""
    vectors = features.assemble(_with_gaps(spark, folder), keep=KEYS)
    return vectors.select(*KEYS, *_vector_columns())


@query
def incomplete_rows(spark, folder):
    return features.count_incomplete(_with_gaps(spark, folder))


@query
def vector_and_label(spark, folder):
    values = vector_to_array(F.col("features"))
    return (
        features.assemble(inputs.clean(spark, folder))
        .select("features", "main_aqi")
        .groupBy("main_aqi")
        .agg(
            F.count("*").alias("n_rows"),
            F.max(F.size(values)).alias("vector_size"),
            F.sum(values[FEATURES.index("components_pm2_5")]).alias("total_pm2_5"),
        )
    )


@query
def request_defaults(spark, folder):
    filled = features.fill_request_defaults(inputs.requests(spark, folder))
    return filled.select(*KEYS, *REQUEST_DEFAULTS)


@query
def derived_features(spark, folder):
    ready = features.derive_features(features.fill_request_defaults(inputs.requests(spark, folder)))
    return ready.select(*KEYS, *FEATURES)


@query
def lenient_number(spark, folder):
    whole = F.col("components_pm2_5").cast("int").cast("string")
    kind = F.col("reading_id") % 7
    text = (
        F.when(kind == 0, F.concat(whole, F.lit(".5abc")))
        .when(kind == 1, F.concat(F.lit("  "), whole))
        .when(kind == 2, "junk")
        .when(kind == 3, "")
        .when(kind == 4, F.lit(None))
        .when(kind == 5, F.concat(F.lit("-"), whole, F.lit("e1")))
        .otherwise(F.concat(F.lit("."), whole, F.lit(".9")))
    )
    return inputs.readings(spark, folder).select(*KEYS, number_at_start(text).alias("number"))


@query
def form_requests(spark, folder):
    """Requests typed in by hand: some with a unit, some left empty."""
    form = inputs.readings(spark, folder).select(
        *KEYS,
        "city",
        F.concat(F.col("components_pm2_5").cast("int"), F.lit(" ug/m3")).alias("components_pm2_5"),
        F.when(F.col("reading_id") % 3 != 0, F.col("components_pm2_5").cast("int").cast("string")).alias("components_co"),
        F.lit("n/a").alias("components_no2"),
        F.concat(F.lit("-"), F.col("line_no"), F.lit(".5C")).alias("temperature_2m"),
    )
    return features.requests_from_form(form)


@query
def pm25_class(spark, folder):
    return inputs.requests(spark, folder).select(
        *KEYS, "components_pm2_5", class_of_pm25(F.col("components_pm2_5")).alias("aqi_code")
    )


@query
def fallback_rule(spark, folder):
    rows = features.fill_request_defaults(inputs.requests(spark, folder))
    answer = fallback_result(F.col("components_pm2_5"), F.col("city"))
    answered = baselines.attach_baselines(rows, baselines.default_baselines(spark))
    flat = answered.select(*KEYS, answer.alias("answer"), "historical_baselines")
    return flat.select(
        *KEYS, "answer.*", *[f"historical_baselines.{name}" for name in BASELINE_MEASURES]
    ).withColumn("precautions", F.array_join("precautions", " | "))


@query
def rule_confidence(spark, folder):
    """How many confidences of each class lie in its range, and whether they repeat."""
    code = class_of_pm25(F.col("components_pm2_5"))
    rows = inputs.readings(spark, folder).select(code.alias("aqi_code"), *KEYS)
    drawn = rows.select(
        "aqi_code", confidence_of_rule(F.col("aqi_code"), *[F.col(k) for k in KEYS]).alias("value")
    )
    inside = F.lit(False)
    for value, (low, high) in RULE_CONFIDENCE.items():
        inside = inside | ((F.col("aqi_code") == value) & F.col("value").between(low, high))
    return drawn.groupBy("aqi_code").agg(
        F.count("*").alias("n_rows"), F.count_if(inside).alias("n_inside")
    )


@query
def model_or_rule(spark, folder):
    """The label stands in for a model that answers two requests in three."""
    answered = F.when(F.col("reading_id") % 3 != 0, F.col("main_aqi"))
    chosen = scoring.model_or_rule(answered, class_of_pm25(F.col("components_pm2_5")))
    return inputs.readings(spark, folder).select(*KEYS, chosen.alias("aqi_code"))


@query
def vector_max(spark, folder):
    parts = ["components_no2", "components_o3", "components_pm2_5", "components_so2"]
    vectors = inputs.readings(spark, folder).select(
        *KEYS, array_to_vector(F.array(*[F.col(name) for name in parts])).alias("probability")
    )
    return vectors.select(*KEYS, forest.confidence().alias("largest"))


@query
def forest_confidence(spark, folder):
    """How often the confidence is the probability of the predicted class and no class has more."""
    rows = _both_ways(spark, folder)
    odds = vector_to_array("probability")
    same = (F.col("confidence") == odds[F.col("prediction").cast("int")]) & (
        F.size(F.filter(odds, lambda share: share > F.col("confidence"))) == 0
    )
    return rows.groupBy("main_aqi").agg(F.count("*").alias("n_rows"), F.count_if(same).alias("n_same"))


def _both_ways(spark, folder) -> DataFrame:
    """Test rows with what the model itself says and with class and confidence of `predict`."""
    model = inputs.forest(spark, folder)
    raw = model.transform(inputs.test_vectors(spark, folder)).withColumnRenamed("prediction", "raw_prediction")
    own = model.copy()
    own.setPredictionCol("prediction").setProbabilityCol("own_probability").setRawPredictionCol("own_votes")
    own_odds = own.transform(raw)
    return own_odds.select(
        "*",
        F.col("prediction").cast("int").alias("aqi_code"),
        forest.confidence("own_probability").alias("confidence"),
    )


@query
def prediction_to_int(spark, folder):
    """The class of `predict` is a whole number, and one that the forest knows."""
    scored = forest.predict(inputs.forest(spark, folder), inputs.test_vectors(spark, folder))
    whole = F.lit(dict(scored.dtypes)["prediction"] == "int") & F.col("prediction").between(0, 5)
    return scored.groupBy("main_aqi").agg(F.count("*").alias("n_rows"), F.count_if(whole).alias("n_whole"))


@query
def percent_rounding(spark, folder):
    share = F.col("components_pm2_5") / 400
    return inputs.readings(spark, folder).select(*KEYS, to_percent(share).alias("percent"))


@query
def display_index(spark, folder):
    code = F.when(F.col("reading_id") % 10 != 9, F.col("reading_id") % 8)
    return inputs.readings(spark, folder).select(
        *KEYS, code.alias("aqi_code"), index_of_class(code).alias("display_index")
    )


@query
def percent_of_baseline(spark, folder):
    rows = inputs.clean(spark, folder)
    compared = baselines.percent_of_baseline(rows, baselines.dataset_baselines(rows))
    return compared.select(*KEYS, *[f"{name}_percent" for name in BASELINE_MEASURES])


@query
def composition_profile(spark, folder):
    profile = baselines.composition_profile(inputs.clean(spark, folder), KEYS)
    return profile.withColumn("share", F.round("share", 9))


@query
def timeline_label(spark, folder):
    return inputs.clean(spark, folder).select(
        *KEYS, month_label(F.col("year"), F.col("month")).alias("label")
    )


@query
def city_label(spark, folder):
    label = label_with_city(F.lit("Optimal Air Index"), F.col("city"))
    return inputs.readings(spark, folder).select(*KEYS, label.alias("aqi_label"))


# Joins


@query
def advice_lookup(spark, folder):
    code = F.when(F.col("reading_id") % 10 != 9, F.col("reading_id") % 8)
    rows = inputs.readings(spark, folder).select(*KEYS, "city", code.alias("aqi_code"))
    return advice.attach_advice(rows).withColumn("precautions", F.array_join("precautions", " | "))


@query
def attach_baselines(spark, folder):
    rows = inputs.clean(spark, folder)
    joined = baselines.attach_baselines(rows, baselines.dataset_baselines(rows), "means")
    return joined.select(
        *KEYS, *[F.round(F.col(f"means.{name}"), 6).alias(f"mean_{name}") for name in BASELINE_MEASURES]
    )


# Aggregation, order, collections


@query
def cleaning_report(spark, folder):
    return cleaning.cleaning_report(csv_files.typed_readings(inputs.text_readings(spark, folder)))


@query
def cleaning_report_after_write(spark, folder):
    text = csv_files.typed_readings(inputs.text_readings(spark, folder))
    raw = inputs.stored(spark, text, scratch_folder(spark, "raw"))
    path = scratch_folder(spark, "reported")
    tables.write_readings(cleaning.clean_readings(raw), path)
    return cleaning.cleaning_report_after_write(raw, tables.read_readings(spark, path))


@query
def csv_malformed(spark, folder):
    """Lines with a field too many or too few, with labels and numbers that are none; counted by
    the report of the plan and from what the pass that sorts the rows out has committed."""
    path, sorted_ = scratch_folder(spark, "malformed"), scratch_folder(spark, "sorted-out")
    text = inputs.text_readings(spark, folder)
    last = ["wind_speed_10m", "relative_humidity_2m"]
    text = text.select(*[name for name in text.columns if name not in last], *last)
    kind = F.col("reading_id").cast("long") % 31
    text = text.withColumns(
        {
            "main_aqi": F.when(kind == 1, "3.7").when(kind == 2, "high").otherwise(F.col("main_aqi")),
            "components_co": F.when(kind == 3, "2f").otherwise(F.col("components_co")),
            "city": F.when(kind == 4, 'A "B", C').otherwise(F.col("city")),
        }
    )
    # Quotes inside a field are doubled, as files of data frames have them.
    field = lambda name: F.concat(F.lit('"'), F.replace(F.coalesce(name, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    whole = F.concat_ws(",", *[field(F.col(name)) for name in text.columns])
    short = F.concat_ws(",", *[field(F.col(name)) for name in text.columns[:-2]])
    open_ = F.concat(whole, F.lit(',"open'))
    line = F.when(kind == 5, F.concat(whole, F.lit(',"more"'))).when(kind == 6, short).when(kind == 7, open_)
    _write_lines(text.select(line.otherwise(whole).alias("value")), path)
    # The header is given, so no file starts with one.
    read = csv_files.read_csv(spark, path, text.columns, trace=True, headed=False)
    raw = inputs.stored(spark, read, scratch_folder(spark, "read"))
    remove_folder(spark, path)
    tables.write_outcomes([cleaning.sort_out(part) for part in cleaning.in_parts(raw, _PARTS)], sorted_)
    exact = cleaning.cleaning_report_of_parts(raw, _PARTS).withColumn("counted_by", F.lit("exact"))
    committed = cleaning.report_of_outcomes(tables.read_outcomes(spark, sorted_))
    return exact.unionByName(committed.withColumn("counted_by", F.lit("pass")))


@query
def rejected_rows(spark, folder):
    """One pass writes clean rows by month and beside them the rejected ones, each with how many rows
    of the input it stands for."""
    path = scratch_folder(spark, "outcomes")
    raw = csv_files.typed_readings(inputs.text_readings(spark, folder))
    raw = raw.withColumns({"_malformed": F.lit(None).cast("string"), "_short": F.lit(False), "_bad_label": F.lit(False)})
    tables.write_outcomes(cleaning.sort_out(raw), path)
    return (
        tables.read_outcomes(spark, path)
        .groupBy("cleaning_outcome", "year", "month")
        .agg(F.count("*").alias("n_rows"), F.sum("_copies").alias("n_input_rows"), F.sum("components_pm2_5").alias("total_pm2_5"))
    )


@query
def csv_line_breaks(spark, folder):
    """Texts with line breaks, backslashes, quotes and commas, written and read back."""
    path = scratch_folder(spark, "breaks")
    pieces = [" a\nb", "c\r\n\"d\",", "\\n\\", "e\\s\n\\r", "plain "]
    kind = (F.col("reading_id") % len(pieces)).cast("int")
    text = F.concat("city", F.element_at(F.array(*map(F.lit, pieces)), kind + 1))
    csv_files.write_csv(inputs.readings(spark, folder).withColumn("city", text).select(*KEYS, "city", "main_aqi"), path)
    n_lines = spark.read.text(path).where(~F.col("value").startswith("reading_id")).agg(F.count("*")).scalar()
    return csv_files.read_csv(spark, path).select(*_typed_keys(), "city", n_lines.alias("n_lines"))


@query
def dataset_baselines(spark, folder):
    means = baselines.dataset_baselines(inputs.clean(spark, folder))
    return means.select(*[F.round(name, 6).alias(name) for name in BASELINE_MEASURES])


@query
def monthly_means(spark, folder):
    return analytics.monthly_means(inputs.clean(spark, folder)).select(
        "year", "month", F.round("mean_aqi", 9).alias("mean_aqi"),
        F.round("mean_pm2_5", 9).alias("mean_pm2_5"),
    )


@query
def monthly_order(spark, folder):
    ordered = analytics.in_time_order(analytics.monthly_means(inputs.clean(spark, folder)))
    return ordered.select("year", "month", F.round("mean_pm2_5", 9).alias("mean_pm2_5"))


@query
def monthly_timeline(spark, folder):
    return analytics.monthly_timeline(inputs.clean(spark, folder))


@query
def overall_index(spark, folder):
    return analytics.overall_index(inputs.clean(spark, folder))


@query
def city_leaderboard(spark, folder):
    return analytics.city_leaderboard(inputs.clean(spark, folder)).withColumn(
        "mean_aqi", F.round("mean_aqi", 9)
    )


@query
def city_leaderboard_of_pieces(spark, folder):
    """One raw piece per city, from one write, and no city inside: the city is that of the piece. Equal
    rows of two pieces are copies, and count for the first city by name."""
    root = scratch_folder(spark, "per-city")
    text = inputs.text_readings(spark, folder).where("city <> 'N/A'")
    piece = F.concat(F.replace("city", F.lit(" "), F.lit("-")), F.lit("_complete_data.csv"))
    pieces = text.withColumn("piece", piece).drop("city").write.partitionBy("piece")
    pieces.option("header", True).option("escape", '"').csv(root)
    raw = csv_files.read_training(spark, root, city_of_file=True)
    return analytics.city_leaderboard(cleaning.clean_readings(raw)).withColumn("mean_aqi", F.round("mean_aqi", 9))


@query
def timeline_series(spark, folder):
    """Both arrays, shown again as rows by place."""
    series = analytics.timeline_series(inputs.clean(spark, folder))
    return series.select(F.posexplode(F.arrays_zip("labels", "real_pm25"))).select(
        F.col("pos").alias("place"), F.col("col.labels").alias("label"), F.col("col.real_pm25").alias("real_pm25")
    )


@query
def dashboard_or_fallback(spark, folder):
    """The dashboard of a written table, and what an absent one gives."""
    root = scratch_folder(spark, "dashboard")
    tables.write_readings(inputs.clean(spark, folder), f"{root}/there")
    shown = live_dashboard(spark, f"{root}/there").unionByName(live_dashboard(spark, f"{root}/absent"))
    return shown.select(
        "status",
        F.size("labels").alias("n_months"),
        F.array_join("labels", ",").alias("labels"),
        "overall_index",
        F.array_join("cities", ",").alias("cities"),
        F.get("city_index", F.lit(0)).alias("highest_index"),
    )


@query
def dedup_across_loads(spark, folder):
    """Overlapping loads leave the rows that one load of all would leave."""
    return loaded_readings(spark, inputs.loads(spark, folder)).select(
        *_typed_keys(), "datetime", "city", "main_aqi", "hour", "month", "year", *MEASURES
    )


@query
def rollup_monthly_means(spark, folder):
    return rollup.monthly_means(loaded_sums(spark, inputs.loads(spark, folder))).select(
        "year", "month", F.round("mean_aqi", 6).alias("mean_aqi"), F.round("mean_pm2_5", 6).alias("mean_pm2_5")
    )


@query
def rollup_baselines(spark, folder):
    means = loaded_baselines(spark, inputs.loads(spark, folder))
    return means.select(*[F.round(name, 6).alias(name) for name in BASELINE_MEASURES])


@query
def rollup_leaderboard(spark, folder):
    board = rollup.city_leaderboard(loaded_sums(spark, inputs.loads(spark, folder)))
    return board.withColumn("mean_aqi", F.round("mean_aqi", 9))


@query
def rollup_dashboard(spark, folder):
    """The dashboard of the sums, before the first load and after all."""
    root = scratch_folder(spark, "no-loads")
    shown = loaded_dashboard(spark, inputs.loads(spark, folder)).unionByName(loaded_dashboard(spark, root))
    return shown.select(
        "status",
        F.size("labels").alias("n_months"),
        F.array_join("labels", ",").alias("labels"),
        "overall_index",
        F.array_join("cities", ",").alias("cities"),
        F.get("city_index", F.lit(0)).alias("highest_index"),
    )


# Machine learning


@query
def forest_fit(spark, folder):
    """Importances of the forest, and whether fits of rows laid out in two ways give equal trees."""
    model = inputs.forest(spark, folder)
    vectors = inputs.training_vectors(spark, folder)
    times = forest.partitions_for(vectors.count(), 1)
    layouts = []
    for n in (3, 7):
        path = scratch_folder(spark, "layout")
        tables.write_features(vectors.repartition(n * times), path)
        fitted = forest.fit_forest(
            tables.read_features(spark, path), num_trees=3, repeatable_partitions=inputs.FIT_PARTITIONS
        )
        remove_folder(spark, path)
        layouts.append(fitted.toDebugString.split("\n", 1)[1])
    importances = [float(value) for value in model.featureImportances.toArray()]
    return train_split(inputs.clean(spark, folder)).agg(
        F.count("*").alias("n_train"),
        F.lit(len(importances)).alias("n_features"),
        F.round(F.lit(sum(importances)), 9).alias("total_importance"),
        F.lit(min(importances) >= 0).alias("none_negative"),
        F.lit(layouts[0] == layouts[1]).alias("layout_is_no_matter"),
    )


@query
def forest_shape(spark, folder):
    model = inputs.forest(spark, folder)
    return train_split(inputs.clean(spark, folder)).agg(
        F.lit(model.getNumTrees).alias("num_trees"),
        F.lit(model.getMaxDepth()).alias("max_depth"),
        F.lit(model.numFeatures).alias("num_features"),
        F.lit(model.numClasses).alias("num_classes"),
        F.count("*").alias("n_train"),
    )


@query
def forest_predictions(spark, folder):
    """How often the class of `predict` is the one with the most votes, the first of equal ones."""
    rows = _both_ways(spark, folder)
    votes = vector_to_array("rawPrediction")
    most = F.array_position(votes, F.array_max(votes)) - 1
    return rows.groupBy("main_aqi").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("aqi_code") == most).alias("n_same")
    )


@query
def forest_prediction_counts(spark, folder):
    """Every test row is scored once, with a class and a confidence that can be."""
    scored = forest.predict(inputs.forest(spark, folder), inputs.test_vectors(spark, folder))
    return scored.groupBy("main_aqi").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("prediction").between(0, 5)).alias("n_class_valid"),
        F.count_if((F.col("confidence") > 0) & (F.col("confidence") <= 1)).alias("n_confidence_valid"),
    )


@query
def forest_on_counted_rows(spark, folder):
    """A fit on different rows with their counts as weights, beside one on all rows: training rows of
    every third reading stand three times. Both are measured on the test split."""
    rows = train_split(inputs.clean(spark, folder))
    thrice = F.explode(F.array_repeat(F.lit(1), F.when(F.col("reading_id") % 3 == 0, 3).otherwise(1)))
    vectors = features.assemble(rows.select("*", thrice.alias("__time")).drop("__time"))
    paths = [scratch_folder(spark, name) for name in ("all-rows", "counted-rows")]
    tables.write_features(vectors, paths[0])
    everything = tables.read_features(spark, paths[0])
    tables.write_features(forest.counted_rows(everything), paths[1])
    counted = tables.read_features(spark, paths[1])
    test = inputs.test_vectors(spark, folder)
    fits = [forest.fit_forest(frame, repeatable_partitions=inputs.FIT_PARTITIONS) for frame in (everything, counted)]
    first, second = (forest.evaluate(forest.predict(model, test)).first() for model in fits)
    close = lambda name: F.lit(abs(first[name] - second[name]) <= 0.005)
    return counted.agg(
        F.sum(forest.WEIGHT).cast("long").alias("n_rows"),
        F.count("*").alias("n_different"),
        close("accuracy").alias("accuracy_is_close"),
        close("weighted_f1").alias("weighted_f1_is_close"),
    )


@query
def forest_metrics(spark, folder):
    """Accuracy and weighted F1 against those of Spark's evaluator."""
    scored = forest.predict(inputs.forest(spark, folder), inputs.test_vectors(spark, folder))
    path = scratch_folder(spark, "scored")
    scored.write.parquet(path)
    stored = spark.read.parquet(path)
    doubles = stored.select(F.col("main_aqi").cast("double"), F.col("prediction").cast("double"))
    theirs = {
        name: MulticlassClassificationEvaluator(labelCol="main_aqi", metricName=metric).evaluate(doubles)
        for name, metric in (("accuracy", "accuracy"), ("weighted_f1", "f1"))
    }
    own = forest.evaluate(stored)
    return own.select(
        "n_rows", *[(F.abs(F.col(name) - value) < 1e-9).alias(f"{name}_agrees") for name, value in theirs.items()]
    )


def _rule_predictions(spark, folder) -> DataFrame:
    prediction = class_of_pm25(F.col("components_pm2_5"))
    return inputs.clean(spark, folder).select("main_aqi", prediction.alias("prediction"))


@query
def rule_accuracy(spark, folder):
    return forest.evaluate(_rule_predictions(spark, folder)).select(
        "n_rows", F.round("accuracy", 9).alias("accuracy")
    )


@query
def rule_weighted_f1(spark, folder):
    return forest.evaluate(_rule_predictions(spark, folder)).select(
        "n_rows", F.round("weighted_f1", 9).alias("weighted_f1")
    )


@query
def confusion_matrix(spark, folder):
    return forest.confusion_matrix(_rule_predictions(spark, folder))


_SCORE_TEXTS = ["health_status", "aqi_label", "aqi_desc", "color_theme", "city"]


def _flat_answer(answers: DataFrame, *more: Column | str) -> DataFrame:
    return answers.select(
        *KEYS,
        "status",
        "aqi_code",
        *_SCORE_TEXTS,
        F.array_join("precautions", " | ").alias("precautions"),
        "display_index",
        *[
            F.round(F.col(f"historical_baselines.{name}"), 6).alias(f"mean_{name}")
            for name in BASELINE_MEASURES
        ],
        *more,
    )


@query
def score_by_rule(spark, folder):
    means = baselines.dataset_baselines(inputs.clean(spark, folder))
    return _flat_answer(scoring.score(inputs.requests(spark, folder), means, keep=KEYS))


@query
def score_by_forest(spark, folder):
    means = baselines.dataset_baselines(inputs.clean(spark, folder))
    model = inputs.forest(spark, folder)
    return _agreeing(scoring.score(inputs.requests(spark, folder), means, model, keep=KEYS))


def _agreeing(answers: DataFrame) -> DataFrame:
    """Per status, answers whose advice, label and index are those of their own class, whose
    confidence can be one, and which say that the model gave them."""
    texts = advice.advice_table(answers.sparkSession).collect()
    expected = F.lit(None)
    for row in texts:
        own = F.struct(
            F.lit(row.health_status).alias("health_status"),
            F.concat(F.lit(row.label_prefix + " ("), "city", F.lit(")")).alias("aqi_label"),
            F.lit(row.color_theme).alias("color_theme"),
        )
        expected = F.when(advice.advice_class(F.col("aqi_code")) == row.advice_class, own).otherwise(expected)
    given = F.struct("health_status", "aqi_label", "color_theme")
    return answers.groupBy("status").agg(
        F.count("*").alias("n_rows"),
        F.count_if(given == expected).alias("n_advice"),
        F.count_if(F.col("display_index") == index_of_class(F.col("aqi_code"))).alias("n_index"),
        F.count_if(F.col("prediction_confidence").between(0, 100)).alias("n_confidence"),
        F.count_if(F.col("scored_by") == "model").alias("n_model"),
    )


def _request_lines(spark, folder) -> str:
    """Requests as JSON files, with one line in 13 cut short."""
    path = scratch_folder(spark, "requests")
    line = F.to_json(F.struct(*KEYS, *REQUEST_DEFAULTS), {"ignoreNullFields": "true"})
    rows = inputs.requests(spark, folder).withColumn(
        "temperature_2m", F.nullif(F.col("temperature_2m"), F.lit(float("nan")))
    )
    broken = F.when(F.col("reading_id") % 13 == 0, F.concat(F.lit("x"), line)).otherwise(line)
    _write_lines(rows.select(broken.alias("value")), path)
    return path


def _mixed_request_lines(spark, folder) -> str:
    """Requests as JSON files in which numbers come as text or with a fraction, some are junk or
    missing, some lines are cut or no object, and some give a date instead of hour and month."""
    path = scratch_folder(spark, "mixed-requests")
    rows = inputs.requests(spark, folder).withColumn(
        "temperature_2m", F.nullif(F.col("temperature_2m"), F.lit(float("nan")))
    )

    def line(**changed: Column) -> Column:
        fields = [changed.get(name, F.col(name)).alias(name) for name in [*KEYS, *REQUEST_DEFAULTS]]
        more = [value.alias(name) for name, value in changed.items() if name not in REQUEST_DEFAULTS]
        return F.to_json(F.struct(*fields, *more), {"ignoreNullFields": "true"})

    kind = F.col("reading_id") % 17
    moment = F.format_string("2021-%02d-13T%02d:30:00", F.col("line_no") + 1, F.col("line_no"))
    texts = {name: F.col(name).cast("string") for name in ("hour", "components_pm2_5")}
    absent = F.lit(None).cast("int")
    value = (
        F.when(kind == 0, line(**texts))
        .when(kind == 2, line(hour=F.col("hour") + 0.9))
        .when(kind == 3, line(components_pm2_5=F.lit("abc")))
        .when(kind == 4, F.expr("left(plain, length(plain) - 3)"))
        .when(kind == 5, F.concat(F.lit("["), F.col("plain"), F.lit("]")))
        .when(kind == 6, line(components_pm2_5=F.lit("NaN")))
        .when(kind == 7, line(hour=absent, month=absent, datetime=moment))
        .otherwise(F.col("plain"))
    )
    _write_lines(rows.withColumn("plain", line()).select(value.alias("value")), path)
    return path


@query
def score_json_requests(spark, folder):
    lines = request_files.read_requests(spark, _mixed_request_lines(spark, folder), inputs.KEY_FIELDS)
    means = baselines.default_baselines(spark)
    answers = scoring.score(lines, means, keep=[*KEYS, "hour", "month"])
    return answers.select(*KEYS, "status", "aqi_code", "city", "hour", "month", "scored_by", "message")


def _streamed(spark, folder, model) -> tuple[DataFrame, DataFrame]:
    """Answers of the stream and of a batch over the same files."""
    means = baselines.dataset_baselines(inputs.clean(spark, folder)).first().asDict()
    lines = _request_lines(spark, folder)
    output = scratch_folder(spark, "answers")
    arriving = request_files.stream_requests(spark, lines, inputs.KEY_FIELDS)
    started = start_scoring(
        arriving, means, output, scratch_folder(spark, "progress"), model, keep=KEYS
    )
    started.awaitTermination()
    batch = scoring.score(
        request_files.read_requests(spark, lines, inputs.KEY_FIELDS), means, model, keep=KEYS
    )
    return spark.read.parquet(output), batch


@query
def stream_by_rule(spark, folder):
    return _flat_answer(_streamed(spark, folder, None)[0])


@query
def stream_by_forest(spark, folder):
    return _agreeing(_streamed(spark, folder, inputs.forest(spark, folder))[0])


@query
def stream_equals_batch(spark, folder):
    """Answers that only the stream or only the batch gave, out of all."""
    streamed, batch = (
        _flat_answer(side, "prediction_confidence").groupBy(F.xxhash64(F.to_json(F.struct(
            *KEYS, "status", "aqi_code", "aqi_label", "prediction_confidence"))).alias("answer")
        ).agg(F.count("*").alias(name))
        for side, name in zip(_streamed(spark, folder, inputs.forest(spark, folder)), ("n_stream", "n_batch"))
    )
    both = streamed.join(batch, "answer", "full").fillna(0, ["n_stream", "n_batch"])
    return both.agg(
        F.sum("n_batch").alias("n_rows"),
        F.sum(F.abs(F.col("n_stream") - F.col("n_batch"))).alias("n_different"),
    )


@query
def stream_over_versions(spark, folder):
    """A stream that ran before the first version, then by means alone, then by a forest: requests
    arrive in three lots, and a version is published between them."""
    lines, versions, output = (scratch_folder(spark, name) for name in ("arriving", "versions", "versioned"))
    progress = scratch_folder(spark, "progress")
    requests = inputs.requests(spark, folder)
    means = baselines.dataset_baselines(inputs.clean(spark, folder)).first().asDict()
    lot = F.col("reading_id") % 3
    for place, model in enumerate([None, None, inputs.forest(spark, folder)]):
        _write_lines(requests.where(lot == place).select(F.to_json(F.struct(*requests.columns))), lines)
        if place:
            models.publish_version(spark, versions, means, model)
        arriving = request_files.stream_requests(spark, lines, inputs.KEY_FIELDS)
        start_versioned_scoring(arriving, versions, output, progress, keep=KEYS).awaitTermination()
    answers = spark.read.parquet(output)
    return answers.groupBy(MODEL_VERSION, (F.col("reading_id") % 3).cast("int").alias("lot"), "scored_by", "status").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("batch_id").alias("n_batches"),
        F.round(F.avg("historical_baselines.components_pm2_5"), 6).alias("mean_pm2_5"),
    )
