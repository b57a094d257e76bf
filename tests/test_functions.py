"""Column functions on literal values and against data frames or plain Python."""

import math
import random
import warnings

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.functions import bands, numbers
from skyledger.functions.timestamps import month_label, parse_mixed_timestamp
from skyledger.schema import MEASURES
from skyledger.session import tune
from skyledger.sources import csv_files


def _column(spark, values, kind, expression):
    rows = [(place, value) for place, value in enumerate(values)]
    frame = spark.createDataFrame(rows, f"place int, x {kind}")
    answers = frame.select("place", expression(F.col("x")).alias("y")).collect()
    return [row.y for row in sorted(answers, key=lambda row: row.place)]


def test_pm25_limits_belong_to_the_lower_class(spark):
    levels = [0.0, 25.0, 25.01, 50.0, 50.01, 100.0, 100.01, 150.0, 150.01, None, float("nan"), -3.0]
    assert _column(spark, levels, "double", bands.pm25_class) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 1, 1, 1]


def test_display_index(spark):
    codes = [0, 1, 2, 3, 4, 5, 6, None]
    assert _column(spark, codes, "int", bands.display_index) == [25, 25, 45, 78, 135, 240, 25, 25]


def test_fallback_rule_is_strict_at_its_limit(spark):
    answers = _column(
        spark, [100.0, 100.01, None], "double", lambda x: bands.fallback_result(x, F.lit("Quetta"))
    )
    assert [answer.aqi_code for answer in answers] == [2, 4, 2]
    assert answers[0].aqi_label == "Optimal Air Index (Quetta)"
    assert answers[1].health_status == "UNHEALTHY"
    assert {answer.prediction_confidence for answer in answers} == {91.5}


def test_rule_confidence_stays_in_range_and_repeats(spark):
    rows = spark.range(5000).select((F.col("id") % 7).cast("int").alias("code"), "id")
    draw = bands.rule_confidence(F.col("code"), F.col("id")).alias("value")
    first = {row.id: row for row in rows.select("code", "id", draw).collect()}
    again = {row.id: row for row in rows.repartition(13).select("code", "id", draw).collect()}
    assert first == again
    for row in first.values():
        if row.code not in bands.RULE_CONFIDENCE:
            assert row.value is None
            continue
        low, high = bands.RULE_CONFIDENCE[row.code]
        assert low <= row.value <= high
    spread = [row.value for row in first.values() if row.code == 5]
    assert max(spread) - min(spread) > 0.05


def test_text_to_measure_treats_all_spellings_of_missing_alike(spark):
    texts = ["1.5", "", "NA", "NaN", "nan", "null", "None", "#N/A", "1.#QNAN", " 7 ", "abc", None]
    assert _column(spark, texts, "string", numbers.to_measure) == [
        1.5, None, None, None, None, None, None, None, None, 7.0, None, None,
    ]
    assert _column(spark, numbers.MISSING_TOKENS + ["Lahore"], "string", numbers.missing_to_null) == [
        None
    ] * len(numbers.MISSING_TOKENS) + ["Lahore"]


def test_whole_numbers(spark):
    texts = ["4", "4.0", "3.5", "x", None, "NaN"]
    assert _column(spark, texts, "string", numbers.to_whole_number) == [4, 4, None, None, None, None]


def test_lenient_number(spark):
    given_texts = {
        "12abc": 12.0, "-3.5": -3.5, ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "1e": 1.0, "junk": 0.0,
        "": 0.0, " 7 ": 7.0, "0x10": 0.0, "-0": 0.0, "--4": 0.0, "1_000": 1.0, "NaN": 0.0,
        "12.5.6": 12.5, "Infinity": math.inf, "-Infinity": -math.inf, "+4": 4.0,
    }
    assert _column(spark, list(given_texts), "string", numbers.lenient_number) == list(given_texts.values())
    assert _column(spark, [None], "string", numbers.lenient_number) == [0.0]
    negative_zero = _column(spark, ["-0"], "string", numbers.lenient_number)[0]
    assert math.copysign(1, negative_zero) == 1


def test_halves_round_up_also_below_zero(spark):
    assert _column(spark, [2.5, -2.5, 0.5, -0.5, 1.4999], "double", numbers.round_half_up) == [3, -2, 1, 0, 1]


def test_uniform_is_in_the_unit_interval_and_even(spark):
    drawn = [row.u for row in spark.range(20000).select(numbers.repeatable_uniform(F.col("id")).alias("u")).collect()]
    assert 0 <= min(drawn) and max(drawn) < 1
    assert abs(sum(drawn) / len(drawn) - 0.5) < 0.01


def test_month_label(spark):
    rows = spark.createDataFrame([(2021, 8), (2022, 12)], "y int, m int")
    assert [r.l for r in rows.select(month_label(F.col("y"), F.col("m")).alias("l")).collect()] == ["08/2021", "12/2022"]


DATES = [
    "2021-08-01 05:00:00", "2021-08-01", "8/13/2021 5:00", "8/13/2021 5:00:30", "13/8/2021 5:00",
    "08-13-2021", "13.08.2021", "8/13/21 5:00", "21-08-13", "2021/08/13 5:00", "2021.8.13",
    "20210813", "20210813 05:00", "20210813T05:00:01", "Aug 13, 2021 5:00 PM", "August 13 2021",
    "13 Aug 2021 05:00", "13-Aug-2021", "Sept 3, 2021", "3rd Aug 2021", "Aug-13-2021",
    "2021-08-01 5:00 PM", "2021-08-01 12:00 AM", "2021-08-01 12:30 pm", "8/13/2021 5PM",
    "8/13/2021 13:00 PM", "8/13/2021 0:00 AM", "2021-08-01  05:00:00", " 2021-08-01 ", "2021", "2021-08",
    "8/13/2021 5:00:00.123456", "1/2/2021", "2021-8-1T5:0:0", "2021-08-01T05",
    "junk", "", " ", None, "13/13/2021", "2021-02-30", "2/30/2021", "Foo 13, 2021", "marble 3, 2021",
    "2021-08-01 24:00", "12021-08-01", "99999", "am", "5 pm", "8/13/2021 25:00", "1.5", "100", "20211308",
    "202108",
]


def _pandas_dates(texts):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parsed = [
            pd.to_datetime(pd.Series([text], dtype=object), format="mixed", errors="coerce")[0]
            for text in texts
        ]
    return [None if pd.isna(moment) else moment.to_pydatetime() for moment in parsed]


def _spark_dates(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "place int, x string")
    rows = parse_mixed_timestamp(frame, "x", "moment").collect()
    return [row.moment for row in sorted(rows, key=lambda row: row.place)]


def test_mixed_dates_parse_as_data_frames_do(spark):
    assert dict(zip(DATES, _spark_dates(spark, DATES))) == dict(zip(DATES, _pandas_dates(DATES)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    moments=st.lists(
        st.datetimes(min_value=pd.Timestamp("1970-01-01"), max_value=pd.Timestamp("2199-12-31")),
        min_size=1,
        max_size=30,
    ),
    shape=st.sampled_from(
        ["%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M", "%d %B %Y %H:%M", "%b %d, %Y %I:%M %p", "%Y/%m/%d %H:%M:%S", "%Y%m%d"]
    ),
)
def test_any_moment_in_a_known_shape_parses(spark, moments, shape):
    texts = [moment.strftime(shape) for moment in moments]
    assert _spark_dates(spark, texts) == _pandas_dates(texts)


def test_a_filter_on_the_parsed_date_does_not_copy_the_steps(spark):
    frame = spark.createDataFrame([("8/13/2021 5:00",)], "x string").repartition(1)
    whole = parse_mixed_timestamp(frame, "x")
    parsed = whole.where(F.col("x").isNotNull())
    casts = [f._jdf.queryExecution().executedPlan().toString().count("try_cast") for f in (whole, parsed)]
    assert casts[0] == casts[1] > 0
    assert parsed.count() == 1


def test_percent(spark):
    assert _column(spark, [0.9123, 1.0, None], "double", numbers.to_percent) == [91.2, 100.0, None]


def test_shown_values_round_as_python_does(spark):
    draw = random.Random(5)
    values = [2.675, 0.125, 0.375, 127.335, 1.005, 2.5, -2.675, -0.125, 0.0, 1e-9, 123456.785, 0.285, 1.115]
    values += [draw.randrange(10**6) / 1000 for _ in range(4000)]
    values += [draw.randrange(10**5) / 400 for _ in range(4000)]
    values += [draw.uniform(-500, 500) for _ in range(2000)]
    for digits in (1, 2):
        rounded = _column(spark, values, "double", lambda x: numbers.round_shown(x, digits))
        assert rounded == [round(value, digits) for value in values]
    assert _column(spark, [None, float("inf")], "double", lambda x: numbers.round_shown(x, 1)) == [None, math.inf]


RARE_SHAPES = [
    "13-Aug-21", "13-Aug-99", "Fri Aug 13 2021", "Friday, August 13, 2021", "202108130500", "20210813051542", "08/2021",
    "Aug 2021", "5:00 2021-08-13", "5:00:30 8/13/2021", "8/13/99", "8/13/68", "13-Aug-21 5:00 PM",
    "20210813T0500", "20210813 0500", "20210813T050001", "2021/08", "2021.08", "8-2021", "2021-Aug-13", "2021 Aug 13",
    "5:00 PM 8/13/2021", "5:00:30 PM 13 Aug 2021", "5 PM 8/13/2021", "August 2021 13", "August 2021 13 5:00 PM",
    "2021 Aug", "2021 August", "Aug/13/2021", "13/Aug/2021", "2021 13 Aug", "13Aug2021", "13 of August 2021",
    "August, 13 2021", "Sep. 3, 2021", "8/13/2021T5:00", "Aug 2021 5:00", "2021/08 5:00", "Fri 5:00 2021-08-13",
    "Friday 13 August 2021 5 PM", "8/13/2021 5:00 p.m.", "8/13/2021 5:00p", "12.31.99", "99/12/31", "1/2/3", "21/8/13",
    "2021/8/13 5:00:00.25", "2021-Aug-13 05:00", "2021-08-13 05:00:00 AM", "05:00 13.08.2021",
]


def test_rare_date_shapes_as_data_frames_read_them(spark):
    rows = spark.createDataFrame([(text,) for text in RARE_SHAPES], "text string")
    got = [row.moment for row in parse_mixed_timestamp(rows, "text", "moment").collect()]
    assert got == [pd.to_datetime(text).to_pydatetime() for text in RARE_SHAPES]


def test_the_pivot_of_short_years_is_a_parameter(spark):
    rows = spark.createDataFrame([("1/2/30",), ("1/2/29",)], "text string")
    got = [row.moment.year for row in parse_mixed_timestamp(rows, "text", "moment", year_pivot=30).collect()]
    assert got == [1930, 2029]


def test_names_of_weekdays_and_bare_words_are_no_dates(spark):
    texts = [
        "Sunday", "Mon", "monday morning", "12345", "1234567890", "the 13 August 2021", "2021/13/08", "20211308T0500",
        "20210813X0500", "31 Nov 2021", "13:00 PM 8/13/2021", "08/13", "13 Aug", "08.2021", "-8/13/2021",
        "8/13/2021 5:00 foo", "3xx Aug 2021", "8/13/2021 5 foo", "１３ Aug 2021", "Ağu 13, 2021", "8/13/2021/4", "9a", "a 9", "9:9",
    ]
    assert _spark_dates(spark, texts) == [None] * len(texts)


def test_zones_are_dropped(spark):
    texts = ["8/13/2021 5:00Z", "8/13/2021 5:00 +05:00", "Aug 13 2021 5:00 UTC", "13.8.2021 5:00-0300"]
    assert [str(moment) for moment in _spark_dates(spark, texts)] == ["2021-08-13 05:00:00"] * 4


def test_numbers_with_letters_or_beyond_range_are_missing(spark):
    rows = spark.createDataFrame([("1.5d",), ("2f",), ("1e400",), (" 3.5 ",), ("-.5e1",), ("0x1p3",), ("inf",)], "text string")
    got = rows.select(numbers.to_measure(F.col("text")).alias("a"), numbers.to_whole_number(F.col("text")).alias("b")).collect()
    assert [row.a for row in got] == [None, None, None, 3.5, -5.0, None, None]
    assert [row.b for row in got] == [None, None, None, None, -5, None, None]


def test_each_text_is_taken_apart_once(spark):
    raw = spark.range(1).select(*[F.col("id").cast("string").alias(name) for name in ("main_aqi", *MEASURES)])
    plan = csv_files.typed_readings(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 + len(MEASURES)


def test_numbers_at_the_edge(spark):
    texts = ["3.0", "-0.0", "3.7", "1e400", "-1e400", "1.5d", " 7 ", "3e9", "0x1p3", "", None]
    raw = spark.createDataFrame([(t, t) for t in texts], "main_aqi string, components_co string")
    got = [tuple(row) for row in csv_files.typed_readings(raw).collect()]
    assert got == [
        (3, 3.0), (0, -0.0), (None, 3.7), (None, None), (None, None), (None, None), (7, 7.0), (None, 3e9),
        (None, None), (None, None), (None, None),
    ]


def test_no_stage_has_a_method_that_the_jvm_leaves_uncompiled(spark):
    assert tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_the_city_of_a_piece_is_looked_for_in_names_not_at_every_letter(spark):
    paths = {
        "file:/a/b=c/New%20York_complete_data.csv": "New%20York", "/x_complete_data.csv/part-0.csv": "x",
        "/piece=AS-IA_complete_data.csv/part-0.csv": "AS-IA", "/piece%3DASIA_complete_data.csv": "ASIA",
        "/a=b=c_complete_data.csv": "b=c", "/=x_complete_data.csv": "=x", "/other.csv": "", "/_complete_data.csv": "",
    }
    found = _column(spark, list(paths), "string", lambda path: F.regexp_extract(path, csv_files._PIECE_OF_CITY, 1))
    assert found == list(paths.values())
    assert csv_files._PIECE_OF_CITY.startswith("(?:^|/)")
