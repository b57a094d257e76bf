"""Cleaning against a plain data-frame version of it."""

import datetime
import json
import os
import random
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.operators import clean
from skyledger.sources.csv_files import read_csv, write_csv

COLUMNS = "city string, datetime string, main_aqi int, components_pm2_5 double, components_so2 double"


def _raw_rows(count, seed):
    draw = random.Random(seed)
    texts = ["2021-08-01 05:00:00", "8/13/2021 5:00", "Aug 14, 2021 7:00 PM", "junk", None, "2022-01-05"]
    rows = [
        (
            draw.choice(["Lahore", "Quetta", None]),
            draw.choice(texts),
            draw.choice([1, 2, 3, None]),
            draw.choice([10.0, 60.5, float("nan"), None, 0.0, -0.0]),
            draw.choice([1.0, None]),
        )
        for _ in range(count)
    ]
    return rows + rows[: count // 3]


def _frame_version(rows):
    raw = pd.DataFrame(rows, columns=["city", "datetime", "main_aqi", "components_pm2_5", "components_so2"])
    labelled = raw.dropna(subset=["main_aqi"])
    unique = labelled.drop_duplicates().copy()
    unique["datetime"] = pd.to_datetime(unique["datetime"], format="mixed", errors="coerce")
    dated = unique.dropna(subset=["datetime"]).copy()
    dated["hour"] = dated["datetime"].dt.hour
    return raw, labelled, unique, dated


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cleaning_equals_the_frame_version(spark, tmp_path, seed):
    rows = _raw_rows(400, seed)
    raw, labelled, unique, dated = _frame_version(rows)
    # NaN and missing are one thing in a file, so the comparison starts from one.
    write_csv(spark.createDataFrame(rows, COLUMNS), str(tmp_path / "raw"))
    read = read_csv(spark, str(tmp_path / "raw"))
    cleaned = clean.clean_readings(read)
    assert cleaned.count() == len(dated)
    assert cleaned.agg(F.sum("hour")).first()[0] == dated["hour"].sum()
    expected = {
        "initial_rows": len(raw),
        "labelled_rows": len(labelled),
        "unique_rows": len(unique),
        "clean_rows": len(dated),
        "dropped_rows": len(raw) - len(dated),
    }
    assert clean.cleaning_report(read).first().asDict() == expected
    assert clean.cleaning_report_after_write(read, cleaned).first().asDict() == expected


def test_copies_are_judged_on_raw_rows(spark):
    """One moment in two spellings is no copy."""
    rows = [("2021-08-13 05:00:00", 1), ("8/13/2021 5:00", 1), ("8/13/2021 5:00", 1)]
    cleaned = clean.clean_readings(spark.createDataFrame(rows, "datetime string, main_aqi int"))
    assert [row.datetime for row in cleaned.collect()] == [datetime.datetime(2021, 8, 13, 5)] * 2


def test_null_equals_null_and_nan_equals_nan_among_copies(spark):
    rows = [(None, float("nan")), (None, float("nan")), ("a", None), ("a", None), ("a", float("nan"))]
    assert clean.drop_copies(spark.createDataFrame(rows, "x string, y double")).count() == 3


def test_a_large_group_of_copies_is_collapsed_before_the_shuffle(spark):
    hot = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"), F.lit(1).alias("main_aqi")
    )
    plan = clean.drop_copies(hot)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") == 2
    assert plan.count() == 200_001


def test_empty_input_is_reported_as_zero(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert set(clean.cleaning_report(empty).first().asDict().values()) == {0}
    assert clean.clean_readings(empty).count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([(1, 2.0, 3.0), (None, 2.0, 3.0)], "main_aqi int, a double, b double").write.parquet(path)
    plan = clean.drop_unlabelled(spark.read.parquet(path)).select("a")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(main_aqi)]" in text
    assert "ReadSchema: struct<main_aqi:int,a:double>" in text


def test_counts_of_the_writing_pass_survive_failed_tasks(tmp_path):
    """Committed files give the counts, so tasks that ran twice count once."""
    rows = _raw_rows(500, 5)
    lines = ["city,datetime,main_aqi,components_pm2_5,components_so2"]
    text = lambda value: "" if value is None else f'"{value}"'
    lines += [",".join(map(text, row)) for row in rows]
    lines += ['Lahore,2021-08-01,1,2,3,4'] * 3 + ["Lahore,2021-08-02,2"] * 4 + ["Quetta,2021-08-02,bad,1,1"] * 2
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = os.path.join(root, "tests", "retried_cleaning.py")
    done = subprocess.run(
        [sys.executable, script, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300
    )
    assert "ANSWER" in done.stdout, done.stderr[-3000:]
    answer = json.loads(done.stdout.split("ANSWER")[1])
    assert answer["partitions"] > 2
    assert answer["committed"] == answer["plan"]
    report = answer["committed"]
    assert (report["malformed_rows"], report["short_rows"], report["bad_label_rows"]) == (3, 4, 2)
    assert report["initial_rows"] == len(rows) + 9 and report["clean_rows"] == answer["clean"]
    assert not [name for name in answer["columns"] if name.startswith("_") or name == "cleaning_outcome"]
    assert answer["rejected"][0].count("Lahore,2021-08-01,1,2,3,4") or any("1,2,3,4" in row for row in answer["rejected"])
