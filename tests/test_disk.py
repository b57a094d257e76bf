"""What queries leave on disk while they run."""

import os

from pyspark.sql import functions as F

from skyledger.operators import clean
from skyledger.registry import inputs, queries
from skyledger.session import tune
from skyledger.sources import csv_files, tables
from skyledger.sources.paths import path_exists


def test_shuffles_of_an_action_go_when_it_ends(spark, shuffle_files):
    before = shuffle_files()
    frame = tune(spark).range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    first = sorted(frame.collect())
    assert shuffle_files(before) == set()
    assert sorted(frame.collect()) == first and len(first) == 7


def test_request_lines_are_compressed_and_whole(spark, small, monkeypatch):
    monkeypatch.setattr(queries, "_LINES_PER_FILE", 500)
    path = queries._request_lines(spark, small)
    names = [name for name in os.listdir(path.removeprefix("file:")) if name.startswith("part-")]
    assert names and all(name.endswith(".txt.gz") for name in names)
    lines = spark.read.text(path)
    assert lines.count() == inputs.requests(spark, small).count()
    assert lines.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 500


def _raw(spark):
    """Rows that come up to three times, some malformed, unlabelled or undated."""
    kind = F.col("id") % 10
    fields = {name: F.lit(None).cast("string") for name in ("city",)} | {
        "reading_id": F.col("id").cast("string"),
        "datetime": F.when(kind == 1, "junk").when(kind != 2, F.concat(F.lit("2021-0"), F.col("id") % 9 + 1, F.lit("-05 03:00:00"))),
        "main_aqi": F.when(kind != 3, "2"),
        "components_o3": F.when(kind == 4, "nan").otherwise("0.5"),
        "_malformed": F.when(kind == 5, F.concat(F.lit("x"), "id")),
        "_short": kind == 6,
    }
    rows = spark.range(400).select(*[value.alias(name) for name, value in fields.items()], F.explode(F.array_repeat(F.lit(1), (F.col("id") % 3 + 1).cast("int"))))
    return csv_files.typed_readings(rows.drop("col"))


def test_a_report_of_parts_is_the_report_of_all(spark):
    raw = _raw(spark)
    parts = clean.in_parts(raw, 3)
    assert sum(part.count() for part in parts) == raw.count() and all(part.count() for part in parts)
    whole = clean.cleaning_report(raw)
    summed = clean.cleaning_report_of_parts(raw, 3)
    assert summed.columns == whole.columns and summed.collect() == whole.collect()


def test_outcomes_written_in_parts_are_those_of_one_pass(spark, tmp_path):
    raw = _raw(spark)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    tables.write_outcomes(clean.sort_out(raw), one)
    for _ in range(2):  # the second replaces the first
        tables.write_outcomes([clean.sort_out(part) for part in clean.in_parts(raw, 3)], many)
    assert not path_exists(spark, f"{many}-draft")
    first, second = (tables.read_outcomes(spark, path) for path in (one, many))
    assert first.exceptAll(second.select(first.columns)).count() == 0 == second.select(first.columns).exceptAll(first).count()
    assert clean.report_of_outcomes(first).collect() == clean.report_of_outcomes(second).collect()
