"""Raw folders to clean tables and feature tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import report_of_outcomes, sort_out
from ..operators.features import assemble, available_features, count_incomplete
from ..operators.forest import counted_rows
from ..sources.csv_files import read_testing, read_training, write_csv
from ..sources.tables import read_outcomes, read_readings, write_features, write_outcomes


@dataclass(frozen=True)
class PreparedData:
    """Where preprocessing left its tables, what cleaning dropped and what the vectors lack."""

    train_readings: str
    test_readings: str
    train_csv: str
    test_csv: str
    train_features: str
    test_features: str
    train_report: DataFrame
    test_report: DataFrame
    train_incomplete: DataFrame
    test_incomplete: DataFrame


def preprocess(
    spark: SparkSession,
    train_folder: str,
    test_folder: str,
    output: str,
    header: list[str] | None = None,
    handle_invalid: str = "skip",
    city_of_file: bool = False,
    strict: bool = False,
    multi_line: bool = False,
    line_breaks: str = "escape",
    counted: bool = False,
) -> PreparedData:
    """Clean both folders and write readings, CSV copies and feature vectors.

    ``header`` names the columns of all files, which are then not opened before the scan.
    ``handle_invalid`` says what a missing feature does: ``skip`` drops the row, ``keep`` puts NaN,
    ``error`` fails. A piece that lacks a feature column which others have would lose all its rows
    to ``skip``, so it is refused, by name, unless ``keep`` is asked for. ``city_of_file`` takes the
    city of rows that name none from the name of their piece. ``strict`` fails at rows that do not
    have the fields of their header, ``multi_line`` reads quoted fields over several lines, and
    ``line_breaks`` is what `write_csv` does with them. ``counted`` writes each different training
    vector once, with the number of its rows, for a fit that reads less.

    Each raw folder is scanned once, by the pass that writes the table: clean rows, and rejected rows
    beside them. The report, the CSV and the vectors start from what that pass has committed.
    """
    options = {
        "trace": True, "city_of_file": city_of_file, "strict": strict, "multi_line": multi_line,
        "even": handle_invalid == "skip",
    }
    raw = {
        "train": read_training(spark, train_folder, header, **options),
        "test": read_testing(spark, test_folder, header, **options),
    }
    table = {part: f"{output}/{part}_readings" for part in raw}
    csv = {part: f"{output}/{part}_csv" for part in raw}
    vectors = {part: f"{output}/{part}_features" for part in raw}
    clean: dict[str, DataFrame] = {}
    reports: dict[str, DataFrame] = {}
    for part, readings in raw.items():
        write_outcomes(sort_out(readings), table[part])
        reports[part] = report_of_outcomes(read_outcomes(spark, table[part]))
        clean[part] = read_readings(spark, table[part])
    features = available_features(clean["train"], clean["test"])
    for part, readings in clean.items():
        write_csv(readings, csv[part], line_breaks)
        rows = assemble(readings, features, handle_invalid=handle_invalid)
        write_features(counted_rows(rows) if counted and part == "train" else rows, vectors[part])
    return PreparedData(
        table["train"],
        table["test"],
        csv["train"],
        csv["test"],
        vectors["train"],
        vectors["test"],
        reports["train"],
        reports["test"],
        count_incomplete(clean["train"], features),
        count_incomplete(clean["test"], features),
    )
