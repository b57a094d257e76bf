"""Cleaning: rows without label, full copies, unreadable dates, and the report on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import date_parts, parse_mixed_timestamp
from ..schema import DATETIME, LABEL
from ..sources.csv_files import BAD_LABEL, CITY_OF_FILE, MALFORMED, SHORT, TRACE
from ..sources.tables import CLEAN, OUTCOME, REJECTED_TEXT, TALLIES


def drop_unlabelled(readings: DataFrame) -> DataFrame:
    return readings.where(F.col(LABEL).isNotNull())


def drop_malformed(readings: DataFrame) -> DataFrame:
    """Leave out rows that did not have the fields of their header, and the marks of a trace."""
    if MALFORMED in readings.columns:
        readings = readings.where(F.col(MALFORMED).isNull())
    return readings.drop(*TRACE)


def drop_copies(readings: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows; NULL equals NULL and NaN equals NaN.

    Equal rows collapse inside each task before the shuffle, so a large group of copies reaches
    it as one row per task. The city of the file is no part of a row: of copies the first by name
    stays, and becomes the row's city.
    """
    if CITY_OF_FILE not in readings.columns:
        return readings.dropDuplicates()
    own = [name for name in readings.columns if name != CITY_OF_FILE]
    return readings.groupBy(own).agg(F.min(CITY_OF_FILE).alias("city"))


def parse_datetime(readings: DataFrame) -> DataFrame:
    if dict(readings.dtypes)[DATETIME] != "string":
        return readings
    return parse_mixed_timestamp(readings, DATETIME)


def drop_undated(readings: DataFrame) -> DataFrame:
    return readings.where(F.col(DATETIME).isNotNull())


def add_date_parts(readings: DataFrame) -> DataFrame:
    return readings.withColumns(date_parts(F.col(DATETIME)))


def clean_readings(raw: DataFrame) -> DataFrame:
    """All cleaning steps; copies are judged on raw rows, before dates are parsed."""
    unique = drop_copies(drop_unlabelled(drop_malformed(raw)))
    return add_date_parts(drop_undated(parse_datetime(unique)))


_TRACED = ["malformed_rows", "short_rows", "bad_label_rows"]
_REPORT = ["initial_rows", "labelled_rows", "unique_rows", "clean_rows", "dropped_rows"]


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Rows left after each step, as one row, from one shuffle of the raw rows.

    Of rows read with a trace it also counts the malformed ones and bad labels among the sound.
    """
    traced = [name for name in TRACE if name in raw.columns]
    if traced:
        return _traced_report(raw)
    groups = raw.groupBy(raw.columns).agg(F.count("*").alias("__copies"))
    labelled = F.col(LABEL).isNotNull()
    dated = labelled & F.col(DATETIME).isNotNull()
    count = lambda kept, value: F.coalesce(F.sum(F.when(kept, value)), F.lit(0))
    return (
        parse_datetime(groups)
        .agg(
            count(F.lit(True), F.col("__copies")).alias("initial_rows"),
            count(labelled, F.col("__copies")).alias("labelled_rows"),
            count(labelled, 1).alias("unique_rows"),
            count(dated, 1).alias("clean_rows"),
        )
        .withColumn("dropped_rows", F.col("initial_rows") - F.col("clean_rows"))
    )


def in_parts(raw: DataFrame, parts: int) -> list[DataFrame]:
    """Raw rows in so many frames, by a hash of their content, so that all copies of a row are in one.

    Copies can be judged a part at a time: each shuffles its share of the rows. Every part reads all rows, so
    give it a written table.
    """
    own = [F.col(name) for name in raw.columns if name not in (*TRACE, CITY_OF_FILE)]
    return [raw.where(F.pmod(F.xxhash64(*own), F.lit(parts)) == part) for part in range(parts)]


def cleaning_report_of_parts(raw: DataFrame, parts: int) -> DataFrame:
    """The cleaning report of raw rows, counted a part at a time; as no row is a copy of one in another
    part, its figures are the sums of theirs. It is computed at once."""
    reports = [cleaning_report(part).first() for part in in_parts(raw, parts)]
    total = lambda name: F.lit(sum(report[name] for report in reports)).cast("long").alias(name)
    return raw.sparkSession.range(1).select(*[total(name) for name in reports[0].__fields__])


def _trace_counts(raw: DataFrame) -> list:
    sound = F.col(MALFORMED).isNull()
    return [
        F.count("*").alias("initial_rows"),
        F.count_if(~sound).alias("malformed_rows"),
        F.count_if(F.col(SHORT)).alias("short_rows"),
        F.count_if(sound & F.col(BAD_LABEL)).alias("bad_label_rows"),
    ]


def _traced_report(raw: DataFrame) -> DataFrame:
    found = raw.agg(*_trace_counts(raw)).withColumn("one", F.lit(1))
    rest = cleaning_report(drop_malformed(raw)).drop("initial_rows", "dropped_rows").withColumn("one", F.lit(1))
    return found.join(rest, "one").select(
        *_REPORT[:1], *_TRACED, *_REPORT[1:-1],
        (F.col("initial_rows") - F.col("clean_rows")).alias("dropped_rows"),
    )


def sort_out(raw: DataFrame) -> DataFrame:
    """Each different row of a traced read with what became of it, ready to be written once.

    ``cleaning_outcome`` is clean, malformed, unlabelled or undated. Tallies say how many rows of the
    input a row stands for, how many of those were short and how many had a label that is none. They
    are aggregates of the shuffle that collapses copies, so a task that runs again adds nothing.
    Rejected rows keep the text of their date in ``_datetime_text``.
    """
    city = [F.min(CITY_OF_FILE).alias("city")] if CITY_OF_FILE in raw.columns else []
    own = [name for name in raw.columns if name not in (SHORT, BAD_LABEL, CITY_OF_FILE)]
    tallies = (F.count("*"), F.count_if(SHORT), F.count_if(BAD_LABEL))
    unique = raw.groupBy(own).agg(*(tally.alias(name) for tally, name in zip(tallies, TALLIES)), *city)
    dated = parse_datetime(unique.withColumn(REJECTED_TEXT, F.col(DATETIME).cast("string")))
    outcome = (
        F.when(F.col(MALFORMED).isNotNull(), "malformed")
        .when(F.col(LABEL).isNull(), "unlabelled")
        .when(F.col(DATETIME).isNull(), "undated")
        .otherwise(CLEAN)
    )
    sorted_ = add_date_parts(dated).withColumn(OUTCOME, outcome)
    return sorted_.withColumn(REJECTED_TEXT, F.when(F.col(OUTCOME) != CLEAN, F.col(REJECTED_TEXT)))


def report_of_outcomes(written: DataFrame) -> DataFrame:
    """The cleaning report from rows that `sort_out` made and a sink has committed."""
    rows, short, bad = (F.col(name) for name in TALLIES)
    total = lambda value, kept=F.lit(True): F.coalesce(F.sum(F.when(kept, value)), F.lit(0))
    labelled = F.col(OUTCOME).isin(CLEAN, "undated")
    sound = F.col(OUTCOME) != "malformed"
    report = written.agg(
        total(rows).alias("initial_rows"),
        total(rows, ~sound).alias("malformed_rows"),
        total(short).alias("short_rows"),
        total(bad, sound).alias("bad_label_rows"),
        total(rows, labelled).alias("labelled_rows"),
        F.count_if(labelled).alias("unique_rows"),
        F.count_if(F.col(OUTCOME) == CLEAN).alias("clean_rows"),
    )
    return report.withColumn("dropped_rows", F.col("initial_rows") - F.col("clean_rows"))


def cleaning_report_after_write(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """The same report where the clean rows are a written table already.

    Rows lost to an unreadable date are the only ones that need a second look for copies, so the
    raw rows are not shuffled again.
    """
    labelled = F.col(LABEL).isNotNull()
    scanned = raw.agg(
        F.count("*").alias("initial_rows"),
        F.count_if(labelled).alias("labelled_rows"),
    )
    undated = (
        parse_datetime(drop_unlabelled(raw).withColumn("__text", F.col(DATETIME)))
        .where(F.col(DATETIME).isNull())
        .drop(DATETIME)
        .distinct()
        .agg(F.count("*"))
    )
    written = clean.agg(F.count("*"))
    return (
        scanned.withColumn("clean_rows", written.scalar())
        .withColumn("unique_rows", F.col("clean_rows") + undated.scalar())
        .withColumn("dropped_rows", F.col("initial_rows") - F.col("clean_rows"))
        .select(_REPORT)
    )
