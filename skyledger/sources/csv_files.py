"""CSV readings: scan, choice of source, concatenation by column name, and sink."""

from __future__ import annotations

import csv
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import as_number, finite, missing_to_null, whole
from ..schema import (
    CONCATENATED_FILE,
    DATETIME,
    LABEL,
    MEASURES,
    TEST_PIECES,
    TRAIN_PIECES,
    TRAIN_WORKBOOKS,
)
from .paths import EmptySourceError, create_empty, first_line, matching_paths, path_exists

_WHOLE_NUMBERS = [LABEL, "hour", "month", "year"]
_HEADER_READERS = 16


# The text of a row that has more fields than its header or a quote that does not end; whether a row
# has fewer fields; whether a label is no label.
MALFORMED = "_malformed"
SHORT = "_short"
BAD_LABEL = "_bad_label"
TRACE = [MALFORMED, SHORT, BAD_LABEL]
CITY_OF_FILE = "_city"
# A piece is a file, or a folder, also one that a partitioned write named ``column=value``.
# It starts a name of the path, so that the pattern is not tried at every letter.
_PIECE_OF_CITY = r"(?:^|/)(?:[^/=%]+(?:=|%3D))?([^/]+)_complete_data\.csv(?:/[^/]*)?$"


def _csv_options(spark: SparkSession, strict: bool, multi_line: bool, headed: bool):
    # With enforceSchema off, Spark checks every file's header against the schema it is read by.
    # Rows are judged by all their fields, whatever columns are used later.
    return (
        spark.read.option("header", headed)
        .option("enforceSchema", not headed)
        .option("escape", '"')
        .option("columnPruning", False)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
    )


def _text_schema(header: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in [*header, MALFORMED]])


# A quoted field; of a field that starts with a quote and does not end with one, no match.
_QUOTED_FIELD = r'(^|,)"(?:[^"]|"")*"(?=,|$)'
_OPEN_QUOTE = r'(^|,)"'


def _judged(raw: DataFrame) -> DataFrame:
    """Rows that Spark found to have more or fewer fields than their header, told apart.

    Only those rows have their text here. It is judged without its quoted fields: as many commas as
    are left, so many fields there are beside the first. A short row keeps its values and its text is
    forgotten; the fields that it lacks are NULL.
    """
    names = [name for name in raw.columns if name != MALFORMED]
    if not names:
        return raw.withColumn(SHORT, F.lit(False))
    # True of every row, but reads a second column: Spark answers no query that needs the text of
    # malformed rows alone.
    always = F.coalesce(F.col(names[0]), F.lit("")) >= F.lit("")
    text = F.when(always, F.col(MALFORMED))
    plain = F.regexp_replace(text, _QUOTED_FIELD, "$1")
    commas = F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit("")))
    short = F.coalesce((commas < len(names) - 1) & ~plain.rlike(_OPEN_QUOTE), F.lit(False))
    return raw.withColumns({SHORT: short, MALFORMED: F.when(~short, text)})


def _refusing_malformed(raw: DataFrame) -> DataFrame:
    """Fail at the first malformed row that is met, showing the start of it."""
    message = F.concat(F.lit("malformed CSV row (read with trace to keep and count them): "), F.substring(MALFORMED, 1, 200))
    return raw.where(F.when(F.col(MALFORMED).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The header of a path, from the first line of its first file; no Spark job."""
    line = first_line(spark, path) or ""
    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
    seen = Counter(name.lower() for name in names)
    # Names that are empty or stand twice get their place, as Spark names them.
    return tuple(
        f"_c{place}" if not name else f"{name}{place}" if seen[name.lower()] > 1 else name
        for place, name in enumerate(names)
    )


def _headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, ...]]:
    with ThreadPoolExecutor(min(_HEADER_READERS, len(paths))) as pool:
        return list(pool.map(lambda path: _header(spark, path), paths))


def _escaped(spark: SparkSession, paths: list[str]) -> list[bool]:
    """Whether `write_csv` left its mark in each path."""
    with ThreadPoolExecutor(min(_HEADER_READERS, len(paths))) as pool:
        return list(pool.map(lambda path: path_exists(spark, f"{path}/{ESCAPED_MARK}"), paths))


def numeric_extras(raw: DataFrame) -> list[str]:
    """Undeclared text columns that hold nothing but numbers and missing values.

    Costs one pass over those columns.
    """
    declared = {DATETIME, "city", *TRACE, CITY_OF_FILE, *MEASURES, *_WHOLE_NUMBERS}
    extras = [name for name in raw.columns if name not in declared]
    if not extras:
        return []

    def fits(name: str):
        value = missing_to_null(F.col(name))
        return F.every(value.isNull() | value.try_cast("double").isNotNull()).alias(name)

    verdict = raw.agg(*[fits(name) for name in extras]).first()
    return [name for name in extras if verdict[name]]


def typed_readings(raw: DataFrame, numbers: list[str] | None = None) -> DataFrame:
    """Give text columns their declared type; what does not parse becomes NULL.

    ``numbers`` names further numeric columns; any other column stays text. So does ``datetime``,
    because copies are removed on raw rows before it is parsed.
    """
    measures = {*MEASURES, *(numbers or [])}

    def parsed(name: str) -> Column:
        if name in measures or name in _WHOLE_NUMBERS:
            return as_number(F.col(name)).alias(name)
        return (F.col(name) if name in TRACE else missing_to_null(F.col(name))).alias(name)

    def judged(name: str) -> Column:
        if name in measures:
            return finite(F.col(name)).alias(name)
        return whole(F.col(name)).alias(name) if name in _WHOLE_NUMBERS else F.col(name)

    # Each number is used more than once, so it is made by a projection before.
    given, bad_label = [], []
    if MALFORMED in raw.columns and LABEL in raw.columns:
        given = [missing_to_null(F.col(LABEL)).isNotNull().alias("__label_given")]
        bad_label = [(F.col("__label_given") & whole(F.col(LABEL)).isNull()).alias(BAD_LABEL)]
    staged = raw.select([parsed(name) for name in raw.columns] + given)
    return staged.select([judged(name) for name in raw.columns] + bad_label)


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    header: list[str] | None = None,
    infer: bool = False,
    trace: bool = False,
    strict: bool = False,
    multi_line: bool = False,
    headed: bool = True,
    city_of_file: bool = False,
    even: bool = False,
) -> DataFrame:
    """Read CSV files or folders of them as one frame of readings.

    No row is lost without a count. A row with fewer fields than its header keeps them, and the others
    are NULL. A row with more fields, or with a quote that does not end, is malformed, and the read
    fails there. ``trace`` keeps malformed rows, with their text in ``_malformed``, marks short rows in
    ``_short`` and labels that are no whole number in ``_bad_label``, so that the cleaning report can
    count them all. ``strict`` fails at short rows too.

    A quoted field may hold a line break only with ``multi_line``; files are then read whole by one
    task each, so keep them small.

    Types are declared. ``infer`` looks through the columns that are not, at the price of a pass
    over them, and makes those of numbers numeric.

    ``city_of_file`` adds, where the rows name no city, the one that the name of their piece begins
    with, as ``_city``. Cleaning judges copies without it and then takes it as the city: a row that
    stands in the files of two cities counts once, for the first of them by name.

    Files without a header line (``headed`` false) need ``header``.

    Columns are matched by name; a column that a path lacks is NULL there. There is one scan per
    distinct header, not per path. Give ``header`` where all files share it, and no file is opened
    before the scan; a file that differs then fails the scan. ``even`` refuses, by name, a piece that
    lacks a feature column which another piece has. Line breaks that `write_csv` escaped come back.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise EmptySourceError("no CSV path given")
    found = [tuple(header)] * len(paths) if header else _headers(spark, paths)
    if even and not header:
        refuse_uneven_pieces(dict(zip(paths, found)))
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for path, names, escaped in zip(paths, found, _escaped(spark, paths)):
        groups.setdefault((names, escaped), []).append(path)
    scans = []
    for (names, escaped), members in groups.items():
        scan = _csv_options(spark, strict, multi_line, headed).schema(_text_schema(list(names))).csv(members)
        texts = [name for name in names if name not in (*MEASURES, *_WHOLE_NUMBERS)] if escaped else []
        scans.append(_judged(scan).withColumns({name: restore_line_breaks(F.col(f"`{name}`")) for name in texts}))
    if city_of_file:
        named = F.regexp_extract(F.substring_index("_metadata.file_path", "/", -2), _PIECE_OF_CITY, 1)
        scans = [scan.withColumn(CITY_OF_FILE, F.nullif(F.url_decode(named), F.lit(""))) for scan in scans]
    whole = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), scans)
    if city_of_file and "city" in whole.columns:
        whole = whole.drop(CITY_OF_FILE)
    if not trace:
        whole = _refusing_malformed(whole).drop(MALFORMED, SHORT)
    return typed_readings(whole, numeric_extras(whole) if infer else None)


def read_csv_glob(
    spark: SparkSession, pattern: str, header: list[str] | None = None, **options: bool
) -> DataFrame:
    """Concatenate everything that matches a glob."""
    paths = matching_paths(spark, pattern)
    if not paths:
        raise EmptySourceError(f"no input matches {pattern}")
    return read_csv(spark, paths, header, **options)


def training_paths(spark: SparkSession, folder: str) -> list[str]:
    """The concatenated file where it exists, otherwise the pieces of each city."""
    whole = f"{folder}/{CONCATENATED_FILE}"
    if path_exists(spark, whole):
        return [whole]
    workbooks = matching_paths(spark, f"{folder}/{TRAIN_WORKBOOKS}")
    if workbooks:
        # Spark has no reader for them, and leaving them out would lose readings silently.
        raise ValueError(f"convert these workbooks to CSV first: {', '.join(workbooks)}")
    return matching_paths(spark, f"{folder}/{TRAIN_PIECES}")


def testing_paths(spark: SparkSession, folder: str) -> list[str]:
    return matching_paths(spark, f"{folder}/{TEST_PIECES}")


def refuse_uneven_pieces(headers: dict[str, tuple[str, ...]]) -> None:
    """Raise where a piece lacks a feature column that another piece of the same part has."""
    wanted = {name for names in headers.values() for name in names} & set(MEASURES)
    for path, names in headers.items():
        missing = sorted(wanted - set(names))
        if missing:
            raise ValueError(f"{path} lacks {', '.join(missing)}, which other pieces have")


def read_training(
    spark: SparkSession, folder: str, header: list[str] | None = None, **options: bool
) -> DataFrame:
    """Training readings; raises `EmptySourceError` before planning where there are none."""
    paths = training_paths(spark, folder)
    if not paths:
        raise EmptySourceError(f"no training files in {folder}")
    return read_csv(spark, paths, header, **options)


def read_testing(
    spark: SparkSession, folder: str, header: list[str] | None = None, **options: bool
) -> DataFrame:
    """Testing readings; raises `EmptySourceError` before planning where there are none."""
    paths = testing_paths(spark, folder)
    if not paths:
        raise EmptySourceError(f"no testing files in {folder}")
    return read_csv(spark, paths, header, **options)


# Name of the empty file that says that texts of a folder have their line breaks escaped.
ESCAPED_MARK = "_line_breaks_escaped"


def escape_line_breaks(text: Column) -> Column:
    """Each row on its line: a backslash stands before ``n`` for a line feed, ``r`` for a carriage
    return and ``s`` for a backslash, so what is read back is what was written."""
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def restore_line_breaks(text: Column) -> Column:
    """What `escape_line_breaks` was given. Every backslash in its result starts one of the three
    pairs; backslashes come back last, so that none of them starts a pair anew."""
    breaks = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.when(text.contains("\\"), F.replace(breaks, F.lit("\\s"), F.lit("\\"))).otherwise(text)


def write_csv(readings: DataFrame, path: str, line_breaks: str = "escape") -> None:
    """Write with header and without index; timestamps as ``2021-08-01 05:00:00``.

    Each row stays on its line, so that large files can be split. ``line_breaks`` says what a line
    break inside a text does: ``escape`` writes it as ``\\n`` or ``\\r``, and a backslash as ``\\s``,
    and leaves a mark in the folder, by which `read_csv` knows to turn them back; ``refuse`` fails.
    """
    if line_breaks not in ("escape", "refuse"):
        raise ValueError(f"line breaks can be escaped or refused, not {line_breaks!r}")

    def written(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            return F.col(field.name).cast("string").alias(field.name)
        if not isinstance(field.dataType, T.StringType):
            return F.col(field.name)
        if line_breaks == "escape":
            return escape_line_breaks(F.col(field.name)).alias(field.name)
        broken = F.concat(F.lit(f"line break in {field.name}: "), F.substring(field.name, 1, 200))
        refused = F.when(F.col(field.name).rlike(r"[\r\n]"), F.raise_error(broken)).otherwise(F.col(field.name))
        return refused.alias(field.name)

    shown = [written(field) for field in readings.schema.fields]
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    readings.select(shown).write.mode("overwrite").options(**kept).csv(path)
    if line_breaks == "escape":
        create_empty(readings.sparkSession, f"{path}/{ESCAPED_MARK}")
