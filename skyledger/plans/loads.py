"""A readings table that grows by loads: copies are judged across loads, figures follow each load."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import nan_to_null
from ..operators.analytics import empty_dashboard
from ..operators.baselines import default_baselines
from ..operators.clean import add_date_parts, drop_copies, drop_malformed, drop_undated, drop_unlabelled, parse_datetime
from ..operators.rollup import ROLLUP_SCHEMA, added_up, baselines, dashboard, rollup, signed
from ..sources.csv_files import CITY_OF_FILE
from ..sources.loads import (
    Commit,
    LoadConflict,
    commit,
    commits,
    is_loaded,
    joint_schema,
    new_folder,
    read_folders,
    read_rows,
    row_folders,
    signed_sums,
)
from ..sources.paths import matching_paths

DIGEST = "_row_digest"
# Digests of a load up to this many bytes are sent to all tasks; beyond, both sides are shuffled.
SMALL_LOAD = 32 << 20
# Commits after which the sums of all loads so far are written as one.
SNAPSHOT_AFTER = 16
_ATTEMPTS = 5


def row_digest(raw: DataFrame) -> Column:
    """A digest of a raw row by its columns' names and values, so neither the order of the columns nor
    one that is missing where another load has NULL makes a difference. NaN is NULL and -0.0 is 0.0,
    as they are among the copies of one load."""

    def plain(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = nan_to_null(value) + F.lit(0.0)
        return value.alias(field.name)

    fields = sorted((field for field in raw.schema if field.name != CITY_OF_FILE), key=lambda field: field.name)
    return F.unhex(F.sha2(F.to_json(F.struct(*map(plain, fields))), 256))


def _of_months(rows: DataFrame) -> Column:
    """Whether a row is of a month of the load; a filter on folders, as long as the calendar at most."""
    months: dict[int, list[int]] = {}
    for row in rows.select("year", "month").distinct().collect():
        months.setdefault(row.year, []).append(row.month)
    return reduce(or_, ((F.col("year") == year) & F.col("month").isin(own) for year, own in months.items()), F.lit(False))


def _unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a load whose digest the table does not hold.

    Equal raw rows have equal dates, so only the months of the load are looked at. Of those, first the
    digests that a small load also has are found, so that nothing of the table is shuffled. What is
    found is no more than the load. A larger load meets the table's digests in one join.
    """
    known = known.where(_of_months(rows)).select(DIGEST)
    if rows.count() * 48 > SMALL_LOAD:
        return rows.join(known, DIGEST, "left_anti")
    found = known.join(F.broadcast(rows.select(DIGEST)), DIGEST, "left_semi")
    return rows.join(F.broadcast(found), DIGEST, "left_anti")


def add_load(spark: SparkSession, root: str, load: str, raw: DataFrame) -> bool:
    """Clean a load, leave out rows that the table holds already, and commit rows and sums together.

    A load that is there already changes nothing, so it can be sent again after a failure; the answer
    says whether it was new. Loads of several writers are taken one after the other: who loses the
    race judges its rows anew against what the other has committed.
    """
    if is_loaded(commits(spark, root), load):
        return False
    labelled = drop_unlabelled(drop_malformed(raw))
    # Digests are made after the shuffle that removes copies: there are fewer, and they do not compress.
    unique = drop_copies(labelled).withColumn(DIGEST, row_digest(labelled))
    clean = add_date_parts(drop_undated(parse_datetime(unique)))
    arrived = None
    for _ in range(_ATTEMPTS):
        known = commits(spark, root)
        if is_loaded(known, load):
            return False
        fresh = clean
        if row_folders(known):
            # Several passes compare the load with the table; into an empty one it goes as it is.
            if arrived is None:
                staged = new_folder(root, "staged")
                clean.write.parquet(staged)
                arrived = spark.read.schema(clean.schema).parquet(staged)
            fresh = _unknown(arrived, read_rows(spark, root, known))
        rows, sums = new_folder(root, "rows"), new_folder(root, "sums")
        fresh.hint("rebalance", "year", "month").write.partitionBy("year", "month").parquet(rows)
        new = Commit("add", load)
        if matching_paths(spark, f"{rows}/year=*"):
            written = spark.read.schema(clean.schema).parquet(rows)
            rollup(written).write.parquet(sums)
            new = Commit("add", load, rows, sums, clean.schema.json())
            joint_schema([*known, new])  # refuses a column of another type
        try:
            commit(spark, root, known, new)
        except LoadConflict:
            continue
        _snapshot_if_due(spark, root)
        return True
    raise LoadConflict(f"load {load} lost {_ATTEMPTS} times against other writers")


def remove_load(spark: SparkSession, root: str, load: str) -> bool:
    """Take a load back: its rows are read no more and its sums are subtracted.

    Rows that later loads left out as copies of it do not come back by themselves; send those loads
    again under new names.
    """
    known = commits(spark, root)
    if not is_loaded(known, load):
        return False
    added = [entry for entry in known if entry.action == "add" and entry.load == load][-1]
    commit(spark, root, known, Commit("remove", load, added.rows, added.sums))
    return True


def _snapshot_if_due(spark: SparkSession, root: str) -> None:
    """Write the present sums as one folder; another writer that commits first makes it void."""
    known = commits(spark, root)
    if len(signed_sums(known)) <= SNAPSHOT_AFTER:
        return
    sums = new_folder(root, "sums")
    _sums(spark, known).write.parquet(sums)
    try:
        commit(spark, root, known, Commit("snapshot", "", None, sums))
    except LoadConflict:
        return


def _sums(spark: SparkSession, known: list[Commit]) -> DataFrame:
    by_sign = {sign: [folder for folder, own in signed_sums(known) if own == sign] for sign in (1, -1)}
    parts = [signed(read_folders(spark, folders, ROLLUP_SCHEMA), sign) for sign, folders in by_sign.items()]
    return added_up(parts[0].unionByName(parts[1]))


def loaded_readings(spark: SparkSession, root: str) -> DataFrame:
    """Clean readings of all loads that count."""
    return read_rows(spark, root, commits(spark, root)).drop(DIGEST)


def loaded_sums(spark: SparkSession, root: str) -> DataFrame:
    """Sums and counts of all loads that count."""
    return _sums(spark, commits(spark, root))


def loaded_dashboard(spark: SparkSession, root: str) -> DataFrame:
    """The dashboard from sums alone; the empty one with status ``fallback`` before the first load."""
    known = commits(spark, root)
    return dashboard(_sums(spark, known)) if row_folders(known) else empty_dashboard(spark)


def loaded_baselines(spark: SparkSession, root: str, model_accuracy: float | None = None) -> DataFrame:
    """Means of all loads from sums alone; the default baselines before the first load."""
    known = commits(spark, root)
    return baselines(_sums(spark, known), model_accuracy) if row_folders(known) else default_baselines(spark)
