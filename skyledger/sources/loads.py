"""A table that grows by loads: numbered commits, each naming the folders that it adds.

Commits are small files, numbered without gaps. A writer reads the commits that are there, writes its
folders under names of their own, and then creates the next number, which only one writer can do: the
loser must look again, since what it left out or added up rests on the commits it had read. Readers
take only folders that a commit names, so a load that failed half way leaves nothing to be seen.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .paths import create_new, matching_paths, read_small


class LoadConflict(RuntimeError):
    """Another load was committed meanwhile."""


@dataclass(frozen=True)
class Commit:
    """What one commit did.

    ``add`` brings the rows and the sums of a load, ``remove`` takes both back, ``snapshot`` stands for
    the sums of all commits before it.
    """

    action: str
    load: str
    rows: str | None = None
    sums: str | None = None
    schema: str | None = None  # of the rows, as JSON


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """All commits of a table, in order."""
    return [Commit(**json.loads(read_small(spark, path))) for path in matching_paths(spark, f"{root}/_commits/*.json")]


def commit(spark: SparkSession, root: str, known: list[Commit], new: Commit) -> None:
    """Add a commit behind those that the writer knows; raises `LoadConflict` if there are more."""
    path = f"{root}/_commits/{len(known):012d}.json"
    if not create_new(spark, path, json.dumps(asdict(new))):
        raise LoadConflict(f"commit {len(known)} of {root} is there already")


def new_folder(root: str, kind: str) -> str:
    name = uuid.uuid4().hex
    return f"{root}/rows/{LOAD}={name}" if kind == "rows" else f"{root}/{kind}/{name}"


def removed(known: list[Commit]) -> set[str]:
    """Folders of rows whose load was taken back."""
    return {entry.rows for entry in known if entry.action == "remove" and entry.rows}


def is_loaded(known: list[Commit], load: str) -> bool:
    """Whether a load counts: it was added after it was last removed, if ever."""
    return [entry.action for entry in known if entry.load == load and entry.action != "snapshot"][-1:] == ["add"]


def row_folders(known: list[Commit]) -> list[str]:
    gone = removed(known)
    return [entry.rows for entry in known if entry.action == "add" and entry.rows and entry.rows not in gone]


def signed_sums(known: list[Commit]) -> list[tuple[str, int]]:
    """Folders of sums that make up the present ones: the last snapshot and what came after it."""
    last = max((place for place, entry in enumerate(known) if entry.action == "snapshot"), default=0)
    signs = {"add": 1, "remove": -1, "snapshot": 1}
    return [(entry.sums, signs[entry.action]) for entry in known[last:] if entry.sums]


def read_folders(spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
    """The rows of all folders as one scan; none where there are no folders."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


# Rows of a load stand below a folder of this name, so that all loads are one scan of one table.
LOAD = "load_folder"


def joint_schema(known: list[Commit]) -> T.StructType:
    """Columns of all loads that count, in the order in which they first came."""
    fields: dict[str, T.StructField] = {}
    gone = removed(known)
    for entry in known:
        if entry.action == "add" and entry.schema and entry.rows not in gone:
            for field in T.StructType.fromJson(json.loads(entry.schema)):
                known_field = fields.setdefault(field.name, field)
                if known_field.dataType != field.dataType:
                    raise ValueError(f"{field.name} is {field.dataType} in load {entry.load}, {known_field.dataType} before")
    return T.StructType(list(fields.values()))


def read_rows(spark: SparkSession, root: str, known: list[Commit]) -> DataFrame:
    """Rows of all loads that count, as one scan that skips months; a column that a load lacks is NULL
    there."""
    folders, schema = row_folders(known), joint_schema(known)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(*folders).drop(LOAD)
