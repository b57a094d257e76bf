"""Helpers that several operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_folder, tune

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Everything but 0-9, a-z and non-ASCII separates words; A-Z are lower-cased.
WORD_BYTES = bytes(
    code + 32 if 65 <= code <= 90 else code if 48 <= code <= 57 or 97 <= code <= 122 or code >= 128 else 32
    for code in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it again: cuts the lineage, and what was
    computed survives lost executors."""
    spark = frame.sparkSession
    path = scratch_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Shared:
    """A bounded object for all tasks, broadcast with its class and unpacked once per process."""

    def __init__(self, spark: SparkSession, value):
        self.packed = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})

    def value(self):
        held = self.packed.value
        if "value" not in held:
            held["value"] = pickle.loads(held["packed"])
        return held["value"]

    def built(self, build: Callable):
        """What ``build`` makes of the object, kept by a worker process for its next tasks."""
        held = self.packed.value
        if "built" not in held:
            held["built"] = build(self.value())
        return held["built"]


# Rows of a batch that are held as Python objects at once.
ROWS_AT_ONCE = 1000


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of bounded length, so that a worker's memory does not follow their size."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def map_batches(
    frame: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """Apply a function from column lists to column lists to each Arrow batch of a frame."""
    arrow = arrow_schema(frame.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            made = function(batch.to_pydict())
            yield pa.RecordBatch.from_pydict({field.name: made[field.name] for field in arrow}, arrow)

    return frame.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def documents_only(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null becomes empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


# A join side of up to so many bytes, as text, is sent to all executors.
SMALL_SIDE = 8 << 20


def is_small(frame: DataFrame) -> bool:
    """Whether a written table may be broadcast."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in frame.columns), F.lit(0))
    return (frame.agg(F.sum(size.cast("long")).alias("size")).head()["size"] or 0) <= SMALL_SIDE


def if_small(frame: DataFrame) -> DataFrame:
    """A written table with the hint to broadcast it if it is small, and without it beyond that: then
    both sides are shuffled, and adaptive execution splits hot keys."""
    return F.broadcast(frame) if is_small(frame) else frame


def bounded_sample(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most ``limit`` distinct rows, chosen by a hash of the keys: the same at every layout."""
    order = F.xxhash64(*(F.col(key).cast("string") for key in keys))
    return rows.distinct().orderBy(order, *keys).limit(limit)
