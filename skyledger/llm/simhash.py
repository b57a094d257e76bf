"""SimHash near-duplicates by covering locality-sensitive hashing.

Bits are dealt to the seven non-zero vectors of three bits. For each non-zero vector v, table v
masks the fingerprint to the bits whose vector has an odd product with v. Two fingerprints that
differ in at most two bits differ at bits of at most two vectors; some v is orthogonal to both, so
they agree under table v: every pair within the radius collides in some table.

Inside a bucket no pairs are made. Fingerprints that agree under a mask and differ in at most two
bits meet in one that is at most one flipped bit, outside the mask, from each. So each member of a
bucket of two or more emits itself and its one-bit changes outside the mask; at most 65
fingerprints can meet in one, so no group is hot, and those that meet are linked: exact at any
bucket size, with work in proportion to the members.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other. Repeated
rows and equal ids are rows like others; a null id takes part, but names a component only where no
other id can. Other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_only, map_batches, stored
from .components import connected_components

SHINGLE = 3
SEED = 42
BITS = 64
# The distance that the covering construction below is built for.
RADIUS = 2
_VECTORS = range(1, 2 ** (RADIUS + 1))
_VECTOR_OF_BIT = [1 + bit % len(_VECTORS) for bit in range(BITS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def covering_masks() -> list[int]:
    """One mask per table, as unsigned numbers."""
    return [
        sum(1 << bit for bit, vector in enumerate(_VECTOR_OF_BIT) if (vector & table).bit_count() % 2)
        for table in _VECTORS
    ]


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    shingles = map(b" ".join, zip(*(words[start:] for start in range(shingle))))
    count = len(words) - shingle + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)


def folded(hashes: np.ndarray) -> int:
    """SimHash as a signed 64-bit number: a bit is set if over half of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return folded(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, fp`` per row, written to the scratch folder."""

    def made(rows):
        return rows | {"fp": [fingerprint(text, shingle) for text in rows["text"]]}

    keyed = docs.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")
    )
    return stored(map_batches(keyed, made, "doc_id long, text_key long, fp long"), "simhash")


def _table_keys(fp: Column) -> Column:
    rows = [
        F.struct(F.lit(table).alias("table"), fp.bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for table, mask in enumerate(covering_masks())
    ]
    return F.array(*rows)


def _near(fp: Column, table: Column) -> Column:
    """A fingerprint and its one-bit changes outside the mask of a table."""
    changes = F.array(
        *(
            F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << bit)) for bit in range(BITS) if not mask >> bit & 1))
            for mask in covering_masks()
        )
    )
    return F.transform(F.get(changes, table), lambda change: fp.bitwiseXOR(change))


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``u, v`` that connect all fingerprints (column ``fp``, distinct) within the radius."""
    keyed = distinct.select("fp", F.inline(_table_keys(F.col("fp"))))
    shared = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = keyed.join(shared.drop("members"), ["table", "key"], "left_semi")
    meeting = members.select("fp", F.explode(_near(F.col("fp"), F.col("table"))).alias("point")).distinct()
    met = meeting.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
    return met.select(
        F.col("fps")[0].alias("u"), F.explode(F.slice("fps", F.lit(2), F.size("fps") - 1)).alias("v")
    ).distinct()


def _rooted(marks: DataFrame) -> DataFrame:
    """``fp, root`` of every fingerprint; one that has no link is its own root."""
    distinct = stored(marks.select("fp").distinct(), "fingerprints")
    roots = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicate_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``."""
    marks = fingerprints(docs, shingle)
    least = marks.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    rooted = _rooted(marks).join(least, "fp")
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = stored(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "components")
    return marks.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The document of the smallest id of each component; of repeated rows one stays."""
    docs = documents_only(docs)
    marks = fingerprints(docs, shingle)
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    least = marks.groupBy("fp").agg(F.min(first).alias("first"))
    kept = _rooted(marks).join(least, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = stored(kept.select("first.doc_id", "first.text_key"), "kept")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(kept["doc_id"]) & (keyed["text_key"] == kept["text_key"])
    left = keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return left.drop("text_key")
