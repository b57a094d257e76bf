"""Product codes of vectors, with fixed pivots that spare exact distances.

A vector's components become whole numbers and are cut into equal parts; every part position has a
codebook of entries, fitted by rounds of assignment and whole-number means. The pivots of a part
position are starting entries that lie far apart. A part's distances to its pivots are computed once
and stored with it. They never change, so each round only measures the pivots against the moved
entries: by the triangle inequality the difference of two distances to one pivot never exceeds the
distance between part and entry. The largest such difference orders the entries, in blocks of those
about equally far from the first pivot; the block it puts first is measured exactly, and a block whose
bounds are all above the best exact distance so far is never measured. Exact distances are whole
numbers, so the codes are those of a full search.

Each round is one pass over the stored parts. A task adds up its parts by entry and sends on at most
one row per entry, so what is shuffled and what reaches the driver follow the size of the codebooks.

Cases: vectors that are null or hold null or non-finite components are left out, and without any
other the result is empty. A null id stays and comes last in the order of ids; equal ids come in the
order of their vectors and each row gets its code. Fewer vectors than entries make smaller codebooks.
Null labels count as one label. A width that four does not divide is cut as evenly as whole numbers
allow, and empty vectors have error zero. Vectors of different lengths, and components whose whole
number is beyond 2 ** 26, raise ValueError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_schema, if_small, stored

LARGEST = 1 << 26
ROWS_AT_ONCE = 512


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256  # at most 256: an index is two hex digits
    rounds: int = 4
    pivots: int = 8  # per part position
    block: int = 16  # entries that are measured, or left out, together
    scale: int = 1024


def finite_vector(vector: Column) -> Column:
    """Whether a vector is there and holds finite components only; never null."""
    infinite = F.lit(float("inf")).cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))
    return F.coalesce(fine, F.lit(False))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; a row of another length is an error."""
    if len(column) and (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"a vector does not have {width} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def whole(matrix: np.ndarray, scale: int) -> np.ndarray:
    """Components times ``scale``, rounded down."""
    scaled = np.floor(matrix * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return scaled.astype(np.int64)


def cuts(width: int, parts: int) -> list[slice]:
    return [slice(width * k // parts, width * (k + 1) // parts) for k in range(parts)]


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of each point to each other one."""
    return np.stack([((points - other) ** 2).sum(axis=1) for other in others], axis=1)


def far_apart(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries that lie far apart: the first, then again and again the one farthest from all chosen."""
    chosen = [0]
    nearest = squared(entries, entries[:1])[:, 0]
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


class Book:
    """Entries of one part position, with their distances to its pivots, in blocks of entries that
    lie about equally far from the first pivot."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray, block: int):
        self.entries = entries
        to_pivots = np.sqrt(squared(entries, pivots))
        order = np.argsort(to_pivots[:, 0], kind="stable")
        self.blocks = [np.sort(order[start : start + block]) for start in range(0, len(order), block)]
        self.starts = np.arange(0, len(order), block)
        # By pivot, entries in the order of the blocks.
        self.to_pivots = to_pivots[np.concatenate(self.blocks)].T.astype(np.float32)

    def nearest(self, points: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each point's nearest entry, the lower index among equals,
        and how many distances were measured.

        Each point first meets the block that holds its lowest bound, then every block with a bound
        that is not above its best distance so far. Bounds are single floats; ``slack`` is above
        their rounding error, so no entry that could be nearest, or as near, is left out.
        """
        own = to_pivots.astype(np.float32)
        low, apart = np.zeros((2, len(points), len(self.entries)), np.float32)
        for pivot, theirs in enumerate(self.to_pivots):
            np.subtract(own[:, pivot, None], theirs, out=apart)
            np.abs(apart, out=apart)
            np.maximum(low, apart, out=low)
        bounds = np.minimum.reduceat(low, self.starts, axis=1)
        slack = 1e-6 * (1 + max(own.max(initial=0), self.to_pivots.max(initial=0)))
        first = bounds.argmin(axis=1)
        search = _Search(points, self.entries)
        for number, block in enumerate(self.blocks):
            search.measure(np.flatnonzero(first == number), block)
        limit = (np.sqrt(search.best) + slack).astype(np.float32)
        bounds[np.arange(len(points)), first] = np.inf
        for number in np.argsort(bounds.mean(axis=0), kind="stable"):
            nearer = search.measure(np.flatnonzero(bounds[:, number] <= limit), self.blocks[number])
            limit[nearer] = np.sqrt(search.best[nearer]) + slack
        return search.index, search.best, search.measured


class _Search:
    """The nearest entry of each point so far.

    Squared distances come from products of whole numbers: in doubles where no sum can leave the
    whole numbers that these hold exactly, in longs otherwise.
    """

    def __init__(self, points: np.ndarray, entries: np.ndarray):
        largest = int(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
        kind = np.float64 if 4 * points.shape[1] * largest**2 < 1 << 53 else np.int64
        self.points, self.entries = points.astype(kind), entries.astype(kind)
        self.points_squared = (self.points**2).sum(axis=1)
        self.entries_squared = (self.entries**2).sum(axis=1)
        self.index = np.full(len(points), len(entries))
        self.best = np.full(len(points), np.iinfo(np.int64).max)
        self.measured = 0

    def measure(self, rows: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Measure rows against a block of entries and keep what is nearer; the rows it was for."""
        if not len(rows):
            return rows
        products = self.points[rows] @ self.entries[block].T
        distances = self.entries_squared[block] - 2 * products
        place = distances.argmin(axis=1)
        distance = (distances[np.arange(len(rows)), place] + self.points_squared[rows]).astype(np.int64)
        found, best = block[place], self.best[rows]
        nearer = (distance < best) | (distance == best) & (found < self.index[rows])
        self.best[rows[nearer]], self.index[rows[nearer]] = distance[nearer], found[nearer]
        self.measured += products.size
        return rows[nearer]


def _start(kept: DataFrame, s: Settings) -> np.ndarray | None:
    """The vectors of the smallest ids, as whole numbers; None if there is no vector."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(s.entries).select("vector").collect()
    if not first:
        return None
    column = pa.array([row.vector for row in first], pa.list_(pa.float64()))
    return whole(as_matrix(column, len(first[0].vector)), s.scale)


def _with_pivots(kept: DataFrame, pivots: list[np.ndarray], width: int, s: Settings) -> DataFrame:
    """``vec_id, label, parts, to_pivots`` of every vector, written once: whole numbers, and squared
    distances to the pivots of each part position in turn."""
    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, parts array<int>, to_pivots array<long>"
    shared, arrow, places = Shared(kept.sparkSession, pivots), arrow_schema(kept.sparkSession, schema), cuts(width, s.parts)

    def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
        ends = np.arange(len(matrix) + 1) * matrix.shape[1]
        return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(matrix.ravel(), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value()
        for batch in _slices(batches):
            points = whole(as_matrix(batch.column("vector"), width), s.scale)
            distances = np.concatenate([squared(points[:, place], own) for place, own in zip(places, chosen)], axis=1)
            columns = [batch.column("vec_id"), batch.column("label"), lists(points, pa.int32()), lists(distances, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return stored(kept.mapInArrow(run, schema), "parts")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _assigned(batch: pa.RecordBatch, books: list[Book], places: list[slice], s: Settings):
    """Points, and per part position its index and squared distance of each row of a batch."""
    count, width = batch.num_rows, places[-1].stop
    points = batch.column("parts").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(count, width)
    flat = batch.column("to_pivots").flatten().to_numpy(zero_copy_only=False).reshape(count, -1)
    to_pivots = np.sqrt(flat).reshape(count, s.parts, -1)
    found = [book.nearest(points[:, place], to_pivots[:, k]) for k, (book, place) in enumerate(zip(books, places))]
    return points, found


def _sums(parts: DataFrame, books: list[Book], places: list[slice], s: Settings) -> DataFrame:
    """``part, entry``, the number of parts that are nearest to it, and their sums by position."""
    widest = max(place.stop - place.start for place in places)
    names = [f"s{position}" for position in range(widest)]
    schema = ", ".join(["part int", "entry int", "n long", *(f"{name} long" for name in names)])
    shared, arrow = Shared(parts.sparkSession, books), arrow_schema(parts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value()
        sums = np.zeros((s.parts, len(own[0].entries), widest), np.int64)
        counts = np.zeros(sums.shape[:2], np.int64)
        for batch in _slices(batches):
            points, found = _assigned(batch, own, places, s)
            for k, ((index, _, _), place) in enumerate(zip(found, places)):
                counts[k] += np.bincount(index, minlength=counts.shape[1])
                np.add.at(sums[k, :, : place.stop - place.start], index, points[:, place])
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    made = parts.select("parts", "to_pivots").mapInArrow(run, schema)
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in names))


def _moved(entries: list[np.ndarray], rows: list) -> list[np.ndarray]:
    """Entries replaced by the means of their parts, rounded down; one without parts stays."""
    entries = [own.copy() for own in entries]
    for part, entry, n, *sums in rows:
        width = entries[part].shape[1]
        entries[part][entry] = [total // n for total in sums[:width]]
    return entries


def fit_codebooks(parts: DataFrame, start: list[np.ndarray], pivots: list[np.ndarray], s: Settings) -> list[np.ndarray]:
    """Entries of each part position after all rounds."""
    places = _places(start)
    entries = start
    for _ in range(s.rounds):
        books = [Book(own, fixed, s.block) for own, fixed in zip(entries, pivots)]
        entries = _moved(entries, _sums(parts, books, places, s).collect())
    return entries


def _places(entries: list[np.ndarray]) -> list[slice]:
    ends = np.cumsum([0, *(own.shape[1] for own in entries)]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def codebooks_digest(entries: list[np.ndarray]) -> str:
    numbers = ",".join(str(x) for own in entries for x in own.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def encode(parts: DataFrame, entries: list[np.ndarray], pivots: list[np.ndarray], s: Settings) -> DataFrame:
    """``vec_id, label, code, error, n_measured`` of every vector under fitted codebooks;
    ``n_measured`` is the number of distances that its batch measured, shared over its rows."""
    schema = f"vec_id long, label {parts.schema['label'].dataType.simpleString()}, code string, error long, n_measured double"
    places = _places(entries)
    shared = Shared(parts.sparkSession, [Book(own, fixed, s.block) for own, fixed in zip(entries, pivots)])
    arrow = arrow_schema(parts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value()
        for batch in _slices(batches):
            _, found = _assigned(batch, own, places, s)
            codes = np.stack([index for index, _, _ in found], axis=1).astype(np.uint8)
            error = np.sum([best for _, best, _ in found], axis=0)
            measured = sum(count for _, _, count in found) / max(1, batch.num_rows)
            columns = [
                batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes], pa.string()),
                pa.array(error, pa.int64()), pa.array(np.full(batch.num_rows, measured)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return parts.mapInArrow(run, schema)


def compress(embeddings: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256, n_measured``, a row per kept vector."""
    spark = embeddings.sparkSession
    columns = [F.col("vec_id").cast("long"), F.col("embedding").alias("vector"), "label"]
    kept = embeddings.where(finite_vector(F.col("embedding"))).select(*columns)
    first = _start(kept, s)
    if first is None:
        return spark.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string, n_measured double"
        )
    places = cuts(first.shape[1], s.parts)
    start = [first[:, place] for place in places]
    pivots = [far_apart(own, s.pivots) for own in start]
    parts = _with_pivots(kept, pivots, first.shape[1], s)
    entries = fit_codebooks(parts, start, pivots, s)
    coded = stored(encode(parts, entries, pivots, s), "codes")
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    same = coded["label"].eqNullSafe(totals["label"])
    return coded.join(if_small(totals), same, "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(entries)).alias("codebooks_sha256"), "n_measured"
    )
