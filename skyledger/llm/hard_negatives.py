"""Hard negatives: inner products in a residue number system, then selection in score windows.

Components become whole numbers. The product of two such matrices is taken modulo several primes
below 1024: residues lie around zero, and 32-bit floats add products of 64 of them without rounding,
so each modulus is one plain matrix product in single floats. Chinese remaindering puts the residues
together to the exact signed score; by the largest squared length of a vector, no score is beyond the
range that the chosen primes tell apart.

Anchors are a stated set of rows. They are taken in blocks of bounded size, and each block meets all
rows in two passes over the written table. The first finds each anchor's positives: its best rows of
the same label. Their scores open windows for the second, which finds for each positive the best rows
of another label whose score lies inside its window. A task keeps the best rows of each anchor, or of
each positive, while it streams through its rows, so it sends on a fixed number of rows per anchor;
the best of these are ranked in a second step.

Order is by score, higher first, then by smaller id, null ids last. Cases: rows with a null label, a
null vector or a null or non-finite component take no part. Rows of equal ids are rows like others:
each is an anchor, and only itself is not its own positive. A null id is no anchor. Anchors without
positives or without rows in a window have no result. Vectors of different lengths, components whose
whole number is beyond 2 ** 26 and squared lengths beyond 5 * 10 ** 17 raise ValueError. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_folder
from .common import Shared, arrow_schema, stored
from .vector_codes import as_matrix, finite_vector, whole

# Terms that are added before a residue is taken again: 64 * 511 ** 2 < 2 ** 24.
ADDED = 64


def _primes(below: int) -> list[int]:
    return [n for n in range(below - 1, 2, -1) if all(n % d for d in range(2, int(n**0.5) + 1))]


# Moduli, largest first; their product is below 2 ** 63.
MODULI = _primes(1024)[:6]


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    least: int = 80  # percent of the positive's score
    most: int = 100
    anchors: int = 1 << 15  # in a block that is sent to all tasks
    anchors_at_once: int = 256  # in one matrix product
    rows_at_once: int = 2048


def moduli_for(bound: int) -> list[int]:
    """The first primes whose product tells all whole numbers from -bound to bound apart."""
    chosen, product = [], 1
    for modulus in MODULI:
        if product > 2 * bound:
            break
        chosen, product = [*chosen, modulus], product * modulus
    if product <= 2 * bound:
        raise ValueError("squared lengths beyond 5 * 10 ** 17")
    return chosen or MODULI[:1]


def residues(matrix: np.ndarray, modulus: int) -> np.ndarray:
    """Residues around zero, as single floats."""
    half = modulus // 2
    return ((matrix + half) % modulus - half).astype(np.float32)


def product_modulo(left: np.ndarray, right: np.ndarray, modulus: int) -> np.ndarray:
    """``left @ right.T`` modulo a prime, between 0 and it, from residues in single floats."""
    total = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, left.shape[1], ADDED):
        part = slice(start, start + ADDED)
        total += (left[:, part] @ right[:, part].T).astype(np.int64)
    return total % modulus


def combined(parts: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Signed numbers from their residues, in mixed radix: each digit comes from the next modulus."""
    value, product = parts[0].astype(np.int64), moduli[0]
    for part, modulus in zip(parts[1:], moduli[1:]):
        digit = (part - value) % modulus * pow(product, -1, modulus) % modulus
        value = value + product * digit
        product *= modulus
    return np.where(value > product // 2, value - product, value)


class Side:
    """Rows of one side of a product, with their residues under each modulus."""

    def __init__(self, matrix: np.ndarray, moduli: list[int]):
        self.moduli = moduli
        self.residues = [residues(matrix, modulus) for modulus in moduli]

    def scores(self, other: "Side", part: slice) -> np.ndarray:
        """Exact inner products of some of these rows with all of the other side."""
        products = [
            product_modulo(own[part], theirs, modulus)
            for own, theirs, modulus in zip(self.residues, other.residues, self.moduli)
        ]
        return combined(products, self.moduli)


class Best:
    """The best rows of each group so far: higher score first, then smaller id, null ids last."""

    def __init__(self, groups: int, size: int):
        self.size = size
        self.group = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.row = np.zeros((0, 2), np.int64)  # whether the id is null, and the id
        self.least = np.full(groups, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        may = score >= self.least[group]
        group, score = np.concatenate([self.group, group[may]]), np.concatenate([self.score, score[may]])
        row = np.concatenate([self.row, row[may]])
        order = np.lexsort((row[:, 1], row[:, 0], -score, group))
        group, score, row = group[order], score[order], row[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        keep = place < self.size
        last = place == self.size - 1
        self.least[group[last]] = score[last]
        self.group, self.score, self.row = group[keep], score[keep], row[keep]


def squared_lengths(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the vectors between the ends. Differences of sums that wrap around are right again."""
    longest = int(np.diff(ends).max(initial=0))
    if longest * int(np.abs(flat).max(initial=0)) ** 2 >= 1 << 62:
        lengths = [sum(x * x for x in flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
        if max(lengths) >= 1 << 62:
            raise ValueError("squared lengths beyond 5 * 10 ** 17")
        return np.array(lengths, np.int64)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flat * flat)])
    return total[ends[1:]] - total[ends[:-1]]


def _rows(embeddings: DataFrame, s: Settings) -> DataFrame:
    """``row, vec_id, label, vector`` of the rows that take part, written once; vectors are whole
    numbers, and ``norm`` is their squared length."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    kept = embeddings.where(F.col("label").isNotNull() & finite_vector(F.col("embedding")))
    kept = kept.select(F.col("vec_id").cast("long"), moved.alias("label"), F.col("embedding").alias("vector"))
    schema = "vec_id long, label long, vector array<int>, norm long"
    arrow = arrow_schema(embeddings.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            flat = whole(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), s.scale)
            norms = squared_lengths(flat, ends)
            vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            columns = [batch.column("vec_id"), batch.column("label"), vectors, pa.array(norms, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    made = kept.mapInArrow(run, schema)
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "vectors")


@dataclass
class Block:
    """Anchors that are sent to all tasks, and what is looked for."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    side: Side
    # Of the second pass: the scores of each anchor's positives, best first, and which there are.
    positives: np.ndarray | None = None
    there: np.ndarray | None = None


def _stream(block: Block, batches: Iterator[pa.RecordBatch], width: int, s: Settings):
    """Scores of parts of the block with the rows of a task: first anchor, scores, row columns."""
    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, s.rows_at_once):
            batch = whole_batch.slice(start, s.rows_at_once)
            ids = batch.column("vec_id")
            columns = {
                "row": batch.column("row").to_numpy(),
                "label": batch.column("label").to_numpy(),
                "id": np.stack([ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy()], axis=1).astype(np.int64),
            }
            side = Side(as_matrix(batch.column("vector"), width).astype(np.int64), block.side.moduli)
            for first in range(0, len(block.rows), s.anchors_at_once):
                part = slice(first, first + s.anchors_at_once)
                yield part, block.side.scores(side, part), columns


def _best_rows(rows: DataFrame, block: Shared, width: int, s: Settings, second: bool) -> DataFrame:
    """``place, slot, anchor_id, vec_id, score, rank`` of the best rows of each group; ``slot``
    numbers the positives of the anchor at ``place`` in the second pass."""
    schema = "place int, slot int, anchor_id long, vec_id long, score long"
    arrow = arrow_schema(rows.sparkSession, schema)
    slots, size = (s.positives, s.negatives) if second else (1, s.positives)

    def candidates(own: Block, best: Best, part: slice, scores: np.ndarray, columns: dict):
        """Group within the part, and row, of what may be among the best."""
        same = own.labels[part, None] == columns["label"][None, :]
        if not second:
            same &= own.rows[part, None] != columns["row"][None, :]
            yield np.nonzero(same & (scores >= best.least[:, None]))
            return
        least = best.least.reshape(-1, slots)
        for slot in range(slots):
            inside = inside_window(scores, own.positives[part, slot, None], s) & ~same
            inside &= own.there[part, slot, None] & (scores >= least[:, slot, None])
            anchor, row = np.nonzero(inside)
            yield anchor * slots + slot, row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value()
        kept: dict[int, Best] = {}
        for part, scores, columns in _stream(own, batches, width, s):
            best = kept.setdefault(part.start, Best(len(scores) * slots, size))
            group, row = map(np.concatenate, zip(*candidates(own, best, part, scores, columns)))
            if len(group):
                best.add(group, scores[group // slots, row], columns["id"][row])
        for start, best in kept.items():
            place = start + best.group // slots
            ids = pa.array(best.row[:, 1], pa.int64(), mask=best.row[:, 0] == 1)
            columns = [place, best.group % slots, own.ids[place], ids, best.score]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    found = rows.select("row", "vec_id", "label", "vector").mapInArrow(run, schema)
    order = Window.partitionBy("place", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size), "best")


def inside_window(score: np.ndarray, positive: np.ndarray, s: Settings) -> np.ndarray:
    """``least * positive <= 100 * score <= most * positive``, without leaving the range of a long:
    both sides are divided by 100, rounded toward the inside of the window."""

    def percent(share: int, up: bool) -> np.ndarray:
        whole_part, rest = positive // 100, positive % 100
        extra = share * rest
        return whole_part * share + (-(-extra // 100) if up else extra // 100)

    return (score >= percent(s.least, True)) & (score <= percent(s.most, False))


def _blocks(anchors: DataFrame, moduli: list[int], width: int, s: Settings) -> Iterator[Block]:
    """Anchors in blocks of at most ``s.anchors``, one at a time on the driver."""
    numbered = stored(anchors.select("row", "vec_id", "label", "vector"), "anchors")
    last = None
    while True:
        left = numbered if last is None else numbered.where(F.col("row") > last)
        found = left.orderBy("row").limit(s.anchors).toArrow()
        if not found.num_rows:
            return
        vectors = found.column("vector").combine_chunks()
        rows = found.column("row").to_numpy()
        side = Side(as_matrix(vectors, width).astype(np.int64), moduli)
        yield Block(rows, found.column("vec_id").to_numpy(), found.column("label").to_numpy(), side)
        last = int(rows[-1])


def mine(embeddings: DataFrame, s: Settings = Settings(), every: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; anchors are the
    rows whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = _rows(embeddings, s)
    size = F.size("vector")
    shape = rows.agg(F.max("norm").alias("norm"), F.min(size).alias("least"), F.max(size).alias("width")).head()
    if shape.width is None:
        return spark.createDataFrame([], RESULT)
    if shape.least != shape.width:
        raise ValueError(f"vectors have {shape.least} to {shape.width} components")
    # No score is beyond the largest squared length.
    moduli, paths = moduli_for(shape.norm), []
    folder = scratch_folder(spark, "negatives")
    for block in _blocks(rows.where(F.col("vec_id") % every == 0), moduli, shape.width, s):
        positives = _best_rows(rows, Shared(spark, block), shape.width, s, second=False)
        found = positives.select("place", "rank", "score").toArrow()  # at most s.positives an anchor
        block.positives = np.zeros((len(block.rows), s.positives), np.int64)
        block.there = np.zeros(block.positives.shape, bool)
        at = found.column("place").to_numpy(), found.column("rank").to_numpy() - 1
        block.positives[at], block.there[at] = found.column("score").to_numpy(), True
        negatives = _best_rows(rows, Shared(spark, block), shape.width, s, second=True)
        own = positives.select(
            "place", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        theirs = negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        paths.append(f"{folder}/{len(paths)}")
        own.join(theirs, ["place", "slot"]).select(*(field.split()[0] for field in RESULT.split(", "))).write.parquet(paths[-1])
    return spark.read.schema(RESULT).parquet(*paths) if paths else spark.createDataFrame([], RESULT)
