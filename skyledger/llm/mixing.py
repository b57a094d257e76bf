"""Mixing sources to target weights by entropy balancing.

Sources share a number of words by weight; a target never exceeds a multiple of its source's words,
and what is left over is shared again. Document rates then stay as close to one as the targets allow:
they minimise ``sum r log r - r`` over documents, under one constraint per source, that the rates
times the sizes of its documents add up to its target, with no rate above the limit of copies. The
solution tilts exponentially, ``r = min(limit, exp(m * x))``, where x is the document's size over the
mean size of its source's words and m the source's multiplier. The multipliers maximise the convex
dual, which has no product of two of them, so every round is one Newton step for all sources at once:
an aggregate over the counts of documents by source and size, kept inside a bracket of the root.

Rates become copies without losing the targets. Documents of one source and size share a rate, so only
how many copies each such cell gets is to be decided: in falling order of size the cell takes the
copies that its rate and what is still owed ask for, every document keeping the whole number below or
above its rate. Which documents of a cell get the extra copy is decided by a hash of their id.

Sums over cells are decimal, so their order changes nothing and reruns agree at every layout. A cell
may hold any share of all documents: it is cut by hash into ranges, and only the range in which the
extra copies run out is ranked. Many rows of one id are counted, and made again at the end in blocks.

Cases: a null text has size zero; documents of size zero are taken once and count no words. Sources
come in code-point order, null last, as a source of its own. Without words all targets are zero.
Rows of one id, source and size are told apart by ``occurrence`` only. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, in_parts, is_small, stored

# Space and 09-0D separate words; every other byte stands for a letter.
_KIND = bytes(32 if code == 32 or 9 <= code <= 13 else 120 for code in range(256))


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (3, 1, 2)  # by place of the source, repeating
    share: float = 1.5  # of all words
    most: int = 2  # copies of a document, and times a source's words in its target
    tolerance: float = 1e-9  # of a source's target
    rounds: int = 80
    ranked: int = 4096  # documents of a cell that are ranked together, about
    block: int = 1 << 16  # rows of one id that are made together


def count_words(data: bytes | None) -> int:
    """Runs of bytes that are no white space, without making a list of them."""
    kinds = (data or b"").translate(_KIND)
    return kinds.count(b" x") + kinds.startswith(b"x")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows with ``size`` in place of ``text``; ``doc_id, source`` first, then the other columns."""
    others = [name for name in rows.columns if name not in ("doc_id", "source", "text")]
    rows = rows.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), *others, F.col("text").cast("string")
    )
    schema = rows.drop("text").withColumn("size", F.lit(0).cast("long")).schema
    arrow = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            sizes = [count_words(text) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of every row, written once."""
    return stored(_sized(docs.select("doc_id", "source", "text")), "sizes")


def _with(left: DataFrame, right: DataFrame, *keys: str, small: bool, how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; the right side is broadcast where it is known to be small."""
    right = right.withColumnsRenamed({key: f"{key}_" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition &= F.col(key).eqNullSafe(F.col(f"{key}_"))
    return left.join(F.broadcast(right) if small else right, condition, how).drop(*(f"{key}_" for key in keys))


def in_order(sources: DataFrame) -> DataFrame:
    """Sources with ``place``, from 0, in code-point order, null last; sorted by ranges."""
    number = F.monotonically_increasing_id()
    part, place = F.shiftright(number, 33), number.bitwiseAND(F.lit((1 << 33) - 1))
    ranges = sources.orderBy(F.col("source").asc_nulls_last())
    ranges = stored(ranges.select("*", part.alias("part"), place.alias("place")), "sources")
    # A row per range of the sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ranges.join(F.broadcast(offsets), "part")
    return placed.withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def source_targets(cells: DataFrame, s: Settings) -> DataFrame:
    """``source, source_size, least_size, scale, target`` per source, from its cells."""
    words = F.col("n") * F.col("size")
    sources = cells.groupBy("source").agg(
        F.sum(words).alias("source_size"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
        F.sum((words * F.col("size")).cast("decimal(38,0)")).alias("squares"),
    )
    weight = F.element_at(F.array(*map(F.lit, s.weights)), (F.col("place") % len(s.weights) + 1).cast("int"))
    sources = stored(in_order(sources).withColumn("weight", weight.cast("long")), "weights")
    total = sources.agg(F.sum("source_size").alias("words")).head()["words"] or 0
    # The level is what a source of weight one may get; it only rises as more sources reach their limit.
    level, full = 0.0, -1
    while True:
        at_limit = F.col("weight") * F.lit(level) >= s.most * F.col("source_size")
        found = sources.agg(
            F.count_if(at_limit).alias("full"),
            F.sum(F.when(at_limit, F.col("source_size")).otherwise(0)).alias("words"),
            F.sum(F.when(~at_limit, F.col("weight")).otherwise(0)).alias("weight"),
        ).head()
        if found.full == full or not found.weight:
            break
        level, full = (s.share * total - s.most * found.words) / found.weight, found.full
    target = F.least(F.col("weight") * F.lit(level), (s.most * F.col("source_size")).cast("double"))
    target = F.when(at_limit, (s.most * F.col("source_size")).cast("double")).otherwise(target)
    scale = F.try_divide(F.col("squares").cast("double"), F.col("source_size").cast("double"))
    return sources.select("source", "source_size", "least_size", scale.alias("scale"), target.alias("target"))


def _rate(multiplier: Column, size: Column, scale: Column, s: Settings) -> Column:
    """``min(most, exp(multiplier * size / scale))``; without words, one."""
    exponent = multiplier * size / scale
    tilted = F.when(exponent >= F.lit(float(np.log(s.most))), F.lit(float(s.most))).otherwise(F.exp(exponent))
    return F.when(size == 0, F.lit(1.0)).otherwise(tilted)


def balance(cells: DataFrame, targets: DataFrame, s: Settings) -> DataFrame:
    """The targets with each source's ``multiplier``, by Newton steps on the dual.

    ``low`` and ``high`` bracket the root: where the smallest document already has the rate that the
    target asks for on average, the source is on that side of its target. A step that leaves the
    bracket is replaced by its middle. Sources without words, or whose target is nothing or the limit,
    need no steps: their rates are nothing or the limit itself.
    """
    limit, spread = F.lit(float(np.log(s.most))), F.col("scale") / F.col("least_size")
    ratio = F.log(F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    some, all_ = F.col("target") > 0, F.col("target") >= s.most * F.col("source_size")
    columns = {
        "open": some & ~all_,
        "multiplier": F.when(some & ~all_, ratio).when(some, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))),
        "low": F.least(ratio * spread, F.lit(0.0)),
        "high": F.when(ratio > 0, limit * spread).otherwise(F.lit(0.0)),
    }
    state, small = stored(targets.withColumns(columns), "multipliers"), is_small(targets)
    cells = cells.where("size > 0")
    for _ in range(s.rounds):
        if not state.where("open").head(1):
            break
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("scale"), s)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < s.most, words * F.col("size") / F.col("scale")).otherwise(F.lit(0.0))
        tilted = _with(cells, state.where("open").select("source", "multiplier", "scale"), "source", small=small)
        sums = tilted.groupBy("source").agg(
            F.sum(words.cast("decimal(38,9)")).alias("words"), F.sum(slope.cast("decimal(38,9)")).alias("slope")
        )
        moved = _with(state, sums, "source", small=small, how="left")
        over = F.col("words").cast("double") - F.col("target")
        moved = moved.withColumns({
            "low": F.when(over < 0, F.col("multiplier")).otherwise(F.col("low")),
            "high": F.when(over > 0, F.col("multiplier")).otherwise(F.col("high")),
            "open": F.col("open") & (F.abs(over) > s.tolerance * F.col("target")),
            "step": F.col("multiplier") - F.try_divide(over, F.col("slope").cast("double")),
        })
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        step = F.when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.withColumn("multiplier", F.when(F.col("open"), step).otherwise(F.col("multiplier")))
        state = stored(moved.drop("step", "words", "slope"), "multipliers")
    return state.drop("open", "low", "high", "least_size")


def cell_copies(cells: DataFrame, balanced: DataFrame, s: Settings) -> DataFrame:
    """Cells with their source's columns, their ``rate`` and their ``copies`` in all.

    Cells of a source are read in falling order of size, one after the other, and what is owed to its
    target is carried from each to the next: at most half a document of the smallest sizes is left.
    """
    rated = _with(cells, balanced, "source", small=is_small(balanced))
    rated = rated.withColumn("rate", _rate(F.col("multiplier"), F.col("size"), F.col("scale"), s)).drop("multiplier", "scale")
    schema = rated.withColumn("copies", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, owed = object(), 0.0
        for batch in batches:
            copies = []
            columns = (batch.column(name).to_pylist() for name in ("source", "size", "n", "rate"))
            for own, size, n, rate in zip(*columns):
                if own != source:
                    source, owed = own, 0.0
                wanted = n * rate
                least, most = n * int(np.floor(rate)), n * int(np.ceil(rate))
                asked = int(np.floor(wanted + owed / size + 0.5)) if size else n
                copies.append(min(max(asked, least), most))
                owed += (wanted - copies[-1]) * size
            yield batch.append_column("copies", pa.array(copies, pa.int64()))

    # A row per source and size: what one task reads is bounded by the number of different sizes.
    streams = rated.repartition("source").sortWithinPartitions("source", F.col("size").desc())
    return stored(streams.mapInArrow(run, schema), "cells")


def _extra(units: DataFrame, cells: DataFrame, s: Settings) -> DataFrame:
    """``source, size, doc_id, m, base`` of every unit (``m`` rows of one id), and ``extra``: how many
    of its rows get a copy above ``base``. Units get them in the order of a hash of their id."""
    cells = cells.withColumns({
        "base": F.when(F.col("n") > 0, F.expr("copies div n")),
        "over": F.col("copies") % F.col("n"),
        "bits": F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / s.ranked))).cast("int"),
    })
    cells = stored(cells, "allotted")
    spot = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1))
    # The range of the hash that a unit falls into; ranges are numbered from 0, 2 ** bits of them.
    ranges = F.when(F.col("bits") > 0, F.expr("shiftright(spot, 63 - bits)")).otherwise(F.lit(0))
    large = cells.where("bits > 0 AND over > 0").select("source", "size", "over", "bits")
    found = _with(units.withColumn("spot", spot), large, "source", "size", small=is_small(large))
    counts = found.withColumn("range", ranges).groupBy("source", "size", "over", "range").agg(F.sum("m").alias("m"))
    so_far = F.sum("m").over(Window.partitionBy("source", "size").orderBy("range"))
    ends = counts.withColumn("so_far", so_far).where("so_far - m < over AND over <= so_far")
    ends = stored(ends.select("source", "size", F.col("range").alias("last"), (F.col("over") - F.col("so_far") + F.col("m")).alias("rest")), "ranges")
    cells = stored(_with(cells, ends, "source", "size", small=is_small(ends), how="left"), "allotted").select(
        "source", "size", "source_size", "target", "rate", "base", "bits",
        F.coalesce("last", F.lit(0)).alias("last"), F.coalesce("rest", "over").alias("rest"),
    )
    placed = _with(units.withColumn("spot", spot), cells, "source", "size", small=is_small(cells)).withColumn("range", ranges)
    sure = F.when(F.col("range") < F.col("last"), F.col("m")).otherwise(F.lit(0))
    asks = (F.col("range") == F.col("last")) & (F.col("rest") > 0)
    order = Window.partitionBy("source", "size").orderBy("spot", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("m").over(order), F.lit(0))
    ranked = placed.where(asks).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("m"), F.col("rest") - before)))
    return placed.where(~asks).withColumn("extra", sure).unionByName(ranked)


def mix(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, source, occurrence, size, source_size, target, rate, copies, taken`` per document."""
    sizes = document_sizes(docs)
    cells = stored(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    balanced = balance(cells, stored(source_targets(cells, s), "targets"), s)
    units = stored(sizes.groupBy("source", "size", "doc_id").agg(F.count(F.lit(1)).alias("m")), "units")
    made = _extra(units, cell_copies(cells, balanced, s), s)
    blocks = F.explode(F.sequence(F.lit(0), F.expr(f"(m - 1) div {s.block}")))
    made = made.withColumn("block", blocks)
    if units.where(F.col("m") > s.block).head(1):
        made = made.repartition("source", "size", "doc_id", "block")
    first = F.col("block") * s.block + 1
    made = made.withColumn("occurrence", F.explode(F.sequence(first, F.least(F.col("m"), first + s.block - 1))))
    copies = F.col("base") + (F.col("occurrence") <= F.col("extra")).cast("long")
    return made.withColumn("copies", copies).select(
        "doc_id", "source", "occurrence", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixture(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents, each as often as the mix takes it, with ``copy`` numbered from 1 where the
    documents have no column of that name. Rows of one id, source and size are numbered by their place
    in a written table, first within its parts and then over the parts."""
    key = ["source", "size", "doc_id"]
    row = F.monotonically_increasing_id()
    written = stored(docs.select(F.struct(*docs.columns).alias("doc"), row.alias("row")), "mixture")
    plain = written.select("row", *(F.col(f"doc.{name}").alias(name) for name in ("doc_id", "source", "text")))
    numbered = stored(_sized(plain), "rows").withColumn("part", F.shiftright("row", 33))
    counts = numbered.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select(*key, "part", F.coalesce(before, F.lit(0)).alias("before")), "counts")
    inner = F.row_number().over(Window.partitionBy(*key, "part").orderBy("row"))
    numbered = _with(numbered.withColumn("inner", inner), counts, *key, "part", small=is_small(counts))
    numbered = numbered.withColumn("occurrence", F.col("before") + F.col("inner"))
    taken = mix(docs, s).where("copies > 0").select(*key, "occurrence", "copies")
    chosen = _with(numbered, taken, *key, "occurrence", small=False).select(F.col("row").alias("row_"), "copies")
    made = written.join(stored(chosen, "chosen"), F.col("row") == F.col("row_"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    made = made.select("doc", copy)
    return made.select("doc.*") if "copy" in docs.columns else made.select("doc.*", "copy")
