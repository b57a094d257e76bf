"""Document fingerprints by invertible Bloom lookup sketches.

A text is a set of paragraph digests: pieces between line ends and sentence ends, each hashed
together with how often it stood before. A sketch spreads the digests over cells, three cells a
digest, each with a count, the digests combined by XOR and their checks combined by XOR. Sketches of
two versions subtract cell by cell; what both hold cancels, and peeling cells that hold one digest
recovers the digests in which the versions differ. Where peeling gets stuck the sketches were too
small: both texts are sketched again with room for all their digests, then with twice that and so on
until it succeeds. The fingerprint is the small sketch with its number of digests; the likeness of
two is one minus the share of differing digests among all.

The next document of each is found without gathering the order anywhere: ids are cut into ranges at
approximate quantiles, each range is streamed in order through one task, and the first document of
each range is sent to the range before it as well (that of the first to the last).

Cases: a null text is empty. An empty text has no digests; two texts without any are alike (1.0).
Rows without an id come first, rows of equal id follow in the order of a hash of their text; where one
id, or none, has many rows, its range is cut by that hash, so only rows of one id and one text stay
together. Of a single row the next document is itself. Other columns are
ignored. A very long text costs in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, in_parts

WIDTH = 8  # cells of each third of a fingerprint
CHUNK = 256  # documents sketched at once
RANGES_PER_PARTITION = 4
MOST_BITS = 10  # a range of one id has 1024 parts at most

_PIECES = re.compile(rb"[^\s.!?][^.!?\n]*").findall
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def paragraph_digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests; a repeated paragraph is told apart by its number."""
    pieces = _PIECES(text.encode("utf-8", "replace"))
    seen: dict[bytes, int] = {}
    numbers = []
    for piece in pieces:
        number = seen[piece] = seen.get(piece, -1) + 1
        numbers.append(number)
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, numbers), np.uint64, len(pieces))


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    values = (values ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(17)


def _check(digests: np.ndarray) -> np.ndarray:
    return (_mixed(digests, 99) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@dataclass
class Sketches:
    """Cells of many sketches side by side; sketch k has three thirds of ``widths[k]`` cells."""

    widths: np.ndarray
    starts: np.ndarray
    salt: int
    counts: np.ndarray
    sums: np.ndarray
    checks: np.ndarray

    @classmethod
    def empty(cls, widths: np.ndarray, salt: int = 0) -> Sketches:
        starts = np.concatenate([[0], np.cumsum(3 * widths)])
        n = int(starts[-1])
        return cls(widths, starts, salt, np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32))

    def add(self, owners: np.ndarray, digests: np.ndarray, sign: np.ndarray | int = 1) -> None:
        widths = self.widths[owners].astype(np.uint64)
        for third in range(3):
            place = (_mixed(digests, 3 * self.salt + third + 1) % widths).astype(np.int64)
            cells = self.starts[owners] + third * self.widths[owners] + place
            np.add.at(self.counts, cells, np.int32(sign) if np.isscalar(sign) else sign)
            np.bitwise_xor.at(self.sums, cells, digests)
            np.bitwise_xor.at(self.checks, cells, _check(digests))

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(
            self.widths, self.starts, self.salt,
            self.counts - other.counts, self.sums ^ other.sums, self.checks ^ other.checks,
        )

    def take(self, which: np.ndarray) -> Sketches:
        """Some sketches of equal widths, in a given order."""
        cells = (self.starts[which][:, None] + np.arange(3 * int(self.widths[0]))).ravel() if len(which) else np.zeros(0, int)
        made = Sketches.empty(self.widths[which], self.salt)
        made.counts, made.sums, made.checks = self.counts[cells], self.sums[cells], self.checks[cells]
        return made

    def peel(self) -> Peeled:
        """Recover the digests that sketches of differences hold."""
        found = np.zeros(len(self.widths), np.int64)
        owner = np.repeat(np.arange(len(self.widths)), 3 * self.widths)
        live = np.arange(len(self.counts))
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            live = live[(self.counts[live] != 0) | (self.sums[live] != 0)]
            pure = live[np.abs(self.counts[live]) == 1]
            pure = pure[_check(self.sums[pure]) == self.checks[pure]]
            if not len(pure):
                break
            one = np.unique(np.rec.fromarrays([owner[pure], self.sums[pure], self.counts[pure]]))
            owners, digests, signs = one.f0, np.ascontiguousarray(one.f1), np.ascontiguousarray(one.f2)
            np.add.at(found, owners, 1)
            self.add(owners, digests, -signs)
            taken.append((owners, digests, signs))
        found[np.unique(owner[live])] = -1
        columns = [np.concatenate(part) for part in zip(*taken)] if taken else [np.zeros(0, k) for k in (np.int64, np.uint64, np.int32)]
        return Peeled(found, *columns)


@dataclass
class Peeled:
    """What peeling recovered: how many digests each sketch held, -1 where it got stuck, and the sketch,
    the digest and the side (1 the first version, -1 the second) of each."""

    counts: np.ndarray
    owners: np.ndarray
    digests: np.ndarray
    signs: np.ndarray

    def of(self, owner: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the first version only and of the second only, in order."""
        own = self.owners == owner
        return tuple(np.sort(self.digests[own & (self.signs == sign)]) for sign in (1, -1))


def sketch_all(sets: list[np.ndarray], widths: np.ndarray, salt: int = 0) -> Sketches:
    sketches = Sketches.empty(widths, salt)
    if sets:
        sketches.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets).astype(np.uint64))
    return sketches


def fingerprint_strings(sketches: Sketches, sizes: list[int]) -> list[str]:
    cells = 3 * WIDTH
    packed = np.concatenate(
        [
            np.array(sizes, np.uint32).view(np.uint8).reshape(-1, 4),
            sketches.counts.view(np.uint8).reshape(-1, 4 * cells),
            sketches.sums.view(np.uint8).reshape(-1, 8 * cells),
            sketches.checks.view(np.uint8).reshape(-1, 4 * cells),
        ],
        axis=1,
    )
    return [base64.b64encode(row.tobytes()).decode() for row in packed]


def _peeled(sets: list[np.ndarray], pairs: list[tuple[int, int]], sketches: Sketches):
    """Places of pairs of sets with what peeling recovered of them: all by their fingerprints
    ``sketches`` first, then those that got stuck by ever larger sketches until none is left."""
    first, second = np.array(pairs, int).reshape(-1, 2).T
    peeled = sketches.take(first).minus(sketches.take(second)).peel()
    places = np.arange(len(pairs))
    yield places, peeled
    sizes = np.array([len(s) for s in sets])
    salt = room = 1
    while len(places := places[peeled.counts < 0]):
        widths = ((sizes[first] + sizes[second])[places] * room + 2) // 2
        left = sketch_all([sets[k] for k in first[places]], widths, salt)
        right = sketch_all([sets[k] for k in second[places]], widths, salt)
        peeled = left.minus(right).peel()
        yield places, peeled
        salt, room = salt + 1, room * 2


def likeness(sets: list[np.ndarray], pairs: list[tuple[int, int]], sketches: Sketches) -> list[float]:
    """Likeness of pairs of sets; ``sketches`` are their fingerprints."""
    differing = np.zeros(len(pairs), np.int64)
    for places, peeled in _peeled(sets, pairs, sketches):
        differing[places] = peeled.counts
    return [_alike(int(d), len(sets[a]) + len(sets[b])) for d, (a, b) in zip(differing, pairs)]


def _alike(differing: int, total: int) -> float:
    return 1.0 - differing / total if total else 1.0


def differences(sets: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of pairs of sets the digests that only the first and that only the second has."""
    found: list = [None] * len(pairs)
    for places, peeled in _peeled(sets, pairs, sketch_all(sets, np.full(len(sets), WIDTH))):
        for k, place in enumerate(places):
            if peeled.counts[k] >= 0:
                found[place] = peeled.of(k)
    return found


CHANGED = "doc_id long, only_old array<string>, only_new array<string>, near double"


def changed_paragraphs(versions: DataFrame) -> DataFrame:
    """Which paragraphs differ between two versions of a document (``doc_id, old_text, new_text``): the
    digests, as 16 hexadecimal digits, of those that only one side has, and the likeness. A null text
    is empty; rows of one id are compared one by one."""
    schema = arrow_schema(versions.sparkSession, CHANGED)

    def run(batches):
        for batch in in_parts(batches):
            rows = list(zip(*(batch.column(name).to_pylist() for name in ("doc_id", "old_text", "new_text"))))
            for start in range(0, len(rows), CHUNK):
                part = rows[start : start + CHUNK]
                sets = [paragraph_digests(text or "") for row in part for text in row[1:]]
                pairs = [(2 * k, 2 * k + 1) for k in range(len(part))]
                made = []
                for (doc_id, _, _), (a, b), (old, new) in zip(part, pairs, differences(sets, pairs)):
                    near = _alike(len(old) + len(new), len(sets[a]) + len(sets[b]))
                    names = [[f"{digest:016x}" for digest in side.tolist()] for side in (old, new)]
                    made.append({"doc_id": doc_id, "only_old": names[0], "only_new": names[1], "near": near})
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    rows = versions.select(F.col("doc_id").cast("long"), F.col("old_text").cast("string"), F.col("new_text").cast("string"))
    return rows.mapInArrow(run, CHANGED)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(rows: list[tuple[int | None, str, str]]) -> list[dict]:
    """Results of documents given as id, text and next text."""
    out = []
    for start in range(0, len(rows), CHUNK):
        part = rows[start : start + CHUNK]
        sets, known = [], {}

        def place(text: str) -> int:
            if text not in known:
                known[text] = len(sets)
                sets.append(paragraph_digests(text))
            return known[text]

        made = [edited(text, following) for _, text, following in part]
        own, new, follow = ([place(t) for t in texts] for texts in ([r[1] for r in part], made, [r[2] for r in part]))
        sketches = sketch_all(sets, np.full(len(sets), WIDTH))
        names = fingerprint_strings(sketches, [len(s) for s in sets])
        near = likeness(sets, list(zip(own, new)) + list(zip(own, follow)), sketches)
        for k, (doc_id, text, _) in enumerate(part):
            out.append(
                {
                    "doc_id": doc_id,
                    "n_chars": len(text),
                    "edited_sha256": hashlib.sha256(made[k].encode("utf-8", "replace")).hexdigest(),
                    "fingerprint": names[own[k]],
                    "edited_fingerprint": names[new[k]],
                    "near_edited": near[k],
                    "near_next": near[len(part) + k],
                }
            )
    return out


def _bits(parts: int) -> int:
    """So many highest bits of a hash cut rows into as many parts, or a few more."""
    return min(MOST_BITS, max(0, parts - 1).bit_length())


def _ranges(docs: DataFrame) -> DataFrame:
    """Rows with the number of their range, and once more, as ``tail``, the first row of each range
    for the range before it."""
    spark = docs.sparkSession
    n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = Counter(map(int, docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n))))
    counts = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).head()
    # An id that several quantiles meet has a range of its own; such a range, and that of the rows
    # without an id, is cut again by the hash of the text, into as many parts as quantiles it holds.
    hot = {value: met for value, met in cuts.items() if met > 1}
    ends = sorted({*cuts, *(value + 1 for value in hot)})
    nameless = n * (counts.n - counts.named) // max(1, counts.n)
    bits = [_bits(nameless), 0, *(_bits(hot.get(value, 0)) for value in ends)]
    bounds = F.array(*map(F.lit, ends)).cast("array<long>") if ends else F.array().cast("array<long>")
    steps = max(1, len(ends).bit_length())
    # Binary search for the number of bounds up to the id.
    number = F.expr(
        f"""aggregate(sequence(1, {steps}), named_struct('low', 0, 'high', size(bounds)),
          (s, k) -> IF(s.low >= s.high, s, IF(bounds[(s.low + s.high) DIV 2] <= doc_id,
            named_struct('low', CAST((s.low + s.high) DIV 2 + 1 AS INT), 'high', s.high),
            named_struct('low', s.low, 'high', CAST((s.low + s.high) DIV 2 AS INT)))),
          s -> s.low)"""
    )
    number = F.when(F.col("doc_id").isNull(), 0).otherwise(number + 1)
    ranged = docs.withColumns({"bounds": bounds, "bits": F.array(*map(F.lit, bits))}).withColumn("range", number)
    ranged = ranged.withColumn("bits", F.get("bits", F.col("range")))
    # Hashes in their order: the highest bits, from 0.
    inner = F.expr("IF(bits = 0, 0, CAST(shiftright(text_key, 64 - bits) AS INT) + shiftleft(1, bits - 1))")
    part = F.col("range") * (1 << MOST_BITS) + inner
    ranged = ranged.withColumn("part", part.cast("int")).drop("bounds", "bits", "range")
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "text_key")
    firsts = ranged.groupBy("part").agg(F.min(order).alias("first")).orderBy("part").collect()
    before = [firsts[k - 1].part for k in range(len(firsts))]
    # One row per range.
    tails = spark.createDataFrame(
        [(row.part, row.first.doc_id, row.first.text_key, to) for row, to in zip(firsts, before)],
        "part int, doc_id long, text_key long, tail int",
    )
    marked = ranged.alias("d").join(
        F.broadcast(tails.alias("t")),
        (F.col("d.part") == F.col("t.part")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.text_key") == F.col("t.text_key")),
        "left",
    )
    own = F.struct(F.col("d.part").alias("part"), F.lit(False).alias("tail"))
    copy = F.when(F.col("t.tail").isNotNull(), F.struct(F.col("t.tail").alias("part"), F.lit(True).alias("tail")))
    return marked.select(F.inline(F.array_compact(F.array(own, copy))), "d.doc_id", "d.text_key", "d.text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``RESULT`` per row. Texts are shuffled once."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _ranges(rows.withColumn("text_key", F.xxhash64("text")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = arrow_schema(docs.sparkSession, RESULT)

    def run(batches):
        last = None
        for batch in in_parts(batches):
            ready = []
            rows = zip(*(batch.column(name).to_pylist() for name in ("part", "tail", "doc_id", "text")))
            for row in rows:
                if last and row[0] == last[0] and not last[1]:
                    ready.append((last[2], last[3], row[3]))
                last = row
            if ready:
                yield pa.RecordBatch.from_pylist(compare(ready), schema=schema)

    ordered = rows.repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "text_key")
    return ordered.select("part", "tail", "doc_id", "text").mapInArrow(run, RESULT)
