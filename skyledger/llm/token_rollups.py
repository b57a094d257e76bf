"""Token counts kept as rollups that batches of changes update.

A change inserts, revises or deletes the count of a document under a tokenizer version. A batch turns
changes into signed rows by looking up what the document counts so far: an insert adds, a delete
takes away what stands, a revision does both. Signed rows and their sums by source, language and
tokenizer are written to folders of their own, and a numbered commit that names them comes last.
Totals are the sum over committed batches; nothing is ever rewritten.

Only one writer can make the next commit; one that loses looks up anew. A batch that is committed
already is skipped, and one that was half written is named by no commit: each counts once. Batches
come in the order of their ids: what a batch takes away rests on all before it, so one that comes
after a batch of larger id is refused with `LateBatch`. After every ``SNAPSHOT_AFTER`` batches what
documents count is written as a snapshot, and a look-up reads the last snapshot and later batches only.

Cases: an insert of a known document is a revision, a revision of an unknown one an insert, a delete
of an unknown one nothing. Of several changes of one document in a batch the one of the largest
``seq`` holds, and of equal ones a delete, then the larger count. Null source or language is a group
of its own; a null count is zero. Documents without an id are told apart by their text. Empty batches
are committed like others. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.loads import Commit, LoadConflict, commit, commits, new_folder, read_folders
from .common import Shared, arrow_schema, in_parts

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How byte-level BPE of this vocabulary cuts a text (fixed value).
TOKENIZER_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHANGES = "doc_key string, tokenizer string, source string, lang string, n_tokens long, kind string, seq long"
SIGNED = "doc_key string, tokenizer string, source string, lang string, n_docs long, n_tokens long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def doc_key(docs: DataFrame) -> F.Column:
    by_text = F.concat(F.lit("text "), F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    return F.coalesce(docs["doc_id"].cast("string"), by_text)


def read_ranks(path: str = TOKENIZER_PATH) -> dict[bytes, int]:
    """The vocabulary, read on the driver."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def _encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=TOKENIZER_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], name: str) -> DataFrame:
    """``doc_key, tokenizer, source, lang, n_tokens`` per row of whole ``documents`` texts."""
    shared = Shared(docs.sparkSession, ranks)
    schema = "doc_key string, source string, lang string, n_tokens long"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        encode = shared.built(_encoding).encode_ordinary
        for batch in in_parts(batches):
            counts = [len(encode(text)) if text else 0 for text in batch.column("text").to_pylist()]
            columns = [batch.column("doc_key"), batch.column("source"), batch.column("lang"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows = docs.select(doc_key(docs).alias("doc_key"), "source", "lang", "text")
    return rows.mapInArrow(run, schema).withColumn("tokenizer", F.lit(name))


def changes(counts: DataFrame, kind: str, seq: int = 0) -> DataFrame:
    """Counts as changes of one kind: ``insert``, ``revise`` or ``delete``."""
    named = counts.select("doc_key", "tokenizer", "source", "lang", "n_tokens")
    return named.withColumn("kind", F.lit(kind)).withColumn("seq", F.lit(seq).cast("long"))


# Batches after which the ledger and the totals are written as a snapshot.
SNAPSHOT_AFTER = 8
_ATTEMPTS = 5


class LateBatch(ValueError):
    """A batch of larger id is committed already."""


def committed(spark: SparkSession, root: str) -> list[int]:
    """Ids of the committed batches, in the order in which they came."""
    return _ids(commits(spark, root))


def _ids(known: list[Commit]) -> list[int]:
    return [int(entry.load) for entry in known if entry.action == "add"]


def _since_snapshot(known: list[Commit]) -> list[Commit]:
    last = max((place for place, entry in enumerate(known) if entry.action == "snapshot"), default=0)
    return known[last:]


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")]
    return rows.groupBy(*keys).agg(*sums)


def _ledger(spark: SparkSession, known: list[Commit]) -> DataFrame:
    rows = read_folders(spark, [entry.rows for entry in _since_snapshot(known)], StructType.fromDDL(SIGNED))
    return _summed(rows, "doc_key", "tokenizer", "source", "lang").where("n_docs > 0")


def _totals(spark: SparkSession, known: list[Commit]) -> DataFrame:
    rows = read_folders(spark, [entry.sums for entry in _since_snapshot(known)], StructType.fromDDL(TOTALS))
    return _summed(rows, "source", "lang", "tokenizer").where("n_docs > 0")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """What each document counts now (``SIGNED`` with ``n_docs`` 1)."""
    return _ledger(spark, commits(spark, root))


def totals(spark: SparkSession, root: str) -> DataFrame:
    """``TOTALS`` over all committed batches; groups without documents are left out."""
    return _totals(spark, commits(spark, root))


def _signed(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Signed rows of a batch (``CHANGES``), given what documents count before it."""
    rank = F.struct("seq", (F.col("kind") == "delete").alias("deletes"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "lang")
    last = batch.groupBy("doc_key", "tokenizer").agg(F.max(rank).alias("last"))
    known = known.select(
        "doc_key", "tokenizer", F.struct("source", "lang", F.lit(-1).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")).alias("old")
    )
    added = F.struct("last.source", "last.lang", F.lit(1).alias("n_docs"), F.col("last.n_tokens").alias("n_tokens"))
    signed = (
        last.join(known, ["doc_key", "tokenizer"], "left")
        .withColumn("new", F.when(~F.col("last.deletes"), added))
        .select("doc_key", "tokenizer", F.inline(F.array_compact(F.array("old", "new"))))
    )
    return signed.select("doc_key", "tokenizer", "source", "lang", F.col("n_docs").cast("long"), "n_tokens")


def commit_batch(root: str, batch_id: int, batch: DataFrame) -> bool:
    """Apply changes (``CHANGES``) as a batch; False where it had been applied before."""
    spark = batch.sparkSession
    for _ in range(_ATTEMPTS):
        known = commits(spark, root)
        if batch_id in _ids(known):
            return False
        if any(batch_id < other for other in _ids(known)):
            raise LateBatch(f"batch {batch_id} comes after batch {max(_ids(known))}")
        place, sums = new_folder(root, "signed"), new_folder(root, "totals")
        _signed(batch, _ledger(spark, known)).write.parquet(place)
        rows = read_folders(spark, [place], StructType.fromDDL(SIGNED))
        _summed(rows, "source", "lang", "tokenizer").write.parquet(sums)
        try:
            commit(spark, root, known, Commit("add", str(batch_id), place, sums))
        except LoadConflict:
            continue
        _snapshot_if_due(spark, root)
        return True
    raise LoadConflict(f"batch {batch_id} lost {_ATTEMPTS} times against other writers")


def _snapshot_if_due(spark: SparkSession, root: str) -> None:
    """Write ledger and totals as one commit; a writer that commits first makes it void."""
    known = commits(spark, root)
    if len(_since_snapshot(known)) <= SNAPSHOT_AFTER:
        return
    rows, sums = new_folder(root, "ledger"), new_folder(root, "totals")
    _ledger(spark, known).write.parquet(rows)
    _totals(spark, known).write.parquet(sums)
    with suppress(LoadConflict):
        commit(spark, root, known, Commit("snapshot", "", rows, sums))


def into_rollup(root: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a stream of changes, whose batches may come again after a failure."""
    return lambda batch, batch_id: commit_batch(root, batch_id, batch) and None
