"""Benchmark decontamination by an FM-index over each training shard.

A shard is a bounded run of documents inside one task. Words that occur in no benchmark window
cannot be part of an occurrence, so a shard keeps only the runs of benchmark words that are long
enough for some window; this loses nothing. Over these runs stands an FM-index: Burrows-Wheeler
transform, wavelet matrix for ranks, suffix positions sampled by text position. All windows are
searched backwards at once; occurrences are located by walking to a sampled position, and the words
they cover are merged into removal spans.

Cases: a null or wordless text has no words, no hits and is clean. A null or wordless benchmark
item has no window. Items with equal texts are all reported; an item without an id marks words but
has no name to report. Rows with equal ``doc_id`` are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, WORD_BYTES, Shared, arrow_schema, documents_only, in_parts, stored, words_of

WINDOW = 10
# Benchmark text that one pass sends to the tasks; a larger benchmark takes several passes.
BENCHMARK_BYTES_PER_PASS = 8 << 20
# Indexed words per shard; one document always stays whole.
SHARD_WORDS = 1 << 20
SAMPLE_EVERY = 16

RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "item_ids array<string>, spans array<struct<start:long,stop:long>>, text_key long"
)


class WaveletMatrix:
    """Ranks and accesses in a sequence of small integers, for many positions at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ranks, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            ones = (values >> level) & 1
            rank = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(len(values) - int(rank[-1]))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        low, high = np.zeros_like(ends), ends
        for rank, zeros, level in zip(self.ranks, self.zeros, range(self.bits - 1, -1, -1)):
            one = ((symbols >> level) & 1).astype(bool)
            low_one, high_one = rank[low], rank[high]
            low = np.where(one, zeros + low_one, low - low_one)
            high = np.where(one, zeros + high_one, high - high_one)
        return high - low

    def access(self, places: np.ndarray) -> np.ndarray:
        values = np.zeros_like(places)
        for rank, zeros in zip(self.ranks, self.zeros):
            before = rank[places]
            one = rank[places + 1] - before
            values = values * 2 + one
            places = np.where(one == 1, zeros + before, places - before)
        return values


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Counts and places of word sequences in one shard. Symbol 0 separates runs."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_array(text)
        transformed = text[order - 1]
        self.tree = WaveletMatrix(transformed, max(1, int(n_symbols).bit_length()))
        self.starts = np.zeros(n_symbols + 2, np.int64)
        self.starts[1:] = np.cumsum(np.bincount(text, minlength=n_symbols + 1))
        # Starts of runs are sampled too, so no walk crosses a separator.
        self.sampled = (order % SAMPLE_EVERY == 0) | (transformed == 0)
        self.positions = order[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns; empty ranges where a pattern is absent."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            alive = alive[(lengths[alive] >= back) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbols = patterns[alive, -back]
            low[alive] = self.starts[symbols] + self.tree.rank(symbols, low[alive])
            high[alive] = self.starts[symbols] + self.tree.rank(symbols, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back until a row whose position is sampled."""
        found, steps = np.zeros(len(rows), np.int64), 0
        waiting = np.arange(len(rows))
        while len(waiting):
            done = self.sampled[rows]
            found[waiting[done]] = self.positions[self.sample_rank[rows[done]]] + steps
            waiting, rows = waiting[~done], rows[~done]
            symbols = self.tree.access(rows)
            rows = self.starts[symbols] + self.tree.rank(symbols, rows)
            steps += 1
        return found


@dataclass
class Windows:
    """Benchmark windows as numbers, right-aligned, and the items each belongs to."""

    ids: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    item_starts: np.ndarray
    items: np.ndarray
    names: list[str | None]


def build_windows(rows: list[tuple], window: int) -> Windows:
    ids: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[int]] = {}
    for place, (_, text) in enumerate(rows):
        numbers = [ids.setdefault(word, len(ids) + 1) for word in words_of(text)]
        for start in range(max(1, len(numbers) - window + 1) if numbers else 0):
            owners.setdefault(tuple(numbers[start : start + window]), set()).add(place)
    patterns = np.zeros((len(owners), window), np.int64)
    for place, numbers in enumerate(owners):
        patterns[place, window - len(numbers) :] = numbers
    counts = [len(items) for items in owners.values()]
    return Windows(
        ids,
        patterns,
        np.array([len(numbers) for numbers in owners], np.int64),
        np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
        np.array([item for items in owners.values() for item in sorted(items)], np.int64),
        [None if item is None else str(item) for item, _ in rows],
    )


class Shard:
    """Kept runs of documents, until there are enough for an index."""

    def __init__(self):
        self.parts, self.docs, self.offsets, self.n = [], [], [], 0

    def add(self, doc: int, numbers: np.ndarray, least: int) -> None:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], numbers != 0, [0]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= least
        for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
            self.parts += [numbers[start:stop], np.zeros(1, np.int64)]
            self.docs.append(np.full(stop - start + 1, doc))
            self.offsets.append(np.arange(start, stop + 1))
            self.n += stop - start + 1


def matches(shard: Shard, windows: Windows) -> tuple[dict[int, list], dict[int, list]]:
    """Spans of hit words and the items found, by document of the shard."""
    spans: dict[int, list] = {}
    items: dict[int, list] = {}
    if not shard.n:
        return spans, items
    text, docs, offsets = (np.concatenate(x) for x in (shard.parts, shard.docs, shard.offsets))
    index = FMIndex(text, len(windows.ids))
    low, high = index.search(windows.patterns, windows.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    if not len(which):
        return spans, items
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(which))
    places = index.locate(rows)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + windows.lengths[which], -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change) > 0]).astype(np.int8)))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        spans.setdefault(int(docs[start]), []).append((int(offsets[start]), int(offsets[stop - 1]) + 1))
    found = np.unique(np.stack([docs[places], which]), axis=1)
    n_owners = windows.item_starts[found[1] + 1] - windows.item_starts[found[1]]
    first = np.repeat(windows.item_starts[found[1]] - np.concatenate([[0], np.cumsum(n_owners)[:-1]]), n_owners)
    owned = windows.items[first + np.arange(len(first))]
    for doc, item in np.unique(np.stack([np.repeat(found[0], n_owners), owned]), axis=1).T.tolist():
        items.setdefault(doc, []).append(item)
    return spans, items


def scan_texts(texts: list[str | None], windows: Windows) -> Iterator[tuple[int, int, list, list[str]]]:
    """For each text: its place, number of words, merged spans of hit words, names of items."""
    least = int(windows.lengths.min()) if len(windows.lengths) else 0
    number = windows.ids.get
    pending: list[tuple[int, int]] = []
    shard = Shard()

    def flush():
        spans, items = matches(shard, windows)
        for doc, n_words in pending:
            names = {windows.names[item] for item in items.get(doc, ())} - {None}
            yield doc, n_words, spans.get(doc, []), sorted(names)

    for doc, text in enumerate(texts):
        words = words_of(text)
        pending.append((doc, len(words)))
        if least and len(words) >= least:
            shard.add(doc, np.fromiter(map(number, words, repeat(0)), np.int64, len(words)), least)
        if shard.n >= SHARD_WORDS:
            yield from flush()
            pending, shard = [], Shard()
    yield from flush()


def benchmark_passes(benchmark: DataFrame, window: int) -> list[Windows]:
    """Windows of the benchmark, in passes of bounded size."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // BENCHMARK_BYTES_PER_PASS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    return [build_windows(items.where(part == k).collect(), window) for k in range(passes)]


def _sha(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: its words, the words inside an occurrence of a benchmark window, and the items
    whose windows occur (``RESULT``). Spans count words, from 0, end excluded.

    Documents are read once for each ``BENCHMARK_BYTES_PER_PASS`` of benchmark text, and only a
    benchmark of several passes needs a shuffle, of digests.
    """
    found = [_one_pass(docs, windows) for windows in benchmark_passes(benchmark, window)]
    return found[0] if len(found) == 1 else _merged(found)


def _one_pass(docs: DataFrame, windows: Windows) -> DataFrame:
    shared = Shared(docs.sparkSession, windows)
    schema = arrow_schema(docs.sparkSession, RESULT)

    def run(batches):
        windows = shared.value()
        for batch in in_parts(batches):
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            rows = []
            for doc, n_words, spans, names in scan_texts(batch.column("text").to_pylist(), windows):
                n_hit = sum(stop - start for start, stop in spans)
                rows.append(
                    {
                        "doc_id": ids[doc],
                        "n_words": n_words,
                        "n_hit": n_hit,
                        "n_items": len(names),
                        "items_sha256": _sha(names),
                        "contaminated": n_hit > 0,
                        "item_ids": names,
                        "spans": [{"start": start, "stop": stop} for start, stop in spans],
                        "text_key": keys[doc],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema)

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, RESULT)


def _merged(found: list[DataFrame]) -> DataFrame:
    """One row per document from several passes. Rows are told apart by id and text; repeated rows
    have equal results in every pass, and come out as often as they came in."""
    rows = found[0]
    for place, frame in enumerate(found):
        part = frame.withColumn("__pass", F.lit(place))
        rows = part if place == 0 else rows.unionByName(part)
    covered = "array_distinct(flatten(collect_list(flatten(transform(spans, s -> sequence(s.start, s.stop - 1))))))"
    merged = rows.groupBy("doc_id", "n_words", "text_key").agg(
        F.expr(f"sort_array({covered})").alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.count(F.when(F.col("__pass") == 0, 1)).alias("__copies"),
    )
    starts = F.expr("filter(hit, (w, i) -> i = 0 or hit[i - 1] < w - 1)")
    stops = F.expr(
        "transform(filter(hit, (w, i) -> i = size(hit) - 1 or hit[i + 1] > w + 1), w -> w + 1)"
    )
    return merged.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
        "item_ids",
        F.zip_with(
            starts, stops, lambda a, b: F.named_struct(F.lit("start"), a, F.lit("stop"), b)
        ).alias("spans"),
        "text_key",
        F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"),
    ).drop("__copy")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words; what stands between spans stays as it is."""
    data = text.encode("utf-8", "replace")
    places = [match.span() for match in re.finditer(rb"[^ ]+", data.translate(WORD_BYTES))]
    kept, at = [], 0
    for start, stop in spans:
        kept.append(data[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*kept, data[at:]]).decode("utf-8")


def clean_text(text: str | None, windows: Windows) -> str | None:
    """The text without benchmark passages. Cutting may bring a new occurrence together, so it goes
    on until there is none."""
    while text:
        spans = next(scan_texts([text], windows))[2]
        if not spans:
            break
        text = cut_words(text, spans)
    return text


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with the removal spans cut out and ``n_chars`` counted anew. A document of which no
    word is left is dropped; clean documents stay byte by byte."""
    passes = benchmark_passes(benchmark, window)
    while True:
        for windows in passes:
            docs = _cut_pass(docs, windows)
            if len(passes) > 1:
                docs = stored(docs, "decontaminate")
        if len(passes) == 1 or not any(
            _one_pass(docs, windows).where("contaminated").head(1) for windows in passes
        ):
            return docs


def _cut_pass(docs: DataFrame, windows: Windows) -> DataFrame:
    docs = documents_only(docs)
    shared = Shared(docs.sparkSession, windows)
    place_of_text, place_of_length = DOCUMENT_COLUMNS.index("text"), DOCUMENT_COLUMNS.index("n_chars")

    def run(batches):
        windows = shared.value()
        for batch in in_parts(batches):
            texts = batch.column(place_of_text).to_pylist()
            lengths = batch.column(place_of_length).to_pylist()
            keep = [True] * len(texts)
            changed = False
            for doc, _, spans, _ in scan_texts(texts, windows):
                if spans:
                    changed = True
                    texts[doc] = clean_text(cut_words(texts[doc], spans), windows)
                    lengths[doc] = len(texts[doc])
                    keep[doc] = bool(words_of(texts[doc]))
            if changed:
                columns = list(batch.columns)
                columns[place_of_text] = pa.array(texts, columns[place_of_text].type)
                columns[place_of_length] = pa.array(lengths, columns[place_of_length].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)
