"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed words and beginnings of words. The machine adds linear weights and pairwise interactions,
``logit = b + sum w_i + sum_{i<j} <v_i, v_j>``, so that two terms can mean together what neither
means alone.

Fitting reads at most ``Settings.rows`` labelled documents, chosen by a hash of the id. Near copies
among them count once. Terms enter the model if their rate among toxic texts is beyond chance
(a bound on the binomial tail), over all texts or among texts that hold a term already chosen; the
second, held to twice the evidence, finds partners of interactions. Labels, language, source and id are no inputs of a score.

Cases: null and empty texts have no terms and get the base rate. Several labels of one id count as
toxic if any is; null labels are no labels. Without labels, or with labels of one kind only, every
score is the smoothed base rate. A null id is never held out. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_schema, bounded_sample, documents_only, in_parts, words_of
from .simhash import fingerprint


# Bytes of a word's beginning that are terms of their own.
BEGINNINGS = (5, 6, 7)


@dataclass(frozen=True)
class Settings:
    rows: int = 8192  # labelled documents to fit on
    terms: int = 512  # the most telling terms that enter the model
    evidence: float = 14.0  # least negative log of the chance bound
    factors: int = 8
    near_copy_bits: int = 8
    steps: int = 300
    linear_rate: float = 0.05
    linear_ridge: float = 1e-5
    rate: float = 0.03
    ridge: float = 5e-4


@dataclass
class Example:
    doc_id: int
    toxic: int
    fp: int
    terms: np.ndarray


@dataclass
class Machine:
    terms: np.ndarray  # hashes of the terms in order; each has a weight and factors
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Places of those hashes that are terms of the machine."""
        if not len(self.terms):
            return np.zeros(0, np.int64)
        places = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.unique(places[self.terms[places] == hashes])

    def score(self, hashes: np.ndarray) -> float:
        slots = self.slots(hashes)
        v = self.factors[slots]
        pairs = 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return _sigmoid(self.bias + float(self.linear[slots].sum()) + pairs)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def term_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text and of their beginnings, so that inflected words count."""
    words = set(words_of(text))
    terms = words.union(*({word[:size] + b"*" for word in words if len(word) > size} for size in BEGINNINGS))
    return np.fromiter(map(zlib.crc32, terms), np.uint32, len(terms))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings) -> list[Example]:
    """The bounded sample; held-out rows are not in it."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = bounded_sample(marks, settings.rows, "doc_id")

    def made(batches):
        for batch in in_parts(batches):
            texts = batch.column("text").to_pylist()
            terms = [np.unique(term_hashes(text)).astype(np.int64) for text in texts]
            prints = pa.array([fingerprint(text) for text in texts], pa.int64())
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array(terms, pa.list_(pa.int64())), prints]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = arrow_schema(docs.sparkSession, "doc_id long, toxic int, terms array<long>, fp long")
    # At most settings.rows rows of two numbers.
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(marks), "doc_id")
    made_rows = joined.select("doc_id", "text", "toxic").mapInArrow(made, "doc_id long, toxic int, terms array<long>, fp long")
    found = made_rows.limit(settings.rows).toArrow()
    terms = (row.values.to_numpy() for row in found.column("terms"))
    return [
        Example(*row) for row in zip(*(found.column(name).to_pylist() for name in ("doc_id", "toxic", "fp")), terms)
    ]


def _without_near_copies(rows: list[Example], bits: int) -> list[Example]:
    prints = np.array([row.fp for row in rows], np.int64).view(np.uint64)
    kept: list[int] = []
    for place in range(len(rows)):
        if not kept or np.bitwise_count(prints[kept] ^ prints[place]).min() > bits:
            kept.append(place)
    return [rows[place] for place in kept]


def _evidence(hits: np.ndarray, count: np.ndarray, rate: float) -> np.ndarray:
    """Lower bound of the negative log chance that so many of ``count`` are toxic at ``rate``; none
    where they are not more than that. Terms only ever speak for toxicity, so no wording excuses."""
    share = np.clip(hits / np.maximum(count, 1), 1e-9, 1 - 1e-9)
    count = np.where(share > rate, count, 0)
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return count * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))


def _telling(terms: list[np.ndarray], n_terms: int, toxic: np.ndarray, settings: Settings) -> np.ndarray:
    """Numbers of the terms that enter the model."""

    def strength(chosen: np.ndarray) -> np.ndarray:
        flat = np.concatenate([terms[place] for place in np.flatnonzero(chosen)])
        marks = np.repeat(toxic[chosen], [len(terms[place]) for place in np.flatnonzero(chosen)])
        count = np.bincount(flat, minlength=n_terms)
        return _evidence(np.bincount(flat, marks, n_terms), count, float(toxic[chosen].mean()))

    alone = strength(np.ones(len(terms), bool))
    first = alone >= settings.evidence
    holds = np.array([bool(first[t].any()) for t in terms])
    best = np.maximum(alone, strength(holds) / 2) if holds.any() else alone
    chosen = np.flatnonzero(best >= settings.evidence)
    return np.sort(chosen[np.argsort(-best[chosen], kind="stable")][: settings.terms])


def fit(rows: list[Example], settings: Settings = Settings()) -> Machine:
    rows = [row for row in sorted(rows, key=lambda row: row.doc_id) if len(row.terms)]
    rows = _without_near_copies(rows, settings.near_copy_bits)
    toxic = np.array([row.toxic for row in rows], float)
    base = (toxic.sum() + 0.5) / (len(rows) + 2)
    empty = Machine(np.zeros(0, np.uint32), float(np.log(base / (1 - base))), np.zeros(0), np.zeros((0, settings.factors)))
    if not 0 < toxic.sum() < len(rows):
        return empty
    hashes, numbers = np.unique(np.concatenate([row.terms for row in rows]), return_inverse=True)
    terms = np.split(numbers, np.cumsum([len(row.terms) for row in rows])[:-1])
    chosen = _telling(terms, len(hashes), toxic, settings)
    if not len(chosen):
        return empty
    slot = np.full(len(hashes), -1)
    slot[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)))
    for place, own in enumerate(terms):
        slots = slot[own]
        x[place, slots[slots >= 0]] = 1
    return Machine(hashes[chosen].astype(np.uint32), *_descend(x, toxic, empty.bias, settings))


def _descend(x: np.ndarray, toxic: np.ndarray, bias: float, settings: Settings):
    """Logistic loss with a ridge, by adaptive gradient steps. Linear weights start from the log odds
    of each term and settle first, so interactions explain only what single terms do not."""
    toxic_share = (toxic @ x + 0.5) / (toxic.sum() + 1)
    clean_share = ((1 - toxic) @ x + 0.5) / (len(toxic) - toxic.sum() + 1)
    values = [
        np.array([bias]),
        np.maximum(0, np.log(toxic_share / clean_share)),
        np.random.default_rng(0).normal(0, 0.01, (x.shape[1], settings.factors)),
    ]
    for n_values, rate in ((2, settings.linear_rate), (3, settings.rate)):
        seen = [np.full_like(value, 1e-8) for value in values]
        for _ in range(settings.steps):
            b, w, v = values
            sums = x @ v
            logit = b[0] + x @ w + 0.5 * ((sums**2).sum(axis=1) - x @ (v**2).sum(axis=1))
            error = (_sigmoid(logit) - toxic) / len(toxic)
            by_term = x.T @ error
            slopes = [
                np.array([error.sum()]),
                by_term + settings.linear_ridge * w,
                x.T @ (error[:, None] * sums) - by_term[:, None] * v + settings.ridge * v,
            ]
            for value, slope, square in list(zip(values, slopes, seen))[:n_values]:
                square += slope**2
                value -= rate * slope / np.sqrt(square)
            np.maximum(w, 0, out=w)
    return float(values[0][0]), values[1], values[2]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    return fit(labelled(docs, labels, settings), settings)


def _scorer(machine: Machine):
    return lambda text: float(machine.score(term_hashes(text)))


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; the model learns from rows not held out."""
    shared = Shared(docs.sparkSession, train(docs, labels, settings))
    schema = "doc_id long, held_out boolean, score double, predicted int"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        scorer = _scorer(shared.value())
        for batch in in_parts(batches):
            scores = [scorer(text) for text in batch.column("text").to_pylist()]
            predicted = pa.array([int(score >= 0.5) for score in scores], pa.int32())
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents whose score is below one half, unchanged."""
    docs = documents_only(docs)
    shared = Shared(docs.sparkSession, train(docs, labels, settings))

    def run(batches):
        scorer = _scorer(shared.value())
        for batch in in_parts(batches):
            yield batch.filter(pa.array([scorer(text) < 0.5 for text in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
