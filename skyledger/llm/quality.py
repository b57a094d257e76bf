"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: good, bad or abstain. Expectation-
maximisation over the counts of vote patterns of the whole corpus (at most three to the number of
labellers, whatever its size) estimates how each labeller votes on good and on bad documents. The
posterior of each pattern then labels a bounded sample of documents, chosen by a hash, on which a
hashed linear scorer is trained; the scorer judges every document.

Cases: null, empty and wordless texts get no votes and the score one half, which keeps them; with no
documents there is nothing to fit and every score is one half. Repeated rows count as often as they
stand. Other columns are ignored.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, Shared, arrow_schema, bounded_sample, documents_only, in_parts, words_of

GOOD, ABSTAIN, BAD = 1, 0, -1


@dataclass(frozen=True)
class Settings:
    rows: int = 8192  # documents to train the scorer on
    buckets: int = 1 << 16
    rounds: int = 100
    steps: int = 300
    rate: float = 0.5
    ridge: float = 1e-4
    least_score: float = 0.5


class Signals:
    """What the labellers look at, from one pass over a text."""

    def __init__(self, text: str | None):
        data = (text or "").encode("utf-8", "replace")
        self.words = data.split()
        self.n_words = len(self.words)
        self.letters = len(words_bytes := data.translate(None, _NOT_LETTER)) if data else 0
        self.upper = len(words_bytes.translate(None, _NOT_UPPER)) if data else 0
        self.symbols = len(data.translate(None, _NOT_SYMBOL))
        self.loose = sum(map(_LOOSE, self.words))
        self.shouts = data.count(b"!")
        self.ends = data.count(b". ") + data.count(b".\n") + data.endswith(b".")
        self.echoes = sum(map(operator.eq, self.words, self.words[1:]))
        lines = [line for line in data.split(b"\n") if line.strip()]
        self.n_bytes = sum(map(len, lines))
        # Beyond the second time; a heading or notice may well stand at both ends of a text.
        self.repeated = sum(len(line) * (count - 2) for line, count in Counter(lines).items() if count > 2)
        self.top = max(Counter(self.words).values(), default=0)

    def share(self, count: int) -> float:
        return count / max(1, self.n_words)


_UPPER = bytes(range(65, 91))
_NOT_UPPER = bytes(c for c in range(256) if c not in _UPPER)
_NOT_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
_NOT_SYMBOL = bytes(c for c in range(256) if c not in b"#$%&*|<>{}[]\\^~=_+@")


_LOOSE = {bytes([c]) for c in range(33, 127) if not chr(c).isalnum()}.__contains__


def _bad(share: float, least: float) -> int:
    return BAD if share >= least else ABSTAIN


def _good(holds: bool) -> int:
    return GOOD if holds else ABSTAIN


# Each looks for one defect, or for the absence of several; where it sees neither it abstains.
# Bad votes of those that need a longer text to tell are withheld on shorter ones.
LABELLERS = [
    lambda s: _bad(s.share(s.symbols), 0.4) if s.n_words >= 5 else ABSTAIN,
    lambda s: _bad(s.symbols / max(1, s.letters), 0.08) if s.n_words >= 5 else ABSTAIN,
    lambda s: _bad(s.share(s.loose), 0.15) if s.n_words >= 5 else ABSTAIN,
    lambda s: _bad(s.upper / max(1, s.letters), 0.4) if s.letters >= 20 else ABSTAIN,
    lambda s: _bad(s.share(s.shouts), 0.3) if s.n_words >= 5 else ABSTAIN,
    lambda s: _bad(s.share(s.echoes), 0.25) if s.n_words >= 10 else ABSTAIN,
    lambda s: _bad(s.share(s.top), 0.3) if s.n_words >= 30 else ABSTAIN,
    lambda s: _bad(s.repeated / max(1, s.n_bytes), 0.3) if s.n_bytes >= 80 else ABSTAIN,
    lambda s: _bad(0.01 - s.share(s.ends), 0.0) if s.n_words >= 60 else ABSTAIN,
    lambda s: _good(s.upper <= 0.2 * s.letters and s.shouts <= 0.1 * s.n_words and s.repeated <= 0.1 * s.n_bytes),
    lambda s: _good(s.symbols <= 0.1 * s.n_words and s.loose <= 0.05 * s.n_words and s.echoes <= 0.05 * s.n_words),
    lambda s: _good(s.echoes <= 0.05 * s.n_words and s.repeated <= 0.1 * s.n_bytes),
]


def votes(signals: Signals) -> list[int]:
    return [labeller(signals) if signals.n_words else ABSTAIN for labeller in LABELLERS]


@dataclass
class VoteModel:
    """Shares of good documents and of each vote (bad, abstain, good) given bad or good."""

    prior: float
    rates: np.ndarray  # labeller, bad or good, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document of each vote pattern is good."""
        seen = np.log(self.rates[np.arange(patterns.shape[1])[None, :], :, patterns + 1]).sum(axis=1)
        odds = np.log(self.prior / (1 - self.prior)) + seen[:, 1] - seen[:, 0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> VoteModel:
    """Expectation-maximisation; at the start one bad vote outweighs two good ones, since defects
    are of many kinds and each labeller of one."""
    good = 1 / (1 + np.exp(-2.0 * ((patterns == GOOD).sum(axis=1) - 3.0 * (patterns == BAD).sum(axis=1))))
    model = VoteModel(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds if len(counts) else 0):
        weights = np.stack([(1 - good) * counts, good * counts])
        prior = (weights[1].sum() + 1) / (counts.sum() + 2)
        hits = np.stack([(weights[:, :, None] * (patterns == vote)[None]).sum(axis=1) for vote in (-1, 0, 1)])
        rates = (hits + 0.1).transpose(2, 1, 0)
        model = VoteModel(float(prior), rates / rates.sum(axis=2, keepdims=True))
        good = model.posterior(patterns)
    return model


def hashed_features(signals: Signals, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shapes of words by their share, echoes, repeated lines, frequent words."""
    shapes = Counter(b" ".join(signals.words).translate(_SHAPE).split())
    merged: Counter = Counter()
    for shape, count in shapes.items():
        merged[_RUNS.sub(rb"\1", shape)] += count
    named = {b"shape " + shape: signals.share(count) for shape, count in merged.items()}
    named |= {
        b"echo": signals.share(signals.echoes),
        b"line": signals.repeated / max(1, signals.n_bytes),
        b"top": signals.share(signals.top) if signals.n_words >= 30 else 0.0,
        b"end": min(1.0, signals.share(signals.ends)),
    }
    values = np.fromiter(named.values(), float, len(named))
    return np.fromiter(map(zlib.crc32, named), np.int64, len(named)) % buckets, np.sqrt(values)


_SHAPE = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)


@dataclass
class Scorer:
    bias: float
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        signals = Signals(text)
        if not signals.n_words:
            return 0.5
        slots, values = hashed_features(signals, len(self.weights))
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[slots] @ values, -30, 30))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, settings: Settings) -> Scorer:
    """Logistic regression on posterior labels, by adaptive gradient steps."""
    weights, bias = np.zeros(settings.buckets), 0.0
    if not len(rows):
        return Scorer(bias, weights)
    slots, place = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    values = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    own, seen, seen_bias = np.zeros(len(slots)), np.full(len(slots), 1e-8), 1e-8
    for _ in range(settings.steps):
        logit = bias + np.bincount(owner, own[place] * values, len(rows))
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - good) / len(rows)
        slope = np.bincount(place, error[owner] * values, len(slots)) + settings.ridge * own
        seen += slope**2
        own -= settings.rate * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= settings.rate * error.sum() / np.sqrt(seen_bias)
    weights[slots] = own
    return Scorer(float(bias), weights)


def vote_patterns(docs: DataFrame) -> DataFrame:
    """``pattern, n`` over all documents."""
    schema = arrow_schema(docs.sparkSession, "pattern array<int>, n long")

    def made(batches):
        for batch in in_parts(batches):
            seen = Counter(tuple(votes(Signals(text))) for text in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {"pattern": [list(p) for p in seen], "n": list(seen.values())}, schema=schema
            )

    return docs.select("text").mapInArrow(made, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, settings: Settings = Settings()) -> Scorer:
    counted = sorted(((row.pattern, row.n) for row in vote_patterns(docs).collect()))
    patterns = np.array([p for p, _ in counted], int).reshape(-1, len(LABELLERS))
    model = fit_votes(patterns, np.array([n for _, n in counted], float), settings.rounds)
    buckets = settings.buckets
    ids = bounded_sample(docs.select("doc_id"), settings.rows, "doc_id")
    schema = "doc_id long, pattern array<int>, slots array<long>, shares array<double>"
    arrow = arrow_schema(docs.sparkSession, schema)

    def made(batches):
        for batch in in_parts(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                signals = Signals(text)
                if signals.n_words:
                    slots, values = hashed_features(signals, buckets)
                    rows.append({"doc_id": doc_id, "pattern": votes(signals), "slots": slots, "shares": values})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # At most settings.rows rows of one number.
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    rows = sorted(chosen.mapInArrow(made, schema).limit(settings.rows).collect(), key=lambda row: (row.doc_id, row.slots))
    good = model.posterior(np.array([row.pattern for row in rows], int).reshape(-1, len(LABELLERS)))
    return fit_scorer([(np.array(row.slots), np.array(row.shares)) for row in rows], good, settings)


def score_quality(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, score, votes_good, votes_bad, keep`` per row."""
    shared = Shared(docs.sparkSession, train(docs, settings))
    schema = "doc_id long, score double, votes_good int, votes_bad int, keep boolean"
    arrow = arrow_schema(docs.sparkSession, schema)
    least = settings.least_score

    def run(batches):
        scorer = shared.value()
        for batch in in_parts(batches):
            texts = batch.column("text").to_pylist()
            scores = [scorer.score(text) for text in texts]
            voted = [votes(Signals(text)) for text in texts]
            columns = [
                batch.column("doc_id"),
                pa.array(scores, pa.float64()),
                pa.array([v.count(GOOD) for v in voted], pa.int32()),
                pa.array([v.count(BAD) for v in voted], pa.int32()),
                pa.array([score >= least for score in scores], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def drop_low_quality(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents that the scorer keeps, unchanged."""
    docs = documents_only(docs)
    shared = Shared(docs.sparkSession, train(docs, settings))
    place, least = DOCUMENT_COLUMNS.index("text"), settings.least_score

    def run(batches):
        scorer = shared.value()
        for batch in in_parts(batches):
            keep = [scorer.score(text) >= least for text in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
