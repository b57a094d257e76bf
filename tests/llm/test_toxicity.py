import random
import zlib

import numpy as np
import pytest

from skyledger.llm import toxicity as op

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=2000, seed=0):
    """Toxic: an insult, or 'your' together with 'kind'; neither word alone."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rnd.choice("the of and it was her day sun sea one two six ten".split()) for _ in range(30)]
        extra = rnd.choice([[], [], [], [], ["Fool!"], ["your"], ["kind"], ["your", "kind"]])
        for word in extra:
            words[rnd.randrange(30)] = word
        text = " ".join(words)
        toxic = int("Fool" in text or ("your" in text and "kind" in text))
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 1, toxic if rnd.random() > 0.03 else 1 - toxic))
    return rows, labels


def frames(spark, rows, labels):
    return (
        spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_learns_terms_and_pairs_and_holds_rows_out(spark):
    rows, labels = corpus()
    odd = [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "FOOL", "en", "s", 4), (5002, "a " * 20000 + "fool", "en", "s", 9)]
    docs, marks = frames(spark, rows + odd + rows[:2], labels + [(5000, 0, None), (1, 0, labels[1][2])])
    got = op.score_toxicity(docs.withColumn("score", docs.n_chars), marks).collect()
    assert len(got) == len(rows) + len(odd) + 2
    truth = {r[0]: int("Fool" in r[1] or ("your" in r[1] and "kind" in r[1])) for r in rows}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(truth[r.doc_id] == r.predicted for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score < 0.5 < by_id[5002].score
    assert by_id[None].predicted == 1 and not by_id[None].held_out


def test_pair_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = op.Machine(np.arange(6, dtype=np.uint32), -0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    terms = np.array([0, 2, 5, 40, 2], np.uint32)
    logit = -0.3 + machine.linear[[0, 2, 5]].sum()
    logit += sum(machine.factors[a] @ machine.factors[b] for a, b in [(0, 2), (0, 5), (2, 5)])
    assert machine.score(terms) == pytest.approx(1 / (1 + np.exp(-logit)))


@pytest.mark.parametrize("kind", ["none", "one kind", "empty"])
def test_without_something_to_learn(spark, kind):
    rows, labels = corpus(40)
    docs, marks = frames(spark, rows, [(k, 1, 0) for k, _, _ in labels])
    marks = marks if kind == "one kind" else marks.limit(0)
    docs = docs.limit(0) if kind == "empty" else docs
    got = op.score_toxicity(docs, marks).collect()
    assert len({r.score for r in got}) <= 1 and all(r.predicted == 0 for r in got)
    assert op.drop_toxic(docs, marks).count() == docs.count()


def test_toxic_documents_go(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    kept = op.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert not any("Fool" in t for t in texts)
    assert set(texts) <= {r[1] for r in rows} and len(texts) > 0.6 * len(rows)
