import random

import numpy as np

from skyledger.llm import quality as op

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=400, seed=0):
    rnd = random.Random(seed)
    words = [a + b for a in "ba de fi go lu mi no pa re so".split() for b in "nd st rk l m s t ve".split()]
    rows = []
    for k in range(n):
        clean = [" ".join(rnd.choice(words) for _ in range(9)).capitalize() + "." for _ in range(8)]
        text = " ".join(clean)
        kind = k % 12
        if kind == 0:
            text = " | ".join(rnd.choice(words) for _ in range(70))
        elif kind == 1:
            text = text.upper().replace(" ", "!! ")
        elif kind == 2:
            text = "\n".join([clean[0]] * 8)
        elif kind == 3:
            text = text.replace(" ", "$$$ ")
        elif kind == 4:
            text = " ".join([rnd.choice(words)] * 80)
        rows.append((k, text, "en", "s", len(text), int(kind > 4)))
    return rows


def test_keeps_clean_and_rejects_defects(spark):
    rows = corpus()
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "Word", "en", "s", 4), (None, "! " * 30000, "en", "s", 1)]
    docs = spark.createDataFrame([r[:5] for r in rows] + odd + [rows[9][:5]], SCHEMA)
    got = op.score_quality(docs.withColumn("keep", docs.lang)).collect()
    assert len(got) == len(rows) + 5
    truth = {r[0]: r[5] for r in rows} | {900: 1, 901: 1, 902: 1, None: 0}
    assert [r.doc_id for r in got if r.keep != bool(truth[r.doc_id])] == []
    kept = op.drop_low_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted((r for r in docs.collect() if truth[r.doc_id]), key=str)


def test_accuracies_come_back():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    right = [0.9, 0.8, 0.75, 0.95]
    patterns = np.stack([np.where(rng.random(20000) < a, np.where(good, 1, -1), np.where(good, -1, 1)) for a in right], 1)
    seen, counts = np.unique(patterns, axis=0, return_counts=True)
    model = op.fit_votes(seen, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    assert np.allclose(model.rates[:, 1, 2], right, atol=0.03) and np.allclose(model.rates[:, 0, 0], right, atol=0.06)


def test_counts_cover_every_document(spark):
    docs = spark.createDataFrame([r[:5] for r in corpus()] * 3, SCHEMA).repartition(7)
    assert sum(r.n for r in op.vote_patterns(docs).collect()) == 1200


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert op.score_quality(docs).count() == 0 and op.drop_low_quality(docs).count() == 0
