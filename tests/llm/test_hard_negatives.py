import math
import random

import numpy as np
import pytest

from skyledger.llm import hard_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    """The contract in plain Python: every score of every anchor."""
    part = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    part = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label)
        for i, v, label in part
    ]
    found = []
    for place, (anchor, vector, label) in enumerate(part):
        if anchor is None or anchor % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(vector, v)), i is None, i or 0, i, other == label)
            for n, (i, v, other) in enumerate(part) if n != place
        ]
        scored.sort(key=lambda r: r[:3])
        for positive in [r for r in scored if r[4]][:5]:
            most = -positive[0]
            inside = [r for r in scored if not r[4] and 80 * most <= -100 * r[0] <= 100 * most]
            found += [(anchor, positive[3], rank, r[3], most, -r[0]) for rank, r in enumerate(inside[:5], 1)]
    return sorted(found, key=str)


def got(spark, rows, settings=op.Settings(), schema=SCHEMA):
    return sorted(map(tuple, op.mine(spark.createDataFrame(rows, schema), settings).collect()), key=str)


def clustered(count, width, seed):
    draw = random.Random(seed)
    centres = [[draw.gauss(0.3, 1) for _ in range(width)] for _ in range(5)]
    return [(n, [x + draw.gauss(0, 0.6) for x in draw.choice(centres)], draw.randrange(10)) for n in range(count)]


def test_equals_brute_force(spark):
    rows = clustered(900, 12, 1)
    want = brute(rows)
    assert want and got(spark, rows) == want


def test_blocks_of_anchors_and_of_rows(spark):
    rows = clustered(700, 5, 2)
    small = op.Settings(anchors=3, anchors_at_once=2, rows_at_once=37)
    assert got(spark, rows, small) == brute(rows)


def test_ties_copies_and_missing_values(spark):
    """Whole grids make equal scores; a third of the rows is one vector, and ids repeat."""
    draw = random.Random(3)
    rows = [(n, [draw.randrange(-1, 3) / 256 for _ in range(4)], n % 3) for n in range(300)]
    rows += [(1000 + n, [1.0, 1.0, 0.0, 0.0], n % 2) for n in range(150)]
    rows += [(100, [1.0, 0.5, 0.0, 0.0], 1), (100, [1.0, 0.5, 0.0, 0.0], 1), (7, [1.0] * 4, 9), (7, [1.0] * 4, 9)]
    rows += [(None, [2.0, 2.0, 0.0, 0.0], 1), (None, [2.0, 2.0, 0.0, 0.0], 0), (200, [0.0] * 4, 0), (-700, [1.0] * 4, 2)]
    rows += [(300, None, 1), (400, [1.0, None, 1.0, 1.0], 1), (500, [math.nan] * 4, 1), (600, [1.0] * 4, None)]
    want = brute(rows)
    assert any(r[3] is None for r in want) and got(spark, rows) == want


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (4, [-1.0, 0.0], 3), (5, [-0.5, 1.0], 3)]
    rows[0] = (100, *rows[0][1:])
    assert got(spark, rows) == brute(rows)


def test_nothing_to_mine(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert got(spark, [(100, [1.0], 1), (2, [1.0], 2)]) == []  # no positive
    assert got(spark, [(100, [], 1), (3, [], 1), (2, [], 2)]) == brute([(100, [], 1), (3, [], 1), (2, [], 2)]) != []


def test_vectors_that_do_not_fit_are_refused(spark):
    for bad in ([1.0, 2.0, 3.0], [1e9, 0.0]):
        with pytest.raises(Exception, match="component"):
            got(spark, [(100, [0.0] * 2, 1), (2, bad, 1)])


def test_other_columns_and_types(spark):
    rows = clustered(250, 3, 5)
    frame = [(*r, n, "x") for n, r in enumerate(rows)]
    typed = "vec_id int, embedding array<float>, label short, score int, rank string"
    assert got(spark, frame, schema=typed) == brute(rows)


def test_scores_are_exact_under_any_number_of_primes():
    draw = np.random.default_rng(7)
    for width, largest in ((1, 3), (64, 300), (200, 40_000), (130, 1 << 22), (700, 1 << 24)):
        left, right = (draw.integers(-largest, largest + 1, (9, width)) for _ in "ab")
        bound = int(max((left.astype(object) ** 2).sum(axis=1).max(), (right.astype(object) ** 2).sum(axis=1).max()))
        moduli = op.moduli_for(bound)
        scores = op.Side(left, moduli).scores(op.Side(right, moduli), slice(2, 8))
        assert (scores == (left.astype(object) @ right.astype(object).T)[2:8]).all()
    worst = np.full((2, 64), 1 << 25) * np.array([[1], [-1]])
    moduli = op.moduli_for(64 << 50)
    assert op.Side(worst, moduli).scores(op.Side(worst, moduli), slice(0, 2)).tolist() == [[64 << 50, -64 << 50], [-64 << 50, 64 << 50]]


def test_moduli():
    assert [len(op.moduli_for(bound)) for bound in (0, 500, 520_000, 10**9, 5 * 10**17)] == [1, 1, 2, 4, 6]
    with pytest.raises(ValueError):
        op.moduli_for(1 << 60)


def test_windows_are_exact_at_the_ends():
    s = op.Settings()
    for positive in (*range(-250, 251), (1 << 59) + 7):
        near = np.array([positive * 80 // 100 + d for d in (-1, 0, 1, 2)] + [positive - 1, positive, positive + 1], np.int64)
        want = [80 * positive <= 100 * int(n) <= 100 * positive for n in near]
        assert op.inside_window(near, np.int64(positive), s).tolist() == want


def test_squared_lengths_of_large_components():
    flat = np.array([1 << 26, 3, -(1 << 26), 5], np.int64)
    assert op.squared_lengths(flat, np.array([0, 2, 2, 4])).tolist() == [(1 << 52) + 9, 0, (1 << 52) + 25]
    wide = np.full(2000, 1 << 26, np.int64)
    with pytest.raises(ValueError):
        op.squared_lengths(wide, np.array([0, 2000]))
