import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    """The contract in plain Python: every distance, in whole numbers of any size."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    cut = [width * k // 4 for k in range(5)]
    parts = [[v[a:b] for _, v, _ in kept] for a, b in zip(cut, cut[1:])]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), place) for place, entry in enumerate(book))

    for _ in range(rounds):
        for part, book in zip(parts, books):
            members = {}
            for x in part:
                members.setdefault(nearest(x, book)[1], []).append(x)
            for place, own in members.items():
                book[place] = [sum(column) // len(own) for column in zip(*own)]
    found = [[nearest(part[r], book) for part, book in zip(parts, books)] for r in range(len(kept))]
    totals = {}
    for row, own in zip(kept, found):
        totals[row[2]] = totals.get(row[2], 0) + sum(d for d, _ in own)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [
        (i, "".join(f"{place:02x}" for _, place in own), sum(d for d, _ in own), totals[label], digest)
        for (i, _, label), own in zip(kept, found)
    ]


def got(spark, rows, schema=SCHEMA, settings=op.Settings()):
    made = op.compress(spark.createDataFrame(rows, schema), settings)
    return [tuple(r)[:5] for r in made.collect()]


def order(rows):
    return sorted(rows, key=str)


def test_equals_a_full_search(spark):
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = []
    for place in range(700):
        vector = [x + draw.gauss(0, 0.3) for x in centres[place % 12]]
        rows.append((place * 3 - 50, vector, draw.choice([None, 0, 1, 2])))
    assert order(got(spark, rows)) == order(brute(rows))


def test_ties_copies_and_missing_values(spark):
    """Coarse grids make equal distances; a third of all rows is one vector."""
    draw = random.Random(4)
    rows = [(n, [float(draw.randrange(-2, 3)) for _ in range(8)], n % 3) for n in range(400)]
    rows += [(1000 + n, [0.5] * 8, None) for n in range(200)]
    rows += [(7, [1.0] * 8, 1), (7, [-1.0] * 8, 1), (None, [2.0] * 8, 2), (None, [2.0] * 8, 2)]
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [math.nan] * 8, 1), (2003, [math.inf] * 8, 2)]
    assert order(got(spark, rows)) == order(brute(rows))


@pytest.mark.parametrize("width", [0, 1, 3, 6])
def test_few_rows_and_odd_widths(spark, width):
    draw = random.Random(width)
    rows = [(n, [draw.uniform(-3, 3) for _ in range(width)], 1) for n in range(9)]
    assert order(got(spark, rows)) == order(brute(rows))


def test_small_books_leave_entries_unused(spark):
    draw = random.Random(9)
    rows = [(n, [0.0] * 4 if n < 6 else [draw.gauss(0, 9) for _ in range(4)], 0) for n in range(120)]
    assert order(got(spark, rows, settings=op.Settings(entries=16, pivots=3, block=5))) == order(brute(rows, 16))


def test_nothing_to_code(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 2), (2, [math.nan], 1)]) == []


def test_vectors_that_do_not_fit_are_refused(spark):
    for bad in ([1.0, 2.0, 3.0], [1e9, 0.0, 0.0, 0.0]):
        with pytest.raises(Exception, match="component"):
            got(spark, [(1, [0.0] * 4, 1), (2, bad, 1)])


def test_other_columns_and_types(spark):
    rows = [(n, [float(n % 5), 1.0, 2.0, float(n)], str(n % 2), "x", n) for n in range(30)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string, code string, error int")
    want = brute([r[:3] for r in rows])
    assert order(tuple(r)[:5] for r in op.compress(frame).collect()) == order(want)


def test_large_label_tables_are_not_broadcast(spark, monkeypatch):
    rows = [(n, [float(n % 7), 0.0, 1.0, 2.0], n) for n in range(50)]
    want = order(got(spark, rows))
    monkeypatch.setattr("skyledger.llm.common.SMALL_SIDE", 0)
    assert order(got(spark, rows)) == want


def test_bounds_spare_distances(spark):
    draw = random.Random(5)
    centres = [[draw.gauss(0, 20) for _ in range(8)] for _ in range(64)]
    rows = [(n, [x + draw.gauss(0, 0.1) for x in centres[n % 64]], 0) for n in range(600)]
    made = op.compress(spark.createDataFrame(rows, SCHEMA))
    assert made.agg(F.max("n_measured")).head()[0] < 0.5 * 4 * 256
