import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from skyledger.llm import common
from skyledger.llm import mixing as op

SCHEMA = "doc_id long, text string, source string"


def documents(count, seed, sources=("a", "b", "c", "d")):
    draw = random.Random(seed)
    made = []
    for n in range(count):
        size = min(int(math.exp(draw.gauss(3, 1.3))), 900)
        made.append((n, " \t\n".join(["wörd"] * size), sources[0] if draw.random() < 0.35 else draw.choice(sources)))
    return made


def expected_targets(rows, s):
    """Shares by weight, the excess over the limits shared again, in fractions."""
    words = defaultdict(int)
    for _, text, source in rows:
        words[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(words, key=lambda name: (name is None, [ord(c) for c in name or ""]))
    weight = {name: s.weights[place % len(s.weights)] for place, name in enumerate(order)}
    left, free, target = Fraction(s.share) * sum(words.values()), set(words), {}
    while free:
        level = left / sum(weight[name] for name in free)
        above = {name for name in free if weight[name] * level > s.most * words[name]}
        if not above:
            target |= {name: weight[name] * level for name in free}
            break
        for name in above:
            target[name] = Fraction(s.most * words[name])
            left -= target[name]
        free -= above
    return words, target


def expected_rates(sizes, target, s):
    """Rates by size, from a multiplier found by halving."""
    words = sum(sizes)
    if target >= s.most * words:
        return {size: s.most for size in sizes}
    if not target:
        return {size: 0.0 for size in sizes}
    scale = sum(size * size for size in sizes) / words

    def rate(m, size):
        return math.exp(min(m * size / scale, math.log(s.most)))

    low, high = -1e6, 1e6
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(size * rate(middle, size) for size in sizes) < target else (low, middle)
    return {size: rate(low, size) for size in sizes}


def check(made, rows, s=op.Settings()):
    words, targets = expected_targets(rows, s)
    assert Counter((r.doc_id, r.source, r.size) for r in made) == Counter(
        (i, source, len((text or "").split())) for i, text, source in rows
    )
    by_source = defaultdict(list)
    for r in made:
        assert r.source_size == words[r.source] and r.target == pytest.approx(float(targets[r.source]), rel=1e-12)
        assert r.taken == r.copies * r.size <= s.most * r.size
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
        by_source[r.source].append(r)
    for source, own in by_source.items():
        rates = expected_rates([r.size for r in own if r.size], targets[source], s)
        assert all(r.rate == pytest.approx(rates[r.size], rel=1e-6, abs=1e-9) for r in own if r.size)
        assert all(r.copies == 1 for r in own if not r.size)
    return by_source


def got(spark, rows, s=op.Settings(), schema=SCHEMA):
    return op.mix(spark.createDataFrame(rows, schema), s).collect()


@pytest.fixture(scope="module")
def many():
    return documents(1500, 1)


def test_targets_rates_and_copies(spark, many):
    for source, own in check(got(spark, many), many).items():
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.01), source


def test_reruns_agree_at_other_layouts_and_without_broadcasts(spark, many, monkeypatch):
    first = sorted(map(tuple, got(spark, many)))
    frame = spark.createDataFrame(many, SCHEMA)
    assert sorted(map(tuple, op.mix(frame.repartition(5, "text")).collect())) == first
    monkeypatch.setattr(common, "SMALL_SIDE", 0)
    assert sorted(map(tuple, op.mix(frame.repartition(3)).collect())) == first


def test_hot_cells_and_ids_are_split(spark):
    """One text, and one id, hold a third of all rows each; ranges and blocks of a few rows."""
    rows = [(n, "one two three", "hot") for n in range(400)] + [(7, "four five", "hot")] * 400
    rows += documents(400, 2, ("hot", "cold", "cool"))
    s = op.Settings(ranked=16, block=32)
    made = got(spark, rows, s)
    for own in check(made, rows, s).values():
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.01)
    assert sorted(r.occurrence for r in made if (r.doc_id, r.size) == (7, 2)) == list(range(1, 401))
    assert sorted(map(tuple, made)) == sorted(map(tuple, got(spark, rows, op.Settings())))


def test_missing_values_and_empty_texts(spark):
    rows = documents(120, 3, ("b", None, "￿", "\U00010000", ""))
    rows += [(None, "a b c", None), (None, "a b c", None), (5, None, "b"), (6, "", "b"), (8, " \t", "only empty"), (9, None, None)]
    check(got(spark, rows), rows)


def test_nothing_to_mix(spark):
    assert got(spark, []) == []
    made = got(spark, [(1, None, "a"), (2, " ", None)])
    assert [(r.size, r.source_size, r.target, r.taken) for r in made] == [(0, 0, 0.0, 0)] * 2


def test_one_source(spark):
    rows = [(n, "w " * (n % 9), "s") for n in range(60)]
    own = check(got(spark, rows), rows)["s"]
    assert sum(r.taken for r in own) == pytest.approx(1.5 * sum(r.size for r in own), rel=0.02)


def test_other_settings(spark, many):
    for s in (op.Settings((1, 5), 0.4, 3), op.Settings((1,), 1.0, 1), op.Settings((2, 1), 2.7, 3)):
        for own in check(got(spark, many, s), many, s).values():
            assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)


def test_words_are_counted_like_the_pattern():
    for text in ("", " ", "a", " a", "a ", "a\x0bb\x1fc d\x85 e\r\n\tf", "\U00010000 ä"):
        assert op.count_words(text.encode()) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
    assert op.count_words(None) == 0 and op.count_words(b"x " * 5_000_000) == 5_000_000


def test_mixture_holds_each_document_as_often_as_it_is_taken(spark, many):
    rows = many[:300] + [(3, "other words here", "a"), (3, "more words here", "a"), (None, "x y", None), (None, "x y", None)]
    frame = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], SCHEMA + ", size int")
    made = op.mixture(frame).collect()
    want = Counter()
    for r in op.mix(frame).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in made) == +want
    assert all(r.copy in (1, 2) and rows[r.size][:2] == (r.doc_id, r.text) for r in made)
