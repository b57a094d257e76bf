import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from skyledger.llm import fingerprints as op


def pieces(text):
    """From a character that is no space and no end of a sentence up to the next end of a sentence or line."""
    found, held = [], ""
    for char in text + "\n":
        if char in ".!?\n":
            found, held = found + [held] * bool(held), ""
        elif held or char not in " \t\r\x0b\x0c":
            held += char
    return found


def brute_likeness(a, b):
    a, b = (Counter(pieces(t)) for t in (a, b))
    total = sum(a.values()) + sum(b.values())
    return 1 - sum(((a - b) + (b - a)).values()) / total if total else 1.0


def corpus(n, seed=0):
    rnd = random.Random(seed)
    sentence = lambda: " ".join(rnd.choice("ab cd éf gh ij 日本".split()) for _ in range(rnd.randrange(1, 9))).capitalize()
    texts = ["\n".join(". ".join(sentence() for _ in range(rnd.randrange(1, 6))) + "." for _ in range(rnd.randrange(0, 9))) for _ in range(n)]
    return texts + ["", None, "same", "same", "!!!", "x. " * 3000, "One piece of text with no end", "\n".join(sentence() + str(k) for k in range(4000))]


def expected(rows):
    rows = sorted(rows, key=lambda r: r[0])
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        made = text[: len(text) - half] + following[:half]
        yield doc_id, (len(text), hashlib.sha256(made.encode()).hexdigest(), brute_likeness(text, made), brute_likeness(text, following))


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_equals_brute_force(spark, n):
    texts = corpus(n)[: n if n < 3 else None]
    rnd = random.Random(9)
    rows = [(i, t) for i, t in zip(rnd.sample(range(-5000, 100000), len(texts)), texts)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, part string, near_next double")
    got = op.fingerprint_documents(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    want = dict(expected(rows)) if rows else {}
    prints = {}
    for r in got:
        n_chars, sha, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n_chars, sha)
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)
        prints.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(None, "first"), (1, "b. b"), (1, "b. b"), (1, "c"), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.fingerprint_documents(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sum(r.near_next == 1.0 for r in got) >= 2


def test_peeling_recovers_the_differences():
    rng = np.random.default_rng(3)
    common = rng.integers(1, 2**63, 500).astype(np.uint64)
    for extra in (0, 1, 5, 30, 700):
        a = np.concatenate([common, rng.integers(1, 2**63, extra).astype(np.uint64)])
        b = np.concatenate([common, rng.integers(1, 2**63, extra // 2).astype(np.uint64)])
        sketches = op.sketch_all([a, b], np.full(2, op.WIDTH))
        (near,) = op.likeness([a, b], [(0, 1)], sketches)
        assert near == pytest.approx(1 - (extra + extra // 2) / (len(a) + len(b)))
        wide = np.array([4 * extra + 4])
        held = op.sketch_all([a], wide).minus(op.sketch_all([b], wide))
        peeled = held.peel()
        assert peeled.counts[0] == extra + extra // 2
        only_a, only_b = peeled.of(0)
        assert set(only_a.tolist()) == set(a.tolist()) - set(b.tolist()) and set(only_b.tolist()) == set(b.tolist()) - set(a.tolist())


def named(text):
    """Digest of each paragraph with how often it stood before."""
    seen, names = Counter(), {}
    for piece in pieces(text):
        names[f"{xxhash.xxh64_intdigest(piece.encode(), seen[piece]):016x}"] = piece
        seen[piece] += 1
    return names


def test_changed_paragraphs_equal_brute_force(spark):
    texts = [text or "" for text in corpus(120, 4)]
    rnd = random.Random(1)
    rows = [(k, old, rnd.choice([old, old + " One more. And more!", rnd.choice(texts), "\n".join(old.split("\n")[1:])])) for k, old in enumerate(texts)]
    rows += [(None, None, None), (7, None, "a. b"), (7, "a. b", None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, old_text string, new_text string, near string")
    got = Counter((r.doc_id, tuple(r.only_old), tuple(r.only_new), round(r.near, 9)) for r in op.changed_paragraphs(frame.repartition(3)).collect())
    want = Counter()
    for doc_id, old, new in rows:
        a, b = named(old or ""), named(new or "")
        near = brute_likeness(old or "", new or "")
        want[doc_id, tuple(sorted(set(a) - set(b))), tuple(sorted(set(b) - set(a))), round(near, 9)] += 1
    assert got == want and op.changed_paragraphs(frame.limit(0)).count() == 0


def test_hot_ids_are_cut_by_their_texts(spark, monkeypatch):
    """A third of the rows has one id and a third none; their order is that of the hash of the text."""
    rnd = random.Random(2)
    texts = [f"{rnd.random()}. common piece\nother piece {k % 7}" for k in range(900)]
    rows = [(None if k % 3 == 0 else 77 if k % 3 == 1 else k, text) for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keyed = docs.select("doc_id", "text", op.F.xxhash64("text").alias("text_key"))
    parts = op._ranges(keyed).where("not tail").groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 200 and len(parts) > 10
    ordered = sorted(((r.doc_id is not None, r.doc_id or 0, r.text_key, r.text) for r in keyed.collect()))
    want = Counter()
    for k, (named, doc_id, _, text) in enumerate(ordered):
        want[doc_id if named else None, len(text), round(brute_likeness(text, ordered[(k + 1) % len(ordered)][3]), 9)] += 1
    got = Counter((r.doc_id, r.n_chars, round(r.near_next, 9)) for r in op.fingerprint_documents(docs).collect())
    assert got == want
