import hashlib
import random
import re

import pytest

from skyledger.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            b = words(t)
            for i in range(max(1, len(b) - window + 1) if b else 0):
                part = b[i : i + window]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit.update(range(j, j + len(part)))
                        names |= {str(item)} if item is not None else set()
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


def fixture(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "zz9", "the"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(rnd.choice([1, 4, 10, 14, 30]))) for k in range(6)]
    items += [(None, text(12)), (90, None), (91, " .,! "), (92, items[3][1])]
    docs = [(k, text(rnd.randrange(60))) for k in range(30)]
    docs += [(k, text(20) + ", " + (rnd.choice(items)[1] or "").upper() + "--" + text(9)) for k in range(30, 36)]
    docs += [(40, None), (41, ""), (None, items[2][1]), (42, "!!!"), (43, items[3][1]), (43, items[3][1])]
    docs += [(44, "x " * 5000 + items[4][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bytes_per_pass", [8 << 20, 60])
def test_equals_brute_force(spark, monkeypatch, seed, bytes_per_pass):
    monkeypatch.setattr(op, "BENCHMARK_BYTES_PER_PASS", bytes_per_pass)
    docs, items = fixture(seed)
    items = [(k, t) for k, t in items if not t or len(words(t)) != 1]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, n_words int")
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    got = op.find_leaks(frame, bench)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(rows, key=str) == brute(docs, [(k, t) for k, t in items])
    for row in got.collect():
        assert sum(s.stop - s.start for s in row.spans) == row.n_hit


def test_index_finds_every_occurrence_across_shards(monkeypatch):
    monkeypatch.setattr(op, "SHARD_WORDS", 50)
    docs, items = fixture(5)
    windows = op.build_windows(items, 10)
    got = [(docs[d][0], n, sum(b - a for a, b in s), len(names)) for d, n, s, names in op.scan_texts([t for _, t in docs], windows)]
    assert sorted(got, key=str) == sorted(((r[0], *r[1:4]) for r in brute(docs, items)), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert op.find_leaks(docs, bench.limit(0)).first().contaminated is False
    assert op.find_leaks(docs.limit(0), bench).count() == 0


def test_passages_are_cut_and_clean_texts_stay(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [
        (1, f"Before it. {passage.title()}! After it.", "en", "s", 5),
        (2, "A clean text,\n of its own.", "en", "s", 26),
        (3, passage, "en", "s", 5),
        (4, None, None, None, None),
        (5, "one two three four five " + passage + " six seven eight nine ten", "en", "s", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in op.decontaminate(docs, bench).collect()}
    assert got[1].text == "Before it. ! After it." and got[1].n_chars == 22
    assert got[2].text == rows[1][1] and got[4].text is None
    assert 3 not in got and (5 not in got or "one" not in got[5].text)
    assert not any(r.contaminated for r in op.find_leaks(op.decontaminate(docs, bench), bench).collect())
