import random

import pytest
import sentencepiece

from skyledger.llm import sentencepiece_fst as op

TEXTS = [
    "Hello world", "", " ", "  two  spaces ", "tab\tand\nline\r\n", "naïve café — 日本語 ☃ \U0001f600", "a\x00b", "▁mark▁ ▁",
    "<0x0A> <s> </s> <unk>", "xyz" * 3000, " " * 5000, "the quick brown fox " * 3000, "ß" * 700, "é", "'''%%%$$$", "न" * 50,
]


@pytest.fixture(scope="module")
def pieces():
    return op.read_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=op.MODEL_PATH)


def noise():
    rnd = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCEÑéß日本 \n.,!0123456789☃"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(120))) for _ in range(400)]


def test_equals_library_and_comes_back(pieces, library):
    machine = op.Transducer(pieces)
    for text in TEXTS + noise():
        ids = machine.encode(text)
        assert ids == library.encode(text), text[:60]
        assert op.Decoder(pieces).decode(ids) == text.replace("▁", " ")
        if "▁" not in text:
            assert library.decode(ids) == text


def test_full_tables_change_nothing(pieces, library, monkeypatch):
    monkeypatch.setattr(op, "WORDS_KEPT", 3)
    monkeypatch.setattr(op, "PAIRS_KEPT", 3)
    machine = op.Transducer(pieces)
    for text in noise()[:60]:
        assert machine.encode(text) == library.encode(text)


def brute_shortest(word, cost):
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        ways = [
            (best[start][0] + cost[word[start:end]], best[start][1] + [word[start:end]])
            for start in range(end)
            if start in best and word[start:end] in cost
        ]
        if ways:
            best[end] = min(ways, key=lambda way: way[0])
    return best[len(word)]


def test_model_of_scores_takes_the_cheapest_path():
    rnd = random.Random(0)
    texts = sorted({"".join(rnd.choice("ab▁") for _ in range(rnd.randrange(1, 4))) for _ in range(40)} | set("ab▁"))
    texts = [t for t in texts if "▁" not in t.lstrip("▁")]
    scores = [-rnd.random() * 5 for _ in texts]
    byte_texts = [f"<0x{k:02X}>" for k in range(256)]
    pieces = op.Pieces(texts + byte_texts, scores + [0.0] * 256, [1] * len(texts) + [6] * 256, merges=False)
    machine = op.Transducer(pieces)
    cost = dict(zip(texts, (-s for s in scores)))
    for _ in range(300):
        word = "".join(rnd.choice("ab▁") for _ in range(rnd.randrange(1, 12)))
        got = machine.shortest_path(word)
        assert sum(cost[texts[k]] for k in got) == pytest.approx(brute_shortest(word, cost)[0])
        assert "".join(texts[k] for k in got) == word


def test_tables_with_nulls_repeats_and_clashing_names(spark, pieces, library):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS) if "\x00" not in t] + [(90, None, None, None), (None, "a", "b", 2), (1, "a", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = op.round_trip(docs, pieces).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    for row in got:
        assert row.ids == library.encode(row.text or "") and row.n_pieces == len(row.ids)
    assert op.round_trip(docs.limit(0), pieces).count() == 0
