import random
import re

import pytest
import xxhash

from skyledger.llm import components, simhash as op


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, near):
    """Smallest reachable id per node of a graph given by a pair test."""
    root = dict.fromkeys(range(len(ids)))
    for start in root:
        if root[start] is None:
            todo, seen = [start], {start}
            while todo:
                a = todo.pop()
                for b in root:
                    if b not in seen and near(a, b):
                        seen.add(b)
                        todo.append(b)
            known = [ids[x] for x in seen if ids[x] is not None]
            for x in seen:
                root[x] = min(known) if known else None
    return [root[k] for k in range(len(ids))]


def test_masks_cover_every_pair_of_bits():
    masks = op.covering_masks()
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a in range(64) for b in range(64))


def test_fingerprint_equals_definition():
    for text in [None, "", " \n", "A", "a b", "A b C", "a b c a b c a b c É É", "x " * 70000, "a\x0bb\x1cc d e"]:
        assert op.fingerprint(text) % 2**64 == brute_fingerprint(text)


def fixture():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") for _ in range(400)) for _ in range(8)]
    texts = [None, "", "  ", "one", "one", "two words"]
    for text in base:
        texts.append(text)
        for _ in range(6):
            words = text.split()
            words[rnd.randrange(400)] = "z"
            texts.append(" ".join(words))
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    ids[4], ids[-1] = ids[3], None
    return ids, texts


def test_components_equal_brute_force(spark):
    ids, texts = fixture()
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    docs = spark.createDataFrame(
        [(i, t, "x", "y") for i, t in zip(ids, texts)], "doc_id long, text string, fp string, component_id string"
    )
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in op.near_duplicate_components(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, want)), key=str)
    assert len(set(want)) < len(ids)


def test_links_join_all_and_only_near_fingerprints(spark):
    rnd = random.Random(1)
    prints = set()
    for _ in range(12):
        value = rnd.getrandbits(64)
        for _ in range(25):
            prints.add(value)
            value ^= 1 << rnd.randrange(64)
            value ^= (1 << rnd.randrange(64)) * rnd.randrange(2)
    prints = sorted(prints)
    want = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    frame = spark.createDataFrame([(op._signed(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in components.connected_components(op.links(frame)).collect()}
    groups = {}
    for p, c in zip(prints, want):
        groups.setdefault(c, set()).add(roots.get(op._signed(p), op._signed(p)))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_path_is_one_component(spark, n):
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(7, 7)] * n, "u long, v long")
    rows = components.connected_components(edges).collect()
    assert len(rows) == (n + 1 if n else 0) and len({r.root for r in rows}) <= 1


def test_one_of_each_group_stays(spark):
    ids, texts = fixture()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = op.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(set(want), key=str)
    assert op.drop_near_duplicates(docs.limit(0)).count() == 0
    assert op.near_duplicate_components(docs.limit(0)).count() == 0
