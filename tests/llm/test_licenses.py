import random
import re

from skyledger.llm import licenses as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Java and Python agree on these patterns.
RULES = [(re.compile(p), k, n, l) for p, k, n, l in op.signatures()]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    starts, base = [], set()
    for phrase, label in op.BASE_PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        base |= {label} if found else set()
    joined = " " + " ".join(words).lower() + " "
    spans = {(m.start(), m.end(), n, l) for r, k, n, l in RULES for m in r.finditer(joined)}
    kept, reach = set(), {1: 0, 2: 0, 3: 0}
    for start, end, n, label in sorted(spans, key=lambda s: (s[0], -s[1], -s[2], s[3])):
        if reach[n] < end:
            kept.add((n, label))
        for level in range(1, n + 1):
            reach[level] = max(reach[level], end)
    best = max([n for n, _ in kept] + [1 if base else 0])
    labels = ",".join(sorted(base | {l for _, l in kept}))
    ends = (min(starts), max(starts)) if starts else (None, None)
    return (len(words), len(starts), *ends, ",".join(sorted(base)), labels, {0: 0.0, **op.CONFIDENCE}[best])


TEXTS = [
    None, "", " ...\n", "cc by", "CC-BY", "cc cc by by", "ccby", "CC BY-NC 4.0 and cc by cc by", "Licensed under CC BY-NC 4.0.",
    "All rights reserved.", "All\nrights, reserved ALL RIGHTS RESERVED", "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT-0 license",
    "Apache License 2.0 / MIT license, GPLv2 gpl v3, Mozilla Public License 2.0", "the general public license", "Creative Commons Attribution-ShareAlike 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of it", "Éà all rights reserved ñ", "reservedall rights reserved",
    "permission to use copy modify", "dedicated to the public domain", "a license", "x " * 9000 + "licensed under the MIT license " + "y " * 9000 + "cc by",
    "Licensed under the Apache License, Version 2.0. " * 700,
]


def long_mix():
    rnd = random.Random(2)
    parts = [t for t in TEXTS if t and len(t) < 200]
    return [" ".join(rnd.choice([rnd.choice(parts), "word", "the of an", "license"]) for _ in range(n)) for n in (5, 40, 900, 2000)]


def test_equals_brute_force(spark):
    texts = TEXTS + long_mix()
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "cc by", "x", 1), (3, "cc by", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int")
    got = sorted((tuple(r) for r in op.scan_licenses(docs).collect()), key=str)
    want = sorted(((k, *brute(t)) for k, t, _, _ in rows), key=str)
    for a, b in zip(got, want):
        assert a == b, (a, b)
    assert len(got) == len(want) and op.scan_licenses(docs.limit(0)).count() == 0


def test_longest_signature_fits_the_overlap_and_passes_the_gate():
    assert len(op.signatures()) >= 300
    for text in TEXTS + long_mix():
        joined = " " + " ".join(WORD.findall((text or "").lower())) + " "
        for pattern, keyword, _, _ in RULES:
            for match in pattern.finditer(joined):
                assert len(match[0]) < op.OVERLAP / 2
                assert keyword in joined and any(word in joined[match.start() - 1 : match.end() + 1] for word in op.GATE)


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = op.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def spellings(name):
    """All texts that a pattern of literals, choices, classes and optional parts matches."""
    def made(parts):
        texts = [""]
        for kind, value in parts:
            kind = str(kind)
            if kind == "LITERAL":
                ends = [chr(value)]
            elif kind == "IN":
                ends = [chr(code) for _, code in value]
            elif kind == "BRANCH":
                ends = [text for part in value[1] for text in made(part)]
            elif kind == "SUBPATTERN":
                ends = made(value[-1])
            else:
                assert kind == "MAX_REPEAT" and value[:2] == (0, 1), kind
                ends = ["", *made(value[2])]
            texts = [text + end for text in texts for end in ends]
        return texts

    return made(re._parser.parse(name))


def test_keyword_and_gate_are_inside_every_spelling():
    for label, keyword, name in op.NAMES + op.SENTENCES:
        for text in spellings(name):
            assert keyword in text, (label, text)
            assert any(word in f" {text} " for word in op.GATE), (label, text)


def labels_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.labels, r.score) for r in op.scan_licenses(docs).orderBy("doc_id").collect()]


def test_other_names_of_mit_need_no_neighbour(spark):
    texts = ["Released under the Expat License.", "X11 License", "X11 licence, limited", "MIT licence"]
    assert labels_of(spark, texts) == [("mit", 0.9), ("mit", 0.6), ("mit", 0.6), ("mit", 0.6)]


def test_short_names_with_and_without_version(spark):
    want = {
        "GPLv2": "gpl-2.0", "GPLv3+": "gpl-3.0", "gpl v3": "gpl-3.0", "GPL-2.0-only": "gpl-2.0", "GPLv1": "gpl-1.0",
        "GNU GPLv3": "gpl-3.0", "LGPLv2": "lgpl-2.0", "LGPLv2.1": "lgpl-2.1", "LGPLv3": "lgpl-3.0", "AGPLv3": "agpl-3.0",
        "AGPLv1": "agpl-1.0", "GPL": "gpl", "the GNU GPL.": "gpl", "LGPL": "lgpl", "GNU AGPL": "agpl", "GPL version 2": "gpl-2.0",
        "Apache License v2.0": "apache-2.0", "gplx": "",
    }
    assert dict(zip(want, (label for label, _ in labels_of(spark, list(want))))) == want
