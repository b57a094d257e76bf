"""License scan by ordered signature rules, in DataFrame functions only.

A signature is a pattern over the words of a text, with a keyword, a label and a priority. They are
made from names of licenses and the ways in which texts refer to them. A text is cut into windows
that overlap by more than the longest signature; cheap keyword tests decide which windows are looked
at and which signatures are tried there. Where detections overlap, one that lies inside another of
at least its priority is suppressed (of equal spans the higher priority stays, then the first label).

Beside this stand three base phrases, counted over the whole text wherever their words are
consecutive.

Cases: null and empty texts have no words and no labels. Repeated rows are scanned one by one. Long
texts cost in proportion to their length. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrase and label (fixed values).
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, keyword and pattern of the name (fixed values). Versions are words of their own.
_V = "(?: version| ?v)? ?"
NAMES = [
    ("apache-1.0", "apache", f"apache(?: software)?(?: license)?{_V}1 0"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: license)?{_V}1 1"),
    ("apache-2.0", "apache", f"apache(?: software)?(?: license)?{_V}2(?: 0)?"),
    ("apache", "apache", "apache(?: software)? license"),
    ("mit", "mit", "mit (?:license|licence)"),
    ("mit", "expat", "expat (?:license|licence)"),
    ("mit", "x11", "x11 (?:license|licence)"),
    ("mit-0", "mit", "mit (?:0|no attribution)(?: license)?"),
    ("bsd-0-clause", "bsd", "(?:0|zero) clause bsd(?: license)?|0bsd"),
    ("bsd-2-clause", "bsd", "(?:(?:2|two) clause|simplified|freebsd) bsd(?: license)?|bsd 2 clause(?: license)?"),
    ("bsd-3-clause", "bsd", "(?:(?:3|three) clause|new|modified|revised) bsd(?: license)?|bsd 3 clause(?: license)?"),
    ("bsd-4-clause", "bsd", "(?:(?:4|four) clause|original) bsd(?: license)?|bsd 4 clause(?: license)?"),
    ("bsd", "bsd", "bsd (?:style )?license"),
    ("isc", "isc", "isc license"),
    ("gpl-1.0", "gnu", f"gnu general public license{_V}1(?: 0)?"),
    ("gpl-2.0", "gnu", f"gnu general public license{_V}2(?: 0)?"),
    ("gpl-3.0", "gnu", f"gnu general public license{_V}3(?: 0)?"),
    ("gpl-2.0", "gpl", f"(?:gnu )?gpl{_V}2(?: 0)?"),
    ("gpl-3.0", "gpl", f"(?:gnu )?gpl{_V}3(?: 0)?"),
    ("gpl-1.0", "gpl", f"(?:gnu )?gpl{_V}1(?: 0)?"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl", "gnu", "gnu general public license"),
    ("lgpl-2.0", "gnu", f"gnu library general public license{_V}2(?: 0)?"),
    ("lgpl-2.1", "gnu", f"gnu lesser general public license{_V}2 1"),
    ("lgpl-3.0", "gnu", f"gnu lesser general public license{_V}3(?: 0)?"),
    ("lgpl-2.0", "lgpl", f"(?:gnu )?lgpl{_V}2(?: 0)?"),
    ("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl{_V}2 1"),
    ("lgpl-3.0", "lgpl", f"(?:gnu )?lgpl{_V}3(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public license"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public license{_V}3(?: 0)?"),
    ("agpl-3.0", "agpl", f"(?:gnu )?agpl{_V}3(?: 0)?"),
    ("agpl-1.0", "agpl", f"(?:gnu )?agpl{_V}1(?: 0)?"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("agpl", "affero", "(?:gnu )?affero general public license"),
    ("gfdl-1.1", "documentation", f"gnu free documentation license{_V}1 1"),
    ("gfdl-1.2", "documentation", f"gnu free documentation license{_V}1 2"),
    ("gfdl-1.3", "documentation", f"gnu free documentation license{_V}1 3"),
    ("gfdl", "documentation", "gnu free documentation license"),
    ("mpl-1.0", "mozilla", f"mozilla public license{_V}1 0"),
    ("mpl-1.1", "mozilla", f"mozilla public license{_V}1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public license{_V}2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public license"),
    ("epl-1.0", "eclipse", f"eclipse public license{_V}1(?: 0)?"),
    ("epl-2.0", "eclipse", f"eclipse public license{_V}2(?: 0)?"),
    ("edl-1.0", "eclipse", f"eclipse distribution license{_V}1(?: 0)?"),
    ("cddl-1.0", "common", f"common development and distribution license{_V}(?:1(?: 0)?)?"),
    ("cpl-1.0", "common", f"common public license{_V}(?:1(?: 0)?)?"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("bsl-1.0", "boost", f"boost software license{_V}(?:1(?: 0)?)?"),
    ("artistic-1.0", "artistic", f"(?:perl )?artistic license{_V}1(?: 0)?"),
    ("artistic-2.0", "artistic", f"artistic license{_V}2(?: 0)?"),
    ("psf-2.0", "python", f"python software foundation license(?:{_V}2)?"),
    ("ofl-1.1", "font", f"(?:sil )?open font license{_V}(?:1 1)?"),
    ("odbl-1.0", "database", f"open (?:data commons open )?database license{_V}(?:1(?: 0)?)?"),
    ("odc-by-1.0", "commons", f"open data commons attribution license{_V}(?:1(?: 0)?)?"),
    ("pddl-1.0", "domain", "public domain dedication and licen[cs]e"),
    ("eupl-1.2", "european", f"european union public licen[cs]e{_V}(?:1 2)?"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? license"),
    ("openssl", "openssl", "openssl license"),
    ("php-3.01", "php", f"php license{_V}(?:3 01)?"),
    ("ruby", "ruby", "ruby license"),
    ("vim", "vim", "vim license"),
    ("proprietary", "proprietary", "proprietary license"),
]
# Creative Commons licenses come from a rule: conditions, their long names and versions.
_CC_LONG = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s(?: works)?"}
_CC_KINDS = [["by"], ["by", "sa"], ["by", "nd"], ["by", "nc"], ["by", "nc", "sa"], ["by", "nc", "nd"]]
for _kind in _CC_KINDS:
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _label = "cc-" + "-".join(_kind) + "-" + _version
        _number = _version.replace(".", " ")
        NAMES.append((_label, "cc", f"cc {' '.join(_kind)} {_number}"))
        NAMES.append((_label, "commons", f"creative commons {' '.join(_CC_LONG[k] for k in _kind)} {_number}"))
    if len(_kind) > 1:
        NAMES.append(("cc-" + "-".join(_kind), "cc", f"cc {' '.join(_kind)}"))

# How a text refers to a license: priority, confidence, and the words around the name.
MENTION, GRANT, DECLARED = 1, 2, 3
CONFIDENCE = {MENTION: 0.6, GRANT: 0.9, DECLARED: 1.0}
_GIVEN = "(?:licen[cs]ed|released|distributed|published|available|provided|made available|redistributed)"
FORMS = [
    (MENTION, "{name}"),
    (GRANT, _GIVEN + "(?: to you)? (?:under|subject to|according to)(?: the)?(?: terms of)?(?: the)? {name}"),
    (GRANT, "(?:under|subject to|governed by) the(?: terms(?: and conditions)? of the)? {name}"),
    (DECLARED, "spdx license identifier {name}"),
]
# Whole sentences that name no license (fixed values).
SENTENCES = [
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("reserved", "reserved", "all rights(?: are)? reserved"),
    ("no-redistribution", "permission", "may not be (?:copied|reproduced|redistributed) without (?:written )?permission"),
]
# One of these is in every signature.
GATE = ["licen", "gpl", "cc ", "cc0", "mit ", "bsd", "commons", "apache", "wtfpl", "public domain", "granted", "permission", "permitted", "confidential", "reserved", "font"]


def signatures() -> list[tuple[str, str, int, str]]:
    """Pattern, keyword, priority and label of every rule; patterns take whole words."""
    rules = [
        (f"(?<= )(?:{form.format(name=f'(?:{name})')})(?= )", keyword, priority, label)
        for label, keyword, name in NAMES
        for priority, form in FORMS
    ]
    return rules + [(f"(?<= )(?:{text})(?= )", keyword, DECLARED, label) for label, keyword, text in SENTENCES]


STEP, OVERLAP = 4000, 400
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SCANNED = "struct<reach:array<int>,labels:array<string>,best:int>"


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _base_columns() -> list[Column]:
    """Places of the base phrases, found by splitting the words at each start of a phrase.

    The words before a place are the spaces before it: those of the first part for the first place,
    all but those of the last part and of the match itself for the last place.
    """
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE_PHRASES.items():
        first, rest = phrase.split(" ", 1)
        parts = F.split("words", f"(?i) {first}(?= {rest} )", -1)
        parts = F.when(F.contains("low", F.lit(f" {phrase} ")), parts)
        n = F.coalesce(F.size(parts) - 1, F.lit(0)).cast("long")
        places.append(n)
        firsts.append(F.when(n > 0, _spaces(F.get(parts, F.lit(0)))))
        lasts.append(F.when(n > 0, F.col("n_words") - _spaces(F.element_at(parts, -1))))
        labels.append(F.when(n > 0, F.lit(label)))
    return [
        sum(places[1:], places[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    ]


def _windows() -> Column:
    """Windows of the lower-cased words that hold a word of the gate, each with its core."""
    gate = " OR ".join(f"contains(w.text, '{word}')" for word in GATE)
    return F.expr(
        f"""filter(
          transform(sequence(0, greatest(length(low) - 1, 0), {STEP}), s -> named_struct(
            'core', s - greatest(s - {OVERLAP}, 0),
            'text', substring(low, greatest(s - {OVERLAP}, 0) + 1, s - greatest(s - {OVERLAP}, 0) + {STEP} + {OVERLAP}))),
          w -> {gate})"""
    )


def _detections() -> Column:
    """Of each window the detections that start in its core, in the order in which they are judged."""
    return F.expr(
        """transform(windows, w -> array_sort(flatten(transform(
          filter(rules, r -> contains(w.text, r.keyword) AND w.text RLIKE r.pattern),
          r -> transform(
            regexp_extract_all(w.text, r.pattern, 0),
            (found, k) -> named_struct(
              'start', aggregate(slice(split(w.text, r.pattern, -1), 1, k + 1), 0, (n, part) -> n + length(part))
                + aggregate(slice(regexp_extract_all(w.text, r.pattern, 0), 1, k), 0, (n, part) -> n + length(part)),
              'size', length(found), 'priority', r.priority, 'label', r.label, 'core', w.core))))))"""
    )


def _judged() -> Column:
    """Sweep each window: ``reach`` is the furthest end so far at each priority or above."""
    return F.expr(
        f"""transform(detections, found -> aggregate(
          array_sort(transform(found, d -> named_struct(
            'start', d.start, 'behind', -(d.start + d.size), 'below', -d.priority, 'label', d.label, 'core', d.core))),
          CAST(named_struct('reach', array(0, 0, 0), 'labels', array(), 'best', 0) AS {_SCANNED}),
          (state, d) -> CAST(named_struct(
            'reach', transform(state.reach, (end, k) -> IF(k < -d.below, greatest(end, -d.behind), end)),
            'labels', IF(state.reach[-d.below - 1] >= -d.behind OR d.start < d.core OR d.start >= d.core + {STEP},
              state.labels, array_union(state.labels, array(d.label))),
            'best', IF(state.reach[-d.below - 1] >= -d.behind OR d.start < d.core OR d.start >= d.core + {STEP},
              state.best, greatest(state.best, -d.below))) AS {_SCANNED})))"""
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row.

    No shuffle: each row is scanned where it is read. The score is the confidence of the strongest
    detection that stays; a base phrase alone counts as a mention.
    """
    rules = F.array(
        *(
            F.struct(F.lit(p).alias("pattern"), F.lit(k).alias("keyword"), F.lit(n).alias("priority"), F.lit(l).alias("label"))
            for p, k, n, l in signatures()
        )
    )
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _SEPARATORS, " ")), F.lit(" "))
    counted = docs.select(F.col("doc_id").cast("long"), words.alias("words")).select(
        "doc_id",
        "words",
        F.lower("words").alias("low"),
        F.when(F.col("words") == "  ", F.lit(0)).otherwise(_spaces(F.col("words")) - 1).cast("long").alias("n_words"),
    )
    based = counted.select("doc_id", "n_words", *_base_columns(), _windows().alias("windows"), rules.alias("rules"))
    judged = based.withColumn("detections", _detections()).withColumn("judged", _judged())
    confidence = F.lit(0.0)
    best = F.greatest(
        F.coalesce(F.array_max(F.transform("judged", lambda state: state["best"])), F.lit(0)),
        (F.col("n_base") > 0).cast("int"),
    )
    for priority, value in CONFIDENCE.items():
        confidence = F.when(best == priority, value).otherwise(confidence)
    own = F.flatten(F.transform("judged", lambda state: state["labels"]))
    return judged.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        confidence.alias("score"),
    )
