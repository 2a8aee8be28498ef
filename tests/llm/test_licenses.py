import re

import pytest

from plumbline.llm import licenses

from .helpers import awkward, documents, empty

AUTOMATA = [licenses.Automaton(*x) for x in licenses.TEMPLATES]


def labels(text):
    _, places, spans = licenses.scan_text(text.encode(), AUTOMATA, licenses.BASE_PHRASES)
    return sorted({x[0] for x in spans}), sum(map(len, places.values()))


MIT = next(t for label, t in licenses.TEMPLATES if label == "mit")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Released under the MIT License.", ["mit"]),
        ("under the terms of the MIT license", ["mit"]),
        ("under some terms of the MIT license", []),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gpl-3"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
        ("Licensed under CC BY-SA 4.0.", ["cc-by-sa"]),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["isc"]),
        ("the license of the museum", []),
    ],
)
def test_templates(text, expected):
    assert labels(text)[0] == expected


def test_regions_are_optional_or_replaceable_and_the_rest_is_not():
    body = re.sub(r"<<[^>]*>>", "", MIT[MIT.index("permission is") :])
    for head in ("", "The MIT License ", "The MIT License Copyright (c) 2020 Some One "):
        assert "mit" in labels(head + body)[0]
    assert labels(body.replace("sublicense", "resell"))[0] == []
    one = licenses.Automaton("x", "<<opt>>start <<opt>>deep<<end>><<end>> alpha beta gamma <<var 2>> <<red|blue>> end")
    words = b"start deep alpha beta gamma q blue end".split()
    joined = b" " + b" ".join(words) + b" "
    assert list(one.matches(words, joined)) == [(0, 8)]
    assert not list(one.matches(*(w := b"alpha beta gamma q r s blue end".split(), b" " + b" ".join(w) + b" ")))
    with pytest.raises(ValueError):
        licenses.Automaton("x", "<<opt>>never closed")


def brute_base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_equals_brute_force(spark):
    texts = ["under the MIT license under the mit LICENSE", "Apache License, Version 2.0 cc-by-nc CC BY NC", "underÉ the mit license", "no words: \x7f\x80", None, "", "é under_the-mit/license é apache license version 2x"]
    docs = documents(spark, list(enumerate(texts)))
    for r in licenses.license_scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_awkward_tables(spark):
    assert licenses.license_scan(empty(spark)).count() == 0
    assert licenses.license_scan(awkward(spark)).count() == 10


def test_the_longest_accepted_template_stands():
    three = re.sub(r"<<opt>>(\d)<<end>>", r"\1", next(t for label, t in licenses.TEMPLATES if label == "bsd-3-clause")).replace("<<var 12>>", "the owner")
    assert labels(three)[0] == ["bsd-3-clause"]
    assert labels(three[: three.index(" 3 neither")])[0] == ["bsd-2-clause"]
    assert licenses.outermost([("a", 0, 9), ("b", 2, 5), ("c", 2, 9), ("d", 8, 12), ("e", 0, 9)]) == [("a", 0, 9), ("e", 0, 9), ("d", 8, 12)]


def brute_matches(template, words):
    """All places that a template accepts, by a regular expression over the words."""
    pattern, depth = "", 0
    for part in re.findall(r"<<[^>]*>>|[^\s<>]+", template):
        if part == "<<opt>>":
            pattern += "(?:"
        elif part == "<<end>>":
            pattern += ")?"
        elif part.startswith("<<var "):
            pattern += "(?:\\S+ ){0," + part[6:-2] + "}"
        elif part.startswith("<<"):
            pattern += "(?:" + part[2:-2] + ") "
        else:
            pattern += part + " "
    return bool(re.search("(?:^| )" + pattern, " ".join(words) + " "))


def test_automata_accept_like_regular_expressions():
    import random

    rng = random.Random(3)
    templates = ["a b <<opt>>c <<opt>>d<<end>><<end>> <<x|y>> a", "<<opt>>a<<end>> b c <<var 2>> d", "<<opt>><<x|y>><<end>> a a b <<opt>>c<<end>>"]
    for _ in range(3000):
        words = rng.choices("abcdxy", k=rng.randint(0, 9))
        for t in templates:
            one = licenses.Automaton("l", t)
            raw = [w.encode() for w in words]
            assert bool(list(one.matches(raw, b" " + b" ".join(raw) + b" "))) == brute_matches(t, words)


def test_time_is_linear_in_repeats():
    import time

    began = time.time()
    n, places, spans = licenses.scan_text(b"cc by nc " * 1_000_000, AUTOMATA, licenses.BASE_PHRASES)
    assert n == 3_000_000 and len(places["cc by nc"]) == 1_000_000 and not spans
    licenses.scan_text(b"permission is hereby granted free of charge " * 100_000, AUTOMATA, licenses.BASE_PHRASES)
    assert time.time() - began < 30
