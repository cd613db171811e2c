"""Licence scans and fill-in-the-middle against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from terrane.llm import infill, licenses

SCHEMA = "doc_id long, text string, form string, id string, row int, Output string"
RNG = random.Random(11)
LONG = " ".join(RNG.choice(["alpha", "béta", "the", "mit"]) for _ in range(120_000)) + " Released under the MIT License."
TEXTS = [
    None, "", " ", "\t\n  ", "one", "  lead and trail \n", "no break   wide\x1c\x85 spaces", "a <P> b", "x<S>y", "<M>", "<<P", "a\U0001f600b \U00010000 c", "\x0b\x0cw\rv",
    "Released under the MIT License. under THE mit-license", "Licensed under the Apache License, Version 2.0.", "cc by nc cc by nc sa CC-BY-NC-4.0", "apache license version 20",
    "GNU General Public License, version 3.", "İ under the mit license ß", "Under the KKMIT license under the mit license",
    "x\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\n", "// SPDX-License-Identifier: Apache-2.0.\nlicense: \"MIT\"", "license = foo and bar", "Licence: see the file", "SPDX-License-Identifier:",
    LONG, LONG + "x",
]
ROWS = [(i, t, "f", "i", 1, "o") for i, t in enumerate(TEXTS)] + [(None, "one two three", None, None, None, None), (-7, "a b c d e f g", None, None, None, None)] + [(4, "one", "f", "i", 1, "o")] * 2
ROWS += [(100 + i, " ".join(RNG.choice(["w", "ww", "一", "x \n"]) for _ in range(i)), "f", "i", 1, "o") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut(doc_id, text):
    """The arrangement of one text, step by step."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    key = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(docs, none):
    made = [tuple(r) for r in infill.arranged(docs).collect()]
    assert sorted(made, key=str) == sorted(((r[0], *cut(r[0], r[1])) for r in ROWS), key=str)
    digests = sorted(((r[0], *cut(*r[:2])[:4], sha(cut(*r[:2])[4]), sha(r[1] or "")) for r in ROWS), key=str)
    assert sorted((tuple(r) for r in infill.infill_table(docs).collect()), key=str) == digests
    assert {r[2] for r in made} == {"plain", "spm", "psm"} and infill.infill_table(none).count() == 0


def test_fill_in_middle_keeps_the_other_columns(docs, none):
    with pytest.raises(ValueError):
        infill.transform(docs)
    got = infill.transform(docs, form_column="made", rate=100, spm=30, sentinels=("<|pre|>", "<|suf|>", "<|mid|>"))
    assert got.columns == [*docs.columns, "made"] and infill.transform(none, "made").count() == 0
    back = got.withColumn("text", infill.restored(F.col("text"), F.col("made"), ("<|pre|>", "<|suf|>", "<|mid|>"))).drop("made")
    want = sorted(((r[0], r[1] or "", *r[2:]) for r in ROWS), key=str)
    assert sorted((tuple(r) for r in back.collect()), key=str) == want
    for bad in (("", "a", "b"), ("ab", "b", "c"), ("xa", "ay", "z"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            infill.arranged(docs, sentinels=bad)


def test_infill_plan_has_no_python(docs):
    plan = infill.infill_table(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("regexp_extract_all") == 1


def brute(text):
    """Base places by comparing the words at every place."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_against_brute_force(docs, none):
    rows = licenses.license_table(docs).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in ROWS), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert licenses.license_table(none).count() == 0
    by = {r.doc_id: (r.labels, r.score) for r in rows}
    at = lambda start: by[next(i for i, t in enumerate(TEXTS) if t and t.startswith(start))]
    assert at("GNU") == ("gpl-3", 0.8) and at("Licensed") == ("apache-2", 0.2) and at("cc by nc cc") == ("cc-by-nc,cc-by-nc-sa", 1.0)
    assert at("x\nSPDX") == ("bsd-3-clause,gpl-2,mit", 0.2) and at("// SPDX") == ("apache-2,mit", 0.2)
    assert at("license = foo") == at("Licence: see") == at("SPDX-License-Identifier:") == ("", 0.0) and at("apache license version 20") == ("apache", 0.2)


def test_places_and_spans_of_notices():
    machine = licenses.automaton(tuple(licenses.BASE.items()), tuple(licenses.NOTICES.items()))
    n, places, _ = licenses.scan_text("all rights reserved. Redistribution and use in source and binary forms; GNU general public license version 2", machine)
    assert n == 17 and [(p.word, p.words, p.label) for p in places] == [(0, 3, "all-rights-reserved"), (3, 8, "bsd"), (11, 6, "gpl-2")]
    _, places, found = licenses.scan_text("MIT License\nSPDX-License-Identifier: mit OR apache-2.0", machine)
    assert [p.label for p in places] == ["mit"] and [(e.word, e.rpn, e.labels) for e in found] == [(2, ["mit", "apache-2.0", "or"], ["mit", "apache-2"])]
    _, _, found = licenses.scan_text('"license": "MIT", license: gpl-3.0+ and\nSPDX-License-Identifier: Acme-1', machine)
    assert [(e.labels, e.level) for e in found] == [(["mit"], 0.2), (["gpl-3"], 0.8), (["acme-1"], licenses.UNKNOWN)]


def written(depth):
    """A random expression as tokens and as a nested tuple."""
    kind = RNG.random()
    if depth == 0 or kind < 0.3:
        name = RNG.choice(["mit", "gpl-2.0", "agpl-3.0", "mpl-2.0", "cc-by-nc-4.0"])
        return ([name, "with", "some-exception"], ("with", name)) if kind < 0.1 else ([name], name)
    op = "or" if kind < 0.65 else "and"
    (a, x), (b, y) = written(depth - 1), written(depth - 1)
    return ["(", *a, ")", op, "(", *b, ")"], (op, x, y)


def value(tree):
    if isinstance(tree, str):
        return licenses.level_of(tree)
    if tree[0] == "with":
        return min(value(tree[1]), licenses.EXCEPTED)
    return (min if tree[0] == "or" else max)(value(tree[1]), value(tree[2]))


def test_expressions_against_their_trees():
    for _ in range(300):
        tokens, tree = written(4)
        assert licenses.evaluate(licenses.parse(tokens))[0] == value(tree)


def test_precedence_and_broken_expressions():
    say = lambda text: " ".join(licenses.parse(text.split()))
    assert say("mit or gpl-2.0 and bsd") == "mit gpl-2.0 bsd and or" and say("mit and gpl-2.0 or bsd") == "mit gpl-2.0 and bsd or"
    assert say("gpl-2.0 with x-1 and mit") == "gpl-2.0 x-1 with mit and" and say("( mit or isc ) and bsd") == "mit isc or bsd and"
    assert say("mit and") == say("( mit") == say("mit and (") == say("mit )") == say("mit bsd") == say("mit or ( (") == "mit"
    assert say("( mit or isc") == "mit isc or" and say("bsd and ( mit or isc") == "bsd mit isc or and" and say("( mit or isc ) with x-1") == "mit isc or"
    assert say("") == say("and mit") == say("( )") == say(") mit") == say("or") == "" and say("mit and it is") == "mit"


def test_a_worker_keeps_one_thing_at_a_time():
    from terrane.llm import common

    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [common.kept(k, make(k)) for k in "aabb"] == list("aabb") and made == ["a", "b"]
    common.release()
    assert common.kept("b", make("b")) == "b" and made == ["a", "b", "b"]
    common.release()
