import random
import re

from gleaner.llm.license_rules import SIGNATURES, rules
from gleaner.llm.licenses import BASE, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = WORD.findall((text or "").translate(LOW))
    places = [(i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, words string, n_words int")
    return {r.doc_id: r for r in scan_licenses(df).collect()}


def test_base_places_equal_brute_force(spark):
    rnd = random.Random(2)
    parts = ["MIT", "license", "License", "apache", "general", "public", "é", "İ", " ", "-", "\n", "_", "the ", "gnu ", "mit license", "x2"]
    texts = [None, "", "...", "mit license " * 3000, "MIT\x00License"] + ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randrange(25))) for _ in range(400)]
    rows = scan(spark, texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), repr(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_rules_and_suppression(spark):
    cases = {
        "Released under the GNU Lesser General Public License, version 2.1": "gpl,lgpl",
        "This is distributed under the terms of the Mozilla Public License v2.0.": "mpl",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd",
        "SPDX-License-Identifier: Apache-2.0": "apache",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa",
        "All rights reserved.": "proprietary",
        "a license to kill": "",
        "the Affero General Public License": "agpl,gpl",
    }
    rows = scan(spark, list(cases))
    assert [rows[i].labels for i in range(len(cases))] == list(cases.values())
    assert rows[0].n_detections == 1 and rows[2].score == 1.0 and rows[7].score == 0.0


def test_empty_table_and_ids(spark):
    assert scan(spark, []) == {}
    df = spark.createDataFrame([(None, "mit license"), (7, "mit license"), (7, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.labels, r.score) for r in scan_licenses(df).collect()) == [(-1, "mit", 0.6), (7, "", 0.0), (7, "mit", 0.6)]


def example(pattern, rnd):
    """A string that a pattern matches."""

    def of(parsed):
        out = []
        for op, arg in parsed:
            match str(op):
                case "LITERAL":
                    out.append(chr(arg))
                case "IN":
                    out.append(chr(rnd.choice([c for kind, v in arg for c in ([v] if str(kind) == "LITERAL" else range(v[0], v[1] + 1))])))
                case "BRANCH":
                    out.append(of(rnd.choice(arg[1])))
                case "SUBPATTERN":
                    out.append(of(arg[3]))
                case "MAX_REPEAT":
                    out += [of(arg[2]) for _ in range(rnd.randint(arg[0], min(int(arg[1]), arg[0] + 2)))]
                case other:
                    raise AssertionError(other)
        return "".join(out)

    return of(re._parser.parse(pattern))


COMPILED = [(label, tier, re.compile(f"(?<= )(?:{regex})(?= )")) for label, _, _, tier, regex in rules()]


def brute(text):
    """labels, score and number of detections by running every rule, without gates."""
    w = WORD.findall((text or "").translate(LOW))
    words = " " + "".join(f"{x} " for x in w)
    found = []
    for label, tier, regex in COMPILED:
        for m in regex.finditer(words):
            start = words[: m.start()].count(" ") - 1
            found.append((start, -(start + m.group().count(" ") + 1), tier, label))
    kept = []
    for d in sorted(found):
        if kept and d[0] < -kept[-1][1]:
            last = kept[-1]
            if (d[2], d[1] + d[0]) < (last[2], last[1] + last[0]):
                kept[-1] = d
        else:
            kept.append(d)
    labels = {d[3] for d in kept} | set(filter(None, base(text)[4].split(",")))
    best = min((d[2] for d in kept), default=99)
    return ",".join(sorted(labels)), round(1.1 - best * 0.1, 1) if best <= 5 else 0.6 if base(text)[1] else 0.0, len(kept)


def test_rules_are_many_and_each_holds_its_gate():
    rnd = random.Random(1)
    assert sum(map(len, SIGNATURES.values())) >= 300 and len({r for *_, r in rules()}) == len(rules())
    for _, word, needs, _, regex in rules():
        for _ in range(20):
            words = example(regex, rnd).split(" ")
            assert word in words and all(set(c) & set(words) for c in needs), regex


def test_gating_changes_nothing(spark):
    rnd = random.Random(4)
    texts = [f"{x.upper() if rnd.random() < 0.2 else x}, {y}." for *_, r in COMPILED_SOURCES for x, y in [(example(r, rnd), "end of the license")]]
    texts += [" ".join(rnd.choice(["the", "under", "license", "licensed under the", example(rnd.choice(COMPILED_SOURCES)[-1], rnd)]) for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    texts += ["GNU LGPLv3 license", "licensed under the Q Public License version 1.0", "License: GPLv3", "released under the LGPLv2.1", "the gplv4 and mit9 words", "\u212ait \u0130sc mit l\u0130cense", "MIT-\u212a license", "mit license " * 2000]
    rows = scan(spark, texts)
    wrong = [(t[:200], (rows[i].labels, rows[i].score, rows[i].n_detections), brute(t)) for i, t in enumerate(texts) if (rows[i].labels, rows[i].score, rows[i].n_detections) != brute(t)]
    assert wrong == []


COMPILED_SOURCES = rules()
