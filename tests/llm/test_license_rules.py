"""Rules of the license scan with no keyword gate, on texts drawn from the patterns themselves."""

import random
import re
from re import _constants as c
from re import _parser

from arborline.llm import licenses


def _drawn(parsed, r):
    """A text that a pattern matches, its choices drawn at random."""
    out = ""
    for op, value in parsed:
        if op is c.LITERAL:
            out += chr(value)
        elif op is c.IN:
            kind, x = value[0]
            out += r.choice("0123456789") if kind is c.CATEGORY and x is c.CATEGORY_DIGIT else "a" if kind in (c.CATEGORY, c.NEGATE) else chr(r.choice(value)[1])
        elif op is c.BRANCH:
            out += _drawn(r.choice(value[1]), r)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            out += "".join(_drawn(value[2], r) for _ in range(r.randint(value[0], min(value[1], value[0] + 3))))
        elif op is c.SUBPATTERN:
            out += _drawn(value[3], r)
        else:
            assert op in (c.ASSERT, c.AT), op
    return out


def _labels(text):
    """Labels and score by all rules, run whether or not their keyword occurs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    canon = f" {' '.join(words)} "
    base = [label for phrase, label in licenses.BASE.items() if f" {phrase} " in canon]
    found = []
    for nth, (label, _, priority, pattern) in enumerate(licenses.rules()):
        for m in re.finditer(pattern, canon):
            first = canon[: m.start()].count(" ")
            found.append((first, first + m[0].count(" "), priority, -nth, label))
    beaten = lambda d: any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[:2] != d[:2] or e[2:4] > d[2:4]) for e in found)
    kept = [d for d in found if not beaten(d)]
    return ",".join(sorted({*base, *(d[4] for d in kept)})), max([d[2] for d in kept] + [2 * bool(base)]) / 5


def _report(spark, texts):
    rows = licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["labels"], r["score"]) for r in rows}


def test_gate_passes_whatever_a_rule_matches():
    r = random.Random(1)
    for label, word, _, pattern in licenses.rules():
        for _ in range(60):
            text = f" {_drawn(_parser.parse(pattern), r)} "
            assert re.search(pattern, text) and licenses.sign(word) in text, (label, text)
            assert re.search(licenses.GATE, text), (label, text)


def test_names_without_their_keyword(spark):
    r = random.Random(2)
    texts = ["licensed under the FreeBSD license", "released under the Berkeley Software Distribution license", "licensed under the GPL2 license", "licensed under GPL3", "LGPL3 license", "AGPL3 license", "license Apache2", "GNU Library General Public license"]
    texts += [_drawn(_parser.parse(x[3]), r) for x in licenses.rules()[::6]]
    got = _report(spark, texts)
    assert [got[i][0] for i in (0, 2, 3)] == ["bsd-2-clause", "gpl-2.0", "gpl-3.0"]
    assert got == {i: _labels(t) for i, t in enumerate(texts)}


def test_permission_grant_as_it_is_written(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    notice = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies"
    texts = [grant, grant.replace("person", "person or organization"), grant + notice, "Permission is hereby granted free of charge provided that the copyright stays"]
    got = _report(spark, texts)
    assert got == dict.fromkeys(range(4), ("permission-notice", 0.8)) == {i: _labels(t) for i, t in enumerate(texts)}


def _most_words(parsed):
    """The most words that a pattern can match, less one: its spaces."""
    out = 0
    for op, value in parsed:
        if op is c.LITERAL:
            out += value == 32
        elif op is c.BRANCH:
            out += max(_most_words(x) for x in value[1])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            out += int(value[1]) * _most_words(value[2]) if _most_words(value[2]) else 0
        elif op is c.SUBPATTERN:
            out += _most_words(value[3])
    return out


def test_no_match_exceeds_the_context():
    assert max(_most_words(_parser.parse(x[3])) for x in licenses.rules()) + 1 <= licenses.CONTEXT


def test_chunks_find_what_the_whole_text_holds(spark):
    r = random.Random(3)
    texts = []
    for _ in range(6):
        parts = []
        for x in r.sample(licenses.rules(), 60):
            parts += [f"word{r.randrange(99)}" for _ in range(r.randrange(40))] + [_drawn(_parser.parse(x[3]), r)]
        texts.append(" ".join(parts))
    assert _report(spark, texts) == {i: _labels(t) for i, t in enumerate(texts)}
