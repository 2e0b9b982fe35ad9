"""Licence scans: every paragraph against brute force by the classifier's own weights, and texts that it wasn't fitted on."""

import pytest

from skyledger.llm import licences as L


def _paragraphs(text):
    """(first line, last line, words) of each paragraph, by the rule as it is worded."""
    lines, blocks = text.replace("\r\n", "\n").split("\n"), []
    for k, line in enumerate(lines):
        if line.strip(" \t\f\r"):
            if blocks and blocks[-1][-1] == k - 1:
                blocks[-1].append(k)
            else:
                blocks.append([k])
    out = []
    for b in blocks:
        wide = max(len(lines[k]) for k in b) > L.WRAP
        out += [(k, k, L.words(lines[k])) for k in b] if wide else [(b[0], b[-1], L.words(" ".join(lines[k] for k in b)))]
    return out


def _scan(text):
    found = []
    for n, (first, last, ws) in enumerate(_paragraphs(text)):
        p = L.classifier().probabilities(" ".join(ws))
        if p[L.NONE] > 0.5:
            continue
        probability, predicted = max((v, c) for c, v in p.items() if c != L.NONE)
        similarity = max((L.similarity(ws, t) for t in L.templates().get(predicted, [])), default=0.0)
        found.append((n, first, last, predicted if similarity >= L.ALIKE else "unknown", predicted, round(probability, 5), round(similarity, 5)))
    return found


#: What a classifier of licences should know without having been fitted on it.
MIT = """Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
NOTICES = [
    ("Released under the MIT License.", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("All rights reserved.", "proprietary"),
    ("Distributed under the GNU/GPL v3.", "gpl"),
    ("Released under GPLv3.", "gpl"),
    ("Code: BSD 3-Clause", "bsd"),
    ("Released under Apache 2.0", "apache-2.0"),
    ("The parser in this folder is MPL 2.0.", "mpl-2.0"),
    ("Released under the Eclipse Public License - v 2.0", "epl-2.0"),
    ("Available under the ISC licence", "isc"),
    ("Licensed under the Foobar Research License", "unknown"),
    ("This module may be used under the Eiffel Forum License, version 2.", "unknown"),
]
CLEAN = [
    "The MIT license plate reader failed",
    "Licence plate",
    "His licence plate was dirty.",
    "Das Kind kam mit der Mutter.",
    "Mit.",
    "the of and",
    "He put the work under the table, or so the source said.",
    "The Apache pilots landed in the dark.",
    "Copyright reform was discussed in parliament.",
    "Her pilot license had expired.",
]


def test_texts_that_the_fit_has_not_seen():
    fitted = {" ".join(L.words(t)) for t, _, _ in L.examples()}
    for text, licence in NOTICES:
        assert licence == "proprietary" or " ".join(L.words(text)) not in fitted
        assert [f[3] for f in _scan(text)] == [licence], text
    for text in CLEAN:
        assert not _scan(text), text
    assert [(f[0], f[1], f[2], f[3]) for f in _scan(MIT)] == [(1, 2, 7, "mit"), (2, 9, 10, "mit")]
    assert [f[3] for f in _scan(ZLIB)] == ["zlib"] and [f[3] for f in _scan(ISC)] == ["isc"] and [f[3] for f in _scan(BSD)] == ["bsd"]


def test_every_paragraph_is_scored(spark):
    prose = ["some prose here that goes on and on for more than a hundred characters, so that its lines are paragraphs of their own", "and more of it"]
    parts = [" ".join(t.split()[k : k + 6]) for ts in L.TEXTS.values() for t in ts for k in range(0, 60, 6) if t.split()[k : k + 6]]
    texts = [MIT, MIT.replace("\n", "\r\n"), f"{MIT}\n \t\n\n{ZLIB}\n", "\n\n" + ISC + "\n\n" + BSD, "\n".join([prose[0], *(t for t, _ in NOTICES), *CLEAN]), *(f"{prose[1]}\n{t}" for t, _ in NOTICES), *CLEAN]
    texts += ["\n\n".join(parts), "\n".join([prose[0], *parts]), "a-" * 100_000 + "a", "", "\n", " ", "x" * 300_000, "license " * 3000]
    rows = [(k, t, 0, "b") for k, t in enumerate(texts)] + [(None, NOTICES[0][0], 0, ""), (None, None, None, None), (3, texts[3], 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, body string").repartition(3)
    got = sorted((repr((r.doc_id, r.paragraph, r.first_line, r.last_line, r.licence, r.predicted, round(r.probability, 5), round(r.similarity, 5))) for r in L.scan(df).collect()))
    want = sorted(repr((r[0], *f)) for r in rows for f in _scan(r[1] or ""))
    near = lambda x: [eval(r, {"None": None}) for r in x]  # noqa: E731, S307
    assert [r[:6] for r in near(got)] == [r[:6] for r in near(want)]
    assert all(a[6:] == pytest.approx(b[6:], abs=2e-5) for a, b in zip(near(got), near(want), strict=True))
    assert L.scan(df.limit(0)).count() == 0


def test_only_the_plan_of_the_jvm(spark):
    """One reader of the corpus, and no Python on the way."""
    df = spark.createDataFrame([(1, NOTICES[0][0])], "doc_id long, text string")
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_paragraphs_without_a_telling_word_are_no_licences():
    import itertools
    import math
    import random

    m, draw = L.classifier(), random.Random(3)
    telling = set(m.telling())
    none, t = m.classes.index(L.NONE), m.temperature
    idle = [w for g, w in m.weights.items() if not telling & set(g.split())]
    most = [(b - m.bias[none]) / t + sum(max(0.0, w[j] - w[none]) / t for w in idle) for j, b in enumerate(m.bias) if j != none]
    assert sum(map(math.exp, most)) < 1
    ordinary = sorted({w for g in m.weights for w in g.split()} - telling)
    for _ in range(300):
        text = " ".join(itertools.chain(draw.choices(ordinary, k=draw.randrange(1, 200))))
        assert m.probabilities(text)[L.NONE] > 0.5
