"""Licence scans by a trained paragraph classifier. DataFrame functions only where the corpus passes.

A sparse logistic regression over word 1- to 3-grams with one class for each licence family, one for licence language of
no such family (``unknown``) and one for everything else is fitted on the driver, on the fixed texts below and variants of
them. Its scores are calibrated by a temperature found on texts that the fit hasn't seen. A family that is
predicted has to be confirmed by comparison with that family's templates, the share of 3-word shingles in common; without
that the paragraph is ``unknown``.

Paragraphs are blocks between blank lines, their lines joined, so hard-wrapped texts are seen whole. A block that has a
line of over WRAP characters isn't wrapped: there each line is a paragraph.

The corpus is read once. A text is looked at further if it holds a word without which no paragraph can reach probability
one half of being a licence, whatever else stands in it; these words follow from the weights, so nothing is lost. Weights
and templates are tables of a few thousand rows, fixed by the texts below and not by the corpus, so they are broadcast.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import whole_text, written

#: Paragraphs of public licences.
TEXTS = {
    "apache-2.0": [
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES',
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 Definitions Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "cc-by": [
        "This is an open access article distributed under the terms of the Creative Commons Attribution License (CC BY), which permits unrestricted use, distribution, and reproduction in any medium, provided the original author and source are credited.",
        "The images and other third party material are included in the article's Creative Commons Attribution 4.0 International License, unless indicated otherwise in a credit line.",
    ],
    "cc-by-sa": [
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "You may share and adapt the material under the Creative Commons Attribution-ShareAlike 4.0 International License if you distribute your contributions under the same license as the original.",
    ],
    "cc-by-nc": [
        "You may copy and redistribute the material under the Creative Commons Attribution-NonCommercial 4.0 International License, but not for commercial purposes.",
        "This book is shared under a Creative Commons Attribution-NonCommercial-NoDerivatives license and may not be sold or changed.",
    ],
    "public-domain": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "The author or authors dedicate any and all copyright interest in the software to the public domain.",
    ],
    "proprietary": [
        "Copyright 2019 the publisher, all rights reserved worldwide.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher; all rights are reserved by the owner.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited. All rights reserved by the company.",
        "The contents of this site are protected by copyright. All rights reserved, including the right of reproduction in whole or in part.",
    ],
}
#: Names of the families, and of licences that are none of them.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache 2.0", "Apache Software License", "Apache-2.0"],
    "mit": ["MIT License", "MIT licence", "MIT", "MIT/X11 license", "Expat License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "New BSD License", "modified BSD license", "BSD-3-Clause", "BSD"],
    "isc": ["ISC License", "ISC"],
    "zlib": ["zlib License", "zlib/libpng License", "Zlib"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 2", "GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL", "GNU GPL, version 2 or later", "GNU/GPL v3", "GPL", "GPLv2", "GPLv3", "GPL-3.0-or-later", "GPL-2.0-only"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL", "LGPLv3", "LGPL-2.1-or-later"],
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0-only"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0"],
    "epl-2.0": ["Eclipse Public License", "Eclipse Public License - v 2.0", "Eclipse Public License, version 2.0", "EPL 2.0", "EPL-2.0"],
    "boost": ["Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "Creative Commons Attribution 3.0 Unported", "CC BY 4.0", "CC BY", "CC-BY-3.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA", "CC-BY-SA-3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC BY-NC", "CC BY-NC-ND 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-3.0"],
    "public-domain": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "Unlicense", "Creative Commons Zero", "CC0-1.0"],
    "unknown": ["Artistic License 2.0", "CeCILL license", "SIL Open Font License", "Microsoft Public License", "European Union Public Licence", "Open Database License", "Sleepycat License", "PostgreSQL License", "Python Software Foundation License", "Server Side Public License", "Business Source License", "Academic Free License", "Common Development and Distribution License", "Open Software License", "Example Community License", "W3C Software Notice and License", "terms of the accompanying agreement", "Foo Public License, version 1.2", "NASA Open Source Agreement"],
}
#: What names stand in. What the tables of the check hold ("Released under the ...", "Licensed under ...", "This work is licensed under ...") isn't among them.
FRAMES = [
    "{}",
    "License: {}",
    "under the {}",
    "Distributed under the terms of the {}.",
    "This project is available under the {}; see the LICENSE file.",
    "The code is covered by the {}.",
    "SPDX-License-Identifier: {}",
    "You may use these files under {} only.",
    "All files here are published under {}",
    "It is made available to you under the {}, without charge.",
]
#: Licence language of no family.
UNKNOWN = [
    "You may use this product only in accordance with the license agreement that came with it.",
    "By installing the software you accept the terms of this license agreement.",
    "The data are licensed for use by subscribers under separate terms.",
    "See the file COPYING for the licensing terms of this package.",
    "This package is free software and may be distributed under the same terms as the interpreter itself.",
    "Use, duplication and disclosure are subject to the restrictions of the vendor's standard license.",
    "The font is licensed to you, not sold, for use on one device.",
    "Permission is given to copy this page for classroom use if this notice stays on it.",
]
#: Sentences that hold words of licences and grant nothing.
OTHERS = [
    "She renewed her driving licence at the office last week.",
    "The restaurant lost its liquor license after the inspection.",
    "He asked for permission to leave the room.",
    "The pilot holds a commercial license and flies on weekends.",
    "Copyright law is taught in the second year of the course.",
    "The washing machine came with a two year warranty.",
    "Apache helicopters flew over the valley during the exercise.",
    "The Apache lived in the mountains of the southwest for centuries.",
    "The gnu is a large antelope of the open plains.",
    "A herd of gnu crossed the river under the eyes of crocodiles.",
    "They discussed the licensing of broadcast rights for the games.",
    "Permission was denied by the server, so the file was not written.",
    "The museum put the painting into the public domain section of its guide.",
    "A fishing licence is required to fish in the lake.",
    "Redistribution of income was the theme of the debate.",
    "The licensed plumber fixed the pipe under the sink.",
    "Which license should I choose for my project?",
    "The court ruled on copyright in software and on open source licenses in general.",
    "The license plate of the car was bent in the accident.",
    "Cameras read the license plates of the cars that pass.",
    "A new license plate recognition system was installed at the gate.",
    "Students at MIT built a robot that folds paper.",
    "MIT is a university in Massachusetts.",
    "The MIT team won the race with a solar car.",
    "Mozilla and the Eclipse foundation were at the conference.",
    "The total eclipse was seen by the public from the coast.",
    "All seats are reserved, and all rights of way are marked on the map.",
    "The table was reserved for eight, and all were on time.",
    "Free of charge, the guide shows any person the old town.",
    "The commons are open to the public, and creative people meet there.",
    "The boost in sales came from the new version of the software.",
    "The driver had no valid licence and was fined by the court.",
    "Her license to practise medicine was suspended by the board.",
    "A marriage license costs thirty dollars in the county.",
    "The hunting license expires at the end of the season.",
    "The software was written by the authors in two years and sold to a bank.",
    "The notice on the door said that the shop was closed.",
    "In version 2 of the program the file format was changed.",
    "The general told the public that the war would be over soon.",
    "Rights and duties of tenants are listed in the lease.",
    "The warranty covers any kind of damage except that caused by water.",
    "He has a poetic license to say so.",
    "The work was done under the direction of the foundation.",
    "They were granted a license to sell beer at the festival.",
]
#: Ordinary prose, so that the fit sees what common words such as "the" or the German "mit" mean there.
PROSE = [
    "The children walked to the river in the morning, and it was as cold as it had been on the day of the first snow.",
    "This is the house that he built for his brother, at the end of a road which no one used.",
    "An answer to the question is given by the teacher, or it can be read from the notes on this page.",
    "They are to be found in all parts of the country, with the most of them near the coast.",
    "You can see it from here, but not without a good map and some time to look for it.",
    "Any of these is as good as another, and in no way better than what we had before.",
    "Sie fuhr mit dem Zug nach Berlin und kam mit einem Koffer zurück.",
    "Er sprach mit der Nachbarin über das Wetter, und die Kinder spielten im Garten.",
    "Die Suppe wird mit Salz und Pfeffer gewürzt und ist in einer Stunde fertig.",
    "Mit den Jahren wurde das Haus zu klein für die Familie.",
    "Komm doch mit.",
    "Le train est parti de la gare avec une heure de retard, et il n'y avait pas de place pour tous.",
    "Les enfants jouent dans le jardin, et la porte est ouverte sur la rue.",
    "La casa está en el centro de la ciudad, con una puerta que da a la plaza por la que pasan los coches.",
    "El libro que compró para su hermana es de un autor que no conocía.",
    "See the photo of the lake below, and the list of works at the end.",
    "It is used for many purposes, and its use is subject to the weather.",
    "For more details ask at the desk; the files are kept in the other room.",
]
#: Common words. An n-gram of these and of words of PROSE alone is no feature.
ORDINARY = frozenset(
    "a about above after again against all also an and another any are as at be because been before being below between both but by came can come could day did do does down each end even every few first for from "
    "get give go good great had has have he her here him his home how i if in into is it its just know last less like line list little long look made make man many may me more most much must my never new next no not now "
    "of off old on once one only or other our out over own page part people place put read right said same see set she should side so some still such take than that the their them then there these they thing this those "
    "through time to too two under until up upon use used very want was way we well were what when where which while who why will with without word words work works world would year you your file files name names page "
    "source table text number data book books water three four five form open free large small high low left each end day side part kind law order state general public".split()
)
#: What follows a name that isn't a licence's there.
PLATES = ["The {} plate was bent in the crash.", "A {} plate costs ten dollars.", "The {} exam was hard.", "Every {} holder has to pay a fee."]
GRAMS, ALIKE, WRAP = 3, 0.8, 100
NONE, UNKNOWN_CLASS = "none", "unknown"
_BREAK = r"[^\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def grams(ws: list[str], sizes=range(1, GRAMS + 1)) -> set[str]:
    return {" ".join(ws[k : k + n]) for n in sizes for k in range(len(ws) - n + 1)}


def examples() -> list[tuple[str, str, int]]:
    """(text, class, source): what the classifier is fitted on. Variants of one text share their source."""
    base = [(t, f) for f, ts in TEXTS.items() for t in ts] + [(t, UNKNOWN_CLASS) for t in UNKNOWN]
    base += [(frame.format(n), f) for f, ns in NAMES.items() for k, n in enumerate(ns) for j, frame in enumerate(FRAMES) if j == 0 or (j + k) % 3 == 0 or k < 2]
    out = []
    for k, (t, f) in enumerate(base):
        ws = t.split()
        around = PROSE[k % len(PROSE)], PROSE[(k * 7 + 3) % len(PROSE)]
        out += [(t, f, k), (f"{around[0]} {t}" if k % 2 else f"{t} {around[1]}", f, k)]
        if len(ws) > 14:
            out += [(" ".join(ws[: len(ws) * 2 // 3]), f, k), (" ".join(ws[len(ws) // 3 :]), f, k), (f"{around[0]} {t} {around[1]}", f, k)]
    plates = [frame.format(n) for f, ns in NAMES.items() for n in ns if re.search(r"licen[cs]e$", n, re.I) for frame in PLATES]
    for k, t in enumerate(OTHERS + PROSE + plates[::3], len(base)):
        ws = t.split()
        out += [(t, NONE, k), (f"{t} {PROSE[k % len(PROSE)]}", NONE, k), (" ".join(ws[: len(ws) // 2 + 1]), NONE, k), (" ".join(ws[len(ws) // 2 :]), NONE, k)]
    return out


class Classifier:
    """weights: n-gram -> one weight for each class; a class's score is its bias and the weights of the n-grams present, over the temperature."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float], temperature: float):
        self.classes, self.weights, self.bias, self.temperature = classes, weights, bias, temperature

    def probabilities(self, text: str) -> dict[str, float]:
        z = list(self.bias)
        for g in grams(words(text)):
            for j, w in enumerate(self.weights.get(g, ())):
                z[j] += w
        top = max(z)
        e = [math.exp((x - top) / self.temperature) for x in z]
        return {c: x / sum(e) for c, x in zip(self.classes, e, strict=True)}

    def telling(self) -> list[str]:
        """Words of which a paragraph has to hold one to reach probability one half of being a licence of any kind.

        The others are found from the weakest on: a word joins them as long as the sum of exp(score - score of NONE) over
        all other classes stays under 1, where each score is taken with every n-gram of these words that speaks for it.
        """
        none, t = self.classes.index(NONE), self.temperature
        gain = {g: [max(0.0, x - w[none]) / t for j, x in enumerate(w) if j != none] for g, w in self.weights.items()}
        by_word: dict[str, list[str]] = {}
        for g in gain:
            for w in set(g.split()):
                by_word.setdefault(w, []).append(g)
        score = [(b - self.bias[none]) / t for j, b in enumerate(self.bias) if j != none]
        idle: set[str] = set()
        for w in sorted(by_word, key=lambda w: (max(gain.get(w, [0.0])), sum(max(gain[g]) for g in by_word[w]), w)):
            tried = list(score)
            for g in by_word[w]:
                if set(g.split()) <= idle | {w}:
                    tried = [a + b for a, b in zip(tried, gain[g], strict=True)]
            if sum(map(math.exp, tried)) < 0.99:
                idle.add(w)
                score = tried
        return sorted(by_word.keys() - idle)


@lru_cache(maxsize=1)
def classifier(rounds: int = 100, strength: float = 4e-4) -> Classifier:
    """The classifier of this module's texts: proximal gradient steps with momentum, an L1 penalty that leaves few weights."""
    import numpy as np

    rows = examples()
    classes = [*TEXTS, UNKNOWN_CLASS, NONE]
    held = [grams(words(t)) for t, _, _ in rows]
    seen: dict[str, set[int]] = {}
    for gs, (_, _, source) in zip(held, rows, strict=True):
        for g in gs:
            seen.setdefault(g, set()).add(source)
    common = ORDINARY | {w for t in PROSE for w in words(t)}
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, s in seen.items() if (len(s) > 1 or len(g.split()) < 3) and not common.issuperset(g.split())))}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for r, gs in enumerate(held):
        x[r, [vocabulary[g] for g in gs if g in vocabulary]] = 1.0
    y = np.zeros((len(rows), len(classes)), np.float32)
    y[np.arange(len(rows)), [classes.index(c) for _, c, _ in rows]] = 1.0
    share = y.sum(axis=0)
    weight = (y @ (1 / np.sqrt(share))).astype(np.float32)
    weight /= weight.sum()

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(use):
        a, b, m = x[use], y[use], weight[use, None] / weight[use].sum()
        step = 2.0 / (m[:, 0] @ (a**2).sum(axis=1))
        w = v = np.zeros((x.shape[1], len(classes)), np.float32)
        c = d = np.zeros(len(classes), np.float32)
        for k in range(rounds):
            g = m * (softmax(a @ v + d) - b)
            new = v - step * 10 * (a.T @ g)
            new = np.sign(new) * np.maximum(np.abs(new) - step * 10 * strength, 0)
            newer = d - step * 10 * g.sum(axis=0)
            pace = k / (k + 3)
            v, d = new + pace * (new - w), newer + pace * (newer - c)
            w, c = new, newer
        return w, c

    fold = np.array([source % 2 for _, _, source in rows])
    z = np.zeros(y.shape, np.float32)
    for f in range(2):  # scores of each half by the fit on the other
        w, c = fit(fold != f)
        z[fold == f] = x[fold == f] @ w + c
    loss = {t: -float((weight * np.log(softmax(z / t)[y == 1] + 1e-9)).sum()) for t in (0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.3, 1.6, 2.0)}
    w, c = fit(np.ones(len(rows), bool))
    weights = {g: [round(float(v), 4) + 0.0 for v in w[k]] for g, k in vocabulary.items() if np.abs(w[k]).max() >= 5e-4}
    return Classifier(classes, weights, [round(float(v), 4) for v in c], min(loss, key=loss.get))


def templates() -> dict[str, list[list[str]]]:
    """Word lists that paragraphs of a family are compared with: its texts, its names, and its names behind "under" and "under the"."""
    found = {f: [words(t) for t in ts] for f, ts in TEXTS.items()}
    for f, ns in NAMES.items():
        if f != UNKNOWN_CLASS:
            found[f] += [words(a + n) for n in ns for a in ("", "under ", "under the ")]
    found["proprietary"].append(words("all rights reserved"))
    return found


def shingles(ws: list[str]) -> set[str]:
    """3-word shingles; of fewer words, all of them as one."""
    return grams(ws, range(GRAMS, GRAMS + 1)) or ({" ".join(ws)} if ws else set())


def similarity(ws: list[str], template: list[str]) -> float:
    """The share of shingles, of the shorter of the two, that a paragraph has in common with a template; a template of two words may stand anywhere in it."""
    held = shingles(ws) | (grams(ws, range(2, 3)) if len(template) == 2 else set())
    return len(held & shingles(template)) / min(len(shingles(ws)), len(shingles(template)))


def _words(c: Column | str) -> Column:
    return F.split(F.lower(c), _BREAK)


def _grams(ws: Column, n: int) -> Column:
    last = F.size(ws) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.array_join(F.slice(ws, k + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def _holds(ws: Column, some: list[str]) -> Column:
    return F.arrays_overlap(ws, F.array(*map(F.lit, some))) if some else F.lit(False)


def paragraphs(rows: DataFrame, text: str = "text") -> DataFrame:
    """row, doc_id, paragraph (from 0 in each row), first_line, last_line (from 0), body: the paragraphs of rows (row, doc_id, text), row being unique."""
    lines = rows.select("row", "doc_id", F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "body"))
    lines = lines.withColumn("blank", F.trim(F.translate("body", "\t\f\r", "   ")) == "")
    lines = lines.withColumn("block", F.sum(F.col("blank").cast("int")).over(Window.partitionBy("row").orderBy("line"))).filter("NOT blank")
    lines = lines.withColumn("wide", F.max(F.length("body")).over(Window.partitionBy("row", "block")) > WRAP)
    lines = lines.withColumn("start", F.when(F.col("wide"), F.col("line")).otherwise(F.min("line").over(Window.partitionBy("row", "block"))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), " ")
    found = lines.groupBy("row", "start").agg(F.first("doc_id").alias("doc_id"), F.max("line").alias("last_line"), whole.alias("body"))
    found = found.withColumn("paragraph", F.row_number().over(Window.partitionBy("row").orderBy("start")) - 1)
    return found.select("row", "doc_id", "paragraph", F.col("start").alias("first_line"), "last_line", "body")


def _fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as a literal of the plan."""
    fields = [x.strip().partition(" ")[0] for x in re.split(r",\s*(?![^<]*>)", schema)]
    text = json.dumps([dict(zip(fields, r, strict=True)) for r in rows])
    kinds = ", ".join(x.strip().replace(" ", ": ", 1) for x in re.split(r",\s*(?![^<]*>)", schema))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>")))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE) -> DataFrame:
    """One row per paragraph that is a licence with probability one half or more: doc_id, paragraph, first_line, last_line, licence, predicted, probability, similarity.

    predicted is the likeliest class but for NONE, with its probability (among all classes); similarity is the largest share
    of shingles (of the shorter of the two) that the paragraph has in common with a template of that family. licence is that
    family if similarity >= alike, else ``unknown``. Null and empty texts have no paragraphs. Rows that repeat an id are
    scanned each on its own, null ids stay null, extra columns are ignored. An empty table gives an empty result.
    """
    spark, model = df.sparkSession, classifier()
    telling = model.telling()
    n = len(model.classes)
    # the one pass over the corpus; row parts documents that repeat an id
    texts = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).filter(_holds(_words("text"), telling))
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "licence-texts")
    held = paragraphs(texts).withColumn("words", F.filter(_words("body"), lambda w: w != "")).filter(_holds(F.col("words"), telling))
    held = written(held.drop("body"), "licence-paragraphs")
    key = ["row", "paragraph"]
    table = _fixed(spark, [(g, *w) for g, w in model.weights.items()], "gram string, " + ", ".join(f"w{j} double" for j in range(n)))
    every = F.array_distinct(F.concat(*[_grams(F.col("words"), k) for k in range(1, GRAMS + 1)]))
    scored = held.select(*key, F.explode(every).alias("gram")).join(F.broadcast(table), "gram").groupBy(*key).agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(n)])
    z = F.transform(F.array(*[F.col(f"w{j}") + F.lit(b) for j, b in enumerate(model.bias)]), lambda x: x / model.temperature)
    scored = scored.select(*key, z.alias("z"))
    scored = scored.withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    scored = scored.withColumn("all", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    none = model.classes.index(NONE)
    best = F.array_max(F.array(*[F.struct((F.col("e")[j] / F.col("all")).alias("probability"), F.lit(c).alias("predicted")) for j, c in enumerate(model.classes) if j != none]))
    scored = scored.filter(F.col("e")[none] / F.col("all") <= 0.5).select(*key, best.alias("best")).select(*key, "best.*")
    known = _fixed(spark, [(f, k, s, len(ss)) for f, ts in templates().items() for k, t in enumerate(ts) for ss in [shingles(t)] for s in ss], "family string, template int, shingle string, n int")
    three = F.array_distinct(F.when(F.size("words") >= GRAMS, _grams(F.col("words"), GRAMS)).otherwise(F.array(F.array_join("words", " "))))
    likely = held.join(scored, key).withColumn("three", three)
    with_two = F.array_distinct(F.concat("three", _grams(F.col("words"), 2)))
    shared = likely.select(*key, "predicted", F.size("three").alias("m"), F.explode(with_two).alias("shingle")).join(F.broadcast(known), "shingle").filter("family = predicted")
    shared = shared.groupBy(*key, "template").agg((F.count(F.lit(1)) / F.least(F.first("m"), F.first("n"))).alias("share")).groupBy(*key).agg(F.max("share").alias("similarity"))
    found = likely.join(shared, key, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    licence = F.when(F.col("similarity") >= alike, F.col("predicted")).otherwise(UNKNOWN_CLASS)
    return found.select("doc_id", "paragraph", "first_line", "last_line", licence.alias("licence"), "predicted", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"))
