"""License scan by a trained paragraph classifier.

Templates of common licences (notices and telling passages) are varied at random and set against paragraphs from the corpus to train a softmax regression on sparse word
n-grams (1 to 3 words). Only n-grams that hold a licence word count, a word that is rare in ordinary paragraphs, so a paragraph without one is
"none" by construction and isn't looked at further. Probabilities are calibrated by a temperature and each family by a threshold, both fitted on variations
left out of training. A paragraph that looks like a licence is given to a family only if its calibrated probability reaches the threshold and a template of
that family confirms it by shared n-grams; else it is "unknown".

A paragraph is a line, or several if a notice is wrapped: lines that go on in the next one, comment marks left aside, are first judged together, and each alone if they aren't a known licence
together; neighbouring lines that look like a licence but are not sure alone are judged together at last. Spans count code points.

Edge cases: null and empty texts hold no licence; repeated rows get the same row each; an empty table gives an empty result; other columns aren't read. Training on an empty
corpus uses the templates and built-in prose. Texts are scanned whole. Rows that share an id count as one when paragraphs are sampled.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, slices, texts_of, two_columns

_TOKEN = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")

TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "This project is distributed under the terms of the MIT License, see the LICENSE file.",
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "to deal in the Software without restriction",
        "copyright notice and this permission notice shall be included in all copies or substantial portions",
        "of this software and associated documentation files (the Software)",
        "including without limitation the rights to use, copy and modify",
        "to permit persons to whom the Software is furnished to do so",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPLv3 license.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0, Creative Commons Attribution-NonCommercial-NoDerivatives.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "SPDX-License-Identifier: Unlicense",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
PROSE = [
    "He lost his driving license after the accident and had to walk to work for a year.",
    "The public library in the general area of the square opens at nine, free of charge for any person.",
    "She was granted permission to leave the room and use the telephone in the hall.",
    "The software was fast, but the documentation was poor and nobody could find the right version.",
    "Rights of way are reserved for pedestrians in the old part of the town.",
    "The committee reserved all seats in the first row for the guests.",
    "Any conditions of this kind are met with a smile by the people who work there.",
    "They published a copy of the letter in the morning paper without restriction.",
    "The source of the river lies in the mountains, and its use is free to all.",
    "A student of MIT wrote about Mozilla and the Apache people in the same essay.",
    "The foundation gave its name to the hall and promoted products of the region.",
    "You may obtain a map of the common at the gate; the law requires it.",
]
#: Short names of families, and forms in which they are put.
NAMES: dict[str, list[str]] = {
    "mit": ["MIT"],
    "apache-2.0": ["Apache 2.0", "Apache-2.0", "Apache License 2.0"],
    "gpl": ["GPLv3", "GPL v2", "GNU GPL", "GPL-2.0-only", "GNU General Public License"],
    "lgpl": ["LGPLv3", "LGPL 2.1", "GNU LGPL"],
    "agpl": ["AGPLv3", "AGPL-3.0", "GNU AGPL"],
    "bsd": ["BSD", "BSD-2-Clause", "BSD 3-Clause", "New BSD"],
    "mpl-2.0": ["MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0"],
    "isc": ["ISC"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-SA-4.0"],
    "public-domain": ["CC0", "Unlicense", "CC0-1.0"],
}
FORMS = ["License: {0}", "{0} licensed.", "{1} is {0} licensed.", "Licensed under {0}.", "{1} is covered by the {0} license.", "{0} license, see the file for details", "Published under the {0} License"]
#: Forms of licences that belong to no family.
FOREIGN = [
    "Licensed under the {0} License, version {1}.",
    "Released under the {0} License.",
    "This work is licensed under the {0} Public License {1}.0.",
    "Use of this software is subject to the {0} Community License Agreement.",
    "Distributed under the terms of the {0} Open License v{1}.",
]
NONE = "none"
#: Words that speak of licences however often a corpus has them: licen*, copyright, SPDX and the names of families.
_ALWAYS = re.compile(r"(?:\S*licen[cs]|copyright|spdx|apache|mozilla|mpl|[al]?gpl|bsd|cc0|cc-by)|(?:mit|gnu|isc|cc|affero|unlicense)$")
_NOTICE = frozenset(["rights", "reserved", "released"])


@dataclass(frozen=True)
class LicenseTraining:
    """corpus_rows: documents from which ordinary paragraphs are taken, at most; paragraphs_per_row: from each, at most. copies: variations of each template. All paragraphs taken are learnt from."""

    corpus_rows: int = 400
    paragraphs_per_row: int = 4
    copies: int = 24
    epochs: int = 8
    seed: int = 11


@dataclass
class LicenseModel:
    families: list[str]
    features: dict[str, int]
    words: frozenset[str]  # licence words: a paragraph without one is none
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    thresholds: dict[str, float]
    grams: dict[str, list[frozenset[str]]] = field(default_factory=dict)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def ngrams(words: list[str], telling: frozenset[str] | None = None) -> set[str]:
    """N-grams of 1 to 3 words; with `telling`, those that hold such a word."""
    out = set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            own = words[i : i + n]
            if telling is None or any(w in telling for w in own):
                out.add(" ".join(own))
    return out


def _varied(text: str, rng: random.Random, prose: list[list[str]]) -> str:
    words = text.split()
    if len(words) > 12 and rng.random() < 0.5:  # a part of it
        a = rng.randrange(len(words) - 9)
        words = words[a : a + rng.randint(9, len(words) - a)]
    words = [w for w in words if len(words) < 5 or rng.random() > 0.04]
    if len(words) > 6 and rng.random() < 0.3:
        words[rng.randrange(len(words))] = rng.choice(rng.choice(prose))
    if rng.random() < 0.3:
        words = ["Copyright", "(c)", str(rng.randint(1995, 2026)), rng.choice(rng.choice(prose)).title(), *words]
    if rng.random() < 0.3:
        words += rng.choice(prose)[: rng.randint(1, 6)]
    if rng.random() < 0.2:
        words = rng.choice(prose)[: rng.randint(1, 6)] + words
    text = " ".join(words)
    return text.upper() if rng.random() < 0.1 else text


def train(paragraphs: list[str], p: LicenseTraining = LicenseTraining(), templates: dict[str, list[str]] = TEMPLATES) -> LicenseModel:
    """Train on the templates against ordinary paragraphs. The same input gives the same model."""
    rng = random.Random(p.seed)
    licence = {w for texts in templates.values() for t in texts for w in tokens(t)}
    # paragraphs of the corpus that hold a licence of their own teach nothing about ordinary ones
    ordinary = PROSE + [t for t in paragraphs if not any(w == "rights" or _ALWAYS.match(w) for w in tokens(t))]
    often = Counter(w for t in ordinary for w in set(tokens(t)))
    words = frozenset(w for w in licence if often[w] <= 0.02 * len(ordinary) or _ALWAYS.match(w) or w in _NOTICE)
    prose = [t.split() or ["text"] for t in ordinary]
    families = [NONE, "unknown", *sorted(templates)]
    rows = [(_varied(t, rng, prose), families.index(f)) for f, texts in sorted(templates.items()) for t in texts for _ in range(p.copies)]
    rows += [(t, families.index(f)) for f, texts in sorted(templates.items()) for t in texts for _ in range(3)]
    named = {f: [form.format(n, rng.choice(rng.choice(prose))) for n in NAMES.get(f, []) for form in FORMS] for f in templates}
    rows += [(t, families.index(f)) for f, texts in sorted(named.items()) for t in texts for _ in range(3)]
    foreign = lambda: rng.choice(FOREIGN).format(" ".join(w.title() for w in rng.choice(prose)[: rng.randint(1, 3)]), rng.randint(1, 9))
    rows += [(_varied(foreign(), rng, prose), 1) for _ in range(300)]
    # single licence words strewn into prose are no licence
    rows += [(" ".join(w if rng.random() > 0.1 else rng.choice(sorted(words)) for w in rng.choice(prose)[:40]), 0) for _ in range(600)]
    rows += [(t, 0) for t in ordinary] + [(t, 0) for t in PROSE for _ in range(10)]
    rng.shuffle(rows)
    count = Counter(g for t, _ in rows for g in ngrams(tokens(t), words))
    features = {g: i for i, g in enumerate(sorted(g for g, k in count.items() if k >= 3))}
    coded = [(np.array(sorted(features[g] for g in ngrams(tokens(t), words) if g in features), np.int64), y) for t, y in rows]
    cut = len(coded) * 4 // 5
    fit, rest = coded[:cut], coded[cut:]
    w, b = np.zeros((len(features), len(families))), np.zeros(len(families))
    gw, gb = np.full_like(w, 1e-3), np.full_like(b, 1e-3)
    order = list(range(len(fit)))
    for _ in range(p.epochs):
        rng.shuffle(order)
        for k in order:  # Adagrad, one paragraph at a time
            at, y = fit[k]
            z = w[at].sum(axis=0) + b
            q = np.exp(z - z.max())
            q /= q.sum()
            q[y] -= 1
            step = q[None, :] + 1e-4 * w[at]
            gw[at] += step**2
            w[at] -= 0.2 * step / np.sqrt(gw[at])
            gb += q**2
            b -= 0.2 * q / np.sqrt(gb)
    b[0] = max(b[0], b[1:].max() + 4)  # without features: none
    z = np.array([w[at].sum(axis=0) + b for at, _ in rest])
    y = np.array([y for _, y in rest])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

    temperature = min((0.25 * 1.15**k for k in range(30)), key=loss)
    s = z / temperature
    q = np.exp(s - s.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    # licences of no known family set, with the errors on what was left out, how sure one must be
    held = [[features[g] for g in ngrams(tokens(foreign()), words) if g in features] for _ in range(300)]
    u = np.array([w[at].sum(axis=0) + b for at in held]) / temperature
    u = np.exp(u - u.max(axis=1, keepdims=True))
    u /= u.sum(axis=1, keepdims=True)
    thresholds = {}
    for k, f in enumerate(families[2:], 2):
        wrong = np.concatenate([q[(q.argmax(axis=1) == k) & (y != k), k], u[u[:, 1:].argmax(axis=1) + 1 == k, k]])
        thresholds[f] = float(min(0.97, max(0.5, np.quantile(wrong, 0.95)))) if len(wrong) else 0.5
    grams = {f: [frozenset(ngrams(tokens(t))) for t in [*texts, *NAMES.get(f, [])]] for f, texts in templates.items()}
    return LicenseModel(families, features, words, w, b, float(temperature), thresholds, grams)


def classify(text: str, m: LicenseModel, least_overlap: float = 0.3) -> tuple[str, float]:
    """(family, unknown or none; probability) of a paragraph."""
    words = tokens(text)
    if m.words.isdisjoint(words):
        return NONE, 1.0
    at = [m.features[g] for g in ngrams(words, m.words) if g in m.features]
    z = (m.weights[at].sum(axis=0) + m.bias) / m.temperature
    q = np.exp(z - z.max())
    q /= q.sum()
    if q[0] >= 0.5:
        return NONE, float(q[0])
    k = 1 + int(q[1:].argmax())
    family = m.families[k]
    own = ngrams(words)
    if family == "unknown":
        return family, float(1 - q[0])
    overlap = max(len(own & t) / min(len(own), len(t)) for t in m.grams[family])
    return (family, float(q[k])) if q[k] >= m.thresholds[family] and overlap >= least_overlap else ("unknown", float(1 - q[0]))


def scan_text(text: str, m: LicenseModel) -> list[tuple[int, int, str]]:
    """(start, end, family) of the licence paragraphs of a text."""
    if m.words.isdisjoint(tokens(text)):
        return []
    out: list[tuple[int, int, str]] = []
    at, unsure = 0, []  # unsure: lines in a row that look like a licence, but alone are unknown

    def settle() -> None:
        if len(unsure) > 1:
            together, _ = classify(text[unsure[0][0] : unsure[-1][1]], m)
            if together not in (NONE, "unknown"):
                out.append((unsure[0][0], unsure[-1][1], together))
                unsure.clear()
        out.extend((a, b, "unknown") for a, b in unsure)
        unsure.clear()

    for lines in _wrapped(text):
        if len(lines) > 1:
            a, b = lines[0][0], lines[-1][1]
            family = NONE
            if not m.words.isdisjoint(tokens(text[a:b])):
                family, _ = classify("\n".join(text[x:y].lstrip(_MARKS) for x, y in lines), m)
            if family not in (NONE, "unknown"):
                settle()
                out.append((a, b, family))
                continue
        for a, b in lines:
            family, _ = classify(text[a:b], m)
            if family == "unknown":
                unsure.append((a, b))
            else:
                settle()
                if family != NONE:
                    out.append((a, b, family))
    settle()
    return out


#: Marks of comments and lists before a line.
_MARKS = " \t#/*;%!-|>\"'."
#: How wide a line is at least that is wrapped, and at most.
_WRAP = (40, 120)


def _wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lines of a text as (start, end), those of a wrapped paragraph together: a line goes on if it is about as wide as wrapped lines are, doesn't end a sentence, and isn't followed by an empty
    one or one that begins a heading, a field or a list entry."""
    at, group = 0, []
    for line in text.split("\n"):
        own = (at, at + len(line))
        at += len(line) + 1
        body = line.strip(_MARKS)
        if group and not body:
            yield group
            group = []
        group.append(own)
        width = len(line.rstrip())
        if not (body and _WRAP[0] <= width <= _WRAP[1] and line.rstrip(" \t*/")[-1:] not in ".!?:;"):
            yield group
            group = []
    if group:
        yield group


def sample_paragraphs(docs: DataFrame, p: LicenseTraining = LicenseTraining(), id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Paragraphs of at most corpus_rows documents, chosen by a hash of their ids."""
    source = two_columns(docs, id_col, text_col)
    chosen = source.select("id").orderBy(F.xxhash64("id"), "id").limit(p.corpus_rows)
    some = F.expr(f"slice(filter(split(text, '\\n'), x -> length(x) between 20 and 600), 1, {p.paragraphs_per_row})")
    lines = source.join(F.broadcast(chosen.distinct()), "id").select("id", some.alias("lines")).groupBy("id").agg(F.min("lines").alias("lines"))
    return sorted({t for r in lines.collect() for t in r.lines or []})


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and licenses, an array of (family, start, end), of every row."""
    source = two_columns(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [[{"family": f, "start": a, "end": b} for a, b, f in scan_text(t, model)] for part in slices(batch, "text") for t in texts_of(part, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], names=[id_col, "licenses"])

    return map_batches(source, run, f"`{id_col}` {dict(source.dtypes)['id']}, licenses array<struct<family:string,start:bigint,end:bigint>>")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scan(docs, train(sample_paragraphs(docs)))
    return found.selectExpr(
        "doc_id",
        "array_join(array_sort(array_distinct(filter(transform(licenses, x -> x.family), f -> f <> 'unknown'))), ',') as families",
        "cast(size(licenses) as bigint) as n_licenses",
        "cast(size(filter(licenses, x -> x.family = 'unknown')) as bigint) as n_unknown",
        "array_join(transform(licenses, x -> concat(x.family, ':', x.start, ':', x.end)), ',') as spans",
    )


QUERIES = {"op6_license_scans": op6_license_scans}
ORACLES: dict[str, str] = {}
