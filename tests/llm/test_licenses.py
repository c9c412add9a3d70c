import random

import pytest

from columnaut.llm import licenses as L


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    vocabulary = ["river", "stone", "the", "of", "and", "walks", "under", "light", "house", "green", "any", "to"]
    return L.train([" ".join(rng.choice(vocabulary) for _ in range(25)) for _ in range(500)])


def test_held_out_variations(model):
    rng = random.Random(99)
    prose = [t.split() for t in L.PROSE]
    right = total = 0
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            for _ in range(6):
                got = L.classify(L._varied(t, rng, prose), model)[0]
                right += got == family
                total += 1
    assert right >= 0.85 * total
    assert sum(L.classify(t, model)[0] == "none" for t in L.PROSE) >= len(L.PROSE) - 1


def test_unknown(model):
    names = ["Zebra Community", "Foo Bar", "Lantern", "Old Harbour", "Quiet Sea"]
    got = [L.classify(f.format(n, 3), model)[0] for f in L.FOREIGN for n in names]
    assert sum(g == "unknown" for g in got) >= 0.7 * len(got)


def test_spans_and_rows(spark, model):
    text = "Größe of stone\nReleased under the MIT License.\nriver\nAll rights reserved."
    assert L.scan_text(text, model) == [(15, 46, "mit"), (53, 73, "proprietary")]
    full = "\n".join(["green house", "Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met", "light"])
    assert any(f == "bsd" for *_, f in L.scan_text(full, model))
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, "river " * 60_000 + "\nReleased under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as licenses")
    got = sorted((r.doc_id, [x.family for x in r.licenses]) for r in L.scan(docs, model).collect())
    assert got == [(1, []), (2, []), (3, ["mit", "proprietary"]), (3, ["mit", "proprietary"]), (4, ["mit"])]
    assert L.scan(docs.limit(0), model).count() == 0 and L.sample_paragraphs(docs.limit(0)) == []


def test_corpus_full_of_licences():
    rng = random.Random(7)
    vocabulary = ["river", "stone", "the", "of", "and", "walks", "under", "light", "house", "green", "any", "to"]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(25)) for _ in range(300)]
    lines += [f"Copyright (c) 2019 {rng.choice(vocabulary).title()} {k}. Released under the MIT License. All rights reserved." for k in range(300)]
    m = L.train(lines + [f"SPDX-License-Identifier: MIT {k}" for k in range(100)])
    assert {"copyright", "rights", "reserved", "license", "licensed", "released", "mit", "spdx-license-identifier"} <= m.words
    assert L.scan_text("river\nReleased under the MIT License.\nstone", m) == [(6, 37, "mit")]
    assert L.scan_text("All rights reserved.", m) == [(0, 20, "proprietary")]
    assert L.scan_text("Licensed under the Apache License, Version 2.0.", m) == [(0, 47, "apache-2.0")]
    assert sum(L.classify(t, m)[0] == "none" for t in L.PROSE) >= len(L.PROSE) - 1


#: Notices as projects word them, written apart from the templates; and texts that speak of licences without granting one.
HELD_OUT = [
    ("mit", "mylib is MIT licensed. See LICENSE.txt for details."),
    ("mit", "Distributed under the MIT license (http://opensource.org/licenses/MIT)"),
    ("mit", "// SPDX-License-Identifier: MIT"),
    ("mit", "You may use this code under the terms of the MIT License."),
    ("mit", " * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software, to deal in the Software without\n * restriction, subject to the following conditions"),
    ("apache-2.0", "Copyright 2018 The Authors. Licensed under the Apache License 2.0."),
    ("apache-2.0", "# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance with the License."),
    ("apache-2.0", "This project is available under the Apache License, Version 2.0"),
    ("apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */"),
    ("gpl", "This file is part of Foo, which is released under the GNU General Public License version 2."),
    ("gpl", "License: GNU GPL v3"),
    ("gpl", "Foo is free software: you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free\nSoftware Foundation, either version 3, or any later version"),
    ("gpl", "# SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License v2.1."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl", "The server is available under the GNU Affero General Public License version 3."),
    ("bsd", "This software is licensed under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by the 3-clause BSD license found in the LICENSE file."),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the conditions below are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License Version 2.0"),
    ("isc", "Foo is released under the ISC License."),
    ("cc-by", "Except where noted, content is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "This article is published under CC BY 4.0"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License 4.0"),
    ("cc-by-sa", "Images: CC BY-SA 4.0"),
    ("cc-by-nc", "This dataset is licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "Photos are under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("public-domain", "This code is free and unencumbered and released into the public domain."),
    ("public-domain", "To the extent possible under law, we waived all copyright to this work (CC0 1.0)."),
    ("proprietary", "Copyright (c) 2021 Acme Corp. All rights reserved."),
    ("proprietary", "(c) 1999-2004 Foo Media GmbH, all rights reserved"),
    ("none", "The committee gave him a licence to sell fish at the harbour, and he sold none."),
    ("none", "My driving licence is from 1987 and the photograph shows another man."),
    ("none", "All seats are reserved for guests of the mayor, said the usher."),
    ("none", "She released the bird and it flew over the general store."),
    ("none", "The film was released in two versions, one of them without sound."),
    ("none", "He is a graduate of MIT and works for the public library."),
    ("none", "Apache helicopters flew over the valley in the morning."),
    ("none", "Software costs money, but the source of a river is free."),
    ("none", "They have the rights to use the well and to distribute its water."),
    ("none", "Every notice in the hall must be copied by hand."),
]


def test_recall_and_precision_on_notices_written_apart_from_the_templates(model):
    found = {t: L.scan_text(t, model) for _, t in HELD_OUT}
    licences = [(f, t) for f, t in HELD_OUT if f != "none"]
    right = sum(any(f == g for *_, g in found[t]) for f, t in licences)
    said = [(f, g) for f, t in HELD_OUT for *_, g in found[t] if g != "unknown"]
    noticed = sum(bool(found[t]) for f, t in licences)
    assert noticed >= 0.95 * len(licences)  # as a licence, known or not
    assert right >= 0.85 * len(licences)  # recall of families
    assert sum(f == g for f, g in said) >= 0.9 * len(said)  # precision of families


def test_wrapped_notices_are_one_paragraph(model):
    text = "green house\n\n" + "# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance with the License.\n" + "stone"
    assert [(f, text[a:b].count("\n")) for a, b, f in L.scan_text(text, model)] in ([("apache-2.0", 1)], [("apache-2.0", 0), ("apache-2.0", 0)])
    text = "river\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the conditions below are met\nlight"
    assert [f for *_, f in L.scan_text(text, model)] == ["bsd"]


@pytest.mark.parametrize("share", [0.05, 0.2, 0.5])
def test_licences_are_found_however_common_they_are(model, share):
    rng = random.Random(3)
    vocabulary = ["river", "stone", "the", "of", "and", "walks", "under", "light", "house", "green", "any", "to"]
    plain = [" ".join(rng.choice(vocabulary) for _ in range(25)) for _ in range(500)]
    every = [t for texts in L.TEMPLATES.values() for t in texts]
    common = L.train(plain + [f"Copyright (c) {1990 + k % 30} Person {k}. {rng.choice(every)}" for k in range(int(500 * share / (1 - share)))])
    assert sum(L.classify(t, common)[0] == L.classify(t, model)[0] for t in every) >= 0.98 * len(every)


def test_clashing_names_and_repeated_ids(spark, model):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "river " * 10), (None, "All rights reserved.")], "doc_id long, text string").selectExpr("*", "'x' as families", "2 as lines", "3 as licenses")
    got = L.scan(docs, model)
    assert got.columns == ["doc_id", "licenses"] and sorted(len(r.licenses) for r in got.collect()) == [0, 1, 1]
    assert len(L.sample_paragraphs(docs)) <= 2


def test_query_finds_every_licence_line(spark):
    sf = "/root/testdata/sf0.001"
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "proprietary", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in L.op6_license_scans(spark, sf).collect():
        want = {lines[x] for x in text[r.doc_id].split("\n") if x in lines}
        assert set(filter(None, r.families.split(","))) == want
