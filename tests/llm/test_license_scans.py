import numpy as np
import odd
import pyarrow as pa
import pytest

from panelforge.llm import license_scans as scans


@pytest.fixture(scope="module")
def found(small):
    return {r["doc_id"]: r for r in scans.scan(small[0]).collect()}


def test_notices_of_the_corpus(small, found):
    """Every line that is a notice is found, and nothing else."""
    by_line = {n: family for family, notices in scans.NOTICES.items() for n in notices}
    for i, text in small[1]:
        lines = (text or "").split("\n")
        wanted = {by_line[line] for line in lines if line in by_line}
        assert found[i]["n_paragraphs"] == sum(bool(scans._words(line)) for line in lines)
        assert (found[i]["family"] in wanted) if wanted else found[i]["family"] is None
        if wanted:
            assert by_line[lines[found[i]["paragraph"]]] == found[i]["family"]


def test_held_out_variants(small):
    """Variants drawn with another seed, among words of the corpus."""
    model = scans.train(small[0])
    draw = np.random.default_rng(99)
    words = " ".join(t or "" for _, t in small[1][:20]).split()
    texts, labels = [], []
    for family, notices in scans.NOTICES.items():
        for notice in notices:
            for _ in range(20):
                kept = [w for w in notice.split() if draw.random() > 0.05]
                texts.append(" ".join([*draw.choice(words, 5), *kept, *draw.choice(words, 5)]))
                labels.append(family)
    bucket, line = scans._vectors(texts)
    p = model.probabilities(model.logits(bucket, line, len(texts)))
    guess = [model.classes[k] for k in p.argmax(1)]
    right = np.mean([g == label for g, label in zip(guess, labels, strict=True)])
    assert right > 0.9
    plain = [line for _, t in small[1] for line in (t or "").split("\n")][:3000]
    plain = [x for x in plain if max(scans.similarity(x, f) for f in scans.NOTICES) < 0.2]
    bucket, line = scans._vectors(plain)
    p = model.probabilities(model.logits(bucket, line, len(plain)))
    assert (p[:, 1:].max(1) >= model.threshold).mean() < 0.01


def test_odd_documents(docs):
    got = {r["doc_id"]: r for r in scans.scan(docs).collect()}
    assert got[21]["family"] == "Apache-2.0" and got[21]["paragraph"] == 0
    assert got[22]["family"] == "MIT" and got[22]["paragraph"] == 1
    assert sum(r["family"] is not None for r in got.values()) == 2
    assert got[1]["n_paragraphs"] == got[2]["n_paragraphs"] == got[19]["n_paragraphs"] == 0
    assert scans.scan(docs).count() == docs.count()


def test_empty_table(no_docs):
    assert scans.scan(no_docs).collect() == []


@pytest.fixture(scope="module")
def model(small):
    return scans.train(small[0])


@pytest.mark.parametrize("n", [40, 200, 5000])
def test_notices_deep_inside_a_line(model, small, n):
    """Words of the corpus before and behind a notice on its line do not hide it."""
    draw = np.random.default_rng(n)
    plain = [x for _, t in small[1] for x in (t or "").split("\n")]
    plain = [x for x in plain if max(scans.similarity(x, f) for f in scans.NOTICES) < 0.2]
    words = np.array([w for w in " ".join(plain).split() if len(w) < 30])
    texts, wanted = [], []
    for family, notices in scans.NOTICES.items():
        for notice in notices:
            for _ in range(4):
                before, after = draw.choice(words, n), draw.choice(words, 40)
                texts.append("first line\n" + " ".join([*before, notice, *after]))
                wanted.append(family)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    _, paragraphs, licensed, family, paragraph, _, similarity = scans._scan_piece(model, batch)
    right = np.mean([a == b for a, b in zip(family.to_pylist(), wanted, strict=True)])
    assert right > 0.97
    assert set(paragraphs.to_pylist()) == {2}
    hit = [k for k, f in enumerate(family.to_pylist()) if f]
    assert {paragraph[k].as_py() for k in hit} == {1} == {licensed[k].as_py() for k in hit}
    assert min(similarity[k].as_py() for k in hit) >= scans.SIMILAR


def test_windows_hold_every_notice_whole():
    for notices in scans.NOTICES.values():
        for notice in notices:
            n = len(scans._words(notice))
            for at in range(40):
                begin, end = scans.windows(np.array([7]), np.array([n + 60]))
                assert ((begin <= 7 + at) & (end >= 7 + at + n)).any()


WRAPPED = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n"
        'of this software and associated documentation files (the "Software"), to deal\n'
        "in the Software without restriction",
        0,
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify\n"
        "it under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n"
        "(at your option) any later version.",
        1,
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without\n"
        "modification, are permitted provided that the following conditions\nare met:",
        0,
    ),
}


@pytest.mark.parametrize("family", WRAPPED)
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_notices_wrapped_over_lines(model, family, mark):
    """A notice is found over line breaks, at the line where it begins."""
    text, at = WRAPPED[family]
    text = "".join(f"{mark}{line}\n" for line in ("Some title", "", *text.split("\n"), "", "end"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    _, _, licensed, got, paragraph, _, similarity = scans._scan_piece(model, batch)
    assert got.to_pylist() == [family] and licensed.to_pylist() == [1]
    assert paragraph.to_pylist() == [2 + at]
    assert similarity[0].as_py() >= scans.SIMILAR


def test_a_blank_line_parts_blocks():
    text = pa.array(["a b\nc\n\nd e f\n #\ng", "h i", None, "j"], pa.string())
    data, cuts, row = scans._lines(text)
    words = scans.spans.find_words(data, cuts)
    runs = scans.blocks(words, row)
    assert runs.first.tolist() == [0, 3, 6, 7, 9] and runs.count.tolist() == [3, 3, 1, 2, 1]


# The usual headers and titles, and what each may be called: its own family, or none where
# only a part of a notice is there. Never a sister.
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of "
    "the GNU {}General Public License as published by the Free Software Foundation, either "
    "version {} of the License, or (at your option) any later version."
)
CC = "This work is licensed under a Creative Commons {} 4.0 International License."
HEADERS = [
    ("GPL-3.0", GNU.format("", "3")),
    ("GPL-2.0", GNU.format("", "2").replace("Foundation, either", "Foundation; either")),
    ("LGPL", GNU.format("Lesser ", "3")),
    ("LGPL", GNU.format("Lesser ", "2.1").replace("Foundation, either", "Foundation; either")),
    ("AGPL-3.0", GNU.format("Affero ", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software',
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    ("CC-BY-4.0", CC.format("Attribution")),
    ("CC-BY-SA-4.0", CC.format("Attribution-ShareAlike")),
    ("CC-BY-NC-4.0", CC.format("Attribution-NonCommercial")),
    ("CC-BY-ND-4.0", CC.format("Attribution-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", CC.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-NC-ND-4.0", CC.format("Attribution-NonCommercial-NoDerivatives")),
    *[
        (f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.")
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
    ],
    ("CC0-1.0", "Released under CC0 1.0."),
]
NO_FAMILY = [
    "This work is licensed under the GNU General Public License, version 1.",
    "This work is licensed under the GNU Free Documentation License, version 3.",
    "Licensed under the Apache License, Version 1.1.",
    "Subject to the terms of the Mozilla Public License, version 1.1.",
    "Licensed under CC BY 3.0.",
    "licensed under a Creative Commons Attribution 2.0 Generic License",
]


def wrapped(text, width):
    lines, line = [], ""
    for word in text.split(" "):
        if line and len(line) + len(word) >= width:
            lines.append(line)
            line = ""
        line += (" " if line else "") + word
    return "\n".join([*lines, line])


@pytest.mark.parametrize("width", [10**6, 60, 30])
def test_usual_headers_are_never_named_after_a_sister(model, width):
    texts = [f"Some title\n\n{wrapped(text, width)}\n\nend" for _, text in HEADERS]
    texts += [f"Some title\n\n{wrapped(text, width)}\n\nend" for text in NO_FAMILY]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    got = scans._scan_piece(model, batch)[3].to_pylist()
    wanted = [family for family, _ in HEADERS] + [None] * len(NO_FAMILY)
    wrong = [(w, g, t) for w, g, t in zip(wanted, got, texts, strict=True) if g not in (w, None)]
    assert wrong == []
    named = sum(g == w for w, g in zip(wanted, got, strict=True) if w)
    assert named >= len(HEADERS) - 1


def test_results_do_not_follow_the_splits(spark, small):
    one = scans.scan(small[0].repartition(2)).collect()
    other = scans.scan(small[0].repartition(9)).collect()
    assert odd.ordered(map(tuple, one)) == odd.ordered(map(tuple, other))
