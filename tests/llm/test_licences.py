import pytest

from agentcorpus.llm import licences

NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA",
    "All rights reserved.": "Proprietary",
}


@pytest.fixture(scope="module")
def model(spark, sf):
    return licences.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_notices_are_found_and_plain_lines_are_not(spark, model):
    plain = "Ofthedin hesh inonble thainon the lyoren was tion of the erwh and with it ha"
    rows = [(k, f"{plain}\n{notice}\n{plain}") for k, notice in enumerate(NOTICES)]
    rows += [(50 + k, f"{' '.join([plain] * 6)} {notice} {' '.join([plain] * 7)}") for k, notice in enumerate(NOTICES)]
    rows += [(100 + k, plain) for k in range(20)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).where("confirmed").collect()
    got = {(r["doc_id"], r["line"]): r["family"] for r in found}
    for k, family in enumerate(NOTICES.values()):
        assert got.pop((k, 1)) == family
    embedded = {k: f for (k, _), f in got.items() if 50 <= k < 100}
    assert sum(embedded.get(50 + k) == f for k, f in enumerate(NOTICES.values())) >= 5
    assert not [k for k in got if k[0] >= 100]


def test_held_out_accuracy(spark, sf):
    """Neither the pieces of notices nor the lines of the corpus are those of the training."""
    negatives = licences.sample_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    trained = licences.Model(negatives[::2])
    texts, labels = licences.examples(negatives[1::2], seed=11)
    windows = licences.Windows([licences.clean(t) for t in texts])
    right = trained.logits(windows).argmax(axis=1) == labels[windows.text]
    assert right.mean() > 0.9


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; ", "-- "])
def test_wrapped_notices(model, mark):
    code = "def run(value):\n    return value + 1\n\n"
    for family, notice in WRAPPED.items():
        text = code + "".join(f"{mark}{line}\n" for line in notice.split("\n")) + "\n" + code
        found = model.scan([text])
        confirmed = found[found["overlap"] >= licences.LEAST_OVERLAP]
        assert set(confirmed["family"]) == {family}, (family, found)
        assert confirmed["line"].min() == 3


def test_two_notices_in_one_paragraph(model):
    text = WRAPPED["GPL-3.0"] + "\n" + "some other words " * 10 + "\nReleased under the MIT License.\n"
    found = model.scan([text])
    confirmed = found[found["overlap"] >= licences.LEAST_OVERLAP]
    assert {("GPL-3.0", 0), ("MIT", 5)} <= set(zip(confirmed["family"], confirmed["line"]))


def test_copies_do_not_fill_the_sample(spark):
    rows = [(k, f"line number {k} of its own") for k in range(200)] + [(1000, "the same line")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    lines = licences.sample_lines(docs, 50)
    assert len(lines) == len(set(lines)) == 50
    assert lines == licences.sample_lines(docs.repartition(3), 50)
    assert len(licences.sample_lines(docs, 5000)) == 201
    long = spark.createDataFrame([(1, "x" * 10**6)], "doc_id long, text string")
    assert [len(x) for x in licences.sample_lines(long)] == [licences.NEGATIVE_CHARS]


def test_whole_table(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = licences.scan(docs, model).where("confirmed").collect()
    got = {(r["doc_id"], r["line"]) for r in found}
    want = set()
    for r in docs.collect():
        for at, line in enumerate(r["text"].split("\n")):
            if line in NOTICES:
                want.add((r["doc_id"], at))
    assert want <= got and len(got - want) <= 1


def test_odd_rows(odd, empty, model):
    assert licences.scan(odd, model).where("confirmed").collect() == []
    assert licences.scan(empty, licences.fit(empty)).collect() == []
