"""Each licence text's label on the full licence as it is published."""

import random

import pytest

from nestra.llm import licenses
from nestra.llm.common import words

MIT = """MIT License. Copyright (c) 2020 Someone
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD_2 = """Copyright (c) 2020, Someone. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
BSD_3 = BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ISC = """Copyright (c) 2020, Someone
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
APACHE = """Copyright 2020 Someone. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
FULL = {"mit": MIT, "bsd-3-clause": BSD_3 + WARRANTY, "isc": ISC, "apache-2": APACHE, "unlicense": UNLICENSE}


@pytest.mark.parametrize("idf", [{}, {b"contributors": 5.0, b"redistribution": 4.0, b"name": 0.5, b"software": 1.0, b"license": 2.0}])
def test_full_texts(idf):
    index = licenses.Index(idf)
    for label, (text, _) in licenses.TEXTS.items():  # notices and texts of one passage are known by their own words
        assert label in index.scan(words(("a b " + text + " c").encode()))[2], label
    for label, text in FULL.items():
        for seq in (words(text.encode()), words(("x y z " * 30 + text + " end" * 50).encode())):
            assert label in index.scan(seq)[2], label
    assert index.scan(words((BSD_2 + WARRANTY).encode()))[2] == {"bsd-2-clause"}
    assert index.scan(words((BSD_3 + WARRANTY).encode()))[2] == {"bsd-3-clause"}


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_labels(seq):
    """Every phrase at every place, every passage against every stretch."""
    labels, score = set(), 0.0
    has = lambda p: any(seq[i : i + len(p)] == p for i in range(len(seq)))
    for phrase, label in [*licenses.BASE.items(), *licenses.PHRASES.items()]:
        if has(phrase.encode().split()):
            labels.add(label)
            score = 1.0
    base = {label for phrase, label in licenses.BASE.items() if has(phrase.encode().split())}
    for label, (text, mandatory) in licenses.TEXTS.items():
        if all(has(m.encode().split()) for m in mandatory):
            found = 0
            for passage in text.split("\n"):
                p = passage.encode().split()
                n = len(p) + 3 * licenses.DRIFT
                found += max(longest(p, seq[i : i + n]) for i in range(max(1, len(seq) - n + 1)))
            covered = found / len(text.split())
            if covered >= licenses.COVERAGE:
                labels.add(label)
                score = max(score, covered)
    return labels - {less for more, less in licenses.MORE_THAN.items() if more in labels and less not in base}, min(1.0, score)


def test_labels_equal_a_plain_search(spark):
    r = random.Random(8)
    rows = []
    for label, (text, _) in licenses.TEXTS.items():
        seq = text.split()
        for share in (0.0, 0.05, 0.1, 0.15):  # words lost, put in and changed
            edited = [w for w in seq if r.random() >= share / 2]
            edited = [w if r.random() >= share / 4 else "changed" for w in edited]
            for _ in range(int(share * 20)):
                edited.insert(r.randrange(len(edited)), "more")
            rows.append((len(rows), " ".join(["code"] * r.randint(0, 40) + edited + ["end"] * r.randint(0, 40))))
    rows += [(len(rows), "spdx license identifier mit and mozilla public license v 2"), (len(rows) + 1, None), (len(rows) + 2, "")]
    got = {x["doc_id"]: (set(filter(None, x["labels"].split(","))), x["score"]) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    agree = 0
    for i, text in rows:
        labels, score = plain_labels(licenses.words((text or "").encode()))
        # stretches begin near an alignment, so an edge may be cut off: never more is found, rarely less
        assert got[i][0] <= labels and got[i][1] <= score + 1e-9
        agree += got[i][0] == labels and abs(got[i][1] - score) < 0.03
    assert agree >= 0.97 * len(rows)


def test_order_counts():
    text, (key,) = licenses.TEXTS["mit"][0], licenses.TEXTS["mit"][1]
    head, _, tail = text.partition(key)
    seq = tail.split()
    random.Random(1).shuffle(seq)
    index = licenses.Index({})
    assert index.scan((head + key + tail).encode().split())[2] == {"mit"}
    assert index.scan((head + key + " " + " ".join(seq)).encode().split())[2] == set()
