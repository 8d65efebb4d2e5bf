"""Licence scans with a positional rare-token index over licence templates.

The index holds each template's words with their positions, and the inverse document frequency of every licence
word over all documents scanned. A file is looked up by its rarest licence words: for each template the words it
shares with the file are ordered by that frequency, the positions of the rarest are turned into alignments (place
in the file minus place in the template), and the alignments of several words are intersected. What remains is
verified word by word: key phrases must stand there whole, and a longer text must have its mandatory phrases and
most of its words in order.

Cases: a null or empty text has no words and no places. Places may overlap and count each. Repeated rows are
scanned each for itself. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8, words

# Phrases of the base report and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Key phrases that name a licence by themselves.
PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license v 2": "mpl-2",
    "eclipse public license": "epl",
    "boost software license version 1": "bsl-1",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2": "apache-2",
    "spdx license identifier bsd 3 clause": "bsd-3-clause",
    "spdx license identifier bsd 2 clause": "bsd-2-clause",
    "released into the public domain": "public-domain",
    "cc by sa": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
}
# Passages of licence texts, a line each where others stand between, with the phrases that must be there.
TEXTS = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("free of charge to any person obtaining a copy of this software",),
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met\n"
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("redistribution and use in source and binary forms", "endorse or promote products derived from this software"),
    ),
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met\n"
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"),
    ),
    "gpl-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation either version 3",),
    ),
    "gpl-2": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation either version 2",),
    ),
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu affero general public license as published by the free software foundation",),
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license as published by the free software foundation",),
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("subject to the terms of the mozilla public license v 2 0",),
    ),
    "epl": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        ("made available under the terms of the eclipse public license",),
    ),
    "bsl-1": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ("to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("permission is granted to anyone to use this software for any purpose including commercial applications",),
    ),
    "cc0": (
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
        ("dedicated the work to the public domain by waiving all of his or her rights",),
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0 international license",),
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike 4 0 international license",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("you may not use this file except in compliance with the license",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
}
#: A licence whose text holds all of another's: the other is not reported beside it.
MORE_THAN = {"bsd-3-clause": "bsd-2-clause"}
#: Rarest words by which a template is looked up, words that an alignment may be off after an edit, and the part
#: of a text's words that must stand in the aligned stretch.
LOOKED_UP, DRIFT, COVERAGE = 4, 6, 0.8


class Template:
    def __init__(self, label: str, text: str, base: bool = False, whole: bool = True, mandatory: tuple[str, ...] = ()):
        self.label, self.base, self.whole = label, base, whole
        self.words = [w.encode() for w in text.split()]
        self.places: dict[bytes, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        self.needs = frozenset(self.words)
        self.mandatory = [Template(label, m) for m in mandatory]
        self.bits = {w: sum(1 << i for i in at) for w, at in self.places.items()}
        self.passages = [self] if whole or "\n" not in text else [Template(label, p, whole=False) for p in text.split("\n")]


    def in_order(self, seq: list[bytes]) -> int:
        """Length of the longest common subsequence with the template, a machine word of it at a time."""
        every = (1 << len(self.words)) - 1
        open_ = every
        for w in seq:
            if hit := open_ & self.bits.get(w, 0):
                open_ = ((open_ + hit) | (open_ - hit)) & every
        return len(self.words) - open_.bit_count()


class Index:
    """Templates and the inverse document frequency of their words."""

    def __init__(self, idf: dict[bytes, float]):
        self.templates = [Template(label, text, base=True) for text, label in BASE.items()]
        self.templates += [Template(label, text) for text, label in PHRASES.items()]
        self.templates += [Template(label, text, whole=False, mandatory=m) for label, (text, m) in TEXTS.items()]
        self.idf = idf
        self.words = frozenset(w for t in self.templates for w in t.needs)
        # a template cannot be there without the rarest word of it (or of a mandatory phrase of it)
        self.rarest = [(max((t.mandatory or [t])[0].needs, key=self._weight), t) for t in self.templates]

    def _weight(self, w: bytes) -> tuple[float, bytes]:
        return self.idf.get(w, 0.0), w

    def scan(self, seq: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases (all places), base labels, all labels, score."""
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        score = 0.0
        present = self.words.intersection(seq)
        if not present:
            return starts, base, labels, score
        where: dict[bytes, list[int]] = {}

        def places(w: bytes) -> list[int]:
            if w not in where:
                found, at = [], -1
                for _ in range(seq.count(w)):
                    at = seq.index(w, at + 1)
                    found.append(at)
                where[w] = found
            return where[w]

        for rarest, t in self.rarest:
            if rarest not in present:
                continue
            if t.whole:
                if t.needs <= present and (found := self._phrase(t, seq, places)):
                    labels.add(t.label)
                    score = 1.0
                    if t.base:
                        starts += found
                        base.add(t.label)
            elif all(m.needs <= present and self._phrase(m, seq, places) for m in t.mandatory):
                # each passage has a stretch of its own; all of the words of the text count together
                covered = sum(self._cover(p, seq, present, places) * len(p.words) for p in t.passages) / len(t.words)
                if covered >= COVERAGE:
                    labels.add(t.label)
                    score = max(score, covered)
        labels -= {less for more, less in MORE_THAN.items() if more in labels and less not in base}
        return starts, base, labels, min(1.0, score)

    def _phrase(self, t: Template, seq: list[bytes], places) -> list[int]:
        """Starts of a phrase: alignments that its rarest words share, verified."""
        looked_up = sorted(t.needs, key=self._weight, reverse=True)[:LOOKED_UP]
        starts: set[int] | None = None
        for w in looked_up:
            # each of the word's places in the template is at the same distance from the start
            for p in t.places[w]:
                near = {i - p for i in places(w)} if starts is None else {s for s in starts if 0 <= s + p < len(seq) and seq[s + p] == w}
                starts = near
            if not starts:
                return []
        n = len(t.words)
        return sorted(s for s in starts or () if s >= 0 and seq[s : s + n] == t.words)

    def _cover(self, t: Template, seq: list[bytes], present: frozenset, places) -> float:
        """Largest part of the template's words that stand in order in one stretch of the file, near their alignment."""
        looked_up = sorted(t.needs & present, key=self._weight, reverse=True)[:LOOKED_UP]
        votes: Counter[int] = Counter()
        for w in looked_up:
            for near in {(i - p) // DRIFT + d for i in places(w) for p in t.places[w] for d in (0, 1)}:
                votes[near] += 1
        best, n = 0, len(t.words)
        for near, count in votes.items():
            if count * 2 >= len(looked_up):
                start = max(0, (near - 2) * DRIFT)
                best = max(best, t.in_order(seq[start : start + n + 3 * DRIFT]))
        return best / n


def frequencies(documents: DataFrame) -> dict[bytes, float]:
    """Inverse document frequency of the licence words over all documents: one row per word and task is shuffled,
    and as many rows as the templates have words come to the driver."""
    vocabulary = Index({}).words
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                rows += 1
                seen.update(vocabulary.intersection(words(text or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in seen)]), pa.array([rows, *seen.values()], pa.int64())], names=schema.names)

    found = {r["word"].encode(): r["n"] for r in documents.select("text").mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rows = found.pop(b"", 0)
    return {w: math.log((rows + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def scan(documents: DataFrame, idf: dict[bytes, float] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    shared = documents.sparkSession.sparkContext.broadcast(frequencies(documents) if idf is None else idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for text in utf8(batch.column(1)):
                seq = words(text or b"")
                starts, base, labels, score = index.scan(seq)
                out.append((len(seq), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=_SCHEMA.names)

    return documents.select("doc_id", "text").mapInArrow(run, _SCHEMA)
