"""Licence scans by a positional rare-token index.

The library of templates is a set of licence notices, each with a key phrase that must be there word for word.
Inverse document frequencies of the templates' words are counted over the scanned files themselves, all of them.
The index holds, for each template, the postings (word, place) of the RARE words of its key phrase that have the
highest inverse document frequency. In a file the licence words are looked up in that order, the rarest first:
a place in the file and a posting fix a relative position of file and template, and the positions of one posting
are intersected with those of the next, so that few are left when the common words come. What is left is a
candidate, and counts if its whole key phrase stands there. Its score is the share of the template's words,
weighted by their inverse document frequency, that stand where the template has them. As every place of every
indexed word is looked up, and the key phrase holds all of them, no place of a key phrase is lost.

Defined results: null is an empty text; no label is an empty string and score 0; equal scores need no tie-break,
as only the greatest value is reported; rows alike are scanned (and counted) each; an empty table gives no rows;
other columns of the documents do not matter.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import small_batches, tidy, words_of


@dataclass(frozen=True)
class Template:
    """A notice; key is a part of it that must stand word for word. base: every place is reported."""

    label: str
    text: str
    key: str
    base: bool = False


# The base phrases and labels of the scan.
BASE = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
)
# The notices that public licences ask to be put into files, and common short forms of them.
NOTICES = (
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License, Version 2.0",
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    Template(
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "GNU Affero General Public License",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms",
    ),
    Template(
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so",
        "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", "Boost Software License, Version 1.0"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "CC BY-NC 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA", "CC BY-SA"),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International"),
    Template(
        "cc0-1.0",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is "
        "distributed without any warranty.",
        "dedicated all copyright and related and neighboring rights",
    ),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License 2.0"),
    Template(
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU General Public License as published by the Free Software Foundation; either version 2",
    ),
    Template("gpl-2.0", "Licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"),
    Template(
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU General Public License as published by the Free Software Foundation, either version 3",
    ),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose",
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
        "Lesser General Public License",
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    Template("mit", "Released under the MIT license", "MIT license"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License, v. 2.0"),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain",
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications",
    ),
)
LIBRARY = (*BASE, *NOTICES)
#: Postings of each template that the index holds at most: those of its key phrase's rarest words.
RARE = 4
#: Weights are whole numbers, so that sums of them do not depend on their order.
SCALE = 1000


def vocabulary(templates: tuple[Template, ...] = LIBRARY) -> set[str]:
    return {w for t in templates for w in words_of(t.text)}


def weights(files: int, present: Mapping[str, int], words: set[str]) -> dict[str, int]:
    """The inverse document frequency of each word, ln((1 + files) / (1 + files that hold it)) + 1, in whole 1 / SCALE."""
    return {w: math.floor(SCALE * (math.log((1 + files) / (1 + present.get(w, 0))) + 1)) for w in words}


def corpus_weights(docs: DataFrame, templates: tuple[Template, ...] = LIBRARY) -> dict[str, int]:
    """`weights` over all documents: each task counts its own, one row a word comes to the driver."""
    known = vocabulary(templates)

    def run(batches):
        files, present = 0, Counter()
        for batch in batches:
            files += batch.num_rows
            for text in batch.column("text"):
                present.update(known.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([None, *present], pa.string()), pa.array([files, *present.values()], pa.int64())], ["word", "n"])

    with small_batches(docs.sparkSession):
        counted = docs.select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    sums = {r["word"]: r["n"] for r in counted}
    return weights(sums.pop(None, 0), sums, known)


class Index:
    """Postings of the rarest words of the templates' key phrases."""

    def __init__(self, weight: Mapping[str, int], templates: tuple[Template, ...] = LIBRARY, rare: int = RARE):
        self.templates, self.weight = templates, weight
        self.words = [words_of(t.text) for t in templates]
        self.total = [sum(map(weight.__getitem__, words)) for words in self.words]
        self.keys: list[tuple[int, list[str]]] = []
        self.postings: list[list[tuple[str, int]]] = []  # of each template, rarest first
        for template, words in zip(templates, self.words):
            key = words_of(template.key)
            start = next((s for s in range(len(words) - len(key) + 1) if words[s : s + len(key)] == key), None)
            if not key or start is None:
                raise ValueError(f"the key phrase of {template.label} is not in its text")
            self.keys.append((start, key))
            places = sorted(range(start, start + len(key)), key=lambda p: (-weight[words[p]], words[p], p))  # noqa: B023
            self.postings.append([(words[p], p) for p in places[:rare]])
        #: By its rarest word: the templates that a file with that word may hold.
        self.heads: dict[str, list[int]] = defaultdict(list)
        for i, postings in enumerate(self.postings):
            self.heads[postings[0][0]].append(i)
        self.indexed = {w for postings in self.postings for w, _ in postings}

    def candidates(self, words: list[str]) -> list[tuple[int, int]]:
        """(template, relative position) at which all indexed words of the template stand."""
        if self.heads.keys().isdisjoint(words):
            return []
        places: dict[str, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            if word in self.indexed:
                places[word].append(at)
        out = []
        for head in sorted(self.heads.keys() & places.keys(), key=lambda w: (-self.weight[w], w)):
            for template in self.heads[head]:
                met: set[int] | None = None
                for word, place in self.postings[template]:
                    here = {at - place for at in places.get(word, ())}
                    met = here if met is None else met & here
                    if not met:
                        break
                out += [(template, offset) for offset in sorted(met)]
        return out

    def scan(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(template, start of its key phrase, score) of each candidate whose key phrase stands in the words."""
        out = []
        for template, offset in self.candidates(words):
            start, key = self.keys[template]
            if offset + start >= 0 and words[offset + start : offset + start + len(key)] == key:
                held = sum(self.weight[w] for j, w in enumerate(self.words[template]) if 0 <= offset + j < len(words) and words[offset + j] == w)
                out.append((template, offset + start, held / self.total[template]))
        return out


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_documents(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """Per document: RESULT. Without an index, the library's, with the documents' own frequencies."""
    index = index or Index(corpus_weights(docs))
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def row(name, text) -> tuple:
        words = words_of(text)
        hits = index.scan(words)
        base = [(index.templates[t].label, at) for t, at, _ in hits if index.templates[t].base]
        places = [at for _, at in base]
        labels = {index.templates[t].label for t, _, _ in hits}
        return name, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), max((s for *_, s in hits), default=0.0)

    def run(batches):
        for batch in batches:
            rows = [row(n.as_py(), t.as_py()) for n, t in zip(batch.column("doc_id"), batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), RESULT)
