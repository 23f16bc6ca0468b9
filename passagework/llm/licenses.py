"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance down the directories.

Document frequencies are those of all documents: exact for the words of the templates, by hash (an array of fixed size that every
task sums before the exchange) for the others. A piece of text is compared with the templates only if it holds a word of their prefix: the
heaviest words of a template without which the cosine cannot reach the limit. Pieces are the lines, the sentences of long lines, the
whole text, and, so that statements wrapped over lines are found, every window of a template's number of words around its prefix words,
whatever line breaks lie in it. A document's licence is that of its best piece; licence files are told by name or by the share of words in
such pieces. A document without a licence inherits from the nearest directory above it that has a licence file, found by joins on the
path's parents; directories meet their documents under salts, so that no directory's documents go to one task.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.words import terms
from passagework.plans.stage import stage

#: Statements under which files are commonly released, and headings and main paragraphs of licence texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)
#: Least cosine; share of a document's words in licence lines from which it is taken for a licence file.
COSINE, FILE_SHARE = 0.8, 0.5
BUCKETS = 1 << 17
#: Parts of a directory's documents that meet its licence apart.
SALTS = 16
#: Names of licence files, as lower-case stems.
FILE_NAMES = ("license", "licence", "copying", "unlicense")


def bucket(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word, 13) % BUCKETS


def template_slots(templates: tuple) -> dict[bytes, int]:
    """Places of the templates' words in the counts, beyond those of the buckets."""
    return {word: BUCKETS + i for i, word in enumerate(sorted({w for _, text in templates for w in terms(text.encode())}))}


def document_frequencies(docs: DataFrame, text: str = "text", slots: dict[bytes, int] | None = None) -> tuple[np.ndarray, int]:
    """Number of documents holding a word of each bucket or slot, and of documents, over all rows; nulls count as empty."""
    slots = slots or {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, rows, memory = np.zeros(BUCKETS + len(slots), np.int64), 0, {}
        for batch in batches:
            for value in batch["text"]:
                rows += 1
                held = set()
                for word in set(terms(value)):
                    code = memory.get(word)
                    if code is None:
                        if len(memory) > 1 << 19:
                            memory.clear()
                        code = slots.get(word)
                        code = memory[word] = bucket(word) if code is None else code
                    held.add(code)
                sums[list(held)] += 1
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": np.append(used, -1), "n": np.append(sums[used], rows)})

    sent = docs.select(F.col(text).cast("binary").alias("text")).mapInPandas(count, "bucket int, n bigint")
    out, rows = np.zeros(BUCKETS + len(slots), np.int64), 0
    for b, n in sent.groupBy("bucket").agg(F.sum("n")).collect():
        if b < 0:
            rows = n
        else:
            out[b] = n
    return out, rows


class Matcher:
    """TF-IDF vectors of the templates, and the cosine of pieces of text to them."""

    def __init__(self, templates: tuple, frequencies: np.ndarray, documents: int, cosine: float):
        self.idf = np.log((1 + documents) / (1 + frequencies)) + 1.0
        self.slots = template_slots(templates)
        self.cosine, self.names, self.vectors, self.sizes, self.prefix = cosine, [], [], [], {}
        self.weights: dict[bytes, float] = {}
        for place, (name, text) in enumerate(templates):
            words = terms(text.encode())
            vector = self.vector(words)
            norm = math.sqrt(sum(w * w for w in vector.values()))
            unit = {word: w / norm for word, w in vector.items()}
            self.names.append(name)
            self.vectors.append(unit)
            self.sizes.append(len(words))
            left = 1.0
            for word in sorted(unit, key=lambda x: (-unit[x], x)):
                if left < (cosine - 1e-9) ** 2:
                    break
                self.prefix.setdefault(word, []).append(place)
                left -= unit[word] ** 2

    def weight(self, word: bytes) -> float:
        known = self.weights.get(word)
        if known is None:
            if len(self.weights) > 1 << 18:
                self.weights.clear()
            known = self.weights[word] = float(self.idf[self.slots[word] if word in self.slots else bucket(word)])
        return known

    def vector(self, words: list[bytes]) -> dict[bytes, float]:
        return {word: (1 + math.log(n)) * self.weight(word) for word, n in Counter(words).items()}

    def best(self, words: list[bytes]) -> tuple[float, str | None]:
        """Highest cosine of at least the limit and its licence; the first template wins a tie."""
        if self.prefix.keys().isdisjoint(words):
            return 0.0, None
        vector = self.vector(words)
        norm = math.sqrt(sum(w * w for w in vector.values()))
        found = (0.0, None)
        for name, unit in zip(self.names, self.vectors):
            score = sum(w * vector[x] for x, w in unit.items() if x in vector) / norm
            if score >= self.cosine and score > found[0] + 1e-12:
                found = (min(1.0, score), name)
        return found

    def windows(self, words: list[bytes], place: int, hits: list[int]) -> Iterator[tuple[float, int]]:
        """Cosine and start of the best window of each run of windows that reach the limit.

        Windows have as many words as the template; those without a word of its prefix, at ``hits``, cannot reach the limit.
        """
        unit, size = self.vectors[place], self.sizes[place]
        counts: dict[bytes, int] = {}
        dot = square = 0.0
        at, run = -1, None  # first word of the window in ``counts``, best of the run

        def change(word: bytes, by: int) -> None:
            nonlocal dot, square
            n = counts.get(word, 0)
            weight = self.weight(word)
            old = (1 + math.log(n)) * weight if n else 0.0
            new = (1 + math.log(n + by)) * weight if n + by else 0.0
            counts[word] = n + by
            square += new * new - old * old
            if word in unit:
                dot += (new - old) * unit[word]

        for hit in hits:
            for start in range(max(0, hit - size + 1, at + 1), min(hit, len(words) - size) + 1):
                if start == at + 1 and at >= 0:
                    change(words[at], -1)
                    change(words[at + size], 1)
                else:
                    if run:
                        yield run
                    counts.clear()
                    dot, square, run = 0.0, 0.0, None
                    for word in words[start:start + size]:
                        change(word, 1)
                at = start
                score = min(1.0, dot / math.sqrt(square)) if square > 1e-9 else 0.0
                if score >= self.cosine:
                    run = (score, start) if run is None or score > run[0] + 1e-9 else run
                elif run:
                    yield run
                    run = None
        if run:
            yield run

    def scan(self, text: bytes | None) -> tuple[float, str | None, float]:
        """Best piece's score and licence, and the share of the text's words that stand in such pieces."""
        words = terms(text)
        hits: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            for place in self.prefix.get(word, ()):
                hits.setdefault(place, []).append(at)
        if not hits:
            return 0.0, None, 0.0
        pieces, at = [(*self.best(words), 0, len(words))], 0
        for line in text.splitlines():
            own = terms(line)
            score, name = self.best(own)
            pieces.append((score, name, at, at + len(own)))
            if name is None and len(own) > 8:
                start = at
                for part in line.replace(b"? ", b". ").replace(b"! ", b". ").split(b". "):
                    inside = terms(part)
                    pieces.append((*self.best(inside), start, start + len(inside)))
                    start += len(inside)
            at += len(own)
        for place in sorted(hits):
            size = self.sizes[place]
            pieces += [(score, self.names[place], start, start + size) for score, start in self.windows(words, place, hits[place])]
        found, covered = (0.0, None), np.zeros(len(words), bool)
        for score, name, start, end in pieces:
            if name is not None:
                covered[start:end] = True
                if score > found[0] + 1e-9:
                    found = score, name
        return *found, float(covered.mean())


def parents(path: Column) -> Column:
    """The directories above a path, nearest first, the root ``''`` last; a null path has none."""
    parts = F.split(F.trim(path), "/")
    depth = F.size(parts)
    return F.when(path.isNotNull(), F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, 1, depth - i), "/")))


def license_scan(docs: DataFrame, path: Column, templates: tuple = TEMPLATES, cosine: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; repeated rows too): doc_id, path, license, basis, score.

    ``basis`` is ``own`` for a matching header (wrapped or not), ``file`` for a licence file (named like one, or mostly licence statements),
    ``inherited`` for the licence of the nearest directory above with a licence file, ``none`` otherwise. Where a directory
    holds several licence files, the licence of the highest score holds, the first by name among equals. Null and blank texts
    have no licence of their own; a null path inherits nothing. Directories are joined once each, not once per document.
    """
    source = docs.select("doc_id", path.alias("path"), F.col("text").cast("binary").alias("text"))
    frequencies, documents = document_frequencies(source, slots=template_slots(templates))
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(templates, frequencies, documents, cosine))

    @F.pandas_udf("struct<score: double, license: string, share: double>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.scan(t) for t in texts], columns=["score", "license", "share"])

    folder = F.coalesce(F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1), F.lit(""))
    stem = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*\z", 1))
    found = stage(source.withColumn("found", scan("text")).select("doc_id", "path", F.when(F.col("path").isNotNull(), folder).alias("folder"), stem.alias("stem"), "found.*"), "licenses")
    is_file = F.col("license").isNotNull() & ((F.col("share") >= file_share) | F.coalesce(F.col("stem").isin(*FILE_NAMES), F.lit(False)))
    held = found.where(is_file & F.col("folder").isNotNull()).groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("rank"), "license")).alias("best"))
    held = held.select(F.col("folder").alias("above"), F.col("best.license").alias("given"))
    folders = found.select("folder").where("folder IS NOT NULL").distinct()
    steps = folders.select("folder", F.posexplode(F.concat(F.array("folder"), F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(parents(F.col("folder"))))).alias("up", "above"))
    nearest = steps.join(held, "above").groupBy("folder").agg(F.min(F.struct("up", "given")).alias("near")).select("folder", "near.given")
    basis = F.when(is_file, "file").when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path", "score"), F.lit(SALTS)).cast("int"))
    return found.join(salted, ["folder", "salt"], "left").select("doc_id", "path", F.coalesce("license", "given").alias("license"), basis.alias("basis"), "score")
