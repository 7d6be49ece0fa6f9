"""License scans (operator 9): sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Document frequencies of all words are counted over all files by aggregation and written. A file's header notice is looked for in every line
and in every run of as many words as a template has, over the whole text, so it may be wrapped or stand within a longer one: the part's TF-IDF vector
is compared with each template's, and the best cosine of at least ``min_cosine`` declares the licence. A file named as a licence file (LICENSE, COPYING, NOTICE, with any suffix) also compares its whole text, and declares the licence of its directory. Files that
declare none inherit that of their nearest ancestor directory that has one: the distinct directories' ancestors are joined with those of licence files by path.

Workers know the frequencies of the templates' words only. With them they find the candidates: parts of a text whose cosine may reach the least one,
and the text's best, whatever their other words weigh (1 at least, as words of all files; as words of one file at most). The other words of candidates are then
joined with the written frequencies, so each has its true weight.

Only counts of the templates' words reach the driver, a few hundred whatever the data.

Defined results: null and empty texts declare nothing; a null path has no directory and inherits nothing. Equal cosines go to the template
that comes first; several licence files of one directory to the best cosine, then the name first in order. Repeated rows are files of their own
and count as often in frequencies. Extra columns are not read, whatever their names, and not returned. Texts are read whole, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolens.llm.common import materialise

MIN_COSINE = 0.75
#: The Creative Commons family: codes and names, versions and how they are called.
CC = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
CC_VERSIONS = (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))
#: Names, kinds and versions of the GNU licences, whose headers differ in these only.
GNU = (("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))
GNU_TERMS = (
    "you can redistribute it and/or modify it under the terms of the GNU",
    "General Public License as published by the Free Software Foundation, either version",
    "of the License, or (at your option) any later version.",
)
#: Titles of whole licence texts, and notices of common licences (fixed values). Of templates that fit as well, the first counts.
TEMPLATES = (
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Artistic-1.0", "The Artistic License Preamble The intent of this document is to state the conditions under which a Package may be copied"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    *((name, f"This {what} is free software: {GNU_TERMS[0]} {kind}{GNU_TERMS[1]} {version} {GNU_TERMS[2]}") for what in ("program", "library") for name, kind, version in GNU),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-2-Clause", "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *((f"CC-{code}-{version}", text) for code, name in CC for version, port in CC_VERSIONS for text in (f"This work is licensed under a Creative Commons {name} {version} {port} License.", f"Licensed under CC {code} {version}.")),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License."),
    *((f"GFDL-{v}", f"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {v} or any later version published by the Free Software Foundation") for v in ("1.2", "1.3")),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
#: For rounding, where candidates are chosen.
SLACK = 1e-9
#: Distinct words that a task counts before it hands them on.
PARTIAL_WORDS = 100_000
CANDIDATES = pa.list_(pa.struct({"template": pa.int32(), "dot": pa.float64(), "square": pa.float64(), "outside": pa.list_(pa.struct({"word": pa.string(), "k": pa.int32()}))}))
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Candidate(NamedTuple):
    """A part of a text: its closest template, their scalar product, its square in template words, and its other words with their counts."""

    template: int
    dot: float
    square: float
    outside: tuple[tuple[str, int], ...]

    def cosine(self, weight: Callable[[str], float]) -> float:
        return self.dot / math.sqrt(self.square + sum((k * weight(w)) ** 2 for w, k in self.outside))


class Scanner:
    """Templates with weights from document frequencies of their words over n files."""

    def __init__(self, frequencies: dict[str, int], n: int, templates=TEMPLATES, min_cosine: float = MIN_COSINE):
        self.idf = idf = lambda df: math.log((1 + n) / (1 + df)) + 1
        self.frequencies = frequencies
        self.names, self.min_cosine = [name for name, _ in templates], min_cosine
        counts = [Counter(tokens(text)) for _, text in templates]
        self.lengths = [c.total() for c in counts]
        self.ids = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
        self.weights = [idf(frequencies.get(w, 0)) for w in self.ids]
        #: The most that a word of a file can weigh.
        self.rarest = idf(1) if n else 1.0
        self.matrix = np.zeros((len(templates), len(self.ids)))
        for row, c in zip(self.matrix, counts):
            for w, k in c.items():
                row[self.ids[w]] = k * self.weights[self.ids[w]]
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)

    def candidate(self, words: list[str]) -> Candidate | None:
        """The closest template of a part of a text, if its cosine can be large enough."""
        known = Counter([w for w in words if w in self.ids])
        if not known:
            return None
        inside = {self.ids[w]: k * self.weights[self.ids[w]] for w, k in known.items()}
        square = sum(x * x for x in inside.values())
        # Words outside add at least their number; a part that can't reach the cosine even if all inside fits is done.
        if square < (1 - SLACK) * self.min_cosine**2 * (square + len(words) - known.total()):
            return None
        outside = Counter([w for w in words if w not in self.ids])
        at = list(inside)
        dots = self.matrix[:, at] @ np.array([inside[i] for i in at])
        i = int(np.argmax(dots))
        found = Candidate(i, float(dots[i]), square, tuple(sorted(outside.items())))
        return found if found.cosine(lambda w: 1.0) >= self.min_cosine * (1 - SLACK) else None

    def best(self, line: str) -> tuple[float, int] | None:
        """Cosine and template of a line, if it is close enough to one, by the frequencies at hand."""
        found = self.candidate(tokens(line))
        cosine = found.cosine(lambda w: self.idf(self.frequencies.get(w, 0))) if found else 0.0
        return (cosine, found.template) if found and cosine >= self.min_cosine else None

    def viable(self, words: list[str]) -> list[int]:
        """Templates of which the words hold enough: no part's cosine exceeds the norm of the template in the words there are."""
        at = [i for w in set(words) if (i := self.ids.get(w)) is not None]
        return np.flatnonzero((self.matrix[:, at] ** 2).sum(axis=1) >= (1 - SLACK) * self.min_cosine**2).tolist()

    def windows(self, words: list[str], near: list[int]) -> Iterator[Candidate]:
        """Candidates among the runs of words as long as a template, whatever the lines."""
        ids = np.array([self.ids.get(w, -1) for w in words])
        weights = np.array([*self.weights, 1.0])  # at -1: words outside add 1 to the square at least
        square = np.concatenate([[0], np.cumsum(weights[ids] ** 2)])
        inside = np.append(self.matrix, np.zeros((len(self.matrix), 1)), axis=1) * weights
        surely = 0.0
        for t in near:
            n = min(self.lengths[t], len(words))
            dot = np.concatenate([[0], np.cumsum(inside[t][ids])])
            # Repeated words have a larger square than this, so no cosine is larger.
            most = (dot[n:] - dot[:-n]) / np.sqrt(square[n:] - square[:-n])
            hits = np.flatnonzero(most >= self.min_cosine * (1 - SLACK))
            for i in hits[np.argsort(-most[hits], kind="stable")].tolist():
                if most[i] < surely * (1 - SLACK):
                    break
                if c := self.candidate(words[i : i + n]):
                    surely = max(surely, c.cosine(lambda w: self.rarest))
                    yield c

    def candidates(self, text: str | None, whole: bool) -> list[Candidate]:
        """What may declare the text's licence: all whose cosine can be the largest one."""
        words = tokens(text) if text else []
        near = self.viable(words)
        if not near:
            return []
        parts = [tokens(line) for line in text.split("\n")] + [words] * whole
        found = dict.fromkeys(c for part in parts if (c := self.candidate(part)))
        found |= dict.fromkeys(self.windows(words, near))
        if len(found) < 2:
            return list(found)
        surely = max(c.cosine(lambda w: self.rarest) for c in found)
        return [c for c in found if c.cosine(lambda w: 1.0) >= surely * (1 - SLACK)]


def frequencies(files: DataFrame, text_col: str) -> DataFrame:
    """word, n: in how many files each word occurs; the word "" stands for all files."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        rows = lambda: pa.record_batch({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[""] += 1
                counts.update(set(tokens(text)) if text else ())
                if len(counts) > PARTIAL_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    return files.select(text_col).mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def weigh(found: DataFrame, words: DataFrame, n: int, names: list[str], min_cosine: float) -> DataFrame:
    """__row, own, score of the rows that declare a licence, from found's candidates (__row, c)."""
    each = found.where(F.size("c") > 0).select("__row", F.posexplode("c").alias("__at", "c")).select("__row", "__at", "c.template", "c.dot", "c.square", F.explode_outer("c.outside").alias("o"))
    idf = F.log((1 + n) / (1 + F.coalesce(F.col("n"), F.lit(0)))) + 1
    cosine = F.first("dot") / F.sqrt(F.first("square") + F.coalesce(F.sum((F.col("o.k") * idf) ** 2), F.lit(0.0)))
    return (
        each.join(words, F.col("o.word") == F.col("word"), "left")
        .groupBy("__row", "__at").agg(F.first("template").alias("template"), F.round(cosine, 12).alias("score"))
        .where(F.col("score") >= min_cosine)
        .groupBy("__row").agg(F.min(F.struct((-F.col("score")).alias("s"), "template")).alias("b"))
        .select("__row", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("b.template") + 1).alias("own"), (-F.col("b.s")).alias("score"))
    )


def _parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def inherit(files: DataFrame) -> DataFrame:
    """files (path, own, score, ...) with license and license_dir (null: declared by the file itself, or none)."""
    name, directory = F.element_at(F.split("path", "/"), -1), _parent(F.col("path"))
    placed = files.withColumn("__dir", directory)
    # Written, so that joins have plain tables on both sides and adaptive execution can split a folder, or the root, of most files.
    by_dir = materialise(
        placed.where(name.rlike(LICENSE_FILE) & F.col("own").isNotNull())
        .groupBy("__dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), name.alias("n"), "own")).alias("__best"))
        .select(F.col("__dir").alias("__anc"), F.col("__best.own").alias("license")),
        "licensed",
    )
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    nearest = materialise(
        placed.select("__dir").where(F.col("__dir").isNotNull()).distinct().withColumn("__anc", F.explode(F.array_distinct(above))).join(by_dir, "__anc").groupBy("__dir")
        .agg(F.max(F.struct(F.length("__anc").alias("depth"), F.col("__anc").alias("dir"), "license")).alias("__near")),
        "nearest",
    )
    return placed.join(nearest, "__dir", "left").select(
        *files.columns,
        F.coalesce("own", "__near.license").alias("license"),
        F.when(F.col("own").isNull(), F.col("__near.dir")).alias("license_dir"),
    )


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates=TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """doc_id, path, own (licence the file declares), score, license, license_dir for each row of files."""
    words = materialise(frequencies(files, text_col), "words")
    wanted = sorted({"", *(w for _, t in templates for w in tokens(t))})
    counts = {r["word"]: r["n"] for r in words.where(F.col("word").isin(wanted)).collect()}
    n = counts.pop("", 0)
    scanner = Scanner(counts, n, templates, min_cosine)

    @F.arrow_udf("array<struct<template:int,dot:double,square:double,outside:array<struct<word:string,k:int>>>>")
    def scanned(texts: pa.Array, whole: pa.Array) -> pa.Array:
        rows = [
            [{"template": c.template, "dot": c.dot, "square": c.square, "outside": [{"word": w, "k": k} for w, k in c.outside]} for c in scanner.candidates(t, bool(w))]
            for t, w in zip(texts.to_pylist(), whole.to_pylist())
        ]
        return pa.array(rows, CANDIDATES)

    whole = F.coalesce(F.element_at(F.split(path_col, "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    found = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), scanned(F.col(text_col), whole).alias("c"), F.monotonically_increasing_id().alias("__row"))
    # Texts are scanned once; candidates, licence files and heirs are read from written results.
    found = materialise(found, "candidates")
    own = found.join(weigh(found, words, n, scanner.names, min_cosine), "__row", "left").select("doc_id", "path", "own", F.coalesce("score", F.lit(0.0)).alias("score"))
    return inherit(materialise(own, "licences"))
