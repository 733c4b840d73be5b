"""License scans: winnowed template fingerprints in an inverted index pick candidates, banded alignment measures them.

The templates are a fixed list, so their index is of fixed size and travels with the tasks; documents are mapped over
and never shuffled. Every template's word k-grams are winnowed; every k-gram of a document is looked up, so a match as long as
one winnowing window and one k-gram is never missed. Besides, of each template one word more is looked up than a passage of
LEAST_COVERAGE may lack, the longest ones: every such passage holds one of them, whatever was put in or changed. A candidate
is a template and the diagonal of such a k-gram or word, unless a passage found before holds it or too few words around it are
the template's; around it a banded local alignment, kept off the passages found before, counts matched
template words and gives the span of document words. So passages that follow each other closely are each reported. Of
overlapping spans of different templates the one with more matched words is reported.

Null and empty texts have no matches, and documents without a match give no row. Repeated rows give their matches each
time; ties between templates go to the first name. Only id and text are read, so extra columns cannot clash. An empty
table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common

GRAM, WINDOW, BAND = 3, 2, 8
LEAST_COVERAGE = 0.8
#: Notices and opening paragraphs of common licenses (public texts, fixed values).
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-notice": "Released under the MIT License",
    "mit-header": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
WORD = re.compile(rb"[a-z0-9]+")


def tokens(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def winnowed(keys: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of the rightmost least hash of every window of consecutive k-grams."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = set()
    for at in range(max(1, len(keys) - window + 1)):
        part = mixed[at : at + window]
        out.add(at + len(part) - 1 - int(part[::-1].argmin()))
    return sorted(out)


class Index:
    """The templates' words, numbered, and their winnowed k-grams: key to (template, position)."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW, least: float = LEAST_COVERAGE):
        self.names, self.gram = sorted(templates), gram
        texts = [tokens(templates[n]) for n in self.names]
        self.number: dict[bytes, int] = {}
        self.texts = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in t]) for t in texts]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.texts):
            keys = self.keys(ids)
            for at in winnowed(keys, window) if len(keys) else []:
                self.places.setdefault(int(keys[at]), []).append((t, at))
        self.known = np.array(sorted(self.places))
        self.words: dict[int, list[tuple[int, int]]] = {}
        #: Of each template: which word numbers it holds.
        self.holds = np.zeros((len(texts), len(self.number) + 1), bool)
        for t, (own, ids) in enumerate(zip(texts, self.texts, strict=True)):
            self.holds[t, ids] = True
            spare = sum(n >= least * len(own) for n in range(len(own)))  # words that a passage may lack
            for at in sorted(range(len(own)), key=lambda i: (-len(own[i]), i))[: spare + 1]:
                self.words.setdefault(int(ids[at]), []).append((t, at))
        self.seeds = np.isin(np.arange(len(self.number) + 1), sorted(self.words))

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """One number for each k-gram: the words' numbers in a row."""
        n, base = len(ids) - self.gram + 1, len(self.number) + 2
        out = np.zeros(max(n, 0), np.int64)
        for k in range(self.gram):
            out = out * base + ids[k : k + len(out)]
        return out


def aligned(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched template words, and the first and the end word of the span, by local alignment within the band around the diagonal.

    A match scores 2, a mismatch or a gap loses 1. Cell: (score, matched, first word)."""
    best, above = (0, 0, 0, 0), {}
    for i, t in enumerate(template):
        row = {}
        for j in range(max(0, i + diagonal - band), min(len(words), i + diagonal + band + 1)):
            s, m, first = above.get(j - 1, (0, 0, j))
            if not s:
                m, first = 0, j
            cell = (s + 2, m + 1, first) if t == words[j] else (s - 1, m, first)
            for s, m, first in (above.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, first)
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = (*cell, j + 1)
        above = row
    return best[1], best[2], best[3]


def found(index: Index, text: str | None, least: float = LEAST_COVERAGE, band: int = BAND) -> list[tuple[str, int, float, int, int]]:
    """(template, matched words, coverage, first word, end word) of every license passage."""
    words = tokens(text)
    ids = np.fromiter(map(index.number.get, words, [0] * len(words)), np.int64, len(words))
    keys = index.keys(ids)
    keep = ids[: len(keys)] > 0
    for k in range(1, index.gram):
        keep &= ids[k : k + len(keys)] > 0
    seeded = index.seeds[ids]
    seeded[: len(keys)] |= keep & np.isin(keys, index.known)
    out, spans, tried = [], [[] for _ in index.texts], set()
    for j in np.flatnonzero(seeded).tolist():
        grams = index.places.get(int(keys[j]), []) if j < len(keys) and keep[j] else []
        for t, i in (*grams, *index.words.get(int(ids[j]), [])):
            template, diagonal = index.texts[t], j - i
            while not any(a <= j < b for a, b in spans[t][-2 * band :]):
                near = spans[t][-2 * band :]
                low = max(0, diagonal - band, *(b for _, b in near if b <= j))
                high = min(len(ids), diagonal + len(template) + band, *(a for a, _ in near if a > j))
                if (t, diagonal, low, high) in tried:
                    break
                tried.add((t, diagonal, low, high))
                if index.holds[t, ids[low:high]].sum() < least * len(template):
                    break
                matched, first, end = aligned(template, ids[low:high], diagonal - low, band)
                if matched < least * len(template):
                    break
                spans[t].append((low + first, low + end))
                out.append((index.names[t], matched, matched / len(template), low + first, low + end))
    out.sort(key=lambda m: (-m[1], m[0], m[3]))
    kept: list = []
    for m in out:
        if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COVERAGE) -> DataFrame:
    """A row for each license passage: template, matched words, coverage, and its span in words of [a-z0-9]+."""
    index = Index(templates or TEMPLATES, least=least)

    def rows(ids: list, texts: list) -> list:
        out = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in found(index, t, least)]
        return list(zip(*out, strict=True)) if out else [[]] * 6

    return common.map_rows(docs.select(id_col, text_col), rows, f"{id_col} bigint, license string, matched_words bigint, coverage double, span_start bigint, span_end bigint")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.read_table(spark, sf_dir, "documents"))
