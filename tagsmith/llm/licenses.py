"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

A template of m shingles is looked for in windows of 2 L shingles that start at every L-th shingle of a
document, L the least power of two not under m. So each run of L shingles lies within a window, and a
template with the wanted containment has at least a known similarity with it. Bands of one minimum each are
as many as make the chance of no common band at that similarity less than MISS. Minima of long windows come
from those of shorter ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tagsmith.llm.common import add_columns, fresh
from tagsmith.llm.decontamination import words
from tagsmith.llm.ngram_join import rolling

#: Words of a shingle, share of a template's shingles that a window must hold, chance to miss one.
SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-5
#: Shingles that are hashed at once.
AT_ONCE = 1 << 19

# Public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.")),
    ("BSD-3-Clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    ("MIT", "Released under the MIT License."),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use,"
        " copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


class Templates:
    """Shingles, window classes and band minima of license templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...], containment: float = CONTAINMENT, miss: float = MISS) -> None:
        self.containment = containment
        self.names = [n for n, _ in templates]
        split = [words(t) for _, t in templates]
        if short := [n for n, w in zip(self.names, split, strict=True) if len(w) < SHINGLE]:
            raise ValueError(f"templates need {SHINGLE} words: {short}")
        self.shingles = [np.unique(rolling(w, SHINGLE)) for w in split]
        sizes = [len(s) for s in self.shingles]
        self.length = [1 << max(0, (m - 1).bit_length()) for m in sizes]
        # the least similarity of a template and a window that holds enough of it
        held = [math.ceil(containment * m - 1e-9) for m in sizes]
        least = min(h / (2 * n + m - h) for h, n, m in zip(held, self.length, sizes, strict=True))
        self.bands = math.ceil(math.log(miss) / math.log(1 - least))
        rng = np.random.default_rng(4)
        self.factors = rng.integers(0, 1 << 63, (self.bands, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.minima = np.array([[self._hash(s, b).min() for s in self.shingles] for b in range(self.bands)])

    def _hash(self, x: np.ndarray, band: int) -> np.ndarray:
        a, c = self.factors[band]
        return (x ^ (x >> np.uint64(31))) * a ^ c

    def candidates(self, stream: np.ndarray, real: np.ndarray) -> list[tuple[int, int]]:
        """(first shingle of a window, template) with a band in common. stream: documents, each filled up to whole
        windows of the longest class; real: which shingles aren't filling."""
        found: set[tuple[int, int]] = set()
        top = np.uint64(2**64 - 1)
        lengths = sorted(set(self.length))
        for band in range(self.bands):
            level, length = np.where(real, self._hash(stream, band), top), 1
            while True:
                if length in lengths:
                    window = np.minimum(level, np.r_[level[1:], top])
                    of = [t for t, n in enumerate(self.length) if n == length]
                    hits = np.flatnonzero(np.isin(window, self.minima[band, of]))
                    for i, v in zip(hits.tolist(), window[hits].tolist(), strict=True):
                        found.update((i * length, t) for t in of if self.minima[band, t] == v)
                if length >= lengths[-1]:
                    break
                level, length = np.minimum(level[::2], level[1::2]), 2 * length
        return sorted(found)

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        """The licenses of each text: license, containment, first_word, n_words; each license once, by its best window."""
        longest = max(self.length)
        out: list[list[dict]] = [[] for _ in texts]
        parts, at, size = [], [], 0

        def flush() -> None:
            starts = np.cumsum([0, *(-(-len(p) // longest) * longest for p in parts)])
            stream, real = np.zeros(int(starts[-1]), np.uint64), np.zeros(int(starts[-1]), bool)
            for s, p in zip(starts.tolist(), parts, strict=False):
                stream[s : s + len(p)] = p
                real[s : s + len(p)] = True
            best: dict[tuple[int, str], tuple[float, int, int]] = {}
            for first, t in self.candidates(stream, real):
                d = int(np.searchsorted(starts, first, side="right") - 1)
                begin = first - int(starts[d])
                window = parts[d][begin : begin + 2 * self.length[t]]
                share = float(np.isin(self.shingles[t], window).sum() / len(self.shingles[t]))
                if share >= self.containment - 1e-9:
                    inside = np.flatnonzero(np.isin(window, self.shingles[t]))
                    got = (share, -(begin + int(inside[0])), int(inside[-1] - inside[0]) + SHINGLE)
                    key = (at[d], self.names[t])
                    best[key] = max(best.get(key, got), got)
            for (row, name), (share, place, n) in sorted(best.items()):
                out[row].append({"license": name, "containment": share, "first_word": -place, "n_words": n})

        for i, text in enumerate(texts):
            w = words(text)
            if len(w) >= SHINGLE:
                parts.append(rolling(w, SHINGLE))
                at.append(i)
                size += len(w)
            if parts and (size >= AT_ONCE or i == len(texts) - 1):
                flush()
                parts, at, size = [], [], 0
        if parts:
            flush()
        return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, name: str = "licenses") -> DataFrame:
    """The rows of `docs` (text) with a column of the licenses found: license, containment, first_word, n_words.

    Words are runs of digits, letters and all beyond ASCII, without case; a license is found where a window
    holds the share `containment` of a template's distinct shingles. Of several templates or places of a
    license the best counts, of equal ones the first. Sorted by license. Null, empty and short texts have
    none. Texts are read whole, each by itself, so repeated rows, hot lines, empty tables and further columns
    do no harm; nothing is shuffled. The templates go to the tasks whole: they are a parameter, not data.
    """
    if name in docs.columns:
        raise ValueError(f"{name} is a column already")
    side = Templates(templates, containment)

    def make() -> Callable:
        return lambda b: {new: side.scan(b["text"])}

    new = fresh(docs, "found")
    out = add_columns(docs, ["text"], make, f"`{new}` array<struct<license:string,containment:double,first_word:int,n_words:int>>")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"`{new}`").alias(name))
