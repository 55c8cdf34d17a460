"""License scans: MinHash bands over overlapping windows retrieve license templates.

Words are runs of ASCII letters and digits in lower case; templates and texts
are compared by their runs of ``SHINGLE`` words.  A template of m words is looked
for in windows of three steps, a step being the power of two with
step < m <= 2 * step (at least 4): windows start at every step, so every passage
of m words lies whole in one.  Such a window and a template of five words or more then have a
similarity of at least 0.23, and with ``HASHES`` bands of one minimum each, every
minimum by a hash function of its own, they share a band in all but
0.77 ** HASHES < 1e-6 of the cases.  Templates of fewer words have one or two
shingles, all of which must occur: their first is looked up directly.

What is retrieved is verified exactly: the share of the template's shingles that
the window holds must reach ``CONTAINED`` per cent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tallyweave.llm.common import hash_words, id_and_text, map_rows, mix64

SHINGLE = 3
HASHES = 56
CONTAINED = 80
#: Templates of fewer words are looked up by a shingle.
DIRECT = 5
STEPS = (4, 8, 16, 32, 64, 128)
#: Characters of texts handled together.
CHUNK = 4_000_000

_FOLD = bytes(
    ord(chr(i).lower()) if i < 0x80 and chr(i).isalnum() else 0x20 for i in range(256))

#: Notices by license: short references and the beginnings of usual file headers.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "licensed under the GNU General Public License v3",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either version "
        "2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "dedicated to the public domain under CC0 1.0 Universal"),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _shingles(words: list[bytes]) -> np.ndarray:
    h = hash_words(words)
    out = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return out


def _values(h: np.ndarray, turn: int) -> np.ndarray:
    """The ``turn``-th hash function of shingles, 32 bits: half of a scramble of the whole hash."""
    seed = mix64(np.array([turn // 2 + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (mix64(h ^ seed) >> np.uint64(32 * (turn % 2))).astype(np.uint32)


@dataclass
class Index:
    """Templates: their shingles, step, and, by band, which templates have a minimum."""

    names: list[str]
    shingles: list[np.ndarray]
    sizes: list[int]
    steps: list[int]
    bands: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, templates: dict[str, tuple[str, ...]]) -> Index:
        names, shingles, sizes, steps = [], [], [], []
        for name, notices in templates.items():
            for notice in notices:
                words = words_of(notice)
                if not SHINGLE <= len(words) <= 2 * STEPS[-1]:
                    raise ValueError(f"a template of {name} has {len(words)} words")
                names.append(name)
                shingles.append(np.unique(_shingles(words)))
                sizes.append(len(words))
                steps.append(next(s for s in STEPS if len(words) <= 2 * s))
        bands = {}
        for step in set(steps):
            own = [i for i, s in enumerate(steps) if s == step]
            for turn in range(HASHES):
                least = np.array([_values(shingles[i], turn).min() for i in own], np.uint32)
                maybe = np.zeros(4096, bool)
                maybe[least & 4095] = True
                order = np.argsort(least, kind="stable")
                bands[step, turn] = maybe, least[order], np.array(own)[order]
        return cls(names, shingles, sizes, steps, bands)

    def retrieve(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(first shingle of a window, template) that share a band; ``h`` is one run of shingles."""
        found = set()
        for template, size in enumerate(self.sizes):
            if size < DIRECT:
                step = self.steps[template]
                for at in np.flatnonzero(h == self.shingles[template][0]).tolist():
                    # every window that holds the shingle
                    found.update((k * step, template) for k in range(max(0, at // step - 2), at // step + 1))
        used = sorted(set(self.steps))
        for turn in range(HASHES):
            values = _values(h, turn)
            blocks, step = values, 1
            for target in used:
                while step < target:  # minima of blocks, each from two of half the size
                    if len(blocks) % 2:
                        blocks = np.r_[blocks, np.uint32(0xFFFFFFFF)]
                    blocks = np.minimum(blocks[::2], blocks[1::2])
                    step *= 2
                padded = np.r_[blocks, np.full(2, 0xFFFFFFFF, np.uint32)]
                least = np.minimum(np.minimum(padded[:-2], padded[1:-1]), padded[2:])
                maybe, keys, owners = self.bands[target, turn]
                for at in np.flatnonzero(maybe[least & 4095]).tolist():
                    a, b = np.searchsorted(keys, least[at], "left"), np.searchsorted(keys, least[at], "right")
                    found.update((at * step, int(t)) for t in owners[a:b])
        return found

    def window(self, start: int, template: int) -> tuple[int, int]:
        """Shingles of the window that begins at ``start``."""
        return start, start + 3 * self.steps[template] + SHINGLE

    def verify(self, own: np.ndarray, template: int) -> tuple[int, int] | None:
        """Words from the first to the last matching shingle of the best passage, if contained.

        Passages are about as long as the template; the shingles ``own`` of a
        window are searched for the one that holds most of the template's.
        """
        want = self.shingles[template]
        hit = np.isin(own, want)
        if 100 * len(np.unique(own[hit])) < CONTAINED * len(want):
            return None
        places = np.flatnonzero(hit)
        length = self.sizes[template] + self.sizes[template] // 4
        best = None
        for first in places.tolist():
            inside = places[(places >= first) & (places <= first + length - SHINGLE)]
            n = len(np.unique(own[inside]))
            if 100 * n >= CONTAINED * len(want) and (best is None or n > best[0]):
                best = n, first, int(inside[-1])
        return None if best is None else (best[1], best[2] + SHINGLE)


def find(texts: list[str], index: Index) -> list[list[tuple[str, int, int]]]:
    """Per text (license, first word, end word), without findings inside longer ones."""
    cut = [words_of(t) for t in texts]
    # texts are laid end to end; a word of its own between them keeps their shingles apart
    flat = [w for i, ws in enumerate(cut) for w in (*ws, b"\x00")]
    starts = np.r_[0, np.cumsum([len(ws) + 1 for ws in cut])]
    h = _shingles(flat)
    out: list[dict] = [{} for _ in texts]
    for start, template in sorted(index.retrieve(h)):
        low, high = index.window(start, template)
        # the window may reach over several texts; each is verified on its own
        for doc in range(int(np.searchsorted(starts, low, "right") - 1),
                         min(int(np.searchsorted(starts, high, "left")), len(texts))):
            a, b = max(low, int(starts[doc])), min(high, int(starts[doc + 1]) - SHINGLE)
            span = index.verify(h[a:b], template) if b > a else None
            if span:
                at = a - int(starts[doc])
                out[doc][index.names[template], at + span[0], at + span[1]] = True
    return [_outer(list(found)) for found in out]


def _outer(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Findings not strictly inside a longer one, in order; equal spans keep all names."""
    return sorted(
        (f for f in found if not any(
            g[1] <= f[1] and f[2] <= g[2] and (g[2] - g[1]) > (f[2] - f[1]) for g in found)),
        key=lambda f: (f[1], f[2], f[0]))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``doc_id, findings`` per row: license, first word and end word of each notice.

    Null and empty texts have none; repeated rows have equal findings.  Texts of any
    length are looked through whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index.of(templates or TEMPLATES))  # fixed texts

    def run(parts):
        for part in parts:
            texts, out, first = part["text"], [], 0
            while first < len(texts):
                size, last = 0, first
                while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                    size += len(texts[last])
                    last += 1
                out += find(texts[first:last], shared.value)
                first = last
            yield [part["doc_id"], [[{"license": n, "start": a, "end": b} for n, a, b in f] for f in out]]

    return map_rows(id_and_text(docs), run, "doc_id long, findings array<struct<license:string,start:int,end:int>>", 1000)
