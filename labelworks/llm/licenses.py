"""License notices in texts: MinHash bands over windows retrieve templates, containment verifies them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelworks.llm.common import LOWER, SPACE, _pieces, mix, prefix_hash, prepare, span_hash

WIDTH = 3  # words of a shingle; notices can be as short as three words
CONTAINED = 0.8  # share of a template's shingles that a window must hold
# A window is up to 1.25 times as long as its template; with 0.8 of the template it has similarity
# 0.8 / (1 + 1.25 - 0.8) = 0.55 or more (0.5 for a template of one shingle): missed with 1e-6 at most.
ROWS, BANDS = 1, 20
HASHES = ROWS * BANDS
CHUNK = 16_384  # words looked at together

# Wordings of public notices. What follows # tells wordings of one license apart.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0#grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a "
    "perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare "
    "Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative "
    "Works in Source or Object form.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "BSD#notice": "Released under the BSD License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring "
    "rights to this work.",
    "CC0-1.0#notice": "Licensed under CC0 1.0 Universal.",
    "CC-BY-4.0#short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0#short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0#long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL": "under the terms of the GNU General Public License",
    "GPL-3.0#preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "AGPL": "GNU Affero General Public License",
    "LGPL": "GNU Lesser General Public License",
    "MIT#licensed": "Licensed under the MIT License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_rng = np.random.Generator(np.random.PCG64(99))
_MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


_PUNCTUATION = re.compile("[\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u3003\u3008-\u3020]")
_INSIDE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_JOINS = np.array([b in b"-.'_" for b in range(256)])


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text without punctuation (runs of letters and digits; a hyphen, point,
    apostrophe or underscore between two of them joins, as in by-nc and 2.0), and for
    each the number of words parted by white space before the one that it stands in."""
    text = text or ""
    if not text.isascii():
        text = _PUNCTUATION.sub(",", text)
    hashes, places, before = [], [], 0
    for piece in _pieces(text.encode("utf-8", "surrogatepass").translate(LOWER)):
        a = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(a) + 2, np.int8)
        letters = _INSIDE[a]
        inside[1:-1] = letters
        inside[2:-2] |= letters[:-2] & letters[2:] & _JOINS[a[1:-1]]
        edge = np.diff(inside)
        starts = np.flatnonzero(edge == 1)
        hashes.append(span_hash(prefix_hash(a), starts, np.flatnonzero(edge == -1)))
        dark = ~SPACE[a]
        begins = dark.copy()
        begins[1:] &= ~dark[:-1]
        number = np.cumsum(begins)
        places.append(before + number[starts] - 1)
        before += int(number[-1]) if len(number) else 0
    return np.concatenate(hashes), np.concatenate(places)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of consecutive words in order."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    acc = words[: len(words) - width + 1]
    for i in range(1, width):
        acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + words[i : len(words) - width + 1 + i])
    return acc


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` values in turn (last axis), by doubling."""
    have, out = 1, values
    while have * 2 <= size:
        out = np.minimum(out[..., : out.shape[-1] - have], out[..., have:])
        have *= 2
    if have < size:
        n = values.shape[-1] - size + 1
        out = np.minimum(out[..., :n], out[..., size - have : size - have + n])
    return out


def _bands(low: np.ndarray) -> np.ndarray:
    """Band keys (bands, windows) from minima (hashes, windows)."""
    keys = mix(low[0::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None])
    for i in range(1, ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[i::ROWS])
    return keys


class Scanner:
    """The templates, by number of shingles, with their band keys."""

    def __init__(self, templates: dict[str, str], width: int = WIDTH, contained: float = CONTAINED):
        self.width, self.contained = width, contained
        self.sets: dict[str, np.ndarray] = {}
        self.sizes: dict[int, list[str]] = defaultdict(list)
        for name, text in templates.items():
            s = shingles(words_of(text)[0], width)
            if not len(s):
                raise ValueError(f"template {name} has fewer than {width} words")
            self.sets[name] = np.unique(s)
            self.sizes[len(s)].append(name)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets.values()]))
        self.known_marks = np.zeros(1 << 16, bool)
        self.known_marks[self.known >> np.uint64(48)] = True
        self.tables = {}
        for n, names in self.sizes.items():
            step = max(1, n // 4)
            keys: dict[int, set[str]] = defaultdict(set)
            for name in names:
                low = (self.sets[name][None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1)
                for k in _bands(low[:, None])[:, 0].tolist():
                    keys[k].add(name)
            marks = np.zeros(1 << 16, bool)
            marks[np.array(list(keys), np.uint64) >> np.uint64(48)] = True
            self.tables[n] = (step, n + step, dict(keys), marks)

    def _possible(self, part: np.ndarray) -> set[str]:
        """The templates of which so many shingles stand anywhere in a part of a text that a window could
        hold enough of them."""
        some = part[self.known_marks[part >> np.uint64(48)]]
        here = np.intersect1d(some, self.known)
        if not len(here):
            return set()
        return {name for name, mine in self.sets.items() if np.isin(mine, here).mean() >= self.contained}

    def find(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, word after the last, containment) of the best window of each place; words
        are counted between white space."""
        if not self.sets:
            return []
        words, places = words_of(text)
        all_shingles = shingles(words, self.width)
        found: dict[tuple[str, int], float] = {}
        smallest = min(self.tables)
        for begin in range(0, len(all_shingles), CHUNK):
            reach = max(w for _, w, _, _ in self.tables.values())
            part = all_shingles[begin : begin + CHUNK + reach]
            possible = self._possible(part)
            if not possible:
                continue
            hashed = part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]
            for n, (step, window, keys, marks) in self.tables.items():
                if possible.isdisjoint(self.sizes[n]):
                    continue
                size = min(window, len(part))
                if size < min(n, smallest):
                    continue
                low = _sliding_min(hashed, size)[:, ::step]
                if (low.shape[1] - 1) * step + size < len(part):  # the end of the text
                    low = np.concatenate([low, hashed[:, -size:].min(axis=1, keepdims=True)], axis=1)
                bands = _bands(low)
                rows, cols = np.nonzero(marks[bands >> np.uint64(48)])
                for key, at in zip(bands[rows, cols].tolist(), cols.tolist()):
                    for name in keys.get(key, ()):
                        first = min(at * step, len(part) - size)
                        if (name, begin + first) not in found:
                            mine = self.sets[name]
                            share = np.isin(mine, part[first : first + size]).mean()
                            found[name, begin + first] = float(share) if share >= self.contained else 0.0
        return [
            (name, int(places[a]), int(places[b - 1]) + 1, share)
            for name, a, b, share in self._best(found, all_shingles)
        ]

    def _best(self, found: dict[tuple[str, int], float], all_shingles: np.ndarray) -> list[tuple[str, int, int, float]]:
        out: list[tuple[str, int, int, float]] = []
        for name, first in sorted(k for k, v in found.items() if v):
            window = all_shingles[first : first + self.tables_window(name)]
            inside = np.flatnonzero(np.isin(window, self.sets[name]))
            a, b = first + int(inside[0]), first + int(inside[-1]) + self.width
            if out and out[-1][0] == name and a < out[-1][2]:
                _, a0, b0, share = out[-1]
                out[-1] = (name, min(a, a0), max(b, b0), max(share, found[name, first]))
            else:
                out.append((name, a, b, found[name, first]))
        return out

    def tables_window(self, name: str) -> int:
        return next(self.tables[n][1] for n, names in self.sizes.items() if name in names)


def scanning(templates: dict[str, str], width: int, contained: float):
    @F.pandas_udf("array<struct<license: string, first: long, last: long, containment: double>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates, width, contained)
        for texts in batches:
            yield pd.Series(
                [
                    [dict(zip(("license", "first", "last", "containment"), (m[0].split("#")[0], *m[1:]))) for m in scanner.find(t)]
                    for t in texts
                ]
            )

    return scan


def license_matches(
    docs: DataFrame,
    templates: DataFrame | dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    contained: float = CONTAINED,
) -> DataFrame:
    """(doc_id, matches): for every document the places where a window of its whole text holds at least
    ``contained`` of a template's shingles; first word, word after the last, and the share held.

    ``templates``: a small table (license, text), wordings by name, or none for ``TEMPLATES``; a license may
    have several wordings. Case and punctuation do not count. Matches of one template that overlap are one. Null, empty and shorter texts match nothing. Repeated
    rows get equal results, an empty table an empty one; other columns are not read.
    """
    prepare(docs.sparkSession)
    if isinstance(templates, DataFrame):
        listed = templates.select("license", "text").distinct().orderBy("license", "text").collect()
        templates = {f"{r.license}#{i}": r.text for i, r in enumerate(listed)}
    Scanner(TEMPLATES if templates is None else templates, width, contained)  # an error here, not in a task
    return docs.select(
        F.col(id_col).alias("doc_id"),
        scanning(TEMPLATES if templates is None else templates, width, contained)(F.col(text_col)).alias("matches"),
    )
