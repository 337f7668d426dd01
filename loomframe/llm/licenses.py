"""License scans: MinHash bands over overlapping text windows, then exact containment.

Templates are word sequences (A-Z lower-cased; words of digits, letters and non-ASCII
characters).  For every template length, texts are cut into windows of one and a half
times that length every half length, so that an occurrence lies whole in some window.
A window whose least shingle hashes agree with a template's in any band is a candidate;
with `BANDS` bands of one row a window whose share of the template's shingles reaches `CONTAINMENT` is missed with
probability below 1e-5 (`miss` gives the bound of each template; one-shingle notices are the worst).  Candidates are verified by the exact share of the template's
distinct shingles in the window, which must reach `CONTAINMENT`.

Shingles have five words, or the whole template's if it is shorter.  Defined cases:
null, empty and wordless texts have no license; equal texts, equal rows; neighbouring windows that
verify for one template count as one match; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import ALNUM_TABLE, mix64, pieces, text_bytes, windows, words

SHINGLE, BANDS, CONTAINMENT = 5, 30, 0.8
#: Notices by license, in their public wording.
TEMPLATES = {
    "all-rights-reserved": ["All rights reserved."],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-3.0": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
}


def _hashes(text: str) -> np.ndarray:
    data, off = text_bytes(pa.array([text]))
    return words(data, off, ALNUM_TABLE)[0]


def _shingles(h: np.ndarray, per: np.ndarray, width: int):
    """Shingles of exactly `width` words and offsets of rows; shorter rows have none."""
    s, off = windows(h, per, width)
    short = (np.diff(per) < width) & (np.diff(off) > 0)
    if short.any():
        keep = np.ones(len(s), bool)
        keep[off[:-1][short]] = False
        n = np.diff(off)
        n[short] = 0
        s, off = s[keep], np.concatenate([[0], np.cumsum(n)])
    return s, off


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, bands: int = BANDS, containment: float = CONTAINMENT):
        rng = np.random.default_rng(77)
        self.xor = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        self.mul = rng.integers(0, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.containment = containment
        #: by shingle width, then by template length
        self.classes: dict[int, dict[int, list[tuple[str, np.ndarray, np.ndarray]]]] = {}
        for name, texts in templates.items():
            for t in texts:
                h = _hashes(t)
                width = min(SHINGLE, len(h))
                s = np.unique(_shingles(h, np.array([0, len(h)]), width)[0])
                self.classes.setdefault(width, {}).setdefault(len(h), []).append((name, s, self._least(s)))

    def _minima(self, s: np.ndarray) -> np.ndarray:
        return ((s.ravel()[None] ^ self.xor[:, None]) * self.mul[:, None]).reshape(len(self.xor), -1)

    def _least(self, s: np.ndarray) -> np.ndarray:
        return self._minima(s).min(1)

    def scan(self, texts: pa.Array) -> list[list[tuple[str, int, int, float]]]:
        """(license, first word, word after, containment) matches of each text."""
        data, off = text_bytes(texts)
        out: list[list] = [[] for _ in range(len(off) - 1)]
        for a, b in pieces(off, 1 << 20):
            h, _, _, per = words(data[off[a] : off[b]], off[a : b + 1] - off[a], ALNUM_TABLE)
            for width, sizes in self.classes.items():
                s, so = _shingles(h, per, width)
                if not len(s):
                    continue
                n = np.diff(so)
                cut = {size: self._windows(n, so, size, width) for size in sizes}
                hits = {size: np.zeros((len(t), len(cut[size][0])), bool) for size, t in sizes.items()}
                padded = np.append(s, np.uint64(0))
                for i in range(len(self.xor)):  # hashes of a band serve all lengths
                    v = (padded ^ self.xor[i]) * self.mul[i]
                    v[-1] = np.uint64(0xFFFFFFFFFFFFFFFF)
                    for size, templates in sizes.items():
                        least = np.minimum.reduceat(v, cut[size][3])[::2]
                        for t, (_, _, m) in enumerate(templates):
                            hits[size][t] |= least == m[i]
                for size, templates in sizes.items():
                    row, at, end, _ = cut[size]
                    for t, w in zip(*np.nonzero(hits[size])):
                        name, want, _ = templates[t]
                        have = s[at[w] : end[w]]
                        share = float(np.isin(want, have).mean())
                        if share >= self.containment:
                            inside = np.flatnonzero(np.isin(have, want))
                            first = int(at[w] - so[row[w]] + inside[0])
                            last = int(at[w] - so[row[w]] + inside[-1] + width)
                            out[a + row[w]].append((name, first, last, share))
        return [_joined(m) for m in out]

    @staticmethod
    def _windows(n: np.ndarray, so: np.ndarray, size: int, width: int):
        """(row, first shingle, shingle after, both in turn) of the windows for templates of `size` words; a shorter text is one window."""
        length, step = length_of(size, width), max(1, size // 2)
        count = np.where(n > 0, np.maximum(1, -(-(n - length) // step) + 1), 0)
        row = np.repeat(np.arange(len(n)), count)
        at = so[row] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
        end = np.minimum(at + length, so[row + 1])
        return row, at, end, np.column_stack([at, end]).ravel()


def length_of(size: int, width: int) -> int:
    """Shingles of a window for templates of `size` words."""
    return max(1, size * 3 // 2 - width + 1)


def miss(words_: int, shingles: int, bands: int = BANDS, containment: float = CONTAINMENT) -> float:
    """Greatest probability that no band retrieves a window that holds the asked share of a template."""
    from math import ceil

    held = ceil(containment * shingles - 1e-9)
    return (1 - held / (length_of(words_, min(SHINGLE, words_)) + shingles - held)) ** bands


def _joined(matches: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Overlapping matches of one license are one."""
    out: list[tuple[str, int, int, float]] = []
    for name, first, last, share in sorted(matches):
        if out and out[-1][0] == name and first < out[-1][2]:
            p = out.pop()
            first, last, share = p[1], max(last, p[2]), max(share, p[3])
        out.append((name, first, last, share))
    return out


def matches(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """doc_id, found (array of license, first word, word after, containment) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            got = [[{"license": n, "start": s, "end": e, "containment": c} for n, s, e, c in m] for m in scanner.scan(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, shape)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<license:string,start:int,end:int,containment:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (sorted, comma-joined), n_matches, best containment of every document."""
    from pyspark.sql import functions as F

    return matches(docs).select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
        F.size("found").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.col("found.containment")), F.lit(0.0)).alias("best"),
    )
