"""Operator 2: licence texts, retrieved by MinHash bands over overlapping windows.

Texts are cut to words of letters and digits (ASCII lower-cased; all other ASCII signs separate),
and five of them in a row are a shingle. For each length of a template, in shingles, windows of that length start
at every ``step``-th shingle of the whole text, ``step`` being an eighth of the length, at least one. A
window's MinHash values make ``BANDS`` bands of ``ROWS``; a window that agrees with a template
in a band is compared with it. Windows count from their text's start and see nothing of other
texts, so what is found doesn't depend on how the rows are dealt to tasks.

A window that is accepted holds ``CONTAINED`` of the template's shingles, of which up to two steps,
a quarter from 8 shingles on, may stand in the widening. So the window itself has ``0.8 - 0.25 = 0.55``
of them or more, and ``0.55 / (2 - 0.55) = 0.379`` of all that the two have. Each band is one value,
which agrees with that probability; all 24 miss with ``(1 - 0.379)^24 < 1.2e-5`` at worst. With 0.8
in a row, half a step off, it is ``(1 - 0.584)^24 < 1e-9``. For 5 to 7 shingles, with a step of one,
the worst is 4 of 5 with one on either side, ``(1 - 2/8)^24``, 1 in 1,000; 4 of 5 in a row is
``(1 - 4/6)^24``. Under 5, all shingles must be there, and in the template's order they are met
exactly, as is any full copy with a step of one. The
comparison is exact: the share of the template's shingles inside the window, widened by a
step on both sides, must be ``CONTAINED`` or more, and of each of its ``TELLING`` phrases, which
part it from a sister licence, a shingle that holds the phrase must be among them.

A notice of under five words (``SHORT``) is one shingle of its own length and is met exactly.

The templates are a small fixed list, sent along with the tasks. Null and
empty texts match nothing, and texts under five words short notices only. Repeated rows match each. Empty tables give empty tables. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tractlake.llm.base import Query, table, utf8
from tractlake.llm.neardup import MULTIPLY, SHINGLE, mixed

BANDS, ROWS, CONTAINED = 24, 1, 0.8
#: Shingles of texts, with the gaps between them, that are handled at once.
STEP_SHINGLES = 400_000
NONE = np.uint64(2**64 - 1)

# Licence notices as they are commonly written.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation"
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
}
# Texts that hold most of a template above, or of one another; telling phrases part them.
FURTHER = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation"
    ),
    "bsd-binary-clause": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ),
    "bsd-name-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission."
    ),
    "bsd-source-clause": (
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc0-dedication": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related "
        "and neighboring rights to this software to the public domain worldwide."
    ),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at"
    ),
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation"
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# Of at most SHINGLE words each.
TELLING = {
    "agpl-3.0": ["GNU Affero General", "version 3"],
    "agpl-header": ["GNU Affero General Public License"],
    "apache-2.0-header": ["Apache License, Version 2.0"],
    "epl-2.0-header": ["Eclipse Public License 2.0"],
    "gpl-2.0": ["GNU General", "version 2"],
    "gpl-3.0": ["GNU General", "version 3"],
    "gpl-header": ["GNU General Public License"],
    "lgpl-2.1": ["GNU Lesser General", "version 2.1"],
    "lgpl-3.0": ["GNU Lesser General", "version 3"],
    "lgpl-header": ["GNU Lesser General Public License"],
    "mpl-2.0-header": ["Mozilla Public License", "License, v. 2.0"],
}
SHORT = {
    "all-rights-reserved": "All rights reserved.",
    "cc0-1.0": "CC0 1.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
}

_TABLE = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() else ord(" ") for b in range(0x80)
) + bytes(range(0x80, 0x100))
_SEEDS = np.random.default_rng(20240502).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def word_hashes(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The hash of every word, in order."""
    words = text.translate(_TABLE).split()
    hashes = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        value = known.get(word)
        if value is None:
            value = known[word] = xxhash.xxh3_64_intdigest(word)
        hashes[i] = value
    return hashes


def shingle_hashes(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The hash of every shingle, in order."""
    return shingles_of(word_hashes(text, known))


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    sums = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        sums += hashes[k : n + k] * MULTIPLY[k]
    return mixed(sums)


def first_place(words: np.ndarray, notice: np.ndarray) -> int | None:
    """The first word at which the whole notice stands."""
    at = np.flatnonzero(words[: max(0, len(words) - len(notice) + 1)] == notice[0])
    for k in range(1, len(notice)):
        at = at[words[at + k] == notice[k]]
    return int(at[0]) if len(at) else None


def window_minima(values: np.ndarray, windows: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, the least value of each window) for ``windows``: first places by length.

    Minima over powers of two are made once; a window is covered by two of them.
    """
    reach, powers = 1, [values]
    while 2 * reach <= max(windows, default=0):
        powers.append(np.minimum(powers[-1][:-reach], powers[-1][reach:]))
        reach *= 2
    for length, first in windows.items():
        least = powers[length.bit_length() - 1]
        rest = length - 2 ** (length.bit_length() - 1)
        yield length, np.minimum(least[: len(least) - rest], least[rest:])[first]


def band_values(
    hashes: np.ndarray, gaps: np.ndarray, windows: dict[int, np.ndarray]
) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, length, a hash for each window); ``gaps`` are places without a shingle."""
    for band in range(BANDS):
        totals: dict[int, np.ndarray] = {}
        for row in range(ROWS):
            values = mixed(hashes ^ _SEEDS[band * ROWS + row])
            values[gaps] = NONE
            for length, least in window_minima(values, windows):
                totals[length] = mixed(totals[length]) + least if row else least
        for length, total in totals.items():
            yield band, length, total


class Templates:
    """The templates' shingles, and their band values by length."""

    def __init__(self, texts: dict[str, str], telling: dict[str, list[str]] | None = None):
        self.names = sorted(texts)
        self.shingles, self.by_length, self.bands = [], defaultdict(list), []
        #: For each template, the shingles that hold a phrase, by phrase.
        self.telling: list[list[np.ndarray]] = []
        for i, name in enumerate(self.names):
            hashes = shingle_hashes(texts[name].encode(), {})
            if not len(hashes):
                raise ValueError(f"{name} has under {SHINGLE} words")
            self.shingles.append(np.unique(hashes))
            words = word_hashes(texts[name].encode(), {})
            phrases = [word_hashes(x.encode(), {}) for x in (telling or {}).get(name, [])]
            holds = [
                [first_place(words[j : j + SHINGLE], x) is not None for j in range(len(hashes))]
                for x in phrases
            ]
            self.telling.append([hashes[x] for x in holds])
            self.by_length[len(hashes)].append(i)
            whole = {len(hashes): np.zeros(1, np.int64)}
            self.bands.append([v[0] for _, _, v in band_values(hashes, np.empty(0, np.int64), whole)])
        #: What stands between two texts: a window that starts in one ends before the next.
        self.gap = max(self.by_length, default=1) - 1

    def candidates(self, texts: list[np.ndarray]) -> set[tuple[int, int, int, int]]:
        """(text, template, first shingle, length) of windows that agree with a template in a band."""
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + self.gap) - sizes - self.gap
        gap = np.zeros(self.gap, np.uint64)
        hashes = np.concatenate([part for t in texts for part in (t, gap)])
        within = np.arange(len(hashes)) - np.repeat(starts, sizes + self.gap)
        inside = within < np.repeat(sizes, sizes + self.gap)
        windows = {n: np.flatnonzero(inside & (within % step_of(n) == 0)) for n in self.by_length}
        found = set()
        for band, length, values in band_values(hashes, np.flatnonzero(~inside), windows):
            for t in self.by_length[length]:
                first = windows[length][values == self.bands[t][band]]
                text = np.searchsorted(starts, first, "right") - 1
                at = zip(text.tolist(), within[first].tolist())
                found.update((d, t, place, length) for d, place in at)
        return found


def step_of(length: int) -> int:
    return max(1, length // 8)


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, licence, first_word, last_word, containment): the best place of each match.

    Words count from 0; of several best places, the first is given. With ``texts`` of the
    caller's, these are the only ones.
    """
    short = SHORT if texts is None else {}
    telling = TELLING if texts is None else {}
    texts = {**TEMPLATES, **FURTHER} if texts is None else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, known = Templates(texts, telling), {}
        notices = {name: word_hashes(notice.encode(), {}) for name, notice in short.items()}
        for batch in batches:
            ids, pending, total, brief = [], [], 0, []
            for doc, text in zip(batch.column("doc_id"), batch.column("__text")):
                if len(known) > 500_000:
                    known.clear()
                words = word_hashes(text.as_py(), known)
                for name, notice in notices.items():
                    at = first_place(words, notice)
                    if at is not None:
                        brief.append((doc.as_py(), name, at, at + len(notice) - 1, 1.0))
                hashes = shingles_of(words)
                if not len(hashes):
                    continue
                ids.append(doc.as_py())
                pending.append(hashes)
                total += len(hashes) + templates.gap
                if total >= STEP_SHINGLES:
                    yield matches(templates, ids, pending)
                    ids, pending, total = [], [], 0
            if ids:
                yield matches(templates, ids, pending)
            if brief:
                yield batch_of(brief)

    def matches(templates: Templates, ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for d, t, first, length in templates.candidates(texts):
            step = step_of(length)
            low, high = max(0, first - step), min(len(texts[d]), first + length + step)
            inside = np.isin(texts[d][low:high], templates.shingles[t])
            own = len(np.unique(texts[d][low:high][inside]))
            share = own / len(templates.shingles[t])
            told = all(np.isin(x, texts[d][low:high]).any() for x in templates.telling[t])
            if share >= CONTAINED and told:
                at = low + np.flatnonzero(inside)
                entry = (-share, int(at[0]), int(at[-1]) + SHINGLE - 1)
                best[d, t] = min(best.get((d, t), entry), entry)
        return batch_of(
            [(ids[d], templates.names[t], a, b, -s) for (d, t), (s, a, b) in sorted(best.items())]
        )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        names = ["doc_id", "licence", "first_word", "last_word", "containment"]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names
        )

    return docs.select("doc_id", utf8().alias("__text")).mapInArrow(
        run, "doc_id long, licence string, first_word long, last_word long, containment double"
    )


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = [Query("op2_licence_scan", op2_licence_scan)]
