"""License scans: trained paragraph classifiers confirmed by template comparison.

A paragraph is a line (of a long one ``PIECE`` words at a time), or a run of up to ``lines`` lines of a block (lines without a blank one between them).
Words and word pairs, hashed to a fixed number of columns, feed two logistic regressions that are trained here: one
tells licence notices from other text, a multinomial one tells the families apart. Positives are the families'
notices, alone, joined, with copyright lines, with words dropped and with words of the corpus around them;
negatives are sentences that only talk about licences and a bounded sample of the corpus's own lines (the
``negatives`` lines with the smallest digests of id and line). Notices of other licences teach the first regression
what a notice is. The unknown class is calibrated on families left out: each of ``FOLDS`` fits lacks some families, and
the probability below which a family is unknown is the one that best parts the notices of the left-out families
from notices of the other families which that fit has not seen either.

Lines come first: a line that is a notice, of a family that is probable enough and confirmed, is a paragraph. Then
runs of the lines left are judged alike; of those that overlap the one wins that holds most of a template. Confirmed
means that the paragraph holds ``confirm`` of a template's word pairs and half of those pairs that no other family has.
Notices that remain are "other" if they are probable by ``unknown``: of a family that is not known, not probable or not confirmed; those
within ``lines`` lines of a confirmed notice of their block belong to that notice.

Null and blank texts have no paragraphs. Rows are judged one by one. Ties go to the family listed first and to the
earlier, shorter paragraph. An empty table trains on notices alone and gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

U = np.uint64
#: Sentences by which licences announce themselves.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the Apache License version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "This work has been marked as dedicated to the public domain under CC0 1.0 Universal"],
}
#: What follows in some families' notices.
BODIES = {
    "MIT": ["to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'],
    "Apache-2.0": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL": ["either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "LGPL": ["either version 2.1 of the License, or (at your option) any later version.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "BSD": ["provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "MPL-2.0": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: Notices of no family above.
OTHERS = [
    "All rights reserved.", "Licensed under a custom licence agreement.", "Use of this software is subject to the terms of the licence.", "Redistribution is prohibited without written permission of the copyright holder.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "Distributed under the Boost Software License, Version 1.0.", "Released under the ISC License.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "This software is provided 'as-is', without any express or implied warranty.", "This is free and unencumbered software released into the public domain.",
    "Licensed under the European Union Public Licence, version 1.2.", "This package is free software under the Artistic License 2.0.", "Licensed under the Academic Free License version 3.0", "SPDX-License-Identifier: Zlib", "Released under the Unlicense.",
    "Copyright (c) 2020 the authors. All rights reserved.", "This file is proprietary and confidential.", "Licensed under the PostgreSQL License.", "Eclipse Public License v2.0", "ISC License", "Open Data Commons Open Database License",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "Use, reproduction and redistribution in source form or binary form, with or without changes, are permitted",
    "This work has been released into the public domain by its author.", "To the extent possible under law, the author has waived all copyright to this work.",
]
#: What the families are called, and sentences that talk about licences and are none.
NAMES = {"MIT": "MIT license", "Apache-2.0": "Apache License", "GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "BSD": "BSD license", "MPL-2.0": "Mozilla Public License", "CC-BY": "Creative Commons Attribution license", "CC-BY-SA": "ShareAlike license", "CC-BY-NC": "NonCommercial license", "CC0": "CC0 dedication"}
TALK_OF = ["The court asked whether the {} applies to a work of art.", "She wrote a book about the {} and its history.", "What does it mean that software is licensed under the {}?", "Many projects that were released under the {} moved to another one that year.", "Students discussed the terms of the {} in class, and he told them that it is short."]
TALK = [
    "Ask your lawyer before you choose between one license and another.", "He lost his driving license after the accident.", "A fishing license costs ten dollars a year.", "The article compares open licenses with classic copyright.",
    "Public libraries are free of charge for any person who lives in the town.", "The foundation was published in 1985 and its software is free.", "You can redistribute the weight of the bag to make it easier to carry.", "The public domain of the village ends at the river.",
    "Permission was granted to the school to use the hall.", "A version 2.0 of the game came out in spring.", "The restaurant renewed its licence to sell wine.", "Copyright law was reformed twice in that century.", "In binary form the number is written with zeros and ones.",
    "The report was released under pressure from the press.", "Rights of way are reserved for walkers.", "Our terms changed; the general public was not told.", "International attribution of the painting took years.", "The this of any.", "To the, with.", "Of all or any.",
    "It was a cold morning and nothing moved at all.", "They were here more than once, and some words were said about the number of guests.", "He is not sure which of these two came first.", "We have been there before, but there was no one at home.",
    "If you are in a hurry, take the other road; it is shorter by far.", "All that she had done for them was soon forgotten by everyone.", "Most of what has been written on this was written by others.", "And so they went on, as one does, without a word.", "You may wonder why it is so and not the other way around.",
]
KNOWN = list(TEMPLATES)
FAMILIES = [*KNOWN, "other", "none"]
OTHER, NONE = len(KNOWN), len(KNOWN) + 1
COLUMNS = 1 << 18
PIECE = 64  # words of a long line that are judged as a line
FOLDS = 3
FLOOR = 6  # features that every paragraph is taken to have besides, so that two words alone do not decide


def paragraphs(t: tx.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a slice, the word offsets of its non-blank lines (long ones in pieces), the text each is of, if it
    begins a block, and if it begins a line."""
    starts, ends, offset = t.words(tx.ALNUM_WORDS)
    words = t.hashes(starts, ends)
    left = np.concatenate((t.start[:-1], np.flatnonzero(t.data == 10) + 1))
    left.sort()
    first, lines = np.unique(np.searchsorted(starts, left), return_counts=True)  # blank lines share the word that comes next
    first, lines = first[first < len(words)], lines[first < len(words)]
    pieces = -(-np.diff(np.append(first, len(words))) // PIECE)
    line = np.repeat(np.arange(len(first)), pieces)
    inner = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = first[line] + inner * PIECE
    owner = np.searchsorted(offset, first, "right") - 1
    return words, np.append(first, len(words)), owner, (inner == 0) & ((lines[line] > 1) | (np.diff(owner, prepend=-1) != 0)), inner == 0


def pairs_of(words: np.ndarray) -> np.ndarray:
    return tx.windows(words, np.array([0, len(words)]), 2)[0]


def features(words: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of words and of word pairs inside each line, rows in CSR form."""
    ones = (tx.mix(words) % U(COLUMNS)).astype(np.int64)
    twos, at = tx.windows(words, offset, 2)
    row = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    column = np.concatenate((ones, (twos % U(COLUMNS)).astype(np.int64)))
    both = np.unique(np.concatenate((row, row[at])) * COLUMNS + column)
    return both % COLUMNS, np.searchsorted(both // COLUMNS, np.arange(len(offset)))


def hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words and offsets of paragraphs without line ends, each with at least one word."""
    t = next(tx.slices(pa.array(lines, pa.large_string()), 1 << 40))
    starts, ends, offset = t.words(tx.ALNUM_WORDS)
    return t.hashes(starts, ends), offset


class Regression:
    """Logistic regression over hashed columns, multinomial for several classes; a row's sum is taken by the root of its size."""

    def __init__(self, classes: int, bias: tuple | None = None):
        self.weight, self.bias = np.zeros((COLUMNS, classes), np.float32), np.array(bias or [0.0] * classes)

    def sums(self, column: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Sum of the weights of each row's columns."""
        total = np.concatenate((np.zeros((1, self.weight.shape[1])), np.cumsum(self.weight[column], axis=0, dtype=np.float64)))
        return total[ptr[1:]] - total[ptr[:-1]]

    def probabilities(self, sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        z = sums / np.sqrt(size + FLOOR)[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, lines: list[str], label: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-4, weigh: tuple | None = None) -> Regression:
        """Adaptive gradient descent; classes weigh alike, or as ``weigh`` says, whatever their number of lines."""
        column, ptr = features(*hashed(lines))
        used, inverse = np.unique(column, return_inverse=True)
        size, classes = np.diff(ptr), self.weight.shape[1]
        row = np.repeat(np.arange(len(size)), size)
        share = np.bincount(label, minlength=classes)
        w = ((1 / share[label] / np.count_nonzero(share)) * np.array(weigh or [1] * classes)[label])[:, None]
        scale = (1 / np.sqrt(size + FLOOR))[:, None]
        target = np.eye(classes)[label]
        weight, seen, seen_bias = np.zeros((len(used), classes)), np.full((len(used), classes), 1e-10), np.full(classes, 1e-10)
        for _ in range(rounds):
            total = np.concatenate((np.zeros((1, classes)), np.cumsum(weight[inverse], axis=0)))
            error = (self.probabilities(total[ptr[1:]] - total[ptr[:-1]], size) - target) * w
            spread = (error * scale)[row]
            grad = np.stack([np.bincount(inverse, spread[:, k], len(used)) for k in range(classes)], 1) + decay * weight / len(used)
            seen += grad**2
            weight -= rate * grad / np.sqrt(seen)
            seen_bias += error.sum(0) ** 2
            self.bias = self.bias - 0.1 * rate * error.sum(0) / np.sqrt(seen_bias)
        self.weight[used] = weight
        return self


def varied(texts: list[str], rng: np.random.Generator, plain: list[str], copies: int) -> list[str]:
    """``copies`` of each text: as it is, with a tenth of the words dropped, with a copyright line, with words of the corpus around it."""
    out = []
    for text in texts:
        for c in range(copies):
            words = text.split()
            if c % 2 and len(words) > 4:
                words = [w for w in words if rng.random() > 0.1] or words
            if c % 4 == 2:
                words = ["Copyright", "(c)", str(2000 + int(rng.integers(30))), "by", "the", "authors.", *words]
            if c % 4 == 3 and plain:
                around = plain[int(rng.integers(len(plain)))].split()[: int(rng.integers(0, 10))]
                cut = int(rng.integers(0, len(around) + 1))
                words = [*around[:cut], *words, *around[cut:]]
            out.append(" ".join(words))
    return out


def notices(family: str) -> list[str]:
    """The notices of a family: its templates, what follows them, and both joined."""
    own, body = TEMPLATES[family], BODIES.get(family, [])
    return [*own, *body, *[f"{x} {y}" for x in own[-2:] for y in body]]


@dataclass
class Model:
    """Both regressions, the families they know, the least probability of a family, and the templates' pairs."""

    notice: Regression
    family: Regression
    known: list[str]
    least: float
    pairs: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)  # family number, its pairs, those no other family has

    def __post_init__(self) -> None:
        own = {k: [pairs_of(hashed([s])[0]) for s in TEMPLATES[k]] for k in self.known}
        for k, many in own.items():
            others = np.concatenate([p for j, x in own.items() if j != k for p in x] or [np.empty(0, U)])
            self.pairs += [(KNOWN.index(k), np.unique(p), np.setdiff1d(p, others)) for p in many]

    def held(self, words: np.ndarray, family: int, confirm: float) -> float:
        """The largest share of a template of the family that is held well enough to confirm it, else 0."""
        own, best = np.unique(pairs_of(words)), 0.0
        for k, pairs, sole in self.pairs:
            if k == family:
                share = np.isin(pairs, own, assume_unique=True).mean()
                if share >= confirm and 2 * np.isin(sole, own, assume_unique=True).sum() >= len(sole):
                    best = max(best, float(share))
        return best

    def judge(self, words: np.ndarray, offset: np.ndarray, fresh: np.ndarray, confirm: float, lines: int, unknown: float = 0.7) -> list[tuple[int, int, int, float]]:
        """(first line, line after the last, family number, probability) of each paragraph that is a notice."""
        if len(offset) < 2:
            return []
        column, ptr = features(words, offset)
        size = np.diff(ptr)
        edge = np.concatenate(([0], np.cumsum(size)))
        total = [np.concatenate((np.zeros((1, r.weight.shape[1])), np.cumsum(r.sums(column, ptr), axis=0))) for r in (self.notice, self.family)]
        block = np.cumsum(fresh)
        found: list[tuple[int, int, int, float]] = []
        taken = np.zeros(len(size), bool)
        lone = np.zeros(len(size))

        def likely(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Of the runs of n lines from ``first`` on those that are notices: first line, its probability, best family and its one."""
            sums = [t[first + n] - t[first] for t in total]
            p = self.notice.probabilities(sums[0], edge[first + n] - edge[first])[:, 1]
            some = np.flatnonzero(p >= 0.5)
            q = self.family.probabilities(sums[1][some], (edge[first + n] - edge[first])[some])
            return first[some], p[some], q.argmax(1), q.max(1, initial=0)

        every = np.arange(len(size))
        first, p, family, q = likely(every, 1)
        lone[first] = p
        for i, pi, k, qi in zip(first.tolist(), p.tolist(), family.tolist(), q.tolist()):
            k = KNOWN.index(self.known[k])
            if qi >= self.least and self.held(words[offset[i] : offset[i + 1]], k, confirm):
                found.append((i, i + 1, k, pi * qi))
                taken[i] = True
        runs = []
        busy = np.concatenate(([0], np.cumsum(taken)))
        for n in range(2, lines + 1):
            a = every[: max(len(every) - n + 1, 0)]
            a = a[(block[a] == block[a + n - 1]) & (busy[a + n] == busy[a])]
            for i, pi, k, qi in zip(*(x.tolist() for x in likely(a, n))):
                k = KNOWN.index(self.known[k])
                if qi >= self.least and (share := self.held(words[offset[i] : offset[i + n]], k, confirm)):
                    runs.append((-share, n, i, k, pi * qi))
        for _, n, i, k, p in sorted(runs):
            if not taken[i : i + n].any():
                found.append((i, i + n, k, p))
                taken[i : i + n] = True
        rest = np.flatnonzero((lone > 0) & ~taken)
        sure = taken.copy()
        at = 0
        while at < len(rest):
            a = b = int(rest[at])
            while at < len(rest) and int(rest[at]) == b and block[b] == block[a]:
                at, b = at + 1, b + 1
            near = slice(max(a - lines, 0), b + lines)
            goes_on = (sure[near] & (block[near] == block[a])).any()
            if not goes_on and lone[a:b].max() >= unknown:
                found.append((a, b, OTHER, float(lone[a:b].max())))
        return sorted(found)


def fitted(plain: list[str], known: list[str] = KNOWN, copies: int = 24, seed: int = 7) -> Model:
    """A model of the families ``known`` from the notices and the corpus's own lines ``plain``."""
    rng = np.random.default_rng(seed)
    lines = varied(OTHERS, rng, plain, copies // 2)
    talk = varied([*TALK, *(x.format(NAMES[k]) for k in known for x in TALK_OF)], rng, [], 4) + plain
    positive = {k: varied(notices(k), rng, plain, copies) for k in known}
    every = lines + [x for v in positive.values() for x in v]
    notice = Regression(2, (1.0, -1.0)).fit(every + talk, np.repeat([1, 0], [len(every), len(talk)]), weigh=(3, 1))

    def families(texts: dict[str, list[str]]) -> Regression:
        return Regression(len(known)).fit([x for v in texts.values() for x in v], np.repeat([known.index(k) for k in texts], [len(v) for v in texts.values()]), rounds=100)

    inside, outside = [], []
    for fold in range(FOLDS):  # families left out are what is unknown; a template left out is what is known but new
        there = [k for i, k in enumerate(known) if i % FOLDS != fold]
        if len(there) in (0, len(known)):
            continue
        own = families({k: varied([x for i, x in enumerate(TEMPLATES[k]) if i % FOLDS != fold] or TEMPLATES[k], rng, plain, copies // 3) for k in there})
        for k in known:
            new = [x for i, x in enumerate(TEMPLATES[k]) if i % FOLDS == fold] if k in there else TEMPLATES[k]
            if new:
                column, ptr = features(*hashed(varied(new, rng, plain, 8)))
                (inside if k in there else outside).append(own.probabilities(own.sums(column, ptr), np.diff(ptr))[:, [known.index(x) for x in there]].max(1))
    least = 0.5
    if inside and outside:
        x, y = np.concatenate(inside), np.concatenate(outside)
        grid = np.arange(0.2, 0.8, 0.05)
        least = float(grid[np.argmax([(x >= g).mean() + (y < g).mean() for g in grid])])
    return Model(notice, families(positive), list(known), least)


def trained(docs: DataFrame, id_col: str, text_col: str, negatives: int, line_chars: int) -> Model:
    """A model with at most ``negatives`` lines of the corpus; of a line of over ``line_chars`` characters these stand for it."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = rows.select("id", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "")
    sample = lines.select(F.substring("line", 1, line_chars).alias("line"), F.xxhash64("line", "id").alias("place"))
    count = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    share = min(1.0, 2.0 * negatives / max(count, 1))  # a text has a line at least, or it is blank
    if share < 1:
        sample = sample.filter(F.col("place") <= int(-(1 << 63) + share * ((1 << 64) - 1)))
    found = sorted({r["line"] for r in sample.orderBy("place", "line").limit(negatives).collect()})
    near = {w for s in [*OTHERS, *(x for k in KNOWN for x in notices(k))] for w in pairs_of(hashed([s])[0]).tolist()}
    plain = []
    words = [x.split() for x in found]
    for x in (" ".join(w[i : i + PIECE]) for w in words for i in range(0, len(w), PIECE)):  # a line with a quarter of its word pairs, three at least, from notices may be one
        own = hashed([x])[0]
        pairs = pairs_of(own).tolist()
        held = sum(p in near for p in pairs)
        if len(own) and (held < 3 or 4 * held < len(pairs)):
            plain.append(x)
    return fitted(plain)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negatives: int = 4000, line_chars: int = 1000, confirm: float = 0.9, lines: int = 12, unknown: float = 0.7) -> DataFrame:
    """Per row: id, n_paragraphs, n_licensed, families (sorted, comma-joined), family (of the surest paragraph), probability.

    The model has a fixed size and is broadcast for that reason. Every paragraph of every text is judged.
    n_paragraphs counts the lines that are not blank; a notice of several lines counts once in n_licensed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, id_col, text_col, negatives, line_chars))
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_paragraphs long, n_licensed long, families string, family string, probability double"

    def of(batch: pa.RecordBatch):
        model = shared.value
        for t in tx.slices(batch.column(1), 1 << 18):
            words, offset, owner, fresh, begins = paragraphs(t)
            found: dict[int, list[tuple[float, str]]] = {}
            for a, _, family, p in model.judge(words, offset, fresh, confirm, lines, unknown):
                found.setdefault(int(owner[a]), []).append((p, FAMILIES[family]))
            rows = [found.get(i, []) for i in range(t.n)]
            top = [min(r, key=lambda x: (-x[0], FAMILIES.index(x[1])), default=(None, None)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(t.first, t.n),
                    pa.array(np.bincount(owner[begins], minlength=t.n).astype(np.int64)),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([",".join(sorted({x[1] for x in r})) for r in rows], pa.string()),
                    pa.array([x[1] for x in top], pa.string()),
                    pa.array([x[0] for x in top], pa.float64()),
                ],
                names=[id_col, "n_paragraphs", "n_licensed", "families", "family", "probability"],
            )

    return tx.mapped(docs.select(F.col(id_col), F.col(text_col)), of, schema)
