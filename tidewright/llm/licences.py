"""Licence scans by a trained paragraph classifier.

A paragraph is a line, or a run of lines without a blank one: notices stand in one line
or are wrapped. Its word unigrams and bigrams go into a multinomial
logistic regression over licence families, an unknown licence and prose. Grams have a
weight if a fixed text of this module has them; all others count in a line's length
and are no evidence, and each counts once in a line, so that short lines, repeated words and other languages are prose. It is
fitted here, on templates worn by dropping, adding and changing words; on notices of other
families, of invented names and of reserved rights as unknown licence; and on words and
on sentences about rights that are no notice as prose. One temperature, fitted on worn
templates and invented names that the regression has not seen, calibrates it. A line
has a family if that one's calibrated probability reaches ``LEAST_PROBABILITY``. Where
none does, but the probability that it is not prose does, it is an unknown licence, with
that probability. Other lines are no findings. A prediction of a family with templates
is confirmed if the line's bigrams share ``LEAST_SHARED`` or more with one
of the family's templates, as a part of the smaller of both sets, and at least two
(or the whole of a template of two words). An unknown licence has a similarity of 0.
A run of lines is one finding, in the place of its lines, if it holds ``LEAST_SHARED``
of a template's bigrams and none of its lines does by itself.

The model has a fixed size, is fitted on the driver and broadcast. Null or empty
text has no findings. Repeated rows give their findings again. Of equal probabilities
the first family in the list counts. A text is scored as a whole, in time of its length.
An empty table has no findings. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textkernel import _STEPS, SPACES, blocks, mix, small, word_hashes

LEAST_PROBABILITY = 0.7
LEAST_SHARED = 0.6
PROSE = "prose"
UNKNOWN = "unknown licence"

# Usual notices of each family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
    ),
}
# Notices of families without templates, of rights reserved and of owners.
UNLISTED = (
    "All rights reserved.",
    "Copyright (c) 2019 Example Corporation. All rights reserved.",
    "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
    "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Released under the ISC License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This is free and unencumbered software released into the public domain.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
)
UNLISTED += tuple(
    f"SPDX-License-Identifier: {x}"
    for x in "LGPL-2.1-or-later AGPL-3.0-only GPL-2.0-only MPL-2.0 Unlicense ISC Zlib EUPL-1.2 BSL-1.0 EPL-2.0 CDDL-1.0 WTFPL OFL-1.1 CC-BY-ND-4.0".split()
)
# The same of families that are not known here: a name and a number are put in.
INVENTED = (
    "Licensed under the {} License.",
    "Licensed under the {} License, Version {}.",
    "Released under the {} License.",
    "Distributed under the {} License, version {}.",
    "This work is licensed under the {} Public License, version {}.",
    "This program and the accompanying materials are made available under the terms of the {} License {}.",
    "Use of this software is governed by the {} License Agreement.",
    "SPDX-License-Identifier: {}-{}",
    "SPDX-License-Identifier: {}",
    "Licensed under the {}.",
    "Released under the {}.",
    "This file is confidential and proprietary to {}.",
    "Copyright (c) {1} {0}. All rights reserved.",
)
NO_LICENCE = (
    "The driver lost his license after the second offence last year.",
    "Permission to enter the building was granted by the guard.",
    "This version of the program is free for a month.",
    "You may not use this door except in an emergency.",
    "The work was published by a public foundation in the city.",
    "See the file for more details about the conditions of use.",
    "A copy of the documentation is in the source folder.",
    "All seats in the first row are reserved for guests.",
    "The rights of all people who live in the city were discussed.",
)
FAMILIES = (PROSE, *TEMPLATES)
CLASSES = (*FAMILIES, UNKNOWN)


def _grams(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every unigram and bigram; row and hash of the bigrams."""
    words, first = word_hashes(text, starts)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    pair = mix(words[:-1] * _STEPS[0] + words[1:] * _STEPS[1])[row[:-1] == row[1:]] if len(words) > 1 else words[:0]
    pair_row = row[:-1][row[:-1] == row[1:]] if len(words) > 1 else row[:0]
    return np.concatenate([row, pair_row]), np.concatenate([words, pair]), pair_row, pair


def _packed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode() for x in lines]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _evidence() -> np.ndarray:
    """Sorted hashes of the grams that the fixed texts have; of invented names' texts those beside the names."""
    texts = [t for own in TEMPLATES.values() for t in own] + [*UNLISTED, *NO_LICENCE]
    return np.unique(_grams(*_packed(texts + [part for t in INVENTED for part in re.split(r"\S*\{\d?\}\S*", t)]))[1])


@dataclass
class Model:
    grams: np.ndarray  # sorted hashes
    weights: np.ndarray  # gram x family
    bias: np.ndarray
    temperature: float
    bigrams: list[list[np.ndarray]]  # of each family's templates

    def features(self, row: np.ndarray, gram: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and place of the grams with a weight, each once in a row, and each row's scale."""
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=rows), 1))
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        held = self.grams[place] == gram
        row, place = np.divmod(np.unique(row[held] * len(self.grams) + place[held]), len(self.grams))
        return row, place, scale

    def logits(self, row: np.ndarray, place: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, self.weights[place, k], len(scale)) * scale for k in range(len(self.bias))], axis=1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def shared(self, family: int, pairs: np.ndarray) -> tuple[float, float]:
        """Bigrams in common with the nearest template, as a part of the smaller of both sets; and the most of a template that is there."""
        own, best, cover = np.unique(pairs), 0.0, 0.0
        for template in self.bigrams[family]:
            both = len(np.intersect1d(own, template, assume_unique=True))
            if both >= min(2, len(template)):
                best, cover = max(best, both / min(len(own), len(template))), max(cover, both / len(template))
        return best, cover


def _worn(rng: np.random.Generator, line: str, drop: bool = True) -> str:
    words = line.split()
    if drop and len(words) > 6:  # in shorter notices each word may be the one that names the family
        words = [w for w in words if rng.random() > 0.08]
    words = [w.strip(".,;:()") if rng.random() < 0.2 else w.upper() if rng.random() < 0.03 else w for w in words]
    for _ in range(rng.integers(0, 3)):
        words.insert(int(rng.integers(0, 2)) * len(words), f"{'abcdefghij'[rng.integers(0, 10)]}{rng.integers(0, 999)}")
    return " ".join(words)


def _invented(rng: np.random.Generator, names: list[str]) -> str:
    name = " ".join(rng.choice(names, rng.integers(1, 4))).title()
    return INVENTED[rng.integers(0, len(INVENTED))].format(name, f"{rng.integers(1, 5)}.{rng.integers(0, 3)}" if rng.random() < 0.7 else rng.integers(1990, 2030))


def _examples(seed: int, each: int) -> tuple[list[str], np.ndarray]:
    rng = np.random.default_rng(seed)
    names = ["".join(rng.choice(list("aeinorstlhducmp"), rng.integers(2, 10))) for _ in range(5 * each)]
    lines, label = [], []
    for k, family in enumerate(FAMILIES[1:], 1):
        for template in TEMPLATES[family]:
            lines += [template, *(_worn(rng, template) for _ in range(each))]
            label += [k] * (each + 1)
    for template in UNLISTED:
        lines += [template, *(_worn(rng, template, drop=False) for _ in range(each // 3))]  # a word may part it from a listed family
    lines += [_worn(rng, _invented(rng, names), drop=False) for _ in range(len(INVENTED) * each)]
    label += [len(FAMILIES)] * (len(lines) - len(label))
    pool = [w for texts in (*TEMPLATES.values(), UNLISTED, NO_LICENCE) for t in texts for w in t.split() if not w.startswith("SPDX")]  # that tag alone is a notice
    for i in range(6 * each * len(TEMPLATES)):
        if i % 8 == 0:
            line = _worn(rng, NO_LICENCE[rng.integers(0, len(NO_LICENCE))])
        elif i % 8 == 1:  # words of licences without their order
            line = " ".join(rng.choice(pool, rng.integers(1, 14)))
        elif i % 8 < 4:  # invented names that are no notice
            line = " ".join(rng.choice(names, rng.integers(1, 5))) + "." * (i % 2)
        else:
            line = " ".join("".join(rng.choice(list("aeinorstlhdu"), rng.integers(1, 9))) for _ in range(rng.integers(1, 40)))
        lines.append(line)
        label.append(0)
    return lines, np.array(label)


def train(seed: int = 11, each: int = 60, epochs: int = 60) -> Model:
    lines, label = _examples(seed, each)
    known = _evidence()
    weights, bias = np.zeros((len(known), len(CLASSES))), np.zeros(len(CLASSES))
    speed = np.full((len(known), len(CLASSES)), 1e-8)
    target = np.eye(len(CLASSES))[label]
    model = Model(known, weights, bias, 1.0, [])
    row, place, scale = model.features(*_grams(*_packed(lines))[:2], len(lines))
    for _ in range(epochs):
        slope = (model.probabilities(model.logits(row, place, scale)) - target) / len(lines)
        for k in range(len(CLASSES)):
            gradient = np.bincount(place, slope[row, k] * scale[row], len(known)) + 1e-6 * weights[:, k]
            speed[:, k] += gradient**2
            weights[:, k] -= 0.5 * gradient / np.sqrt(speed[:, k])
        bias -= 5 * slope.sum(0)
    seen, truth = _examples(seed + 1, max(4, each // 4))
    logits = model.logits(*model.features(*_grams(*_packed(seen))[:2], len(seen)))

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(np.maximum(model.probabilities(logits)[np.arange(len(seen)), truth], 1e-12)).mean())

    model.temperature = min(np.geomspace(0.1, 5, 40), key=loss)
    model.bigrams = [[]] + [[np.unique(_grams(*_packed([t]))[3]) for t in TEMPLATES[f]] for f in FAMILIES[1:]] + [[]]
    return model


def named(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and probability of each row of class probabilities: a sure family, else an unknown licence if the row is no prose, else prose."""
    best, likely, notice = p.argmax(1), p.max(1), 1 - p[:, 0]
    unsure = (likely < LEAST_PROBABILITY) & (notice >= LEAST_PROBABILITY)
    found = np.where(unsure, len(CLASSES) - 1, np.where(likely >= LEAST_PROBABILITY, best, 0))
    return found, np.where(unsure, notice, likely)


def _found(model: Model, text: np.ndarray, cuts: np.ndarray) -> dict[int, tuple[int, float, float, float]]:
    """Class, probability, similarity and cover of every part of the text (its starts, and the text's end) that is no prose."""
    row, gram, pair_row, pair = _grams(text, cuts)
    best, likely = named(model.probabilities(model.logits(*model.features(row, gram, len(cuts) - 1))))
    notices = np.flatnonzero(best > 0)
    first, last = np.searchsorted(pair_row, notices), np.searchsorted(pair_row, notices, "right")
    return {i: (int(best[i]), float(likely[i]), *model.shared(int(best[i]), pair[a:z])) for i, a, z in zip(notices.tolist(), first.tolist(), last.tolist())}


def _notices(model: Model, text: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, float, float]]:
    """(row, line, lines, class, probability, similarity) of the notices in the texts that begin at ``starts``, one end more."""
    breaks = np.flatnonzero(text == 0x0A) + 1
    lines = np.unique(np.concatenate([starts[:-1], breaks[breaks < len(text)]])) if len(text) else np.zeros(0, np.int64)
    if not len(lines):
        return []
    lines = np.append(lines, len(text))
    doc = np.searchsorted(starts, lines[:-1], "right") - 1
    first_line = np.searchsorted(lines[:-1], starts[:-1])
    of_line = _found(model, text, lines)
    spaces = np.zeros(len(text) + 1, np.int64)
    np.cumsum(SPACES[text], out=spaces[1:])
    blank = spaces[lines[1:]] - spaces[lines[:-1]] == np.diff(lines)
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    opens = new_doc | (~blank & np.concatenate([[True], blank[:-1]]))
    heads = np.flatnonzero(opens)
    tails = np.append(heads[1:], len(blank))
    filled = np.concatenate([[0], np.cumsum(~blank)])
    many = filled[tails] - filled[heads]
    out = []
    if (many > 1).any():
        of_run = _found(model, text, np.append(lines[heads], len(text)))
        for k, (best, likely, similarity, cover) in of_run.items():
            inside = range(int(heads[k]), int(tails[k]))
            alone = any(i in of_line and of_line[i][3] >= LEAST_SHARED for i in inside)
            if many[k] > 1 and cover >= LEAST_SHARED and not alone:
                d = int(doc[heads[k]])
                first = next(i for i in inside if not blank[i])
                out.append((d, first - int(first_line[d]), int(many[k]), best, likely, similarity))
                for i in inside:
                    of_line.pop(i, None)
    out += [(int(doc[i]), i - int(first_line[doc[i]]), 1, *found[:3]) for i, found in of_line.items()]
    return sorted(out)


def _scan(shared):
    def run(batches):
        for batch in small(batches):
            found = []
            for row, _, text, starts in blocks(batch.column("text")):
                found += [(row + d, *rest) for d, *rest in _notices(shared.value, text, starts)]
            columns = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array([CLASSES[k] for k in columns[3]], pa.string()),
                    pa.array(columns[4], pa.float64()),
                    pa.array(columns[5], pa.float64()),
                    pa.array([s >= LEAST_SHARED for s in columns[5]], pa.bool_()),
                ],
                ["doc_id", "line", "lines", "family", "probability", "similarity", "confirmed"],
            )

    return run


def licence_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, lines, family, probability, similarity, confirmed) of every notice: its first line, how many lines it has, and what it is, known or not."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {id_type}, line long, lines long, family string, probability double, similarity double, confirmed boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan(shared), kinds)
