import textwrap

import numpy as np
import pytest

from tidewright.llm import licences
from tidewright.llm.licences import CLASSES, FAMILIES, LEAST_PROBABILITY, LEAST_SHARED, TEMPLATES, _examples, _grams, _packed, licence_lines, train


def test_accuracy_on_unseen_worn_templates():
    model = train()
    lines, label = _examples(99, 10)
    row, gram, _, _ = _grams(*_packed(lines))
    p = model.probabilities(model.logits(*model.features(row, gram, len(lines))))
    assert np.mean(p.argmax(1) == label) > 0.97
    sure = p.max(1) >= 0.7
    assert np.mean(p.argmax(1)[sure] == label[sure]) > 0.98


def test_every_template_is_found_on_its_line(spark):
    rows, want = [], set()
    for k, family in enumerate(FAMILIES[1:]):
        for j, template in enumerate(TEMPLATES[family]):
            rows.append((100 * k + j, "Some words of prose here\n\n" + template.upper() + "\nand more of them.", 1))
            want.add((100 * k + j, 2, family))
    rows += [(9000, None, 1), (9001, "", 1), (9002, "The license of the driver was lost.\nAll rights reserved.", 1), (None, "SPDX-License-Identifier: MIT", 1)]
    found = licence_lines(spark.createDataFrame(rows, "doc_id long, text string, line int")).where("confirmed").collect()
    assert {(r.doc_id, r.line, r.family) for r in found} - {(None, 0, "MIT")} == want


def test_notices_of_other_families_are_unknown_licences(spark):
    notices = [
        "All rights reserved.",
        "© 2024 Acme GmbH. All rights reserved.",
        "SPDX-License-Identifier: Zlib",
        "Distributed under the Boost Software License, Version 1.0.",
        "This program is made available under the terms of the Eclipse Public License 2.0",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ]
    prose = ["The driver was free to go.", "Und der Mann ging in die Stadt.", "The license was expensive and all the rights were sold to Acme.", "Released in June."]
    rows = [(i, f"Some words of prose here\n{line}\nand more of them.") for i, line in enumerate([*notices, *prose])]
    found = licence_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line, r.family, r.confirmed) for r in found} == {(i, 1, "unknown licence", False) for i in range(len(notices))}
    assert all(0.7 <= r.probability <= 1 for r in found)


def test_empty_table(spark):
    assert licence_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def model():
    return train()


@pytest.mark.parametrize("width", [38, 55, 80])
def test_wrapped_notices_are_one_finding(spark, width):
    rows, want = [], set()
    for k, family in enumerate(FAMILIES[1:]):
        for j, template in enumerate(TEMPLATES[family]):
            parts = textwrap.wrap(template, width)
            if len(parts) > 2:  # of two parts one may be a notice by itself
                rows.append((100 * k + j, "A title\n\n" + "\n".join(f"// {x}" for x in parts) + "\n\nand words after it."))
                want.add((100 * k + j, 2, len(parts), family))
    found = licence_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect()
    alone = {r.doc_id for r in found if r.lines == 1}
    assert {(r.doc_id, r.line, r.lines, r.family) for r in found if r.doc_id not in alone} == {w for w in want if w[0] not in alone}
    assert {r.doc_id for r in found} == {w[0] for w in want} and len(alone) < len(want) / 2  # a line may hold a whole shorter template


def brute(model, texts):
    """Every line, and every run of lines without a blank one, scored by itself in plain Python."""
    out = []
    for d, text in texts:
        if not text:
            continue

        def score(part):
            row, gram, _, pair = _grams(*_packed([part]))
            p = model.probabilities(model.logits(*model.features(row, gram, 1)))[0]
            best = int(p.argmax())
            if p[best] < LEAST_PROBABILITY:
                best, sure = (len(CLASSES) - 1, 1 - p[0]) if 1 - p[0] >= LEAST_PROBABILITY else (0, 0)
            else:
                sure = p[best]
            own, similar, cover = set(pair.tolist()), 0.0, 0.0
            for template in model.bigrams[best]:
                both = len(own & set(template.tolist()))
                if both >= min(2, len(template)):
                    similar, cover = max(similar, both / min(len(own), len(template))), max(cover, both / len(template))
            return best, float(sure), similar, cover

        parts = text.split("\n")
        if parts[-1] == "":
            parts.pop()
        lines = {i: score(x) for i, x in enumerate(parts)}
        blank = [not x.strip(" \t\n\r\x0b\x0c") for x in parts]
        at = 0
        while at < len(parts):
            end = at
            while end < len(parts) and not blank[end]:
                end += 1
            if end - at > 1:
                whole = score("\n".join(parts[at:end]))
                if whole[0] and whole[3] >= LEAST_SHARED and not any(lines[i][0] and lines[i][3] >= LEAST_SHARED for i in range(at, end)):
                    out.append((d, at, end - at, CLASSES[whole[0]], round(whole[1], 6), round(whole[2], 6)))
                    for i in range(at, end):
                        lines[i] = (0, 0, 0, 0)
            at = max(end, at + 1)
        out += [(d, i, 1, CLASSES[k], round(p, 6), round(s, 6)) for i, (k, p, s, _) in lines.items() if k]
    return sorted(out)


def test_query_equals_every_part_scored_alone(spark, model):
    rng = np.random.default_rng(12)
    pool = [x for family in TEMPLATES.values() for t in family for x in (t, *textwrap.wrap(t, 40))] + list(licences.UNLISTED) + list(licences.NO_LICENCE) + ["", "", " ", "some other words", "x"]
    texts = [(i, "\n".join(rng.choice(pool, rng.integers(0, 14)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join([pool[1]] * 3000)), (204, "Released under the MIT License.\n"), (204, "Released under the MIT License.\n")]
    found = licence_lines(spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, family string").repartition(3)).collect()
    assert sorted((r.doc_id, r.line, r.lines, r.family, round(r.probability, 6), round(r.similarity, 6)) for r in found) == brute(model, texts)


def test_short_repeated_and_foreign_lines_are_prose(spark):
    lines = ["Le.", "St.", "Des. Des. Des.", "Und Und Und", "Ndth.", "The " * 300, "Of " * 90, "A, " * 40, "the license", "Version 2.0", "GNU", "Ber mit die und. " * 40]
    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyzäöüßéèñ")
    lines += [" ".join("".join(rng.choice(letters, int(rng.integers(1, 9)))) for _ in range(int(rng.integers(1, 40)))).capitalize() + "." for _ in range(400)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert licence_lines(docs).collect() == []
    # a family's name alone, or the start of a notice, is evidence: found, and not confirmed
    short = {r.doc_id: (r.family, r.confirmed) for r in licence_lines(spark.createDataFrame([(1, "MIT"), (2, "all rights")], "doc_id long, text string")).collect()}
    assert short == {1: ("MIT", False), 2: ("unknown licence", False)}
    long = "word " * 200_000 + "\nReleased under the MIT License.\n" + "more " * 200_000
    (found,) = licence_lines(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert (found.line, found.family, found.confirmed) == (1, "MIT", True)
