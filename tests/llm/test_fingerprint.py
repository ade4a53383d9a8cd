import hashlib

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import fingerprint
from tidewright.llm.fingerprint import LONGEST, digests, fingerprints, likeness, sketch


def paragraphs(text):
    out = set()
    for line in text.splitlines(keepends=True) if "\r" not in text else [text]:
        bare, end = (line[:-1], "\n") if line.endswith("\n") else (line, "")
        cuts = [bare[i : i + LONGEST] for i in range(0, len(bare), LONGEST)]
        out |= set([*cuts[:-1], cuts[-1] + end]) if cuts else {end}
    return out


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i) * 7, "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 9999, rng.integers(1, 60))) for _ in range(rng.integers(1, 30)))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "é😀" * 700), (503, "\n".join(f"line {i}" for i in range(700)))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keys string")
    found = {r.doc_id: r for r in fingerprints(docs).collect()}
    ordered = sorted(rows)
    assert len(found) == len(rows)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - near(text, edited)) < 1e-9 and abs(r.near_next - near(text, after)) < 1e-9


def test_null_and_repeated_ids_single_row_and_empty(spark):
    rows = [(None, "a"), (1, "b"), (1, "b"), (2, "c")]
    found = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 4
    same = [r for r in found if r.doc_id == 1]
    assert same[0].fingerprint == same[1].fingerprint and {r.near_next for r in same} == {0.0, 1.0}
    (alone,) = fingerprints(spark.createDataFrame([(3, "abcdefgh\nx")], "doc_id long, text string")).collect()
    assert alone.near_next == 1.0
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_difference_recovers_from_larger_sketches(spark):
    lines = lambda a, b: "\n".join(f"p{i}" for i in range(a, b)) + "\n"
    pairs = [(lines(0, 900), lines(0, 895)), (lines(0, 300), lines(100, 500)), (lines(0, 40), lines(40, 80)), ("", lines(0, 5))]
    frame = spark.createDataFrame(pairs, "x string, y string").select("x", "y", digests(F.col("x")).alias("a"), digests(F.col("y")).alias("b"))
    frame = frame.withColumn("sa", sketch(F.col("a"))).withColumn("sb", sketch(F.col("b")))
    for r in likeness(frame, "near", "sa", "sb", "a", "b").collect():
        assert abs(r.near - near(r.x, r.y)) < 1e-9


def test_ranges_follow_ids_and_hashes(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "PER_RANGE", 5)
    rows = [(None, f"n{i}") for i in range(60)] + [(7, f"h{i}") for i in range(90)] + [(i, f"t{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seen", F.xxhash64("text"))
    found = sorted(docs.withColumn("range", fingerprint._ranges(docs)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.seen))
    ranges = [r.range for r in found]
    assert ranges == sorted(ranges)
    assert len({r.range for r in found if r.doc_id is None}) > 20 and len({r.range for r in found if r.doc_id == 7}) > 20
    assert len({r.range for r in found if r.doc_id not in (None, 7)}) > 10


def test_next_document_of_null_and_hot_ids(spark):
    rows = [(None, f"n{i}" * 9) for i in range(30)] + [(7, f"h{i}" * 9) for i in range(60)] + [(i, f"t{i}" * 9) for i in range(6, 40) if i != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {r.text: r.seen for r in docs.select("text", F.xxhash64("text").alias("seen")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, seen[r[1]]))
    wanted = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(text) // 4
        wanted.append((str(i), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in fingerprints(docs).collect()) == sorted(wanted)


def test_unpeelable_sketches_are_compared_digest_by_digest(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "LARGER", (2,))
    monkeypatch.setattr(fingerprint, "EXPECTED", 10_000)
    test_difference_recovers_from_larger_sketches(spark)


def test_twenty_thousand_lines(spark):
    rows = [(k, "\n".join(f"{k} line {i}" for i in range(20_000))) for k in (1, 2)]
    found = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.near_next for r in found) == [0.0, 0.0]


def test_ids_of_other_types(spark, monkeypatch):
    """Texts, dates and decimals as ids: the next document is the next in their own order."""
    monkeypatch.setattr(fingerprint, "PER_RANGE", 7)
    rng = np.random.default_rng(9)
    texts = [f"own {i} " * int(rng.integers(1, 9)) for i in range(90)]
    names = sorted({f"k{x:x}-é" for x in rng.integers(0, 1 << 40, 90)})
    rows = list(zip(names, texts))
    hot = [("hot", f"copy {i} " * 4) for i in range(40)]
    docs = spark.createDataFrame(rows[::2] + rows[1::2] + hot + [(None, "no id at all")], "doc_id string, text string")
    seen = {r.text: r.seen for r in docs.select("text", F.xxhash64("text").alias("seen")).collect()}
    ordered = sorted([*rows, *hot, (None, "no id at all")], key=lambda r: (r[0] is not None, (r[0] or "").encode(), seen[r[1]]))
    wanted = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(text) // 4
        wanted.append((str(i), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in fingerprints(docs).collect()) == sorted(wanted)
    days = docs.limit(20).withColumn("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), F.length("text")))
    assert fingerprints(days).count() == 20
    assert fingerprints(docs.withColumn("doc_id", F.lit(None).cast("string"))).count() == docs.count()
    assert fingerprints(docs.limit(0)).count() == 0
