import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace
from tidewright.llm import simhash
from tidewright.llm.components import components
from tidewright.llm.simhash import near_duplicates, near_fingerprints


def brute_print(text, width=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints):
    """Of each place in ``prints`` the first place that links of two bits reach."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "a b c", "A\tb\x0bC d", "é É ß", "x y z " * 500, "a\x85b \x1cc d", "日本 語 テ キ"])
def test_fingerprint_equals_brute_force(text):
    assert simhash.simhash(text) & ((1 << 64) - 1) == brute_print(text)


def test_fingerprint_is_sparks_hash(spark):
    """One shingle alone is the fingerprint, and Spark's xxhash64 has the contract's seed."""
    (row,) = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert simhash.simhash("One two THREE") == row.h


def clustered(n, seed):
    """Fingerprints: chains of steps of one to three bits, and lone ones."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 12))):
            out.append(x)
            for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False).tolist():
                x ^= 1 << bit
    return out[:n]


@pytest.mark.parametrize("full", [512, 4, 1])
def test_components_of_fingerprints_equal_brute_force(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL", full)
    prints = list(dict.fromkeys([*clustered(400, 3), 0, 1, (1 << 64) - 1, 1 << 63, (1 << 63) | 3]))
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "node long")
    work = Workspace(spark, "test-simhash")
    edges = work.keep("edges", near_fingerprints(work, nodes))
    roots = {r.node: r.root for r in components(work, edges, "c").collect()}
    found, names = [roots.get(signed(p), signed(p)) for p in prints], {}
    assert [names.setdefault(f, i) for i, f in enumerate(found)] == brute_roots(prints)


def test_large_cluster_of_near_copies(spark, monkeypatch):
    """Many distinct fingerprints around one: no task compares them all, all are found."""
    monkeypatch.setattr(simhash, "FULL", 40)
    prints = [0x0F0F << 20] + [(0x0F0F << 20) ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)][:900]
    work = Workspace(spark, "test-simhash")
    edges = work.keep("edges", near_fingerprints(work, spark.createDataFrame([(signed(p),) for p in prints], "node long")))
    assert edges.count() < 70 * len(prints)
    assert len({r.root for r in components(work, edges, "c").collect()}) == 1


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = " ".join(f"w{x}" for x in rng.integers(0, 500, 400))
    rows = [(i * 3, base + " end" * (i % 4)) for i in range(30)] + [(200 + i, " ".join(f"v{x}" for x in rng.integers(0, 99, int(rng.integers(1, 40))))) for i in range(60)]
    rows += [(7, None), (1000, ""), (1001, " \n\t"), (1002, "Same text here"), (5, "same TEXT here"), (5, "same TEXT here")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    found = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    prints = [brute_print(t) for _, t in rows]
    roots, least = brute_roots(prints), {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(i, least.get(r, i))
    assert found == sorted((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots))


def test_rows_without_an_id_and_empty_tables(spark):
    rows = [(None, "a b c d"), (9, "a b c d"), (None, "quite other words here")]
    found = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(None, 9), (9, 9), (None, None)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    texts = spark.createDataFrame([("b", "x y z"), ("a", "X y Z")], "doc_id string, text string")
    assert {r.component_id for r in near_duplicates(texts).collect()} == {"a"}


def test_slices_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "_SLICE", 17)
    assert simhash.simhash(text) == whole == signed(brute_print(text))
