import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import jaccard_join
from tidewright.llm.jaccard_join import jaccard_components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, p, q):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, links = sorted(sets), dict.fromkeys(sets, 0)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and q * both >= p * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                links[i], links[j] = links[i] + 1, links[j] + 1
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


def near_copies(seed, families, copies, words, edits):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, words, rng.integers(0, edits + 1)):
                own[at] = f"x{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("width,p,q", [(3, 9, 10), (5, 4, 5)])
@pytest.mark.parametrize("piece", [2048, 5])
def test_equals_brute_force(spark, monkeypatch, width, p, q, piece):
    monkeypatch.setattr(jaccard_join, "PIECE_NODES", piece)
    rows = near_copies(3, 4, 14, 60, 5) + [(1000 + i, t) for i, t in enumerate(["a b", "A  b", "a", "", None, "a b c d e f g h i j k l", "a b c d e f g h i j k"])]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, (p, q)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == brute(rows, width, p, q)


def test_nulls_repeats_and_extra_columns(spark):
    text = "one two three four five six"
    rows = [(1, text, "x"), (1, text, "x"), (None, text, None), (2, None, None), (3, text.upper(), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(docs, 3, (9, 10)).collect()), key=str)
    assert found == sorted([(1, 4, 1, 2), (1, 4, 1, 2), (None, 4, None, 0), (2, 0, 2, 0), (3, 4, 1, 2)], key=str)


@pytest.mark.parametrize("piece", [2048, 2])
def test_repeated_rows_with_near_copies(spark, monkeypatch, piece):
    monkeypatch.setattr(jaccard_join, "PIECE_NODES", piece)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base, *(f"x{j}" for j in range(k))]) for k in range(6)]
    rows = [(k, text) for k, text in enumerate(texts) for _ in range(3 + k)] + [(0, "another text under this id")] * 2
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 3, (9, 10)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, 0) for i, _ in rows)


@pytest.mark.parametrize("words", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("width", [3, 5])
def test_table_of_one_short_document(spark, words, width):
    docs = spark.createDataFrame([(1, " ".join("abcde"[:words]))], "doc_id long, text string")
    (row,) = jaccard_components(docs, width).collect()
    assert (row.doc_id, row.n_shingles, row.component_id) == (1, max(1, words - width + 1), 1)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    for p, q in ((9, 10), (4, 5)):
        for size in [*range(1, 70), 300]:
            base = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
            for _ in range(6):
                drop = rng.integers(0, max(1, size * (q - p) // q) + 1)
                add = rng.integers(1, 1 << 63, rng.integers(0, size * (q - p) // q + 1), dtype=np.uint64)
                other = np.unique(np.concatenate([rng.permutation(base)[drop:], add]))
                if len(other) and not np.array_equal(base, other) and jaccard_join.links(base, other, p, q):
                    places = np.array([0, len(base), len(base) + len(other)])
                    sig, whose = jaccard_join.signatures(np.concatenate([base, other]), places, p, q)
                    assert len(np.intersect1d(sig[whose == 0], sig[whose == 1]))


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(8)
    for _ in range(200):
        base = np.unique(rng.integers(1, 1 << 63, rng.integers(1, 3000), dtype=np.uint64))
        other = np.unique(np.concatenate([base[: rng.integers(0, len(base) + 1)], rng.integers(1, 1 << 63, rng.integers(1, 900), dtype=np.uint64)]))
        rows = jaccard_join.folded([jaccard_join.parity_sketch(base), jaccard_join.parity_sketch(other)])
        differ, apart = int(np.bitwise_count(rows[0] ^ rows[1]).sum()), len(np.setxor1d(base, other))
        assert differ <= apart and (apart > 0.4 * len(base) or len(base) < 200 or differ >= 0.6 * apart)


def test_thin_parts_give_no_signature():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 3, 30, 300, 3000)]
    for p, q in ((9, 10), (4, 5)):
        upper, differ, spare = jaccard_join.size_classes(3000, p, q)
        for own in sets:
            k = int(np.searchsorted(upper, len(own)))
            wanted = sum(int(differ[j]) + 1 for j in (k, k - 1) if j >= 0 and differ[j])
            sig, _ = jaccard_join.signatures(own, np.array([0, len(own)]), p, q)
            assert len(sig) == wanted


def test_shared_rows_over_any_batches():
    rng = np.random.default_rng(9)
    for _ in range(200):
        rows = sorted((int(a), int(b)) for a, b in rng.integers(0, 8, (rng.integers(0, 30), 2)))
        cuts = sorted(rng.integers(0, len(rows) + 1, 4).tolist())
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in (0, 1)], ["sig", "node"]) for part in parts]
        found = [(r["sig"], r["node"]) for b in jaccard_join._shared(iter(batches)) for r in b.to_pylist()]
        distinct = sorted(set(rows))
        assert found == [r for r in distinct if sum(x[0] == r[0] for x in distinct) > 1]


def test_large_buckets_become_stars_over_any_batches(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRED", 3)
    rng = np.random.default_rng(10)
    for _ in range(100):
        tokens = np.unique(rng.integers(1, 1 << 63, 40, dtype=np.uint64))
        rows = sorted((int(s), int(n)) for s, n in {(a, b) for a, b in rng.integers(0, 6, (rng.integers(0, 40), 2)).tolist()})
        cuts = sorted(rng.integers(0, len(rows) + 1, 3).tolist())
        batches = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            part, sketch = rows[a:b], jaccard_join.parity_sketch(tokens)
            arrays = [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([40] * len(part), pa.int64()), pa.array([sketch] * len(part), pa.binary())]
            batches.append(pa.RecordBatch.from_arrays(arrays, ["sig", "node", "n", "sketch"]))
        found = {(r["a"], r["b"]) for b in jaccard_join._bounded_edges(9, 10)(iter(batches)) for r in b.to_pylist()}
        wanted = set()
        for sig in {r[0] for r in rows}:
            nodes = [n for s, n in rows if s == sig]  # equal sketches: a forest is a star as well
            wanted |= {(nodes[0], n) for n in nodes[1:]}
        assert found == wanted


def test_very_long_texts(spark):
    rng = np.random.default_rng(13)
    words = [f"w{x}" for x in rng.integers(0, 50_000, 60_000)]
    other = list(words)
    other[::400] = ["x"] * len(other[::400])
    far = list(words)
    far[::6] = ["y"] * len(far[::6])
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far)), (4, "z" * 1_000_000)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, (9, 10)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == brute(rows, 3, 9, 10)
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_hot_digests_are_parted(spark):
    rows = [(i, "one text that a third of all rows have") for i in range(400)] + [(1000 + i, f"own {i} words of this row {i}") for i in range(700)] + [(5000 + i, None) for i in range(100)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, (9, 10)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 if i < 400 else i for i, _ in rows}
