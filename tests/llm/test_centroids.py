import hashlib
import math

import numpy as np
import pytest

from tidewright.llm.centroids import LARGEST, cluster_vectors


def brute(rows, k=8, rounds=10, width=64):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), row by row."""
    kept = [(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~"
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            if members := [v for (_, v), c in zip(kept, own) if c == n]:
                centroids[n] = tuple(sum(x) // len(members) for x in zip(*members))
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, c, d in last if c == n) for n in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in last), key=str)


def found(frame, **kw):
    return sorted((tuple(r) for r in cluster_vectors(frame, **kw).collect()), key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (5, 64))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(0, 0.3, 64)]) for i in range(150)]
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(80)] + [(7, rows[0][1]), (7, rows[0][1]), (None, rows[1][1]), (None, rows[2][1])]
    bad = [(2000, None), (2001, [0.0] * 63), (2002, [0.0] * 65), (2003, [0.0] * 63 + [None]), (2004, [math.nan] + [0.0] * 63), (2005, [math.inf] + [0.0] * 63), (2006, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, cluster string").repartition(5)
    assert found(frame) == brute(rows + bad)


def test_ties_and_empty_clusters(spark):
    """Two equal first centroids: the smaller number takes all, the other stays empty and where it was."""
    rows = [(i, [float(i % 2)] * 4) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(frame, k=5, width=4) == brute(rows, 5, 10, 4)
    small = [(1, [0.5] * 4), (2, [-0.0001] * 4), (2, [-0.0001] * 4)]
    assert found(spark.createDataFrame(small, "vec_id long, embedding array<double>"), width=4) == brute(small, 8, 10, 4)


def test_weights_beyond_one_digit_are_exact():
    """Sums of a vector with a weight of 2^39."""
    import pyarrow as pa

    from tidewright.llm.centroids import _sums

    vectors = np.array([[LARGEST, -LARGEST], [3, -5]], "<i4")
    batch = pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([(1 << 39) + 12345, 7])], ["vector", "weight"])
    (out,) = _sums(np.zeros((1, 2), np.int64))([batch])
    n = (1 << 39) + 12345
    assert {r["place"]: int(r["total"]) for r in out.to_pylist()} == {0: LARGEST * n + 21, 1: -LARGEST * n - 35, -1: n + 7}


def test_nothing_kept_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    assert cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    assert cluster_vectors(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(spark.createDataFrame([(1, [3e38] * 64)], schema)).count()
