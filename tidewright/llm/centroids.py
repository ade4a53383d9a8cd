"""Centroid clustering over weighted distinct vectors, in exact integers.

A vector's components become integers floor(scale * x). Equal vectors are one row with a
weight, grouped before anything else, so that a vector that a third of all rows have is
one row. Lloyd's rounds run on the distinct ones: each task assigns its vectors and emits the
weighted sums of its clusters, which are added up by key; the ``k`` centroids
of ``width`` integers and their sums are all that the driver holds. Assignments are joined back to the
rows by vector.

Distances are squared Euclidean; of equal ones the smaller number wins. A centroid is the
floor of its vectors' mean; empty ones stay. The first centroids are the kept rows whose ids
have the smallest SHA-256; rows of one id are ordered by their vectors, those without an
id come last. With less than ``k`` kept rows there are as many clusters as rows.

Left out: null vectors, other lengths than ``width``, and those with a null, NaN or infinite
component. Rows without an id and repeated rows are returned each. An integer beyond 2^27 is
an error, since its distances need not fit 64 bits; a sum of distances beyond 63 bits is one,
too. An empty table has no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace
from tidewright.llm.spread import hot_keys, spread_left_join

LARGEST = 1 << 27
_PART = 20


def quantised(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(vec_id, vector binary) of the kept rows: ``width`` little-endian signed 32-bit integers."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kept = rows.where((F.size("embedding") == width) & F.forall("embedding", finite))

    def pack(batches):
        for batch in batches:
            x = np.floor(batch.column("embedding").flatten().to_numpy() * float(scale)).reshape(-1, width)
            if x.size and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} / {scale}: its distances need not fit 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary())], ["vec_id", "vector"])

    return kept.mapInArrow(pack, f"vec_id {kind}, vector binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cluster and its squared distance."""
    distances = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    cluster = distances.argmin(1)
    return cluster, distances[np.arange(len(x)), cluster]


def _sums(centroids: np.ndarray):
    """Rows (vector, weight) to (cluster, place, total): weighted sums of components by their place, at -1 of the weights."""
    k, width = centroids.shape

    def run(batches):
        totals = np.zeros((k, width + 1), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, weight = _matrix(batch.column("vector"), width), batch.column("weight").to_numpy()
            cluster, _ = _nearest(x, centroids)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            for c in np.unique(cluster).tolist():
                own, w = x[cluster == c], weight[cluster == c]
                # the weights' digits to the base 2^20, so that no 64-bit sum of a batch overflows
                for digit in range(3):
                    sums = (own * ((w >> (digit * _PART)) & ((1 << _PART) - 1))[:, None]).sum(0)
                    totals[c] += np.array([int(s) << (digit * _PART) for s in sums], object)
        seen = [c for c in range(k) if totals[c, width]]
        places = [*range(width), -1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(seen, width + 1).astype(np.int32)), pa.array(places * len(seen), pa.int32()), pa.array([str(t) for c in seen for t in totals[c]], pa.string())],
            ["cluster", "place", "total"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            cluster, distance = _nearest(_matrix(batch.column("vector"), centroids.shape[1]), centroids)
            columns = [batch.column("vector"), batch.column("weight"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vector", "weight", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    work = Workspace(spark, "centroids")
    rows = work.keep("rows", quantised(vectors, width, scale))
    distinct = work.keep("distinct", rows.groupBy("vector").agg(F.count("*").alias("weight")))
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    firsts = [bytes(r["vector"]) for r in rows.orderBy(order, "vector").limit(k).collect()]
    centroids = np.frombuffer(b"".join(firsts), "<i4").reshape(-1, width).astype(np.int64)
    for _ in range(rounds if len(firsts) else 0):
        sums = distinct.mapInArrow(_sums(centroids), "cluster int, place int, total string")
        sums = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        totals = {(r["cluster"], r["place"]): int(r["total"]) for r in sums.collect()}  # at most k * (width + 1)
        moved = [[totals[c, d] // totals[c, -1] for d in range(width)] if (c, -1) in totals else own.tolist() for c, own in enumerate(centroids)]
        if (moved := np.array(moved, np.int64)).tolist() == centroids.tolist():
            break
        centroids = moved

    if firsts:
        placed = distinct.mapInArrow(_assigned(centroids), "vector binary, weight long, cluster int, distance long")
    else:
        placed = distinct.select("vector", "weight", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    placed = work.keep("placed", placed)
    summed = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight")).alias("inertia"))
    inertias = {r["cluster"]: int(r["inertia"]) for r in summed.collect()}  # at most k
    named = [(c, inertias[c], sum(inertias.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(inertias)]
    of_cluster = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = spread_left_join(rows, placed.select("vector", "cluster", "distance"), "vector", work.keep("hot", hot_keys(rows, "vector")), "vec_id")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
