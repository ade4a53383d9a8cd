"""SimHash fingerprints and near duplicates by pigeonhole blocks.

A fingerprint bit is set where over half of a text's 3-word shingles, repeats included,
have it set in their XXH64. Equal fingerprints are one node. Its 64 bits are four blocks;
of two fingerprints that differ in two bits, two blocks at least are equal, so each
node is filed under its six pairs of blocks (32-bit keys). Nodes of one key are compared
and those at two bits or fewer linked; a task emits the edges of a spanning forest, not all pairs.

A key with more than FULL nodes (a large cluster of near copies) is too much for a task.
Its nodes are filed, instead, under every number that differs from them in at most one bit: two
nodes at a distance of two or less have such a number in common, no number has more than 65
nodes, and any two of them are at most two bits apart. So this is exact, too, and grows with
the number of nodes only.

Null or blank text: no words, fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence is the one shingle. Rows without an id have a component, but do not
name it: its component_id is its smallest id, or null where no row of it has one. Repeated rows
are returned each. A very long text is hashed in slices. An empty table has no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace
from tidewright.llm.components import components
from tidewright.llm.spread import hot_keys, spread_left_join
from tidewright.llm.textkernel import small

FULL = 512
#: Links are two differing bits at most, which four blocks and numbers one bit apart find; the hash's seed.
BITS = 2
BLOCKS = 4
SEED = 42
_SLICE = 100_000


def bit_counts(text: str, width: int) -> tuple[np.ndarray, int]:
    """In how many of the text's shingles each bit is set (lowest bit first), and the number of shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(64, np.int64), 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    last = max(len(words) - width + 1, 1)
    starts, stops = starts[:last].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist()
    counts, one = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, last, _SLICE):
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE])]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return counts, last


def simhash(text: str, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    counts, n = bit_counts(text, width)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0]) if n else 0


def _fingerprint_rows(width: int):
    def run(batches):
        for batch in small(batches):
            found = [simhash(t, width) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "node"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, node): every row's fingerprint as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_rows(width), f"doc_id {kind}, node long")


def _forest(nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what links connect."""
    own = nodes.view(np.uint64)  # the count of a signed number is that of its absolute value
    near = np.bitwise_count(own[:, None] ^ own[None, :]) <= BITS
    root, places = np.arange(len(nodes)), np.arange(len(nodes))
    while True:
        least = np.where(near, root[None, :], len(nodes)).min(1)
        least = np.minimum(least, least[least])
        if (least == root).all():
            return [(int(nodes[i]), int(nodes[root[i]])) for i in places[root != places].tolist()]
        root = least


def _edges(groups: list[np.ndarray]) -> pa.RecordBatch:
    found = [edge for nodes in groups for edge in _forest(nodes)]
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _linked(batches):
    """Rows (block, node), sorted, to edges; the last block of a batch, of FULL nodes at most, waits for the next one."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        block, node = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("block", "node")))
        if not len(block):
            continue
        at = np.flatnonzero(np.diff(block, prepend=-1))
        yield _edges([node[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if b - a > 1])
        held = block[at[-1] :], node[at[-1] :]
    yield _edges([held[1]])


def near_fingerprints(work: Workspace, nodes: DataFrame) -> DataFrame:
    """(a, b): edges whose components are those of all links between the distinct ``nodes`` (node)."""
    size = 64 // BLOCKS
    block = lambda k: F.shiftrightunsigned("node", size * k).bitwiseAND(F.lit((1 << size) - 1))
    pairs = enumerate(combinations(range(BLOCKS), 2))
    keys = F.array(*(F.lit(pair << 2 * size).cast("long") + F.shiftleft(block(b), size) + block(a) for pair, (a, b) in pairs))
    filed = work.keep("filed", nodes.select(F.explode(keys).alias("block"), "node"))
    full = work.keep("full", filed.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > FULL).select("block"))
    few = filed.join(full, "block", "left_anti").repartition("block").sortWithinPartitions("block")
    edges = few.mapInArrow(_linked, "a long, b long")
    if full.isEmpty():
        return edges
    flipped = [F.col("node").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]
    many = filed.join(full, "block", "left_semi").select("node").distinct()
    met = many.select(F.explode(F.array("node", *flipped)).alias("middle"), "node").groupBy("middle").agg(F.collect_set("node").alias("nodes"))
    stars = met.where(F.size("nodes") > 1).select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b"))
    return edges.unionByName(stars.where("a <> b").distinct())


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the smallest id that links of BITS differing bits reach."""
    work = Workspace(docs.sparkSession, "simhash")
    rows = work.keep("rows", fingerprints(docs, width))
    nodes = work.keep("nodes", rows.groupBy("node").agg(F.min("doc_id").alias("first")))
    roots = components(work, near_fingerprints(work, nodes.select("node")), "near")
    rooted = nodes.join(roots.hint("merge"), "node")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = nodes.join(rooted.select("node", "root").join(least, "root"), "node", "left")
    of = work.keep("named", named.select("node", F.least("first", "least").alias("component_id")))
    for name in ("filed", "full", "nodes", "near-roots"):
        work.drop(name)
    found = spread_left_join(rows, of, "node", work.keep("hot", hot_keys(rows, "node")), "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
