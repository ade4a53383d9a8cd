"""N-gram Jaccard join by a token-group matrix.

A document is its set of distinct word shingles. Two documents link when the
Jaccard similarity of their sets reaches the threshold, and every document gets
the smallest doc_id that it can reach by links. The result is exact up to
collisions of 64-bit shingle hashes.

1. Equal sets collapse to one node, named by a 128-bit digest; copies never meet
   as rows again.
2. Candidate families. If two sets of sizes in one size class link, they differ in
   at most d tokens, so of d + 1 + s parts of the token space at least s + 1 hold
   the same tokens in both. Each node gives a signature for each part of its class
   and of the class below, but for the s parts of fewest tokens. In a bucket of
   equal signatures a parity sketch of each set bounds from below how many tokens
   two of them differ in; pairs within the bound are joined along a spanning forest
   (a bucket of more than ``PAIRED`` nodes is joined as a star, which holds all that
   could link). Families are the components of those edges.
3. Token-group matrix. The nodes of a family (in pieces of bounded size) are put
   in order of their smallest tokens, cut into groups, and each group's token
   union goes into a sparse token x group matrix. A query's overlap with the union
   bounds its overlap with each member; only groups that reach the overlap that
   the threshold needs are opened, and there only members not yet connected.
   Where links are counted, every qualifying group is opened.
4. Families of several pieces: one delegate of each found component goes on to
   the next round until they fit in one piece. What is then still apart is
   compared in full: every node outside the family's largest component queries
   each piece with which it shares a signature. To count links every node does.

Rows: one for each input row. Null or wordless text: an empty set, linked with
nothing. Null doc_id: the row stays, links nothing and has a null component.
Repeated ids and repeated rows: each row is returned; equal sets link. A pair at the
threshold itself links. A long text is shingled whole; its set is held once in each
task that compares it. An empty table has no rows. Other columns are not read,
whatever their names. Rows of one signature, 16 bytes each, pass through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace
from tidewright.llm.columns import numbered
from tidewright.llm.components import components
from tidewright.llm.spread import hot_keys, spread_left_join
from tidewright.llm.textkernel import blocks, mix, shingle_sets, small

GROUP = 32
FEW = 6
PIECE_NODES = 2048
PIECE_TOKENS = 2_000_000
SPARE = 4  # one spare part for so many others
PAIRED = 2048
PAIRED_BYTES = 32 << 20


def size_classes(largest: int, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each class: its upper size, the tokens that a linked pair can differ in, and the spare parts, for the threshold p / q."""
    upper, differ, low = [], [], 1
    while not upper or upper[-1] < largest:
        top = max(low, low * q // p)
        upper.append(top)
        differ.append((q - p) * (top + top * q // p) // (q + p))
        low = top + 1
    d = np.array(differ)
    return np.array(upper), d, np.maximum(2, -(-(d + 1) // SPARE))


def signatures(tokens: np.ndarray, places: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of every set, and the index of the set that each belongs to.

    Of its class's parts a linked pair agrees in one more than the spare ones. In any
    one order of the parts' contents, each set may leave out as many of the first
    ones as there are spare ones: the last one that the pair agrees in is left. The
    order is by the number of tokens (then by the part), so that empty and thin
    parts, in which unlike sets agree, give no signature. Where a class allows no
    difference, linked sets are equal and need none.
    """
    sizes = np.diff(places)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    upper, differ, spare = size_classes(int(sizes.max()), p, q)
    own = np.searchsorted(upper, sizes[rows])
    owner = np.repeat(np.arange(len(rows)), sizes[rows])
    low = (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = (tokens >> np.uint64(32)).astype(np.float64)
    spread = (tokens >> np.uint64(20)).astype(np.int64)
    found, whose = [], []
    for below in (0, 1):
        klass = own - below
        used = (klass >= 0) & (differ[klass] > 0)
        count = np.where(used, (differ + 1 + spare)[klass], 0)
        base = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(count, out=base[1:])
        mine = used[owner]
        cell = base[owner[mine]] + spread[mine] % count[owner[mine]]
        total = int(base[-1])
        held = np.bincount(cell, minlength=total)
        content = np.bincount(cell, low[mine], total).astype(np.uint64) + (
            np.bincount(cell, high[mine], total).astype(np.uint64) << np.uint64(32)
        )
        row = np.repeat(np.arange(len(rows)), count)
        order = np.argsort(row * 256 + np.minimum(held, 255), kind="stable")
        kept = order[np.arange(total) - base[row] >= spare[klass][row]]  # rows stay together in the order
        label = mix((klass[row].astype(np.uint64) << np.uint64(40)) + (np.arange(total) - base[row]).astype(np.uint64))
        found.append(mix(content + label)[kept])
        whose.append(rows[row[kept]])
    return np.concatenate(found), np.concatenate(whose)


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, _, text, starts in blocks(batch.column("text")):
        yield row, *shingle_sets(text, starts, width)


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Parity of the token count in each hash cell, two to four cells a token; a power of two, so that larger ones fold into smaller ones.

    Two sketches differ in no more cells than the sets differ in tokens, and in nearly as many.
    """
    cells = 64
    while cells < 2 * len(tokens):
        cells *= 2
    odd = np.bincount((tokens >> np.uint64(3)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: Sequence[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit words, in the smallest one's cells."""
    least = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), 0) for x in sketches])


def _digest_rows(width: int):
    def run(batches):
        for batch in small(batches):
            sizes, digests, sketches = [], [], []
            for _, tokens, places in _sets(batch, width):
                for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
                    sizes.append(b - a)
                    digests.append(_digest(tokens[a:b]) if b > a else None)
                    sketches.append(parity_sketch(tokens[a:b]) if b > a else None)
            own = [batch.column("doc_id"), batch.column("seen"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "seen", "n_shingles", "digest", "sketch"])

    return run


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _signature_rows(width: int, p: int, q: int):
    """(sig, node) rows. A set that this task has seen gives no rows again; that memory is bounded by the task's rows."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in small(batches):
            for _, tokens, places in _sets(batch, width):
                fresh, nodes = [], []
                for i, (a, b) in enumerate(zip(places[:-1].tolist(), places[1:].tolist())):
                    if b > a and (d := _digest(tokens[a:b])) not in seen:
                        seen.add(d)
                        fresh.append(i)
                        nodes.append(_node(d))
                if not fresh:
                    continue
                fresh_sets = [tokens[places[i] : places[i + 1]] for i in fresh]
                at = np.concatenate([[0], np.cumsum([len(s) for s in fresh_sets])])
                sig, whose = signatures(np.concatenate(fresh_sets), at, p, q)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.array(nodes)[whose])], ["sig", "node"])

    return run


def _shared(batches):
    """Rows whose signature another node has too, each once; the rows come sorted by signature and node."""
    sig, node, joined = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in chain(batches, [None]):
        held = len(sig)
        if batch is not None:
            sig, node = (np.concatenate([x, batch.column(k).to_numpy()]) for x, k in ((sig, "sig"), (node, "node")))
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        alike = sig[1:] == sig[:-1]
        keep = np.concatenate([alike, [False]]) | np.concatenate([[joined and held > 0], alike])
        done = len(sig) if batch is None else len(sig) - 1  # the last row waits for the one after it
        out = keep[:done]
        yield pa.RecordBatch.from_arrays([pa.array(sig[:done][out]), pa.array(node[:done][out])], ["sig", "node"])
        joined = bool(keep[-1]) if len(sig) > 1 or held == 0 else joined
        sig, node = sig[done:], node[done:]


def _forest(held: list[tuple], p: int, q: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the (node, size, sketch) triples that may link."""
    if len(held) < 2:
        return []
    nodes, sizes, sketches = zip(*held)
    sizes, rows = np.array(sizes), folded(sketches)
    label, edges = np.arange(len(nodes)), []
    for i in range(len(nodes) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(others):
            continue
        differ = np.bitwise_count(rows[others] ^ rows[i]).sum(1, dtype=np.int64)
        for j in others[differ * (p + q) <= (q - p) * (sizes[others] + sizes[i])].tolist():
            if label[i] != label[j]:
                edges.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return edges


def _near_pairs(first: list[tuple], second: list[tuple], p: int, q: int) -> list[tuple[int, int]]:
    """Those of the pairs of (node, size, sketch) triples that may link; pairs of one sketch length are compared together."""
    edges, alike = [], {}
    for x, y in zip(first, second):
        if len(x[2]) == len(y[2]):
            alike.setdefault(len(x[2]), []).append((x, y))
        else:
            edges += _forest([x, y], p, q)
    for length, pairs in alike.items():
        left, right = (np.frombuffer(b"".join(pair[k][2] for pair in pairs), np.uint64).reshape(-1, length // 8) for k in (0, 1))
        sizes = np.array([x[1] + y[1] for x, y in pairs])
        near = np.bitwise_count(left ^ right).sum(1, dtype=np.int64) * (p + q) <= (q - p) * sizes
        edges += [(pairs[i][0][0], pairs[i][1][0]) for i in np.flatnonzero(near).tolist()]
    return edges


def _bounded_edges(p: int, q: int):
    """Edges between nodes of one signature that their sizes and sketches allow to link; the rows come sorted by signature.

    Of a bucket no more than ``PAIRED`` nodes or ``PAIRED_BYTES`` of sketches are
    held: the first ones of a larger bucket become a star, and later ones join its
    centre as they pass.
    """

    def run(batches):
        at, held, weight, star = None, [], 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column("sig").to_numpy()
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("node", "n", "sketch"))))
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])).tolist()
            edges, pairs = [], []
            for a, z in zip(starts, [*starts[1:], len(sig)]):
                if sig[a] != at:
                    if not star:
                        edges += _forest(held, p, q)
                    at, held, weight, star = sig[a], [], 0, False
                    if z - a == 2 and z < len(sig):
                        pairs.append(a)
                        continue
                for own in rows[a:z]:
                    if star:
                        edges.append((held[0][0], own[0]))
                        continue
                    held.append(own)
                    weight += len(own[2])
                    if len(held) > 1 and (len(held) > PAIRED or weight > PAIRED_BYTES):
                        edges += [(held[0][0], x[0]) for x in held[1:]]
                        held, star = held[:1], True
            edges += _near_pairs([rows[a] for a in pairs], [rows[a + 1] for a in pairs], p, q)
            if edges:
                yield _edge_batch(set(edges))
        if held and not star and (edges := _forest(held, p, q)):
            yield _edge_batch(edges)

    return run


def _edge_batch(edges) -> pa.RecordBatch:
    a, b = zip(*edges)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _batched(run, rows: int = 20_000):
    """Small batches of ``run`` put together."""

    def merged(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


def _family_sets(width: int):
    """The token set of each wanted row whose text has the wanted digest. A set that this task has given is not given again."""

    def run(batches):
        given = set()
        for batch in small(batches):
            wanted = batch.column("digest").to_pylist()
            keep, packed = [], []
            for row, tokens, places in _sets(batch, width):
                for i in range(len(places) - 1):
                    own = tokens[places[i] : places[i + 1]]
                    if wanted[row + i] not in given and _digest(own) == wanted[row + i]:
                        given.add(wanted[row + i])
                        keep.append(row + i)
                        packed.append(own.tobytes())
            rest = batch.select(["family", "piece", "digest", "copies"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(packed, pa.binary())], ["family", "piece", "digest", "copies", "tokens"])

    return run


def _runs(batches, keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows of equal keys; a run may go over several batches."""
    at, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        start = 0
        for i in range(len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if start < i:
                    if at is not None and rows[start] != at:
                        yield at, held
                        held = []
                    at = rows[start]
                    held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield at, held


class Postings:
    """Which holders have each token, as a sorted list of (token, holder)."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.holders, self.tokens = len(sets), tokens[order]
        self.holder = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    def shared(self, query: np.ndarray) -> np.ndarray:
        """How many of the query's tokens each holder has."""
        a, b = np.searchsorted(self.tokens, query), np.searchsorted(self.tokens, query, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.holder[at], minlength=self.holders)


class TokenGroups:
    """The token-group matrix of some sets: which groups hold each token in their union."""

    def __init__(self, sets: list[np.ndarray], group: int = GROUP):
        order = sorted(range(len(sets)), key=lambda i: sets[i][:4].tolist())
        self.members = [np.array(order[i : i + group]) for i in range(0, len(order), group)]
        self.matrix = Postings([np.unique(np.concatenate([sets[i] for i in m])) for m in self.members])

    def qualifying(self, query: np.ndarray, least: int) -> np.ndarray:
        """Members of the groups whose union shares ``least`` tokens or more with the query."""
        open_ = np.flatnonzero(self.matrix.shared(query) >= least)
        return np.concatenate([self.members[g] for g in open_]) if len(open_) else np.zeros(0, np.int64)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int(np.count_nonzero(y[at] == x))


def links(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if small * q < large * p:
        return False
    both = overlap(x, y)
    return q * both >= p * (len(x) + len(y) - both)


def connect(sets: list[np.ndarray], label: np.ndarray, p: int, q: int, queries: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels merged along every link between differing labels, and how often each set was met by a link.

    Exact: a pair is left out only if it has one label already, its group's union
    is too far from the query, or its sizes are too far apart.
    """
    matrix, postings = TokenGroups(sets), None
    hits, sizes = np.zeros(len(sets), np.int64), np.array([len(s) for s in sets])
    for i in queries if queries is not None else range(len(sets)):
        own, n = sets[i], sizes[i]
        members = matrix.qualifying(own, -(-n * p // q))
        members = members[(label[members] != label[i]) & (sizes[members] * q >= n * p) & (sizes[members] * p <= n * q)]
        if len(members) > FEW:
            postings = postings or Postings(sets)
            both = postings.shared(own)[members]
            met = members[q * both >= p * (n + sizes[members] - both)]
        else:
            met = members[[links(own, sets[j], p, q) for j in members]] if len(members) else members
        if len(met):
            hits[met] += 1
            hits[i] += len(met)
            label[np.isin(label, label[met])] = label[i]
    return label, hits


def link_counts(sets: list[np.ndarray], copies: np.ndarray, p: int, q: int) -> np.ndarray:
    """How many documents each set links with, those of its own set left out: every qualifying group is opened whole."""
    matrix, postings, sizes = TokenGroups(sets), Postings(sets), np.array([len(s) for s in sets])
    found = np.zeros(len(sets), np.int64)
    for i, own in enumerate(sets):
        met = _met(matrix, postings, sizes, own, p, q)
        found[i] = copies[met[met != i]].sum()
    return found


def _met(matrix: TokenGroups, postings: Postings, sizes: np.ndarray, own: np.ndarray, p: int, q: int) -> np.ndarray:
    members = matrix.qualifying(own, -(-len(own) * p // q))
    both = postings.shared(own)[members]
    return members[q * both >= p * (len(own) + sizes[members] - both)]


def _held_sets(held: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint64) for b in held for t in b.column("tokens").to_pylist()]


_ROOTED = "family long, piece int, digest binary, root binary"


def _within_pieces(p: int, q: int, count: bool = False):
    """(family, piece, digest, root): the components inside each piece, each named by the member that met most links; one row for each digest.

    With ``count`` also how many documents of the piece each set links with.
    """

    def run(batches):
        for (family, piece), held in _runs(batches, ["family", "piece"]):
            distinct = dict(zip((d for b in held for d in b.column("digest").to_pylist()), _held_sets(held)))
            digests, sets = list(distinct), list(distinct.values())
            label, hits = connect(sets, np.arange(len(digests)), p, q)
            best: dict[int, int] = {}
            for i in sorted(range(len(digests)), key=lambda i: (-hits[i], digests[i])):
                best.setdefault(int(label[i]), i)
            columns = [
                pa.array([family] * len(digests), pa.int64()),
                pa.array([piece] * len(digests), pa.int32()),
                pa.array(digests, pa.binary()),
                pa.array([digests[best[int(x)]] for x in label], pa.binary()),
            ]
            if count:
                copies = dict(zip((d for b in held for d in b.column("digest").to_pylist()), (n for b in held for n in b.column("copies").to_pylist())))
                columns.append(pa.array(link_counts(sets, np.array([copies[d] for d in digests]), p, q)))
            yield pa.RecordBatch.from_arrays(columns, ["family", "piece", "digest", "root", *["links"] * count])

    return run


def _across_pieces(p: int, q: int):
    """Links of visiting sets with a piece's own sets of other components; the piece's own come first and only they are held."""

    def run(batches):
        at, hosts, matrix = None, [], None
        for batch in batches:
            edges = set()
            for row in batch.to_pylist():
                if (row["family"], row["piece"]) != at:
                    at, hosts, matrix, root_of, known = (row["family"], row["piece"]), [], None, [], set()
                own = np.frombuffer(row["tokens"], np.uint64)
                if not row["visits"]:
                    hosts.append(own)
                    root_of.append(row["root"])
                    continue
                if matrix is None:
                    matrix, postings, sizes = TokenGroups(hosts), Postings(hosts), np.array([len(h) for h in hosts])
                for i in _met(matrix, postings, sizes, own, p, q).tolist():
                    pair = (row["root"], root_of[i])
                    if pair[0] != pair[1] and pair not in known:
                        known.add(pair)
                        edges.add(pair)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def _counts_across(p: int, q: int):
    """(digest, links): with how many documents of a piece each visiting set links; the piece's own come first and only they are held."""

    def run(batches):
        at, hosts, matrix = None, [], None
        for batch in batches:
            digests, counts = [], []
            for row in batch.to_pylist():
                if (row["family"], row["piece"]) != at:
                    at, hosts, matrix, copies = (row["family"], row["piece"]), [], None, []
                own = np.frombuffer(row["tokens"], np.uint64)
                if not row["visits"]:
                    hosts.append(own)
                    copies.append(row["copies"])
                    continue
                if matrix is None:
                    matrix, postings, sizes, weight = TokenGroups(hosts), Postings(hosts), np.array([len(h) for h in hosts]), np.array(copies)
                digests.append(row["digest"])
                counts.append(int(weight[_met(matrix, postings, sizes, own, p, q)].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["digest", "links"])

    return run


def _first64(column: pa.Array) -> np.ndarray:
    return np.array([_node(d) for d in column.to_pylist()], np.int64)


def _piece_signatures(p: int, q: int):
    """(key, piece, node, root, minor): signatures mixed with the family; node and root by the first 64 bits of their digests."""

    def run(batches):
        for batch in batches:
            sets = _held_sets([batch])
            if not sets:
                continue
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            sig, whose = signatures(np.concatenate(sets), at, p, q)
            family = batch.column("family").to_numpy().view(np.uint64)
            key = mix(sig ^ mix(family)[whose]).view(np.int64)
            rest = [batch.column("piece").to_numpy(), _first64(batch.column("digest")), _first64(batch.column("root")), batch.column("minor").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(x[whose]) for x in rest)], ["key", "piece", "node", "root", "minor"])

    return run


def _visits(batches):
    """(node, piece): pieces where a set of another component has a signature of a minor node; the rows come sorted by key."""
    names = ["key", "piece", "node", "root", "minor"]
    held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, bool)]
    for batch in chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for x, k in zip(held, names)]
        key, piece, node, root, minor = held
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        if batch is not None:  # the last run may go on
            starts, ends = starts[:-1], ends[:-1]
        done = int(ends[-1]) if len(ends) else 0
        found = set()
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            if not minor[a:b].any() or (root[a:b] == root[a]).all():
                continue
            roots: dict[int, set[int]] = {}
            for where, r in zip(piece[a:b].tolist(), root[a:b].tolist()):
                roots.setdefault(where, set()).add(r)
            asks = {(n, r) for n, r, m in zip(node[a:b].tolist(), root[a:b].tolist(), minor[a:b].tolist()) if m}
            found |= {(n, where) for n, r in asks for where, there in roots.items() if len(there) > 1 or r not in there}
        held = [x[done:] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32())], ["node", "piece"])


def _links_between_pieces(work: Workspace, sets: DataFrame, several: DataFrame, p: int, q: int) -> DataFrame:
    """(digest, links) of the sets of families of several pieces: documents of other pieces that each links with."""
    full = sets.join(several.hint("merge"), "family", "left_semi").withColumns({"root": F.col("digest"), "minor": F.lit(True)})
    cells = full.mapInArrow(_piece_signatures(p, q), "key long, piece int, node long, root long, minor boolean").select("key", "piece", "node")
    there = cells.select("key", F.col("piece").alias("where")).distinct()
    asked = cells.join(there.hint("merge"), "key").where("piece <> where").select("node", F.col("where").alias("piece"))
    visits = work.keep("other-pieces", asked.distinct())
    own = full.withColumn("node", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long"))
    columns = ["family", "piece", "digest", "copies", "tokens"]
    guests = own.drop("piece").join(visits.hint("merge"), "node").select(*columns, F.lit(True).alias("visits"))
    both = full.select(*columns, F.lit(False).alias("visits")).unionByName(guests)
    ordered = both.repartition("family", "piece").sortWithinPartitions("family", "piece", "visits")
    return ordered.mapInArrow(_counts_across(p, q), "digest binary, links long").groupBy("digest").agg(F.sum("links").alias("links"))


def _by_piece(frame: DataFrame) -> DataFrame:
    return frame.repartition("family", "piece").sortWithinPartitions("family", "piece")


def _join_pieces(work: Workspace, sets: DataFrame, local: DataFrame, p: int, q: int) -> DataFrame:
    """(digest, root) of the nodes in ``local``, with the components of a family's pieces merged."""
    pieces = local.groupBy("family").agg(F.count_distinct("piece").alias("pieces")).where("pieces > 1").select("family")
    several = work.keep("several", pieces)
    if several.isEmpty():
        return local.select("digest", "root")
    sets, parted = (x.join(several.hint("merge"), "family", "left_semi") for x in (sets, local))
    named, delegates, before = parted, parted.select("family", F.col("root").alias("digest")).distinct(), None
    for level in range(1, 64):
        counted = delegates.groupBy("family").agg(F.count("*").alias("nodes"))
        total, most = counted.agg(F.sum("nodes"), F.max("nodes")).first()
        if before is not None and total > 0.7 * before:
            break
        before = total
        piece = F.pmod(F.xxhash64("digest", F.lit(level)), F.ceil(F.col("nodes") / PIECE_NODES)).cast("int")
        placed = delegates.join(counted, "family").select("family", "digest", piece.alias("piece"))
        chosen = sets.drop("piece").join(placed.hint("merge"), ["family", "digest"]).select("family", "piece", "digest", "tokens")
        joined = work.keep(f"round-{level}", _by_piece(chosen).mapInArrow(_batched(_within_pieces(p, q)), _ROOTED))
        later = joined.select("family", F.col("digest").alias("root"), F.col("root").alias("later"))
        named = named.join(later, ["family", "root"], "left").withColumn("root", F.coalesce("later", "root")).drop("later")
        delegates = joined.select("family", F.col("root").alias("digest")).distinct()
        if most <= PIECE_NODES:
            break
    named = work.keep("named", named.select("family", "piece", "digest", "root"))
    sizes = named.groupBy("family", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("apart"))
    rest = work.keep("largest", largest.where("apart > 1").select("family", "largest"))
    final = named.select("digest", "root")
    if not rest.isEmpty():
        found = _across(work, sets, named, rest, p, q).select(F.col("node").alias("root"), F.col("root").alias("later"))
        final = final.join(found, "root", "left").select("digest", F.coalesce("later", "root").alias("root"))
    single = local.join(several.hint("merge"), "family", "left_anti")
    return single.select("digest", "root").unionByName(final)


def _across(work: Workspace, sets: DataFrame, named: DataFrame, rest: DataFrame, p: int, q: int) -> DataFrame:
    """(node, root) over components: every set outside its family's largest component visits the pieces whose signatures it shares."""
    full = sets.drop("piece").join(named.join(rest, "family").hint("merge"), ["family", "digest"])
    full = work.keep("apart", full.select("family", "piece", "digest", "root", "tokens", (F.col("root") != F.col("largest")).alias("minor")))
    cells = full.mapInArrow(_piece_signatures(p, q), "key long, piece int, node long, root long, minor boolean")
    asked = cells.repartition("key").sortWithinPartitions("key").mapInArrow(_visits, "node long, piece int")
    visits = work.keep("visits", asked.distinct())
    own = full.withColumn("node", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")).drop("piece")
    guests = own.where("minor").join(visits.hint("merge"), "node").select("family", "piece", "root", "tokens", F.lit(True).alias("visits"))
    hosts = full.select("family", "piece", "root", "tokens", F.lit(False).alias("visits"))
    asked_pieces = guests.select("family", "piece").distinct()
    open_ = hosts.join(asked_pieces, ["family", "piece"], "left_semi").unionByName(guests)
    ordered = open_.repartition("family", "piece").sortWithinPartitions("family", "piece", "visits")
    crossed = ordered.mapInArrow(_across_pieces(p, q), "a binary, b binary")
    return components(work, crossed, "crossed")


def _connected(docs: DataFrame, width: int, threshold: tuple[int, int], count: bool) -> tuple[Workspace, DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, seen, n_shingles, digest), the nodes (digest, first (doc_id, seen), n, copies), and (digest, root) of nodes in families, with their links to other sets if they are to be counted."""
    p, q = threshold
    work = Workspace(docs.sparkSession, "jaccard")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("seen"))
    rows = work.keep("digests", docs.mapInArrow(_digest_rows(width), f"doc_id {id_type}, seen long, n_shingles long, digest binary, sketch binary"))
    node_key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    sigs = docs.select("text").mapInArrow(_signature_rows(width, p, q), "sig long, node long")
    shared = work.keep("shared", sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_shared, "sig long, node long"))
    drawn = rows.where("digest is not null").select(node_key.alias("node"), F.struct(F.col("n_shingles").alias("n"), "sketch").alias("drawn"))
    drawn = drawn.groupBy("node").agg(F.first("drawn").alias("drawn")).select("node", "drawn.n", "drawn.sketch")
    met = shared.join(drawn.hint("merge"), "node").repartition("sig").sortWithinPartitions("sig")
    near = met.mapInArrow(_batched(_bounded_edges(p, q)), "a long, b long").distinct()
    families = components(work, near, "families").withColumnRenamed("root", "family")
    work.drop("shared")

    whole = rows.where("doc_id is not null and digest is not null")
    nodes = whole.groupBy("digest").agg(F.min(F.struct("doc_id", "seen")).alias("first"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    members = nodes.withColumn("node", node_key).join(families, "node")
    counted = members.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).where("members > 1")
    pieces = F.greatest(F.ceil(F.col("members") / PIECE_NODES), F.ceil(F.col("tokens") / PIECE_TOKENS))
    placed = members.join(counted, "family").select(
        "first.doc_id", "first.seen", "digest", "copies", "family", F.pmod(F.xxhash64("digest"), pieces).cast("int").alias("piece")
    )
    placed = work.keep("members", placed)
    work.drop("families-roots")
    sets_type = "family long, piece int, digest binary, copies long, tokens binary"
    found = docs.join(placed.hint("merge"), ["doc_id", "seen"]).select("text", "family", "piece", "digest", "copies")
    sets = work.keep("sets", found.mapInArrow(_family_sets(width), sets_type))
    work.drop("members")
    kinds = _ROOTED + ", links long" * count
    local = work.keep("local", _by_piece(sets).mapInArrow(_batched(_within_pieces(p, q, count)), kinds))
    roots = _join_pieces(work, sets, local.drop("links"), p, q)
    if count:
        links = local.select("digest", "links")
        if not (several := work.read("several", "family long")).isEmpty():
            links = links.unionByName(_links_between_pieces(work, sets, several, p, q)).groupBy("digest").agg(F.sum("links").alias("links"))
        roots = roots.join(links, "digest", "left")
    roots = work.keep("roots", roots)
    for name in ("sets", "local", "several", "named", "largest", "apart", "visits", "crossed-roots", "other-pieces", *(f"round-{k}" for k in range(64))):
        work.drop(name)
    return work, rows, nodes, roots


def jaccard_components(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs`` (doc_id, text, anything else); links are with rows that have an id."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    work, rows, nodes, roots = _connected(docs, width, threshold, True)
    least = roots.join(nodes, "digest").groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    of = nodes.join(roots.join(least, "root"), "digest", "left").select("digest", F.coalesce("component_id", "first.doc_id").alias("component_id"), n_links.alias("n_links"))
    rows = rows.select("doc_id", "n_shingles", "digest")
    result = spread_left_join(rows, of, "digest", work.keep("hot", hot_keys(rows, "digest")), "doc_id")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast(id_type)).otherwise(F.coalesce("component_id", "doc_id"))
    linked = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0)))
    return result.select("doc_id", "n_shingles", own.alias("component_id"), linked.cast("long").alias("n_links"))


def without_near_copies(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, of that the text of the smallest hash, of equal rows one.

    Rows without an id or without words link with nothing and stay.
    """
    _, _, nodes, roots = _connected(docs, width, threshold, False)
    least = roots.join(nodes, "digest").groupBy("root").agg(F.min("first").alias("first"))
    firsts = least.select("first").unionByName(nodes.join(roots, "digest", "left_anti").select("first")).select("first.doc_id", "first.seen")
    rows, (doc_id, text) = numbered(docs, "doc_id", "text")
    body = F.col(text).cast("string")
    rows = rows.withColumn("seen", F.xxhash64(body))
    single = F.col(doc_id).isNull() | (F.coalesce(F.trim(body, F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == "")
    chosen = rows.where(~single).join(firsts.hint("merge"), (rows[doc_id] == firsts["doc_id"]) & (rows["seen"] == firsts["seen"]), "left_semi")
    whole = [f"c{i}" for i in range(len(docs.columns))]
    # an aggregate: however often a row is repeated, its copies are one row of each task before they are shuffled
    once = chosen.groupBy(F.col(doc_id).alias("id"), "seen").agg(F.min_by(F.struct(*whole), F.xxhash64(*whole)).alias("row")).select("row.*", "seen")
    kept = once.unionByName(rows.where(single))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
