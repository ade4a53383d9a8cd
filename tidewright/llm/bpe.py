"""Byte-level BPE by merge replay over word types.

A block of documents is split into words by the vocabulary's pattern. The words
not met before by this task form one string of symbols, their bytes. An inverted
index has, for every rank, the places where a pair of neighbours would merge to
that rank's token. Ranks are applied in rising order; a merge looks up the two
pairs that it creates with its neighbours and files them under their ranks, so
only touched places are visited. A merge's token is part of every pair that it
creates; where such a pair ranks lower than the current rank (not so in trained
vocabularies) that rank is replayed before going on. Word types give their ids to
every occurrence, and the ids are decoded from the token table.

Each task holds one block and a bounded table of word types; nothing is shuffled.

Null or empty text: no tokens, hashes of the empty string. Repeated rows: each is
returned. A null doc_id stays null. Of equal ranks in one word the left pair merges
first. A very long text is a block of its own; a word without breaks takes about a
hundred bytes for each of its bytes while it is merged. An empty table has no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textkernel import small
from tidewright.llm.vocabulary import default_path, default_pattern, read_ranks

BLOCK_CHARS = 4_000_000
TYPES_HELD = 400_000
_SHIFT = 20


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id << 20 | right id) -> rank of their joined bytes, for every split of every token."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << _SHIFT | right] = rank
    return pairs


class Replay:
    """The merges of a vocabulary, applied to many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        if len(ranks) >= 1 << _SHIFT:
            raise ValueError("a vocabulary of 2^20 tokens or more needs a wider pair key")
        self.pairs = pair_ranks(ranks)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)])
        table = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                table[token[0], token[1]] = rank
        self.first_ranks = table

    def words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        stop = np.zeros(len(raw), bool)
        stop[ends] = True
        symbols = np.where(stop, -1, self.byte_id[raw])
        ranks = np.full(len(raw), -1, np.int64)
        ranks[:-1] = np.where(stop[:-1] | stop[1:], -1, self.first_ranks[raw[:-1], raw[1:]])
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        index: dict[int, list[int]] = {}
        if len(at):
            edges = np.flatnonzero(np.diff(ranks[at], prepend=-2))
            for part in np.split(at, edges[1:]):
                index[int(ranks[part[0]])] = part.tolist()
        final = np.array(self._replay(symbols.tolist(), index), np.int64)
        alive = final >= 0
        ids = final[alive].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(alive)[ends]).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _replay(self, symbols: list[int], index: dict[int, list[int]]) -> list[int]:
        """-1 ends a word, -2 marks a symbol that a merge took."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(-1)
        after.append(n)
        before.append(n - 1)
        rank_of, queue = self.pairs.get, sorted(index)
        while queue:
            rank = heappop(queue)
            places = index.pop(rank)
            places.sort()
            for i in places:
                left = symbols[i]
                if left < 0:
                    continue
                j = after[i]
                right = symbols[j]
                if right < 0 or rank_of(left << _SHIFT | right) != rank:
                    continue
                symbols[i], symbols[j] = rank, -2
                k = after[j]
                after[i] = k
                before[k] = i
                if (other := symbols[k]) >= 0 and (new := rank_of(rank << _SHIFT | other)) is not None:
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heappush(queue, new)
                h = before[i]
                if h >= 0 and (other := symbols[h]) >= 0 and (new := rank_of(other << _SHIFT | rank)) is not None:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heappush(queue, new)
        symbols.pop()
        return symbols


class Encoder:
    """Texts to ids; word types of earlier texts are kept up to a bound, which changes only the time taken."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.replay = Replay(ranks)
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        fresh = {w for words in split for w in words}.difference(self.known)
        if len(self.known) + len(fresh) > TYPES_HELD:
            self.known = {}
            fresh = {w for words in split for w in words}
        fresh = sorted(fresh)
        if fresh:
            self.known.update(zip(fresh, self.replay.words([w.encode() for w in fresh])))
        of = self.known.__getitem__
        return [b"".join(map(of, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _text_blocks(texts: list[str]):
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _rows(shared, pattern: str):
    def run(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in small(batches):
            counts, ids_hash, decoded_hash = [], [], []
            for texts in _text_blocks([t or "" for t in batch.column("text").to_pylist()]):
                for ids in encoder.encode(texts):
                    counts.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    decoded_hash.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _id_rows(shared, pattern: str):
    def run(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in small(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for texts in _text_blocks([t or "" for t in batch.column("text").to_pylist()]) for x in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")), docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text."""
    docs, id_type = _plain(docs)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path or default_path("byte_bpe_50k.tiktoken")))
    return docs.mapInArrow(_id_rows(shared, pattern or default_pattern()), f"doc_id {id_type}, ids array<int>")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every row's text encoded, and decoded from its ids."""
    docs, id_type = _plain(docs)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path or default_path("byte_bpe_50k.tiktoken")))
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(_rows(shared, pattern or default_pattern()), schema)
