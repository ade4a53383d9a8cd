"""Best-fit packing of token sequences in a tree of rounds.

Texts are tokenized and cut into pieces of at most ``limit`` tokens (only longer
ones; their first piece takes the remainder). Every partition packs its pieces by
best fit, longest first. Bins within ``slack`` tokens of the limit are done; the
others go on as items of their own, merged into fewer partitions, and are packed
by best fit again, until one partition holds them or a round leaves more than
``saves`` of them. With ``slack`` 0 and ``saves`` 1 every bin that is not full goes on as
long as any two are put together; the defaults trade that for fewer rounds.
Each round is a table: bin numbers that a lost executor produced are never made
twice with other contents.

Memory is bounded: a task packs at most ``CHUNK`` items at a time, and the last
round gets at most that many, or ends the tree where bins no longer combine. A long
text's ids (8 bytes each) are held once, while it is cut.

Null or empty text: the end token alone, one piece of one token. The string of an
added token in a text is that token. Repeated rows are packed each for itself, and
among pieces of one length the order in the partition decides. A null doc_id stays
null. An empty table has no pieces. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace
from tidewright.llm.textkernel import small
from tidewright.llm.vocabulary import default_path, default_pattern, read_tokenizer

LIMIT = 1024
END = 2
SLACK = 4
CHUNK = 400_000
SAVES = 0.97


def best_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and every bin's fill: longest item first, each into the fullest bin that takes it."""
    order = np.argsort(-sizes, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    room = 0  # bit r: some open bin has r tokens left
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = room >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                room ^= 1 << left
        else:
            b, left = len(fills), limit
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left -= size
        if left:
            open_bins[left].append(b)
            room |= 1 << left
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(fills, np.int64)


def _encoder(ranks: dict[bytes, int], added: list[str], file: str, pattern: str):
    """ids of a text as the tokenizer of ``file`` gives them without special tokens around it.

    A text without a string of an added token is split by the pattern and merged by
    rank, which the tiktoken library does three to four times as fast; a text with
    one, where the tokenizer cuts at added tokens first, goes to the tokenizer itself.
    """
    import tiktoken

    fast, exact = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), None

    def encode(text: str) -> list[int]:
        nonlocal exact
        if not any(token in text for token in added):
            return fast.encode_ordinary(text)
        if exact is None:
            from tokenizers import Tokenizer

            exact = Tokenizer.from_str(file)
        return exact.encode(text, add_special_tokens=False).ids

    return encode


def _pieces(shared, pattern: str, limit: int):
    def run(batches):
        encode = _encoder(*shared.value, pattern)
        for batch in small(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END], "<u4")
                at, k = 0, 0
                while at < len(ids):
                    take = limit if k or len(ids) <= limit else (len(ids) % limit or limit)
                    part = ids[at : at + take]
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    at, k = at + take, k + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _packed(size: str, limit: int):
    """Rows with bin, offset in the bin and the bin's fill; bins are numbered within the task, chunk after chunk."""

    def run(batches):
        base, held, rows = TaskContext.get().partitionId() << 36, [], 0

        def emit():
            nonlocal base
            table = pa.Table.from_batches(held).combine_chunks()
            bins, offsets, fills = best_fit(table.column(size).to_numpy(), limit)
            out = table.append_column("bin", pa.array(bins + base)).append_column("at", pa.array(offsets)).append_column("fill", pa.array(fills[bins]))
            base += len(fills)
            yield from out.to_batches(max_chunksize=50_000)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield from emit()
                held, rows = [], 0
        if rows:
            yield from emit()

    return run


def pack(docs: DataFrame, limit: int = LIMIT, tokenizer_path: str | None = None, pattern: str | None = None, slack: int = SLACK, saves: float = SAVES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path or default_path("byte_bpe_50k.json")))
    cut = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _pieces(shared, pattern or default_pattern(), limit), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    )
    pieces = work.keep("pieces", cut)
    kinds = "bin long, at long, fill long"
    first = work.keep("round-0", pieces.mapInArrow(_packed("length", limit), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, {kinds}"))
    work.drop("pieces")
    rounds, items = [], first.where((F.col("at") == 0) & (F.col("fill") < limit - slack)).select(F.col("bin").alias("item"), F.col("fill").alias("size"))
    before = None
    for level in range(1, 64):
        left = items.count()
        if left < 2 or (before is not None and left > saves * before or left == before):
            break
        before = left
        tasks = -(-left // CHUNK)
        merged = items.coalesce(1) if tasks == 1 else items.repartition(tasks)
        rounds.append(work.keep(f"round-{level}", merged.mapInArrow(_packed("size", limit), f"item long, size long, {kinds}")))
        if tasks == 1:
            break
        items = rounds[-1].where((F.col("at") == 0) & (F.col("fill") < limit - slack)).select(F.col("bin").alias("item"), F.col("fill").alias("size"))
    placed = None
    for level in range(len(rounds), 0, -1):
        own = rounds[level - 1].select("item", (F.col("bin") * 64 + level).alias("sequence"), F.col("at").alias("shift"), F.col("bin").alias("next"))
        if placed is not None:
            later = placed.select(F.col("item").alias("next"), F.col("sequence").alias("later"), F.col("shift").alias("more"))
            own = own.join(later, "next", "left").withColumn("sequence", F.coalesce("later", "sequence")).withColumn("shift", F.col("shift") + F.coalesce("more", F.lit(0)))
        placed = own.select("item", "sequence", "shift")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if placed is None:
        return first.select(*columns, (F.col("bin") * 64).alias("sequence_id"), F.col("at").alias("offset"))
    found = first.join(placed.withColumnRenamed("item", "bin"), "bin", "left")
    return found.select(*columns, F.coalesce("sequence", F.col("bin") * 64).alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
