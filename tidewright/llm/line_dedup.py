"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lowered; it is
held as two 64-bit hashes. ``LineRuns`` holds every key in exactly one sorted run,
with the number of documents of the batch that brought it. A new batch is counted,
sorted and merge-anti-joined with the runs: the keys left make a run of level 0,
the others raise counts in a run of rises. A level with ``FAN_IN`` runs is compacted
into one run of the next level. Runs are bucketed by key, so that the merge joins
read them as they lie, without a shuffle.

``drop_common_lines`` feeds a table to the runs batch by batch and anti-joins its
lines with the keys of ``min_docs`` documents or more; what is left of a document is
put together from those lines. Keys that a thousandth of all documents hold are
broadcast for that (there are at most a thousand times as many as lines in a
document), so that no key of the shuffled join has more rows than that.

A document is a distinct pair of id and text: repeated rows count once and are all
returned. A null id is an id like others. Null or empty text is one empty line. Keys
of less than ``min_chars`` code points are never dropped, nor are lines that the
pattern ``spare`` is found in, for later steps that need them. A key of exactly
``min_docs`` documents is dropped. An empty table has no rows. Long texts are split
in one pass and joined in one pass. Other columns stay as they are; where one has
the name of a new column, the new one takes underscores behind its name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace, delete
from tidewright.llm.columns import free, numbered

FAN_IN = 4
BATCHES = 4
HOT_SHARE = 1000
_WHITE = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(_WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


class LineRuns:
    """Sorted runs (h1, h2, docs) under one folder; after every batch at most FAN_IN - 1 of each level, and of rises."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = {}
        self.rises: list[str] = []
        self.written: set[str] = set()

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.written.add(name)
        placed = keys.select(*_KEY, "docs").write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
        placed.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.folder}/{name}")
            self.written.discard(name)

    def _all(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long")
        return self.spark.read.schema("h1 long, h2 long, docs long").parquet(*(f"{self.folder}/{name}" for name in names))

    def _runs(self) -> list[str]:
        return [name for level in self.levels.values() for name in level]

    def first_seen(self, lines: DataFrame) -> DataFrame:
        """Rows of ``lines`` (h1, h2, ...) whose key no run holds: a merge join with each run."""
        for name in self._runs():
            lines = lines.join(self.spark.table(name).hint("merge"), _KEY, "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """One more batch: a row (h1, h2) for each document and key."""
        batch = self._write(lines.groupBy(*_KEY).agg(F.count("*").alias("docs")))
        if not self.levels:
            self.levels[0] = [batch]
            return
        fresh = self._write(self.first_seen(self.spark.table(batch)))
        self.rises.append(self._write(self.spark.table(batch).join(self.spark.table(fresh).hint("merge"), _KEY, "left_anti")))
        self._drop([batch])
        self.levels.setdefault(0, []).append(fresh)
        for level in sorted(self.levels):
            if len(self.levels[level]) >= FAN_IN:
                old = self.levels.pop(level)
                self.levels.setdefault(level + 1, []).append(self._write(self._all(old)))
                self._drop(old)
        if len(self.rises) >= FAN_IN:
            old, self.rises = self.rises, []
            self.rises = [self._write(self._all(old).groupBy(*_KEY).agg(F.sum("docs").alias("docs")))]
            self._drop(old)

    def counts(self) -> DataFrame:
        """(h1, h2, docs) of every key."""
        risen = self._all(self.rises).groupBy(*_KEY).agg(F.sum("docs").alias("more"))
        held = self._all(self._runs()).join(risen.hint("merge"), _KEY, "left")
        return held.select(*_KEY, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"))

    def close(self) -> None:
        """Remove every run, those of a batch that failed half way included."""
        self._drop(sorted(self.written))
        self.levels, self.rises = {}, []


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, spare: str | None) -> DataFrame:
    """(id, seen, place, h1, h2, batch) of every line; the hashes of keys that are never dropped are null."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(_text(text)).alias("seen"), F.posexplode(F.split(_text(text), "\n")).alias("place", "line"))
    spared = F.col("line").rlike(spare) if spare else F.lit(False)
    keyed = rows.select("id", "seen", "place", line_key(F.col("line")).alias("key"), spared.alias("spared"))
    long_enough = (F.char_length("key") >= min_chars) & ~F.col("spared")
    batch = F.pmod(F.xxhash64("id", "seen"), F.lit(BATCHES)).cast("int")
    h1, h2 = F.xxhash64("key"), F.xxhash64(F.lit("second"), F.col("key"))
    return keyed.select("id", "seen", "place", F.when(long_enough, h1).alias("h1"), F.when(long_enough, h2).alias("h2"), batch.alias("batch"))


def _common(work: Workspace, lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, docs) of the keys that ``min_docs`` documents or more hold."""
    runs = LineRuns(lines.sparkSession, work.path("runs"))
    try:
        for batch in range(BATCHES):
            runs.add(lines.where((F.col("batch") == batch) & F.col("h1").isNotNull()).select("id", "seen", *_KEY).distinct())
        return work.keep("common", runs.counts().where(F.col("docs") >= min_docs))
    finally:
        runs.close()


def _without_common(docs: DataFrame, min_docs: int, min_chars: int, spare: str | None) -> tuple[DataFrame, str]:
    """``docs`` with numbered columns, ``kept``, ``n_lines`` and ``n_kept``; and the name of its text column."""
    spark = docs.sparkSession
    work = Workspace(spark, "lines")
    docs, (doc_id, text) = numbered(docs, "doc_id", "text")
    lines = _lines(docs, doc_id, text, min_chars, spare)
    lines.write.partitionBy("batch").parquet(work.path("lines"))
    lines = spark.read.schema(lines.schema).parquet(work.path("lines"))
    common = _common(work, lines, min_docs)
    hot = F.col("docs") >= F.lit(max(1, docs.count() // HOT_SHARE))
    left = lines.where("h1 is not null").join(F.broadcast(common.where(hot)), _KEY, "left_anti")
    left = left.join(common.where(~hot).hint("merge"), _KEY, "left_anti").unionByName(lines.where("h1 is null"))
    places = left.groupBy(F.col("id").alias("left_id"), F.col("seen").alias("left_seen")).agg(F.sort_array(F.collect_set("place")).alias("places"))
    places = work.keep("places", places)
    work.drop("lines")
    work.drop("common")
    marked = docs.withColumn("own_seen", F.xxhash64(_text(text)))
    same = marked[doc_id].eqNullSafe(places["left_id"]) & (marked["own_seen"] == places["left_seen"])
    found = marked.join(places.hint("merge"), same, "left")
    split = F.split(_text(text), "\n")
    n_lines, n_kept = F.size(split), F.when(F.col("places").isNull(), 0).otherwise(F.size("places"))
    rest = F.array_join(F.transform("places", lambda i: F.get(split, i)), "\n")
    kept = F.when(n_kept == n_lines, _text(text)).otherwise(F.coalesce(rest, F.lit("")))
    return found.select(*docs.columns, kept.alias("kept"), n_lines.cast("long").alias("n_lines"), n_kept.cast("long").alias("n_kept")), text


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, spare: str | None = None) -> DataFrame:
    """``docs`` with ``kept`` (text left), ``n_lines`` (before) and ``n_dropped``; other columns as they were."""
    found, _ = _without_common(docs, min_docs, min_chars, spare)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    new = {"kept": F.col("kept"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_lines") - F.col("n_kept")}
    return found.select(*own, *(column.alias(free(name, docs.columns)) for name, column in new.items()))


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, spare: str | None = None) -> DataFrame:
    """``docs`` with what is left in the place of each text."""
    found, text = _without_common(docs, min_docs, min_chars, spare)
    return found.select(*(F.col("kept" if f"c{i}" == text else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
