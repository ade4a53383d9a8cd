"""Which terms, and which other sources, a source differs from its language in, by sorted streams and run lengths.

A term is a run of letters (A-Z, a-z and all beyond ASCII; A-Z lowered). Blocks of
texts are cut into terms and sorted by (lang, term, source, document); the runs of
a block are its partial counts. These are repartitioned by ranges of (lang, term,
source, document) and sorted again, so that a term that a third of all documents have is
spread over several tasks (lang and term are one column there, which Spark sorts by its first bytes), and a second scan of run lengths yields the document
frequency of a term and its counts in each source. A term at the edge of a range may go on
in the next one: only those (two for each task) are summed up again.

The terms that ``min_docs`` documents or more of a language have are scanned once more,
dealt by a hash of the term, behind the totals of their language's sources. Each scan
emits partial sums for pairs of sources, and for each source the terms that differ most; both
are merged by key. A task holds the totals of one language's sources and, up to DENSE of
them, their pairs; beyond that the pairs of each run of terms are emitted at once. Time is
terms times pairs of sources, and the result itself has a row for each pair of sources.

A document is a row. Null text, lang and source are ''; ids are not read but to break ties
of order, so that rows without an id, and repeated ones, are documents like others. Sources
without any kept term have pairs and no terms; a language without kept terms has pairs of
value 0; one with one source has none. Equal values are ranked by the UTF-8 bytes of the item.
Exact up to counts of 9 * 10^15. An empty table has no rows. A very long text is a block of
its own. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace
from tidewright.llm.textkernel import LOWER, blocks, letter_spans, small

BLOCK = 12_000_000
DENSE = 1_024
PER_DEAL = 2_000
CELLS = 1_000_000
# a term has no \0; one of lang is followed by \1, so that the last \0 of head stands before the term
_RUNS = "head string, source string, document long, df long, n long"
_TERMS = "head string, sources array<string>, counts array<long>, df long, open boolean"
_FOUND = "lang string, source string, part string, item string, value long"


def _block_runs(raw: np.ndarray, starts: np.ndarray, langs: pa.Array, sources: pa.Array, documents: np.ndarray):
    """Record batches of the run lengths of one block, sorted by (lang and source, term, document) as codes."""
    first, end, row_starts = letter_spans(raw, starts)
    n_terms = len(first)
    if not n_terms:
        return
    lengths = end - first
    offsets = np.zeros(n_terms + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[first] += 1
    inside[end] -= 1
    letters = LOWER[raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]]
    del inside, first, end, lengths
    terms = pa.StringArray.from_buffers(n_terms, pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    width = len(source.dictionary)
    groups, of_row = np.unique(lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy(), return_inverse=True)
    document = np.repeat(np.arange(len(row_starts) - 1, dtype=np.int32), np.diff(row_starts))
    key = terms.indices.to_numpy().astype(np.int64) * len(groups) + of_row[document]
    order = np.argsort(key, kind="stable")
    key, document = key[order], document[order]
    fresh = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    at = np.flatnonzero(fresh)
    fresh[1:] |= document[1:] != document[:-1]
    df, n = np.add.reduceat(fresh.astype(np.int64), at), np.diff(at, append=len(key))
    term, group = np.divmod(key[at], len(groups))
    first_part = pc.replace_substring(lang.dictionary, "\0", "\0\1").take(pa.array(groups[group] // width))
    head = pc.binary_join_element_wise(first_part, terms.dictionary.take(pa.array(term)), "\0")
    own = source.dictionary.take(pa.array(groups[group] % width))
    found = pa.RecordBatch.from_arrays([head, own, *map(pa.array, (documents[document[at]], df, n))], ["head", "source", "document", "df", "n"])
    for row in range(0, found.num_rows, 50_000):
        yield found.slice(row, 50_000)


def _partial_runs(batches):
    """Rows (lang, source, document, text) to the run lengths of blocks of about BLOCK bytes."""
    held, size = [], 0

    def block():
        raw = np.concatenate([h[0] for h in held])
        places = np.cumsum([0, *(len(h[0]) for h in held)])
        starts = np.concatenate([*(h[1][:-1] + p for h, p in zip(held, places)), places[-1:]])
        langs, sources = (pa.concat_arrays([h[k] for h in held]) for k in (2, 3))
        yield from _block_runs(raw, starts, langs, sources, np.concatenate([h[4] for h in held]))

    for batch in small(batches):
        lang, source, document = (batch.column(c) for c in ("lang", "source", "document"))
        for row, stop, raw, starts in blocks(batch.column("text"), BLOCK):
            held.append((raw, starts, lang[row:stop], source[row:stop], document[row:stop].to_numpy()))
            size += len(raw)
            if size >= BLOCK:
                yield from block()
                held, size = [], 0
    if held:
        yield from block()


def _changes(*columns: pa.Array) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns; the first row does."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return fresh


def _collapsed(head, source, df, n):
    """One row for each run of (head, source)."""
    at = np.flatnonzero(_changes(head, source))
    take = pa.array(at)
    return head.take(take), source.take(take), np.add.reduceat(df, at), np.add.reduceat(n, at)


def _frequencies(batches):
    """Sorted runs to a row for each head; open where the term may go on in another task."""
    held, first = None, True

    def rows(head, source, df, n, starts, last):
        nonlocal first
        offsets = pa.array(np.append(starts, len(n)).astype(np.int32))
        is_open = np.zeros(len(starts), bool)
        is_open[0], first = first, False
        is_open[-1] |= last
        return pa.RecordBatch.from_arrays(
            [head.take(pa.array(starts)), pa.ListArray.from_arrays(offsets, source), pa.ListArray.from_arrays(offsets, pa.array(n)), pa.array(np.add.reduceat(df, starts)), pa.array(is_open)],
            ["head", "sources", "counts", "df", "open"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [*(batch.column(c) for c in ("head", "source")), *(batch.column(c).to_numpy() for c in ("df", "n"))]
        if held:
            parts = [*(pa.concat_arrays(p) for p in zip(held[:2], parts[:2])), *(np.concatenate(p) for p in zip(held[2:], parts[2:]))]
        parts = _collapsed(*parts)
        starts = np.flatnonzero(_changes(parts[0]))
        done = starts[-1]
        if done:
            yield rows(*(p[:done] for p in parts), starts[:-1], False)
        held = [p[done:] for p in parts]
    if held:
        yield rows(*held, np.zeros(1, np.int64), True)


def _shares(counts: np.ndarray, totals: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * v)), by three divisions that give three digits each."""
    size, rest = totals + 2 * v, counts + 2
    found = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // size
        rest %= size
    return found + 1


class _Language:
    """The scan of one language's terms in one task."""

    def __init__(self, lang: str, sources: list[str], totals: np.ndarray, v: int, says_pairs: bool):
        self.lang, self.sources, self.totals, self.v = lang, sources, totals, v
        self.place = pa.array(sources, pa.string())
        self.dense = len(sources) <= DENSE
        self.pairs = np.zeros((len(sources),) * 2, np.int64) if self.dense else None
        self.says_pairs = says_pairs
        self.top = (np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()))

    def _batch(self, source: np.ndarray, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        n = len(value)
        columns = [pa.repeat(pa.scalar(self.lang, pa.string()), n), self.place.take(pa.array(source)), pa.repeat(pa.scalar(part), n), item, pa.array(value)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])

    def _pairs_of(self, a: int, sums: np.ndarray):
        """The pairs of source ``a`` with those behind it."""
        yield self._batch(np.full(len(sums), a), "pair", self.place[a + 1 :], sums)

    def terms(self, terms: pa.Array, sources: pa.ListArray, counts: pa.ListArray, ranks: int):
        """Rows of terms, sorted; yields pairs where they are too many to be held."""
        step = max(1, CELLS // len(self.sources))
        for at in range(0, len(terms), step):
            yield from self._run(terms[at : at + step], sources[at : at + step], counts[at : at + step], ranks)

    def _run(self, terms, sources, counts, ranks):
        row = np.repeat(np.arange(len(terms)), pc.list_value_length(sources).to_numpy())
        column = pc.index_in(sources.flatten(), self.place).to_numpy()
        table = np.zeros((len(terms), len(self.sources)), np.int64)
        table[row, column] = counts.flatten().to_numpy()
        p = _shares(table, self.totals[None, :], self.v)
        q = _shares(table.sum(1), self.totals.sum(), self.v)
        for a in range(len(self.sources) - 1):
            mine, theirs = p[:, a : a + 1], p[:, a + 1 :]
            sums = ((mine - theirs) ** 2 // (mine + theirs)).sum(0)
            if self.dense:
                self.pairs[a, a + 1 :] += sums
            else:
                yield from self._pairs_of(a, sums)
        self.says_pairs |= self.dense
        mine, its = p[row, column], q[row]
        more = np.flatnonzero((mine > its) & (table[row, column] > 0))
        value = (mine[more] - its[more]) ** 2 // (mine[more] + its[more])
        source, value = np.concatenate([self.top[0], column[more]]), np.concatenate([self.top[1], value])
        item = pa.concat_arrays([self.top[2], terms.take(pa.array(row[more]))])
        # terms come in order, so that a stable sort leaves the smaller of equal values' terms first
        order = np.lexsort((-value, source))
        first = np.flatnonzero(np.diff(source[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        best = np.sort(order[place < ranks])
        self.top = (source[best], value[best], item.take(pa.array(best)))

    def end(self):
        source, value, item = self.top
        yield self._batch(source, "term", item, value)
        if self.says_pairs:
            sums = self.pairs if self.dense else np.zeros((1, len(self.sources)), np.int64)
            for a in range(len(self.sources) - 1):
                yield from self._pairs_of(a, sums[a if self.dense else 0, a + 1 :])


def _divergences(ranks: int):
    """Sorted rows (deal, lang, term, sources, counts, totals, v); the first of a (deal, lang) have no term and name its sources' totals."""

    def run(batches):
        now, head, language = None, [], None

        def ready():
            nonlocal language
            if language is None:
                sources, totals, v = zip(*head)
                language = _Language(now[1], list(sources), np.array(totals, np.int64), v[0], now[0] == 0)
            return language

        for batch in batches:
            if not batch.num_rows:
                continue
            edges = [*np.flatnonzero(_changes(batch.column("deal"), batch.column("lang"))).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                own = (part.column("deal")[0].as_py(), part.column("lang")[0].as_py())
                if own != now:
                    if now:
                        yield from ready().end()
                    now, head, language = own, [], None
                names = part.column("term").null_count
                for sources, total, v in zip(*(part.column(c).slice(0, names).to_pylist() for c in ("sources", "total", "v"))):
                    head.append((sources[0], total, v))
                if names < part.num_rows:
                    rest = part.slice(names)
                    yield from ready().terms(rest.column("term"), rest.column("sources"), rest.column("counts"), ranks)
        if now:
            yield from ready().end()

    return run


def term_counts(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term, sources, counts, df) of the terms that ``min_docs`` documents or more of a language have."""
    work = Workspace(docs.sparkSession, "terms")
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(given("lang"), given("source"), F.xxhash64("doc_id").alias("document"), given("text"))
    runs = work.keep("runs", rows.mapInArrow(_partial_runs, _RUNS))
    order = ["head", "source", "document"]
    scanned = runs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_frequencies, _TERMS)
    scanned = work.keep("scanned", scanned.where(f"open or df >= {int(min_docs)}"))
    work.drop("runs")
    parts = scanned.where("open").select("head", "df", F.arrays_zip("sources", "counts").alias("cells"))
    df = parts.groupBy("head").agg(F.sum("df").alias("df")).where(F.col("df") >= min_docs)
    cells = parts.select("head", F.explode("cells").alias("cell")).groupBy("head", "cell.sources").agg(F.sum("cell.counts").alias("counts"))
    cells = cells.groupBy("head").agg(F.collect_list(F.struct("sources", "counts")).alias("cells"))
    merged = cells.join(df, "head").select("head", "cells.sources", "cells.counts", "df")
    term = F.substring_index("head", "\0", -1)
    lang = F.replace(F.left("head", F.char_length("head") - F.char_length("term") - 1), F.lit("\0\1"), F.lit("\0"))
    both = scanned.where("not open").select(*merged.columns).unionByName(merged).withColumn("term", term)
    kept = work.keep("kept", both.select(lang.alias("lang"), "term", "sources", "counts", "df"))
    work.drop("scanned")
    return kept


def source_divergence(docs: DataFrame, min_docs: int = 10, ranks: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of each (lang, source) (part ``pair``) and its ``ranks`` most divergent terms (part ``term``)."""
    work = Workspace(docs.sparkSession, "divergence")
    kept = term_counts(docs, min_docs)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(named("lang"), named("source")).distinct()
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("cell"))
    totals = cells.groupBy("lang", F.col("cell.sources").alias("source")).agg(F.sum("cell.counts").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    heads = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
    heads = work.keep("groups", heads)

    # each deal emits every pair of sources, so that there are no more deals than its terms are worth
    deals = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), kept.count() // PER_DEAL))
    none = F.lit(None)
    heads = heads.select(
        F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "lang", none.cast("string").alias("term"),
        F.array("source").alias("sources"), none.cast("array<long>").alias("counts"), "total", "v",
    )
    terms = kept.select(
        F.pmod(F.xxhash64("lang", "term"), F.lit(deals)).cast("int").alias("deal"), "lang", "term", "sources", "counts", none.cast("long").alias("total"), none.cast("long").alias("v")
    )
    order = ["deal", "lang", "term", F.when(F.col("term").isNull(), F.col("sources")[0])]
    dealt = heads.unionByName(terms).repartition(deals, "deal").sortWithinPartitions(*order)
    found = work.keep("found", dealt.mapInArrow(_divergences(ranks), _FOUND))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", "part", "value", F.inline(both)).select("lang", "source", "part", "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    best = found.where("part = 'term'").select("*", place).where(F.col("rank") <= ranks)
    return pairs.select("*", place).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
