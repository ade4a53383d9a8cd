from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace
from tidewright.llm import line_dedup
from tidewright.llm.line_dedup import LineRuns, drop_common_lines, without_common_lines

WHITE = "\t\n\x0b\x0c\r "


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, least):
    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            docs[key(line)].add((i, text or ""))
    gone = {k for k, d in docs.items() if k and len(d) >= least}
    return sorted((str(i), "\n".join(x for x in (t or "").split("\n") if key(x) not in gone), len((t or "").split("\n"))) for i, t in rows)


def test_equals_brute_force(spark):
    rows = [(i, f"Header {i % 3}\n  HEADER\x0b\nown {i}\nown {i}\n\nÀ B \nhot") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "header"), (22, "header"), (None, "\thot \r"), (None, None), (23, "à b "), (24, "x\ny\n"), (25, "hot\nhot\n" * 2000)]
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, places string, hit_id int, Batch int")
    for least in (1, 3, 4, 10):
        found = drop_common_lines(docs, least)
        assert sorted((str(r.doc_id), r.kept, r.n_lines) for r in found.collect()) == brute(rows, least)


def test_runs_are_compacted_and_answer_for_every_batch(spark, tmp_path):
    runs = LineRuns(spark, str(tmp_path))
    for batch in range(6):
        keys = spark.range(batch * 10, batch * 10 + 20).select(F.col("id").alias("h1"), F.lit(1).cast("long").alias("h2"))
        fresh = {r.h1 for r in runs.first_seen(keys).collect()}
        assert fresh == set(range(batch * 10 + (10 if batch else 0), batch * 10 + 20))
        runs.add(keys)
        assert all(len(names) < 4 for names in runs.levels.values())
        held = [r.h1 for name in runs._runs() for r in spark.table(name).collect()]
        assert sorted(held) == list(range(batch * 10 + 20))  # every key lies in one run
    assert {r.h1: r.docs for r in runs.counts().collect()} == {i: 2 if 10 <= i < 60 else 1 for i in range(70)}


def test_empty_table(spark):
    assert drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_callers_columns_stay(spark):
    names = ["kept", "N_LINES", "h1", "seen", "left_id", "c0"]
    docs = spark.createDataFrame([(1, "a\nb", *names)], ["doc_id", "text", *names])
    (row,) = drop_common_lines(docs, 1).collect()
    assert list(row.asDict()) == ["doc_id", "text", *names, "kept_", "n_lines_", "n_dropped"]
    assert list(row) == [1, "a\nb", *names, "", 2, 2]
    (row,) = without_common_lines(docs, 2).collect()
    assert list(row) == [1, "a\nb", *names]


def test_merge_joins_read_the_runs_without_a_shuffle(spark, tmp_path):
    runs = LineRuns(spark, str(tmp_path))
    for batch in range(2):
        runs.add(spark.range(batch, 500).select(F.col("id").alias("h1"), F.col("id").alias("h2")))
    batch = runs._write(runs.counts())
    plan = runs.first_seen(spark.table(batch))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_text_of_eighty_thousand_common_lines(spark):
    long = "\n".join(f"line {i}" for i in range(80_000))
    docs = spark.createDataFrame([(1, long), (2, long + "\nown")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept, r.n_dropped) for r in drop_common_lines(docs, 2).collect()) == [(1, "", 80_000), (2, "own", 80_000)]


def test_spared_lines_stay_however_common(spark):
    rows = [(i, f"-----BEGIN X-----\nown {i}\ncommon\n  -----END X-----") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in line_dedup.drop_common_lines(docs, spare="-----(?:BEGIN|END) X-----").collect()}
    assert kept == {i: f"-----BEGIN X-----\nown {i}\n  -----END X-----" for i in range(12)}
    assert {r.kept for r in line_dedup.drop_common_lines(docs).collect()} == {f"own {i}" for i in range(12)}


def test_a_failed_batch_leaves_no_runs(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    work = Workspace(spark, "test-runs")
    runs = line_dedup.LineRuns(spark, work.path("runs"))
    try:
        with pytest.raises(Exception, match="broken"):
            runs.add(docs.select(F.xxhash64("text").alias("h1"), F.xxhash64("text").alias("h2")))
    finally:
        runs.close()
    assert {t.name for t in spark.catalog.listTables()} == before and not runs.written
