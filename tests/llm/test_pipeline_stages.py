import numpy as np
import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars string, kept string, C0 int, seen string, places int, blob string, islands int, score double, place string, salt int"
FILTERS = corpus_pipeline.STAGES[:-1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    prose = lambda: " ".join(f"word{x}" for x in rng.integers(0, 900, 50)) + "."
    texts, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        texts.append((i, " ".join(w + "***" for w in prose().split()) if bad else prose()))
        labels.append((i, int(not bad), 0))
    same = prose() + "\n" + prose()
    own = [(None, prose()), (None, None), (900, None), (901, ""), (902, same), (902, same), (903, same.upper()), (7, prose()), (7, prose()), (904, " ".join(prose() for _ in range(2000))), (905, "token=abcdefgh " + prose())]
    extra = ("en", "s", "no number", "k", 1, "x", 2, "b", 3, 0.5, "p", 4)
    held = tmp_path_factory.mktemp("stages")
    spark.createDataFrame([(*t, *extra) for t in [*texts, *own]], COLUMNS).write.parquet(f"{held}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{held}/labels.parquet")
    return str(held)


@pytest.mark.parametrize("name,stage", FILTERS, ids=[n for n, _ in FILTERS])
def test_every_stage_keeps_columns_nulls_and_clean_rows(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    rows, before = out.collect(), docs.collect()
    rest = lambda r: tuple(r)[2:4] + tuple(r)[5:]
    assert {rest(r) for r in rows} == {rest(r) for r in before}
    ids = sorted(str(r.doc_id) for r in rows)
    if name == "quality classifier":
        assert len(rows) < len(before) and {"904", "905", "7"} <= set(ids)
    elif name == "n-gram Jaccard join":
        assert len(rows) == len(before) - 2 and ids.count("902") == 1 and "903" not in ids
        assert ids.count("7") == 3 and ids.count("None") == 2 and {"900", "901"} <= set(ids)  # unlike texts under one id are documents
    else:
        assert ids == sorted(str(r.doc_id) for r in before)
    if name in ("line dedup", "secret scans"):
        assert all(r.n_chars == (None if r.text is None else str(len(r.text))) for r in rows)
    if name == "secret scans":
        assert all("abcdefgh" not in (r.text or "") for r in rows) and sum(r.text is None for r in rows) == 2


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_an_empty_table(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert stage(spark, docs, folder).count() == 0


def test_packing_takes_every_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = corpus_pipeline.pack_sequences(spark, docs, folder).where("piece = 0")
    assert sorted(str(r.doc_id) for r in packed.collect()) == sorted(str(r.doc_id) for r in docs.collect())
    used = {}
    for r in corpus_pipeline.pack_sequences(spark, docs, folder).collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) + 1


def key_block(i, kind="RSA "):
    rng = np.random.default_rng(1000 + i)
    body = ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 64)) for _ in range(4)]
    return [f"-----BEGIN {kind}PRIVATE KEY-----", *body, f"-----END {kind}PRIVATE KEY-----"], body


@pytest.mark.parametrize("cut", ["whole", "no end", "indented", "shared body"])
def test_no_key_is_readable_behind_line_dedup_and_secret_scans(spark, folder, cut):
    """Twelve documents with twelve keys: the lines that mark a key are common, and yet redaction knows every key."""
    rows, secrets_of = [], {}
    for i in range(12):
        lines, body = key_block(0 if cut == "shared body" and i < 11 else i)
        lines = lines[:-1] if cut == "no end" else ["    " + x for x in lines] if cut == "indented" else lines
        rows.append((i, f"Note {i} before\n" + "\n".join(lines) + f"\nNote {i} behind, with more words."))
        secrets_of[i] = body
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, n_chars long")
    left = corpus_pipeline.drop_repeated_lines(spark, docs, folder)
    out = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, left, folder).collect()}
    assert sum(any(line in out[i] for line in secrets_of[i]) for i in range(12)) == 0
    assert all(f"Note {i} before" in out[i] and f"Note {i} behind, with more words." in out[i] for i in range(12))
