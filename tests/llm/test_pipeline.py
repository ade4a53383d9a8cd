import numpy as np

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(6)
    prose = lambda: " ".join(f"word{x}" for x in rng.integers(0, 2000, 60)) + "."
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = " ".join(w + "***" for w in prose().split()) if bad else prose()
        rows.append((i, text + ("\nSubscribe now" if i % 3 == 0 else ""), "en", "s"))
        labels.append((i, int(not bad), 0))
    copy = prose() + " " + prose()
    rows += [(1000, copy, "en", "s"), (1001, copy, "en", "s"), (1002, copy + " end", "en", "s"), (1003, prose() + " token=abcdef123456", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        if name != "best-fit packing":
            assert out.dtypes == held.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r for r in held.collect()})
    good = {i for i, *_ in rows if i >= 1000 or i % 4}
    assert good - set(kept[0]) == set() and len(set(kept[0]) - good) == 0
    assert not any("Subscribe" in r.text for r in kept[1].values()) and set(kept[1]) == set(kept[0])
    assert all(r.n_chars == len(r.text) for k in (1, 3) for r in kept[k].values())
    assert set(kept[1]) - set(kept[2]) == {1001, 1002}
    assert kept[3][1003].text.endswith("[secret]") and set(kept[3]) == set(kept[2])
    assert set(kept[4]) == set(kept[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == set(kept[4])
