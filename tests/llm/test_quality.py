import zlib

import numpy as np

from tidewright.llm.quality import RANK, SIZE, STATISTICS, WORDS, Model, classify, features, held_out, train


def test_sum_of_squares_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    model = Model(0.3, rng.normal(size=SIZE), rng.normal(0, 0.3, (SIZE, RANK)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    bucket, weight = np.array([5, 9, 70]), np.array([0.5, 0.2, 0.7])
    statistics = rng.normal(size=(1, len(STATISTICS)))
    index = np.concatenate([bucket, np.arange(WORDS, SIZE)])
    x = np.concatenate([weight, np.clip(statistics[0], -4, 4) / np.sqrt(len(STATISTICS))])
    want = 0.3 + model.linear[index] @ x
    for i in range(len(x)):
        for j in range(i):
            want += model.factors[index[i]] @ model.factors[index[j]] * x[i] * x[j]
    assert np.isclose(model.logits(np.zeros(3, np.int64), bucket, weight, statistics)[0], want)


def test_features_do_not_depend_on_neighbours():
    texts = [b"one one two", b"", b"Three! four", b"\n\n x"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    row, bucket, weight, statistics = features(raw, starts, np.zeros(4))
    for i, text in enumerate(texts):
        alone = features(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(1))
        assert np.array_equal(bucket[row == i], alone[1]) and np.allclose(weight[row == i], alone[2])
        assert np.allclose(statistics[i], alone[3][0])


def corpus(spark, n=600):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        docs.append((i, " ".join(w + "***" for w in words) if bad else " ".join(words) + ".", 200, "zz"))
        if i % 2:
            labels.append((i, int(not bad), 0))
    docs += [(n, None, None, None), (n + 1, "", 0, ""), (n, None, None, None), (None, "w1 w2", 5, "")]
    labels += [(1, None, 0), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_rows(spark):
    docs, labels = corpus(spark)
    found = classify(docs, labels).collect()
    assert len(found) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    tested = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(tested) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(spark, 200)
    flipped = labels.withColumn("quality", (1 - labels.quality).cast("int")).where(held_out(labels.doc_id))
    mixed = labels.where(~held_out(labels.doc_id)).unionByName(flipped)
    scores = [sorted((str(r.doc_id), r.score) for r in classify(docs, x).collect()) for x in (labels, mixed)]
    assert scores[0] == scores[1]


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(spark, 10)
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).count() == 0


def test_a_very_long_text_and_n_chars_that_is_no_number(spark):
    docs, labels = corpus(spark, 200)
    long = spark.createDataFrame([(9000, "w1 w2. " * 300_000, None, "x"), (9001, "\n" * 500_000, None, None)], docs.schema)
    told = docs.unionByName(long).selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'many', cast(n_chars as string)) as n_chars")
    found = classify(told, labels).collect()
    assert len(found) == 206 and all(0 <= r.score <= 1 for r in found)


def test_scores_equal_the_model_row_by_row(spark):
    docs, labels = corpus(spark, 300)
    model = train(docs, labels)
    rows = docs.collect()
    wanted = []
    for r in rows:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        row, bucket, weight, statistics = features(raw, np.array([0, len(raw)]), np.array([float(r.n_chars or 0)]))
        dense = np.clip((statistics[0] - model.mean) / model.spread, -4, 4) / np.sqrt(len(STATISTICS))
        index, x = np.concatenate([bucket, np.arange(WORDS, SIZE)]), np.concatenate([weight, dense])
        logit = model.bias + model.linear[index] @ x
        v = model.factors[index] * x[:, None]
        logit += sum(float(v[i] @ v[j]) for i in range(len(x)) for j in range(i))
        wanted.append((str(r.doc_id), round(1 / (1 + np.exp(-logit)), 6)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in classify(docs, labels).collect()) == sorted(wanted)


def test_a_labelled_id_that_repeats_is_learned_once(spark):
    docs, labels = corpus(spark, 300)
    again = docs.where("doc_id = 3")
    many = docs
    for _ in range(6):
        many = many.unionByName(again)
    one, other = ({str(r.doc_id): r.score for r in classify(x, labels).collect()} for x in (docs, many))
    assert one == other
