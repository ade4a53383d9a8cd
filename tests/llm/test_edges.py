"""What every operator over ``documents`` does with ids of another type, and single cases that no other file has."""

import pytest

from tidewright.llm import bpe, chat, divergence, fingerprint, jaccard_join, licences, line_dedup, media, packing, quality, secrets, simhash

PROSE = "The quick brown fox jumps over the lazy dog and runs on through the old town."


def labels(spark):
    return spark.createDataFrame([(f"k{i:03d}", i % 2) for i in range(30)], "doc_id string, quality int")


OPERATORS = {
    "op1": lambda spark, docs: jaccard_join.jaccard_components(docs, 3, (9, 10)),
    "op3": lambda spark, docs: licences.licence_lines(docs),
    "op4": lambda spark, docs: packing.pack(docs).where("piece = 0"),
    "op5": lambda spark, docs: fingerprint.fingerprints(docs),
    "op6": lambda spark, docs: media.text_round_trip(docs),
    "op7": lambda spark, docs: bpe.round_trip(docs),
    "op8": lambda spark, docs: secrets.secret_spans(docs),
    "op9": lambda spark, docs: quality.classify(docs, labels(spark)),
    "op10": lambda spark, docs: line_dedup.drop_common_lines(docs),
    "op12": lambda spark, docs: simhash.near_duplicates(docs),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_text_ids(spark, name):
    rows = [(f"k{i:03d}", f"{PROSE} {i}\nReleased under the MIT License.", "en", "s") for i in range(30)] + [("k005", PROSE, None, None), (None, None, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    found = sorted(str(r.doc_id) for r in OPERATORS[name](spark, docs).collect())
    wanted = [str(r[0]) for r in rows]
    if name == "op3":
        wanted = [str(r[0]) for r in rows if r[1] and "MIT" in r[1]]
    assert found == sorted(wanted)


def test_text_ids_of_sources_and_conversations(spark):
    docs = spark.createDataFrame([(f"k{i}", "word " * 3, "en", "ab"[i % 2]) for i in range(20)], "doc_id string, text string, lang string, source string")
    assert divergence.source_divergence(docs).where("part = 'pair'").count() == 2
    turns = spark.createDataFrame([("c1", 0, "user", "hi"), ("c1", 1, "bot", "yes"), ("c2", 0, "user", "hi")], "conv_id string, turn int, role string, text string")
    assert [r.conv_id for r in chat.format_chats(turns).collect()] == ["c1"]


def test_read_media_of_empty_repeated_and_extra(spark):
    schema = "media_id long, media binary, track string, codec int"
    assert media.read_media(spark.createDataFrame([], schema)).count() == 0
    data = media.store(media.padded(b"some text"))
    found = media.read_media(spark.createDataFrame([(1, data, "x", 1), (1, data, "x", 1), (None, None, None, None), (2, b"no container", "y", 2)], schema)).collect()
    assert [(r.media_id, r.track, r.fault is None) for r in found][:2] == [(1, 0, True)] * 2
    assert sorted(str(r.media_id) for r in found if r.fault is not None or r.track is None) == sorted(str(r.media_id) for r in found)[-2:]


def test_bpe_of_an_empty_table_and_one_very_long_text(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = (PROSE + " ") * 8_000 + "z" * 30_000
    (found,) = bpe.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    import hashlib

    assert found.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repeated_rows_in_families_of_many_pieces_count_links_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIECE_NODES", 5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(24):
        own = list(words)
        own[i % 3] = f"x{i}"
        rows += [(i, " ".join(own))] * (1 + (i % 4 == 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.n_links, r.component_id) for r in jaccard_join.jaccard_components(docs, 3, (8, 10)).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}

    sets = [(i, shingles(t)) for i, t in rows]
    linked = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    links = {i: max(sum(linked(a, b) for k, (_, b) in enumerate(sets) if k != n) for n, (j, a) in enumerate(sets) if j == i) for i, _ in sets}
    assert {(i, n) for i, n, _ in found} == set(links.items()) and {c for *_, c in found} == {0}


def test_exact_packing_leaves_no_two_bins_that_fit_together(spark):
    rows = [(i, "word " * (200 + 37 * i % 700)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    used = {}
    for r in packing.pack(docs, slack=0, saves=1.0).collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    fills = sorted(used.values())
    assert max(fills) <= 1024 and len(fills) < 2 or fills[0] + fills[1] > 1024
