import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm import packing
from tidewright.llm.packing import best_fit, pack
from tidewright.llm.vocabulary import default_path, default_pattern, read_tokenizer


def tokenizer():
    return Tokenizer.from_file(default_path("byte_bpe_50k.json"))


def check(rows, found, limit):
    own = tokenizer()
    want = {i: [*own.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    of = {}
    for r in found:
        of.setdefault(r.doc_id, []).append(r)
    assert set(of) == set(want)
    for i, ids in want.items():
        parts = sorted(of[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(parts) == 1) == (len(ids) <= limit)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences), sum(map(len, want.values()))


@pytest.mark.parametrize("chunk", [400_000, 40])
def test_pieces_and_places(spark, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 99, rng.integers(0, 90)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "<|endoftext|> é 日本 \x1c\x85"), (1003, "long text " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    used, tokens = check(rows, pack(docs, limit=128).collect(), 128)
    assert used <= 1.06 * tokens / 128 + 1


PARTS = st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n\n", "it's", "1234", "日本", "é"]), st.text(max_size=12)), max_size=12)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_ids_are_the_tokenizers_own(parts):
    global _ENCODE
    if _ENCODE is None:
        _ENCODE = packing._encoder(*read_tokenizer(default_path("byte_bpe_50k.json")), default_pattern()), tokenizer()
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert list(_ENCODE[0](text)) == _ENCODE[1].encode(text, add_special_tokens=False).ids


_ENCODE = None


def test_added_token_is_one_id(spark):
    (row,) = pack(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")).collect()
    ids = np.array([*tokenizer().encode("a <|endoftext|> b", add_special_tokens=False).ids, 2], "<u4")
    assert (row.length, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) and 50256 in ids


def test_very_long_text(spark):
    rows = [(1, "ab cd <|endoftext|>" * 20_000), (2, "z" * 30_000), (3, "x " * 100_000)]
    check(rows, pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 1024)


def test_best_fit_fills_exactly():
    bins, offsets, fills = best_fit(np.array([6, 4, 7, 3, 5, 5]), 10)
    assert fills.tolist() == [10, 10, 10] and sorted(offsets.tolist()) == [0, 0, 0, 5, 6, 7]


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (1, "a b", 3), (None, None, None)], "doc_id long, text string, bin int")
    found = pack(docs).collect()
    assert sorted((str(r.doc_id), r.length) for r in found) == [("1", 3), ("1", 3), ("None", 1)]
    assert sorted(r.offset for r in found) in ([0, 1, 4], [0, 3, 6])
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
