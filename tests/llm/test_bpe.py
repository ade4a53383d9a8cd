import hashlib
import struct

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm.bpe import Encoder, Replay, encode, round_trip
from tidewright.llm.vocabulary import default_path, default_pattern, read_ranks, read_tokenizer

RANKS = read_ranks(default_path("byte_bpe_50k.tiktoken"))
OURS = Encoder(RANKS, default_pattern())
THEIRS = tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return list(struct.unpack(f"<{len(x := OURS.encode([text])[0]) // 4}I", x))


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text_equals_the_library(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode([text])[0]) == text.encode()


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n  \n", "aaaaaaaaaaaaaaaaaa", "ab" * 3000, "<|endoftext|>", "don't  I'LL we've", "x\x1cy\x85z w", "日本語 テキスト", "👩‍👩‍👧 🇫🇷" * 20, "1234567 ²½", "-" * 777],
)
def test_cases_equal_the_library(text):
    assert ids(text) == THEIRS.encode_ordinary(text)


def test_words_of_one_replay_do_not_touch():
    words = [b"the", b"re", b"\x00\x00", b" therefore", b"\xff"]
    together = Replay(RANKS).words(words)
    assert together == [Replay(RANKS).words([w])[0] for w in words]


def test_both_files_hold_one_vocabulary():
    assert read_tokenizer(default_path("byte_bpe_50k.json"))[0] == RANKS


def test_rows_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, "", None), (2, None, "ids")]
    found = round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in found] == [(1, 2), (1, 2), (None, 0), (2, 0)]
    assert found[2].ids_sha256 == found[3].decoded_sha256 == empty
    assert found[0].decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest()
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
