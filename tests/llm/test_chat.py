from collections import defaultdict

import numpy as np

from tidewright.llm.chat import format_chats


def brute(rows):
    convs = defaultdict(set)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].add((turn, role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    kept = {}
    for c, turns in sorted(convs.items()):
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values())
        if not longer and turns not in [convs[k] for k in kept]:
            kept[c] = "".join(f"<|{r}|>\n{t.replace('<|', '< |')}\n<|end|>\n" for r, t in turns)
    return kept


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(120):
        base = rng.integers(0, 6)
        for turn in range(rng.integers(1, 7)):
            rows.append((c, turn, ["user", "assistant"][turn % 2], f"topic {base} line {turn}" + (" x" if rng.random() < 0.1 else "")))
    rows += [(500, 0, None, None), (501, 0, "user", "a <|end|> b"), (501, 0, "user", "a <|end|> b"), (None, 0, "user", "lost"), (502, 1, "a", "2"), (502, 1, "a", "1")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, place string")
    found = {r.conv_id: r.rendered for r in format_chats(frame).collect()}
    assert found == brute(rows)


def test_common_first_turn_and_empty_table(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c}") for c in range(3000) for t in range(2)] + [(9999, 0, "user", "hello")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert format_chats(frame).count() == 3000
    assert format_chats(frame.limit(0)).count() == 0


def test_very_long_turns_and_conversations(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "yes")] + [(3, t, "user", str(t)) for t in range(3000)] + [(4, t, "user", str(t)) for t in range(2999)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert {r.conv_id: (r.n_turns, len(r.rendered)) for r in format_chats(frame).collect()} == {c: (len(brute_of(rows, c)), len(brute(rows)[c])) for c in (2, 3)}


def brute_of(rows, conv):
    return [r for r in rows if r[0] == conv]
