import math

import numpy as np
import pytest

from tidewright.operators import boosting
from tidewright.operators.boosting import Settings, SoftmaxBooster, Tree

SCHEMA = "a double, b double, c double, label int, held boolean"


def made(n=600, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.normal(size=3)
        label = (1 if a > 0.5 else -1 if b > 0 else 0) if rng.random() < 0.9 else int(rng.integers(-1, 2))
        a = None if rng.random() < 0.2 else math.nan if rng.random() < 0.05 else float(a)  # where it is unknown is no accident below
        rows.append((a, None if label == 0 and rng.random() < 0.5 else float(b), float(c), label, bool(rng.random() < 0.3)))
    return rows


def brute_rounds(rows, cuts, s, classes=(-1, 0, 1)):
    """Trees grown row by row: every split of every node tried on raw values; (round, class, node) -> split or value, and the losses."""
    known = lambda x: x is not None and not math.isnan(x)
    count = {k: sum(r[3] == k for r in rows) for k in classes}
    w = [len(rows) / (count[r[3]] * sum(n > 0 for n in count.values())) for r in rows]
    margin = [[0.0] * 3 for _ in rows]
    out, losses = {}, []

    def probabilities(m):
        e = [math.exp(x) for x in m]
        return [x / sum(e) for x in e]

    def left(row, f, cut, nulls):
        return nulls if not known(row[f]) else row[f] < cut

    for n in range(s.rounds + 1):
        p = [probabilities(m) for m in margin]
        for side in (False, True):
            own = [i for i, r in enumerate(rows) if r[4] == side]
            losses.append(sum(-w[i] * math.log(p[i][classes.index(rows[i][3])]) for i in own) / sum(w[i] for i in own) if own else None)
        if n == s.rounds:
            break
        for k in range(3):
            g = [w[i] * (p[i][k] - (r[3] == classes[k])) for i, r in enumerate(rows)]
            h = [2 * w[i] * p[i][k] * (1 - p[i][k]) for i in range(len(rows))]

            def grow(members, node, depth):
                fit = [i for i in members if not rows[i][4]]  # noqa: B023
                if not fit:
                    return
                total_g, total_h = sum(g[i] for i in fit), sum(h[i] for i in fit)  # noqa: B023
                part = lambda x, y: x * x / (y + s.penalty)
                best = None
                if depth < s.depth:
                    for f in range(3):
                        for cut in cuts[f]:
                            for nulls in (True, False):
                                own = [i for i in fit if left(rows[i], f, cut, nulls)]
                                gl, hl = sum(g[i] for i in own), sum(h[i] for i in own)  # noqa: B023
                                if min(hl, total_h - hl) < max(s.least_hessian, 1e-9):
                                    continue
                                gain = 0.5 * (part(gl, hl) + part(total_g - gl, total_h - hl) - part(total_g, total_h)) - s.gamma
                                if best is None or gain > best[0] + 1e-9:
                                    best = (gain, f, cut, nulls)
                if best and best[0] > 0:
                    out[n, classes[k], node] = best  # noqa: B023
                    for side in (0, 1):
                        grow([i for i in members if left(rows[i], *best[1:]) == (side == 0)], 2 * node + side, depth + 1)
                else:
                    value = -s.rate * total_g / (total_h + s.penalty)
                    out[n, classes[k], node] = value  # noqa: B023
                    for i in members:
                        margin[i][k] += value  # noqa: B023

            grow(range(len(rows)), 1, 0)
    return out, losses


def test_trees_equal_rows_tried_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    rows = made(240)
    s = Settings(depth=3, rounds=3, rate=0.4, penalty=2.0, gamma=0.05, least_hessian=3.0, bins=8, rows_share=1.0, columns_share=1.0)
    m = SoftmaxBooster(["a", "b", "c"], settings=s).fit(spark.createDataFrame(rows, SCHEMA).repartition(3), validation="held")
    m.best = s.rounds
    want, losses = brute_rounds(rows, m.cuts, s)
    got = {}
    for r in m.tree_rows(spark.range(1)).collect():
        got[r["round"], r["class"], r["node"]] = r["value"] if r["feature"] is None else (r["gain"], "abc".index(r["feature"]), r["cut"], r["null_left"])
    rounds = len(m.trees)
    assert got.keys() == {k for k in want if k[0] < rounds} and rounds >= 1
    for key, own in got.items():
        assert own == pytest.approx(want[key], abs=1e-8)
    flat = [x for pair in m.losses for x in pair]
    assert flat == pytest.approx(losses[: len(flat)], abs=1e-9)


def test_nulls_are_a_side_and_not_a_value(spark):
    """A label that depends on whether a value is known: no filling in could find it."""
    rng = np.random.default_rng(1)
    rows = [(None if i % 3 == 0 else float(rng.normal()), 0.0, 0.0, 1 if i % 3 == 0 else -1, False) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    s = Settings(depth=1, rounds=6, rate=0.5, least_hessian=1.0, rows_share=1.0, columns_share=1.0, gamma=0.0)
    m = SoftmaxBooster(["a"], settings=s).fit(frame)
    scored = m.with_probabilities(frame, ["p_down", "p_flat", "p_up"]).collect()
    # the side of the nulls holds some of the smallest values, too, since a cut is below the first one at most
    assert np.mean([(r.p_up > r.p_down) == (r.label == 1) for r in scored]) > 0.9
    assert all(abs(r.p_down + r.p_flat + r.p_up - 1) < 1e-12 for r in scored)


def test_patience_and_saved_models(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.normal()), float(rng.normal()), float(rng.normal()), int(rng.integers(-1, 2)), i % 2 == 0) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    s = Settings(depth=4, rounds=40, rate=0.5, penalty=0.1, gamma=0.0, least_hessian=0.1, patience=3)
    m = SoftmaxBooster(["a", "b", "c"], settings=s).fit(frame, validation="held")
    watched = [v for _, v in m.losses]
    assert len(m.losses) == m.best + 4 and watched[m.best] == min(watched) and len(m.trees) == m.best
    again = SoftmaxBooster.from_json(m.to_json())
    key = lambda f: sorted(tuple(r) for r in f.collect())
    assert key(again.with_probabilities(frame, list("xyz"))) == key(m.with_probabilities(frame, list("xyz")))


def test_no_rows_one_class_and_constant_columns(spark):
    s = Settings(depth=2, rounds=2, least_hessian=0.0)
    empty = spark.createDataFrame([], SCHEMA)
    m = SoftmaxBooster(["a", "b"], settings=s).fit(empty)
    one = spark.createDataFrame([(1.0, None, 0.0, 1, False)] * 5 + [(1.0, None, 0.0, None, False)], SCHEMA)
    assert [round(r.x, 9) for r in m.with_probabilities(one, list("xyz")).collect()] == [round(1 / 3, 9)] * 6
    m = SoftmaxBooster(["a", "b"], settings=s).fit(one)
    assert all(r.z > r.x for r in m.with_probabilities(one, list("xyz")).collect())


def test_leaves_of_a_tree():
    t = Tree.stump(2)
    t.feature[[1, 3]], t.cut[[1, 3]], t.null_left[1], t.null_left[3] = (0, 1), (4, 0), False, True
    assert t.nodes(np.array([[4, 9], [5, 0], [-1, 1], [-1, -1]])).tolist() == [2, 6, 7, 6]
