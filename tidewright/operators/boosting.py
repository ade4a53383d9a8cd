"""Gradient-boosted trees over a softmax of classes, grown level by level from histograms that Spark sums up.

Each round grows one tree for each class. Its levels are one aggregate each: a task
streams its rows and adds their gradients and hessians to a histogram by (class, node,
feature, bin); histograms are summed by key, and the driver, which holds nothing else
than those sums (classes x nodes x features x bins of two numbers) and the trees, picks each
node's split. A null is a bin of its own: it is never filled in, and each split sends it to
the side where the gain is larger (a null that no row had goes left).

gradient = w (p - y), hessian = 2 w p (1 - p); gain = 1/2 (GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)) - gamma;
a node is split where the largest gain is above 0 and both sides have ``least_hessian``; of equal
gains the first feature, the lowest bin, nulls to the left. A leaf is -rate G/(H+l).

Rows that ``validation`` marks are not learned from: their mean loss is summed in the first
aggregate of each round, boosting ends after ``patience`` rounds without a smaller one,
and the trees up to the best round count. Rows without a label are left out. Weights are those of
``class_weights`` unless a column is named. ``rows_share`` and ``columns_share`` draw by hashes of seed,
round and row, so that a task that runs again draws the same.

Margins are written with the rows every ``KEPT_ROUNDS`` rounds; between, the trees since then are
evaluated again. A lost executor's tasks read the last written table.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace
from tidewright.operators import stats

KEPT_ROUNDS = 8
_FIT_LOSS, _VALIDATION_LOSS = -1, -2


@dataclass(frozen=True)
class Settings:
    depth: int = 5
    rounds: int = 1500
    rate: float = 0.05
    penalty: float = 5.0
    gamma: float = 1.0
    least_hessian: float = 400.0
    bins: int = 64
    rows_share: float = 0.8
    columns_share: float = 0.8
    patience: int = 50
    seed: int = 7


@dataclass
class Tree:
    """Nodes by number: the root is 1, node n has 2n (left) and 2n + 1; ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        size = 1 << (depth + 1)
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.ones(size, bool), np.zeros(size), np.zeros(size))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Each row's leaf; ``bins`` are -1 for nulls, and bins up to the cut go left."""
        node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(len(self.feature).bit_length() - 2):
            own = bins[rows, np.maximum(self.feature[node], 0)]
            left = np.where(own < 0, self.null_left[node], own <= self.cut[node])
            node = np.where(self.feature[node] >= 0, 2 * node + ~left, node)
        return node


def _softmax(margin: np.ndarray) -> np.ndarray:
    z = np.exp(margin - margin.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _drawn(row: np.ndarray, seed: int, n: int, share: float) -> np.ndarray:
    """Whether a row's 64-bit hash, mixed with seed and round, is among ``share`` of all."""
    if share >= 1:
        return np.ones(len(row), bool)
    with np.errstate(over="ignore"):
        x = row.view(np.uint64) ^ (np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n) * np.uint64(0xBF58476D1CE4E5B9))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / (1 << 53) < share


def _arrays(batch: pa.RecordBatch, features: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    flat = lambda c: batch.column(c).flatten().to_numpy()
    return flat("bins").astype(np.int64).reshape(-1, features), flat("margin").reshape(-1, classes)


def _histograms(features: int, classes: int, settings: Settings, n: int, level: int, since: list[list[Tree]], growing: list[Tree]):
    """Rows to (key, g, h); a key is ((class x nodes + node) x features + feature) x (bins + 1) + bin + 1, or one of the losses."""
    wide, nodes = settings.bins + 1, 1 << level

    def run(batches):
        g, h = (np.zeros(classes * nodes * features * wide) for _ in range(2))
        losses = np.zeros((2, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margin = _arrays(batch, features, classes)
            y, weight, learned, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "learned", "row"))
            for trees in since:
                margin = margin + np.stack([t.value[t.nodes(bins)] for t in trees], axis=1)
            p = _softmax(margin)
            if level == 0:
                loss = -weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))
                for side in (0, 1):
                    own = learned == (side == 0)
                    losses[side] += loss[own].sum(), weight[own].sum()
            use = np.flatnonzero(learned & _drawn(row, settings.seed, n, settings.rows_share))
            bins, p, y, weight = bins[use], p[use], y[use], weight[use]
            place = np.arange(features) * wide + bins + 1
            for k, tree in enumerate(growing):
                node = tree.nodes(bins) - nodes
                live = np.flatnonzero(node >= 0)
                at = ((k * nodes + node[live]) * features * wide)[:, None] + place[live]
                slope = weight[live] * (p[live, k] - (y[live] == k))
                curve = np.maximum(2 * weight[live] * p[live, k] * (1 - p[live, k]), 1e-16)
                g += np.bincount(at.ravel(), np.repeat(slope, features), len(g))
                h += np.bincount(at.ravel(), np.repeat(curve, features), len(h))
        keys = np.flatnonzero(h > 0)
        extra = [k for k, own in ((_FIT_LOSS, 0), (_VALIDATION_LOSS, 1)) if losses[own, 1] > 0]
        own = [-1 - k for k in extra]
        columns = [np.append(keys, extra).astype(np.int64), np.append(g[keys], losses[own, 0]), np.append(h[keys], losses[own, 1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "g", "h"])

    return run


def _with_margins(features: int, classes: int, since: list[list[Tree]]):
    def run(batches):
        for batch in batches:
            bins, margin = _arrays(batch, features, classes)
            for trees in since:
                margin = margin + np.stack([t.value[t.nodes(bins)] for t in trees], axis=1)
            own = pa.ListArray.from_arrays(np.arange(0, len(bins) * classes + 1, classes, dtype=np.int32), pa.array(margin.ravel()))
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", own)

    return run


def _split(g: np.ndarray, h: np.ndarray, settings: Settings, allowed: np.ndarray) -> tuple[float, int, int, bool]:
    """Gain, feature, bin and side of the nulls of a node's best split, from its histogram (features x (nulls and bins))."""
    part = lambda a, b: a * a / (b + settings.penalty)
    whole = part(g[0].sum(), h[0].sum())
    total_g, total_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    gains = []
    for left in (True, False):
        gl, hl = (np.cumsum(x[:, 1:], 1)[:, :-1] + (x[:, :1] if left else 0) for x in (g, h))
        gr, hr = total_g - gl, total_h - hl
        gain = 0.5 * (part(gl, hl) + part(gr, hr) - whole) - settings.gamma
        fits = (hl >= settings.least_hessian) & (hr >= settings.least_hessian) & (hl > 0) & (hr > 1e-12) & allowed[:, None]
        gains.append(np.where(fits, gain, -np.inf))
    both = np.stack(gains, axis=2)
    best = int(both.argmax())
    feature, cut, side = np.unravel_index(best, both.shape)
    return float(both.flat[best]), int(feature), int(cut), side == 0


def bin_cuts(frame: DataFrame, features: list[str], bins: int, how: str = "quantiles") -> list[list[float]]:
    """Up to ``bins`` - 1 rising cuts of each feature: quantiles of its values, or places of equal ``width`` from the least to the largest."""
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    if how == "quantiles":
        shares = [i / bins for i in range(1, bins)]
        row = frame.agg(*[F.percentile_approx(v, shares, 50 * bins).alias(f"c{i}") for i, v in enumerate(values.values())]).first()
        return [sorted(set(own or [])) for own in row]
    row = frame.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values.values()) for n, f in (("a", F.min), ("b", F.max))]).first()
    ends = list(zip(row[::2], row[1::2]))
    return [[] if a is None or a == b else [a + (b - a) * i / bins for i in range(1, bins)] for a, b in ends]


def _bins(cuts: list[list[float]], features: list[str]) -> Column:
    def one(c: str, own: list[float]) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x), -1).otherwise(F.size(F.filter(F.lit(own) if own else F.array().cast("array<double>"), lambda cut: cut <= x)))

    return F.array(*[one(c, own) for c, own in zip(features, cuts)]).cast("array<smallint>")


@dataclass
class SoftmaxBooster:
    """``fit`` a frame, then ``with_probabilities`` of any frame with the features."""

    features: list[str]
    classes: tuple = (-1, 0, 1)
    settings: Settings = field(default_factory=Settings)
    cuts: list[list[float]] = field(default_factory=list)
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[tuple[float, float | None]] = field(default_factory=list)
    best: int = 0

    def fit(self, frame: DataFrame, label: str = "label", validation: str | None = None, weight: str | None = None, cuts: str = "quantiles") -> SoftmaxBooster:
        """``losses`` has, before each round and after the last, the weighted mean loss of the rows learned from and of the validation rows."""
        known = frame.where(F.col(label).isin(*self.classes))
        if weight is None:
            shares = stats.class_weights(known, label, []).select(label, F.col("weight").alias("_weight"))
            known = known.join(F.broadcast(shares), label)  # one row for each class
        learned = ~F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(True)
        self.cuts = bin_cuts(known.where(learned), self.features, self.settings.bins, cuts)
        code = F.array_position(F.lit(list(self.classes)), F.col(label)) - 1
        rows = known.select(
            _bins(self.cuts, self.features).alias("bins"), code.cast("int").alias("y"), F.col(weight or "_weight").cast("double").alias("w"), learned.alias("learned"),
            F.xxhash64(*known.columns).alias("row"), F.lit([0.0] * len(self.classes)).alias("margin"),
        )
        work = Workspace(frame.sparkSession, "boosting")
        try:
            self._grow(work, work.keep("rows-0", rows))
        finally:
            work.drop("")
        return self

    def _sums(self, rows: DataFrame, n: int, level: int, since: list[list[Tree]], growing: list[Tree]) -> tuple[np.ndarray, dict[int, float]]:
        """Gradients and hessians by (class, node, feature, bin), and the mean losses by their keys."""
        s, shape = self.settings, (len(self.classes), 1 << level, len(self.features), self.settings.bins + 1)
        task = _histograms(len(self.features), len(self.classes), s, n, level, since, growing)
        summed = rows.mapInArrow(task, "key long, g double, h double").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found = summed.toArrow()  # classes x nodes x features x (bins + 1) rows at most, and two losses
        key, g, h = (found.column(c).to_numpy() for c in ("key", "g", "h"))
        held = np.zeros((2, int(np.prod(shape))))
        held[:, key[key >= 0]] = g[key >= 0], h[key >= 0]
        return held.reshape(2, *shape), {int(k): float(a / b) for k, a, b in zip(key, g, h) if k < 0}

    def _grow(self, work: Workspace, rows: DataFrame) -> None:
        s, since, written = self.settings, [], 0
        self.trees, self.losses, self.best, least = [], [], 0, None
        if rows.isEmpty():
            return
        for n in range(s.rounds + 1):
            trees = [Tree.stump(s.depth) for _ in self.classes]
            sums, losses = self._sums(rows, n, 0, since, trees)
            self.losses.append((losses.get(_FIT_LOSS), losses.get(_VALIDATION_LOSS)))
            watched = losses.get(_VALIDATION_LOSS)
            if watched is None or least is None or watched < least:
                least, self.best = watched, n
            if n == s.rounds or (watched is not None and n - self.best >= s.patience):
                break
            for level in range(s.depth + 1):
                if level:
                    sums, _ = self._sums(rows, n, level, since, trees)
                self._split_level(n, level, trees, sums)
            self.trees.append(trees)
            since.append(trees)
            if len(since) == KEPT_ROUNDS:
                written += 1
                rows = work.keep(f"rows-{written}", rows.mapInArrow(_with_margins(len(self.features), len(self.classes), since), rows.schema))
                work.drop(f"rows-{written - 1}")
                since = []
        self.trees = self.trees[: self.best]

    def _split_level(self, n: int, level: int, trees: list[Tree], sums: np.ndarray) -> None:
        s = self.settings
        for k, tree in enumerate(trees):
            chosen = np.ones(len(self.features), bool)
            if s.columns_share < 1:
                rng = np.random.default_rng((s.seed, n, k))
                chosen[:] = False
                chosen[rng.permutation(len(chosen))[: max(1, round(s.columns_share * len(chosen)))]] = True
            for place in range(1 << level):
                node, (g, h) = place + (1 << level), sums[:, k, place]
                if h[0].sum() <= 0:
                    continue
                tree.value[node] = -s.rate * g[0].sum() / (h[0].sum() + s.penalty)
                if level < s.depth:
                    gain, feature, cut, null_left = _split(g, h, s, chosen)
                    if gain > 0:
                        tree.feature[node], tree.cut[node], tree.null_left[node], tree.gain[node], tree.value[node] = feature, cut, null_left, gain, 0.0

    def with_probabilities(self, frame: DataFrame, names: list[str]) -> DataFrame:
        """``frame`` with a probability of each class, from the trees up to the best round."""
        trees, classes = self.trees, len(self.classes)

        @F.pandas_udf("array<double>")
        def scored(bins: pd.Series) -> pd.Series:
            own = np.stack(bins.to_numpy()).astype(np.int64) if len(bins) else np.zeros((0, 1), np.int64)
            margin = np.zeros((len(own), classes))
            for n in trees:
                margin += np.stack([t.value[t.nodes(own)] for t in n], axis=1)
            return pd.Series(list(_softmax(margin)))

        out = frame.withColumn("_p", scored(_bins(self.cuts, self.features)))
        return out.select(*frame.columns, *[F.col("_p")[k].alias(name) for k, name in enumerate(names)])

    def tree_rows(self, frame: DataFrame) -> DataFrame:
        """(round, class, node, feature, cut, null_left, gain, value) of every node; a cut is the value below which rows go left."""
        rows = []
        for n, trees in enumerate(self.trees):
            for k, t in zip(self.classes, trees):
                for node in range(1, len(t.feature)):
                    f = int(t.feature[node])
                    if f >= 0:
                        cuts = self.cuts[f]
                        at = int(t.cut[node])
                        rows.append((n, int(k), node, self.features[f], float(cuts[at]) if at < len(cuts) else None, bool(t.null_left[node]), float(t.gain[node]), None))
                    elif node == 1 or t.feature[node // 2] >= 0:
                        rows.append((n, int(k), node, None, None, None, None, float(t.value[node])))
        return frame.sparkSession.createDataFrame(rows, "round int, class int, node int, feature string, cut double, null_left boolean, gain double, value double")

    def to_json(self) -> dict:
        trees = [[{name: getattr(t, name).tolist() for name in ("feature", "cut", "null_left", "value", "gain")} for t in n] for n in self.trees]
        return {"features": self.features, "classes": list(self.classes), "settings": asdict(self.settings), "cuts": self.cuts, "trees": trees, "losses": self.losses, "best": self.best}

    @classmethod
    def from_json(cls, held: dict) -> SoftmaxBooster:
        kinds = {"feature": int, "cut": int, "null_left": bool, "value": float, "gain": float}
        trees = [[Tree(**{name: np.array(t[name], kind) for name, kind in kinds.items()}) for t in n] for n in held["trees"]]
        return cls(held["features"], tuple(held["classes"]), Settings(**held["settings"]), held["cuts"], trees, [tuple(x) for x in held["losses"]], held["best"])
