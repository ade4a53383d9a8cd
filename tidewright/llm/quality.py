"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
which is every pairwise interaction of rank ``RANK`` in time linear in the features.

Features of a row: its distinct words hashed into ``WORDS`` buckets, weighted by
log(1 + count) and scaled to length 1; statistics of its bytes and words; and the
logarithm of its n_chars column. Language, source, id and labels are no inputs.

The model is fitted on the driver on a bounded sample: of each label at most
``PER_LABEL`` labelled training rows, those of the smallest hashed ids; weights
restore the labels' true shares, which are counted over all training rows. Of a
training row's words the ``FEATURES`` heaviest buckets are learned from, which bounds
what the driver gets (8 bytes for each, 0.3 GB at most). The model has
a fixed size and is broadcast; every row is scored on its whole text.

Null or empty text has its statistics and no words, and is scored. An n_chars that is
null or no number counts as 0; without that column it is the text's length. Without
training rows every score is 0.5; with rows of one label only, the score is that
label's smoothed share. Repeated rows: each is scored. Labels: null labels are left
out; of repeated ids one label is kept, the smallest, and one row is learned from,
that of the smallest text hash. Equal hashes of ids are told apart by the id. A long
text is scored as a whole, in time and memory of its length. An empty table has no
rows. Of other columns those asked for are returned, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.columns import numbered
from tidewright.llm.textkernel import SPACES, blocks, small, word_hashes, word_spans

WORDS = 1 << 15
RANK = 8
PER_LABEL = 4000
EPOCHS = 12
BATCH = 64
FEATURES = 4096
STATISTICS = (
    "bytes", "words", "lines", "stated_chars", "word_length", "line_length", "upper", "digit", "punctuation", "symbol", "space", "other_script",
    "distinct", "most_common", "same_as_last", "same_as_two_back", "symbol_end", "capital_start",
)
SIZE = WORDS + len(STATISTICS)

_UPPER, _DIGIT, _PUNCTUATION, _SYMBOL, _WIDE = (np.zeros(256, bool) for _ in range(5))
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_PUNCTUATION[list(b".,;:?'\"()-")] = True
_SYMBOL[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = True
_WIDE[0x80:] = True


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def features(text: np.ndarray, starts: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of the words, and the rows' statistics."""
    rows = len(starts) - 1
    hashes, first = word_hashes(text, starts)
    begin, end, _ = word_spans(text, starts)
    words, size = np.diff(first).astype(float), np.diff(starts).astype(float)
    at_least = lambda x: np.maximum(x, 1.0)
    row_of = np.repeat(np.arange(rows), np.diff(first))
    bucket = (hashes >> np.uint64(24)).astype(np.int64) & (WORDS - 1)
    cells, counts = np.unique(row_of * WORDS + bucket, return_counts=True)
    row, bucket = cells // WORDS, cells % WORDS
    weight = np.log1p(counts)
    length = np.sqrt(np.bincount(row, weight * weight, rows))
    distinct = np.bincount(row, minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, row, counts)
    back = []
    for k in (1, 2):
        same = np.zeros(len(hashes), bool)
        same[k:] = (hashes[k:] == hashes[:-k]) & (row_of[k:] == row_of[:-k])
        back.append(_sums(same, first))
    symbol_end = _SYMBOL[text[end - 1]] if len(end) else np.zeros(0, bool)
    capital = _UPPER[text[begin]] if len(begin) else np.zeros(0, bool)
    lines = _sums(text == 0x0A, starts) + 1
    per_byte = [_sums(kind[text], starts) / at_least(size) for kind in (_UPPER, _DIGIT, _PUNCTUATION, _SYMBOL, SPACES, _WIDE)]
    per_word = [x / at_least(words) for x in (distinct, most, *back, _sums(symbol_end, first), _sums(capital, first))]
    scales = [np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(stated), np.log1p(size / at_least(words)), np.log1p(size / lines)]
    return row, bucket, weight / np.where(length > 0, length, 1.0)[row], np.stack([*scales, *per_byte, *per_word], axis=1)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def logits(self, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        rows = len(statistics)
        dense = np.clip((statistics - self.mean) / self.spread, -4, 4) / np.sqrt(len(STATISTICS))
        out = self.bias + dense @ self.linear[WORDS:] + np.bincount(row, self.linear[bucket] * weight, rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[:, f]
            own = v[bucket] * weight
            summed = np.bincount(row, own, rows) + dense @ v[WORDS:]
            squared = np.bincount(row, own * own, rows) + (dense * dense) @ (v[WORDS:] ** 2)
            out += 0.5 * (summed * summed - squared)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], statistics: np.ndarray, label: np.ndarray, importance: np.ndarray, seed: int = 7) -> Model:
    """Adam on the weighted log loss; ``rows`` has buckets and weights of each row's words."""
    rng = np.random.default_rng(seed)
    mean, spread = statistics.mean(0), np.maximum(statistics.std(0), 1e-3)
    dense = np.clip((statistics - mean) / spread, -4, 4) / np.sqrt(len(STATISTICS))
    width, dense_at = 1 + RANK, np.arange(WORDS, SIZE)
    theta = np.zeros((SIZE, width))  # linear weight, then factors
    theta[:, 1:] = rng.normal(0, 0.05, (SIZE, RANK))
    bias, bias_moments = 0.0, [0.0, 0.0]
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(EPOCHS):
        rate = 0.02 / (1 + 0.3 * epoch)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            index = np.concatenate([np.concatenate([rows[i][0], dense_at]) for i in pick])
            x = np.concatenate([np.concatenate([rows[i][1], dense[i]]) for i in pick])[:, None]
            cuts = np.cumsum([0, *(len(rows[i][0]) + len(dense_at) for i in pick)])
            own = theta[index]
            vx = own[:, 1:] * x
            summed = np.add.reduceat(vx, cuts[:-1])
            logit = bias + np.add.reduceat(own[:, 0] * x[:, 0], cuts[:-1]) + 0.5 * (summed**2 - np.add.reduceat(vx**2, cuts[:-1])).sum(1)
            slope = (sigmoid(logit) - label[pick]) * importance[pick] / len(pick)
            many = np.diff(cuts)
            pull = np.repeat(slope, many)[:, None]
            gradient = np.concatenate([pull * x, pull * x * (np.repeat(summed, many, axis=0) - vx)], axis=1)
            touched, where = np.unique(index, return_inverse=True)
            total = np.zeros((len(touched), width))
            for f in range(width):
                total[:, f] = np.bincount(where, gradient[:, f], len(touched))
            total += 1e-5 * theta[touched]
            step += 1
            first[touched] = 0.9 * first[touched] + 0.1 * total
            second[touched] = 0.99 * second[touched] + 0.01 * total**2
            theta[touched] -= rate * (first[touched] / (1 - 0.9**step)) / (np.sqrt(second[touched] / (1 - 0.99**step)) + 1e-8)
            b = float(slope.sum())
            bias_moments = [0.9 * bias_moments[0] + 0.1 * b, 0.99 * bias_moments[1] + 0.01 * b * b]
            bias -= rate * (bias_moments[0] / (1 - 0.9**step)) / (np.sqrt(bias_moments[1] / (1 - 0.99**step)) + 1e-8)
    return Model(bias, theta[:, 0].copy(), theta[:, 1:].astype(np.float32).astype(float), mean, spread)


def constant(share: float) -> Model:
    ones = np.ones(len(STATISTICS))
    return Model(float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, 0)), ones, ones)


def _blocks(batch: pa.RecordBatch, text_name: str = "text"):
    stated = batch.column("n_chars").fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    for row, stop, text, starts in blocks(batch.column(text_name)):
        yield row, features(text, starts, np.maximum(stated[row:stop], 0))


def _heaviest(weight: np.ndarray, a: int, b: int) -> np.ndarray:
    """The places of the FEATURES largest weights from a to b, in order; of equal ones the first."""
    return np.arange(a, b) if b - a <= FEATURES else np.sort(a + np.argsort(-weight[a:b], kind="stable")[:FEATURES])


def _sample_features(batches):
    for batch in small(batches):
        for start, (row, bucket, weight, statistics) in _blocks(batch):
            cuts = np.searchsorted(row, np.arange(len(statistics) + 1))
            parts = [_heaviest(weight, a, b) for a, b in zip(cuts, cuts[1:])]
            part = batch.select(["label"]).slice(start, len(statistics))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([bucket[p].astype(np.int32) for p in parts], pa.list_(pa.int32())),
                    pa.array([weight[p].astype(np.float32) for p in parts], pa.list_(pa.float32())),
                    pa.array(list(statistics), pa.list_(pa.float64())),
                ],
                ["label", "bucket", "weight", "statistics"],
            )


def _scores(shared, text_name: str):
    def run(batches):
        for batch in small(batches):
            scores = [sigmoid(shared.value.logits(*own)) for _, own in _blocks(batch, text_name)]
            flat = np.concatenate(scores) if scores else np.zeros(0)
            keep = [n for n in batch.schema.names if n not in ("text", "n_chars")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(flat)], [*keep, "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _inputs(docs: DataFrame) -> list[Column]:
    stated = F.expr("try_cast(n_chars AS long)") if "n_chars" in docs.columns else F.char_length("text").cast("long")
    return [F.col("text").cast("string").alias("text"), stated.alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, quality) marks, without the held-out fold."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        ones, total = shares.get(1, 0), sum(shares.values())
        return constant((ones + 1) / (total + 2))
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_label ids, and of each id one row: a proven bound of what is broadcast and of what the driver gets
    rows = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(picked), "doc_id")
    one = F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars"))
    rows = rows.groupBy("doc_id", "label").agg(one.alias("row")).select("label", "row.text", "row.n_chars")
    kinds = "label int, bucket array<int>, weight array<float>, statistics array<double>"
    found = rows.mapInArrow(_sample_features, kinds).toArrow()
    label = found.column("label").to_numpy().astype(float)
    if len(set(label.tolist())) < 2:
        return constant((label.sum() + 1) / (len(label) + 2))
    statistics = np.stack(found.column("statistics").to_numpy())
    words = [(np.asarray(b, np.int64), np.asarray(w, float)) for b, w in zip(found.column("bucket").to_numpy(), found.column("weight").to_numpy())]
    order = np.lexsort([*statistics.T, label])  # the rows' order must not depend on the cluster
    share = {k: shares[k] / sum(shares.values()) for k in (0, 1)}
    seen = {k: (label == k).mean() for k in (0, 1)}
    importance = np.where(label == 1, share[1] / seen[1], share[0] / seen[0])
    return fit([words[i] for i in order], statistics[order], label[order], importance[order])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, and its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    # a text that is kept goes to the workers once
    text_name = f"k{keep.index('text')}" if "text" in keep and dict(docs.dtypes)["text"] == "string" else "text"
    inputs = _inputs(docs)[1:] if text_name != "text" else _inputs(docs)
    found = docs.select(*kept, *inputs).mapInArrow(_scores(shared, text_name), f"{kinds}, score double")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""
    rows, _ = numbered(docs)
    named = {"doc_id", "text", "n_chars"}
    inner = [c.lower() if c.lower() in named else f"c{i}" for i, c in enumerate(docs.columns)]
    scored = score(rows.toDF(*inner), model, inner).where(F.col("score") >= least)
    return scored.select(*(F.col(a).alias(b) for a, b in zip(inner, docs.columns)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
