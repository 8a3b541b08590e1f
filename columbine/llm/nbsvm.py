"""Quality classifier: naive Bayes features for a linear support vector machine.

Features are the byte n-grams (1 to ``MAX_GRAM`` bytes) that occur in a whole
text, hashed to indicators, and indicators of word n-gram repetition: whether
the share of words that equal the word before reaches each of ``PAIR_SHARES``
and the share of different 1-, 2- and 3-word n-grams stays under each of
``VARIETY_SHARES``.  Each indicator is scaled by its
class log-count ratio r = log((p / |p|) / (q / |q|)), p and q being smoothed
document counts of the two classes, and a text's vector is divided by the root
of its number of indicators, so length does not decide.  A hinge-loss model
with bias is fitted on the scaled vectors by dual coordinate descent (L2
regularised, box 0..C, random order, every epoch over all rows), and its
margin is mapped to 0..1 by a logistic curve fitted on margins of rows that
the fit behind them has not seen (two halves, each scored by the other's fit).

The fit uses at most about ``MAX_TRAIN`` labelled rows, drawn by a hash of
their id; whole texts are used.  They meet in one task, which the bound makes
safe, and come there through a broadcast of the drawn ids (at most that many).
Scoring is map-only over all rows with the model (``DIMENSIONS`` numbers)
broadcast.  Labels, language, source and id are never inputs of a score.

Defined cases: null and empty texts have no indicator and get the bias' score;
an id labelled more than once has the majority label, a tie being 0; null
labels and ids are ignored in training, and of the texts under one id the
least is learnt from; without rows of both classes the score
is the share of label 1 (0.5 without any); repeated rows repeat; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columbine.llm.common import let_go, text_bytes

DIMENSION_BITS = 18
PAIR_SHARES = (0.01, 0.03, 0.1, 0.3, 0.6)
VARIETY_SHARES = (0.8, 0.6, 0.4, 0.2, 0.1)
DIMENSIONS = (1 << DIMENSION_BITS) + len(PAIR_SHARES) + 3 * len(VARIETY_SHARES)
MAX_GRAM = 4
MAX_TRAIN = 8_000
SMOOTHING = 1.0
BOX = 1.0
EPOCHS = 12
THRESHOLD = 0.3
HELD_OUT_FOLDS = 5


def indicators(raw: bytes) -> np.ndarray:
    """Sorted numbers of the indicators that a text sets."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    seen = np.zeros(DIMENSIONS, bool)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, min(MAX_GRAM, len(b)) + 1):
        code = (code[:len(b) - n + 1] << np.uint32(8)) | b[n - 1:]
        h = (code * np.uint32(0x9E3779B1)) ^ np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        seen[h >> np.uint32(32 - DIMENSION_BITS)] = True
    words = raw.split()
    if len(words) > 1:
        same = sum(map(eq, words, words[1:])) / (len(words) - 1)
        flags = [same >= x for x in PAIR_SHARES]
        for grams in (words, list(zip(words, words[1:])), list(zip(words, words[1:], words[2:]))):
            variety = len(set(grams)) / max(len(grams), 1)
            flags += [variety < x for x in VARIETY_SHARES]
        seen[1 << DIMENSION_BITS:] = flags
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """weight already holds the log-count ratios; score = 1 / (1 + exp(-(a * margin + b)))."""
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, at: np.ndarray) -> float:
        return float(self.weight[at].sum() / np.sqrt(max(len(at), 1)) + self.bias)

    def score(self, raw: bytes) -> float:
        z = self.a * self.margin(indicators(raw)) + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p = np.full(DIMENSIONS, SMOOTHING)
    q = np.full(DIMENSIONS, SMOOTHING)
    for at, label in zip(rows, y):
        (p if label > 0 else q)[at] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, box: float = BOX,
                            epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights (ratio folded in) and bias; the bias is a constant feature."""
    w, bias = np.zeros(DIMENSIONS), 0.0
    alpha = np.zeros(len(rows))
    values = [r[at] / np.sqrt(max(len(at), 1)) for at in rows]
    size = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / size[i], 0.0), box)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * r, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton steps."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: list[bool]) -> Model:
    """The model from the texts' ``indicators`` and their labels."""
    y = np.where(np.array(labels, bool), 1.0, -1.0)
    share = float((y > 0).mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, float(np.log(edge / (1 - edge))))

    def trained(use):
        part, label = [rows[i] for i in use], y[use]
        return dual_coordinate_descent(part, label, log_count_ratio(part, label))

    order = np.random.default_rng(11).permutation(len(rows))
    margin = np.zeros(len(rows))
    for test in (order[::2], order[1::2]):
        learn = np.setdiff1d(order, test)
        if len(learn) and len(set(y[learn])) == 2:
            m = Model(*trained(learn), 1.0, 0.0)
            margin[test] = [m.margin(rows[i]) for i in test]
    weight, bias = trained(np.arange(len(rows)))
    a, b = _logistic(margin, y)
    return Model(weight.astype(np.float32), bias, a, b)


def held_out(id_col: str = "doc_id"):
    """Rows kept away from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HELD_OUT_FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """The model from the labelled rows that are not held out."""
    use = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)) \
        .groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) > 0.5).alias("_y"))
    share = min(1.0, max_train / max(1, use.count()))
    drawn = use.where(F.shiftrightunsigned(F.xxhash64("_id"), 2) < int(share * (1 << 62)))
    rows = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("raw")) \
        .join(F.broadcast(drawn), "_id") \
        .groupBy("_id").agg(F.min("raw").alias("raw"), F.min("_y").alias("_y"))  # about max_train ids

    def run(batches):
        let_go()
        rows, y = [], []
        for b in batches:
            rows += [indicators(x.as_py()) for x in b.column(0)]
            y += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, y))], pa.binary())], names=["model"])

    # one task: about max_train whole texts, in an order of their own
    one = rows.select("raw", "_y", "_id").repartition(1).sortWithinPartitions("_id", "raw").select("raw", "_y")
    model = one.mapInArrow(run, "model binary").first()
    return pickle.loads(model[0]) if model else fit([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1, higher: label 1 likelier)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn("__columbine_raw", text_bytes(text_col)).withColumn(score_col, F.lit(0.0))
    schema = rows.schema

    def run(batches):
        let_go()
        for b in batches:
            raw = b.column(b.schema.names.index("__columbine_raw"))
            s = pa.array([held.value.score(x.as_py()) for x in raw], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [s if f.name == score_col else b.column(k) for k, f in enumerate(b.schema)], schema=b.schema)

    return rows.mapInArrow(run, schema).drop("__columbine_raw")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``."""
    model = train(docs, labels, label_col, id_col, text_col)
    rows = score(docs.select(id_col, text_col), model, id_col, text_col)
    return rows.select(id_col, held_out(id_col).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
