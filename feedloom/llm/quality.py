"""Quality scores by naive-Bayes support vectors.

Features say whether n-grams occur: of words (one and two), and of word shapes
(one to three; a shape has the runs of upper-case letters, other letters,
digits and signs of a word, and whether the word repeats the one before).  An
indicator is scaled by the log ratio of the feature's smoothed frequencies in
the two classes.  A linear hinge-loss model is fitted on these values by dual
coordinate descent, and a logistic curve of the margins of documents that were
left out of a first fit turns margins into scores.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Sent, held_out, short_batches
from feedloom.llm.labelled import sample
from feedloom.llm.text import U64, Powers, Words, blocks, distinct, mix, ngram_hashes, ngram_starts, slice_hashes

#: Hashed features.
BITS = 20
#: The fit is on at most so many documents of each class, of at most so many bytes each.
PER_CLASS = 1200
MAX_BYTES = 100_000
#: Features of fewer documents of the sample are left out.
LEAST_DOCS = 4

CLASS = np.arange(256, dtype=np.uint8)
CLASS[128:] = ord("a")
CLASS[ord("a") : ord("z") + 1] = ord("a")
CLASS[ord("A") : ord("Z") + 1] = ord("A")
CLASS[ord("0") : ord("9") + 1] = ord("0")
SIGN = ~np.isin(CLASS, [ord("a"), ord("A"), ord("0")])


def _shapes(words: Words, buf: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of word shapes; a sign is kept once or twice, other runs once."""
    kind = CLASS[buf]
    same = np.zeros(len(kind), bool)
    same[1:] = kind[1:] == kind[:-1]
    same[words.starts] = False
    third = np.zeros(len(kind), bool)
    third[1:] = same[1:] & same[:-1]
    keep = ~same | (SIGN[buf] & ~third)
    place = np.concatenate(([0], np.cumsum(keep)))
    return slice_hashes(kind[keep], place[words.starts], place[words.ends], powers)


def features(words: Words, buf: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) without repeats, sorted, for a block's texts."""
    plain = words.hashes(powers)
    again = np.zeros(len(plain), bool)
    again[1:] = plain[1:] == plain[:-1]
    again[words.at[:-1][words.counts > 0]] = False
    shaped = mix(_shapes(words, buf, powers) + again.astype(U64))
    row = words.rows()
    found = []
    for salt, (hashes, n) in enumerate(((plain, 1), (plain, 2), (shaped, 1), (shaped, 2), (shaped, 3))):
        at = ngram_starts(words, n) if n > 1 else np.arange(len(plain))
        gram = mix(ngram_hashes(hashes, at, n) + U64(salt)) >> U64(64 - BITS)
        found.append(row[at].astype(np.int64) << BITS | gram.astype(np.int64))
    keys = distinct(np.concatenate(found))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows, columns, powers = [], [], Powers()
    for lo, _, buf, offs in blocks(pa.array(texts, pa.large_string())):
        row, column = features(Words(buf, offs), buf, powers)
        rows.append(row + lo)
        columns.append(column)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def dual_descent(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, cost: np.ndarray, width: int, rounds: int = 25) -> np.ndarray:
    """Weights of a linear model with hinge loss, by coordinate descent in the dual;
    cost bounds each row's dual variable."""
    n = len(y)
    at = np.searchsorted(rows, np.arange(n + 1))
    norm = np.maximum(np.bincount(rows, values * values, n), 1e-12)
    weights, alpha = np.zeros(width), np.zeros(n)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n).tolist():
            c, x = columns[at[i] : at[i + 1]], values[at[i] : at[i + 1]]
            slope = y[i] * (weights[c] @ x) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                weights[c] += (new - alpha[i]) * y[i] * x
                most = max(most, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if most < 1e-3:
            break
    return weights


def _scale(row, column, label, width) -> np.ndarray:
    """Log ratios of the smoothed class frequencies of features; 0 for rare ones."""
    one = np.bincount(column[label[row] == 1], minlength=width)
    none = np.bincount(column[label[row] == 0], minlength=width)
    p = (one + 1.0) / (max(1, (label == 1).sum()) + 2.0)
    q = (none + 1.0) / (max(1, (label == 0).sum()) + 2.0)
    return np.where(one + none >= LEAST_DOCS, np.log(p / q), 0.0)


def _fit(row, column, label, width, c: float = 0.02):
    ratio = _scale(row, column, label, width)
    values = ratio[column]
    on = values != 0
    y = np.where(label == 1, 1.0, -1.0)
    share = np.bincount(label, minlength=2) / max(1, len(label))
    cost = c * 0.5 / np.maximum(share[label], 1e-9)  # classes weigh the same
    # one more feature for the intercept
    rows = np.concatenate((row[on], np.arange(len(label))))
    columns = np.concatenate((column[on], np.full(len(label), width)))
    data = np.concatenate((values[on], np.ones(len(label))))
    order = np.argsort(rows, kind="stable")
    weights = dual_descent(rows[order], columns[order], data[order], y, cost, width + 1)
    return (weights[:width] * ratio), weights[width]


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of margins, by Newton steps."""
    target = np.where(label == 1, ((label == 1).sum() + 1.0) / ((label == 1).sum() + 2.0), 1.0 / ((label == 0).sum() + 2.0))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


class Model:
    """Weights of the features, and the curve from margin to score."""

    def __init__(self, texts: list[str], labels: list[int]) -> None:
        label = np.asarray(labels, np.int64)
        width = 1 << BITS
        row, column = _matrix(texts)
        self.weights, self.offset, self.curve = np.zeros(width, np.float32), 0.0, (1.0, 0.0)
        if len(set(labels)) < 2:  # nothing to tell apart
            self.curve = (1.0, 4.0 * (float(label.mean()) - 0.5) if len(label) else 0.0)
            return
        margin = np.zeros(len(label))
        for fold in range(3):
            out = np.arange(len(label)) % 3 == fold
            place = np.cumsum(~out) - 1
            inner = ~out[row]
            weights, offset = _fit(place[row[inner]], column[inner], label[~out], width)
            margin[out] = np.bincount(row, weights[column], len(label))[out] + offset
        self.curve = _curve(margin, label)
        weights, self.offset = _fit(row, column, label, width)
        self.weights = weights.astype(np.float32)

    def score(self, column: pa.Array) -> np.ndarray:
        powers, out = Powers(), np.zeros(len(column))
        for lo, hi, buf, offs in blocks(column):
            row, feature = features(Words(buf, offs), buf, powers)
            out[lo:hi] = np.bincount(row, self.weights[feature], hi - lo)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * (out + self.offset) + b, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    rows = sample(docs, labels, label_col, per_class, max_bytes)
    return Model([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
          per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`.

    The model learns from a bounded sample of the labelled rows outside the
    held-out fold and scores every whole text; null texts are empty, and texts
    without words have the score of no features.  Rows that repeat are scored
    each; a null id is not held out; without labels of both classes all scores
    are equal; an empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    sent = Sent(spark, train(docs, labels, label_col, per_class, max_bytes))

    def run(batches):
        model = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], names=["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
