r"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are computed with numpy, cut into at most BINS bins, and boosted trees (logistic loss) are
trained on histograms of gradients. The fitted trees are flattened into arrays (feature, threshold, child, value)
and all rows of a batch walk them together.

The training sample is bounded by SAMPLE labelled rows, chosen by a hash of the id; scoring covers every row.
Ids, sources, languages and labels are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import fresh

SAMPLE = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST = 10              # rows in a leaf
RIDGE = 1.0
FOLDS = 5
PREDICT_AT = 0.3

FEATURES = (
    "chars", "words", "word_length", "word_spread", "distinct_words", "repeated_neighbours", "top_word", "upper",
    "digits", "spaces", "punctuation", "symbols", "other_ascii", "non_ascii", "lines", "line_words", "repeated_lines",
    "capital_words", "long_words", "short_words", "byte_entropy", "symbol_words", "bars", "exclamations")

_KIND = np.full(256, 6, np.uint8)  # other ASCII
_KIND[128:] = 7
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\f\r",
                                b".,;:!?'\"()-", b"#*$%&|<>")):
    _KIND[list(_chars)] = _kind


def statistics(text: str | None) -> list[float]:
    """The features of one text; an empty or NULL text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [float(len(raw))] + [0.0] * (len(FEATURES) - 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8) / len(raw)
    share = counts[counts > 0] / len(raw)
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    often = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), len(often) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, max(often.values()) / n, *map(float, kinds[1:]),
        float(np.log1p(len(lines))), n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(map(bytes.isupper, words)) / n, float((lengths > 12).mean()), float((lengths < 3).mean()),
        float(-(share * np.log2(share)).sum()), sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?" for w in words) / n,
        counts[124] / n, counts[33] / n]


def features(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Flattened trees. Node 0 of each tree is its root; a leaf has itself as both children."""
    base: float
    feature: np.ndarray      # trees x nodes
    threshold: np.ndarray
    left: np.ndarray         # the right child follows the left one
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, left, value in zip(self.feature, self.threshold, self.left, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                child = left[node]
                node = np.where(child > 0, child + (x[rows, feature[node]] > threshold[node]), node)
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_split(codes, rows, grad, hess, n_bins):
    """(gain, feature, bin) of the best split of some rows; gradients are summed in one histogram for all features."""
    n_features = codes.shape[1]
    flat = (codes[rows] + np.arange(n_features) * n_bins).ravel()
    size = n_features * n_bins

    def total(weights):
        return np.bincount(flat, np.repeat(weights, n_features), size).reshape(n_features, n_bins).cumsum(1)

    g, h, c = total(grad[rows]), total(hess[rows]), total(np.ones(len(rows)))
    gs, hs, cs = g[:, -1:], h[:, -1:], c[:, -1:]
    gain = g**2 / (h + RIDGE) + (gs - g)**2 / (hs - h + RIDGE) - gs**2 / (hs + RIDGE)
    gain[(c < LEAST) | (cs - c < LEAST)] = -1
    at = int(gain.argmax())
    return gain.flat[at], at // n_bins, at % n_bins


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows or with one label the score is constant."""
    nodes = 2 ** (DEPTH + 1) - 1
    mean = (y.sum() + 0.5) / (len(y) + 1)
    empty = (np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes), np.int64), np.zeros((0, nodes)))
    model = Trees(float(np.log(mean / (1 - mean))), *empty)
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    score, trees = np.full(len(y), model.base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(nodes, np.int64), np.zeros(nodes)
        left, value = np.zeros(nodes, np.int64), np.zeros(nodes)
        level, used = [(0, np.arange(len(y)), 0)], 1
        while level:
            node, rows, depth = level.pop(0)
            value[node] = -RATE * grad[rows].sum() / (hess[rows].sum() + RIDGE)
            if depth == DEPTH or len(rows) < 2 * LEAST:
                score[rows] += value[node]
                continue
            gain, f, cut = _best_split(codes, rows, grad, hess, BINS)
            if gain <= 1e-9 or cut >= len(cuts[f]):
                score[rows] += value[node]
                continue
            feature[node], threshold[node], left[node] = f, cuts[f][cut], used
            above = codes[rows, f] > cut
            level += [(used, rows[~above], depth + 1), (used + 1, rows[above], depth + 1)]
            used += 2
        trees.append((feature, threshold, left, value))
    return Trees(model.base, *(np.stack(part) for part in zip(*trees)))


def held_out(doc_id: Column) -> Column:
    """Every fifth id, by the CRC-32 of its text: never learned from. False for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees fitted on labelled documents outside the held-out fold.

    At most SAMPLE labelled ids are taken, the first by a hash of the id. Statistics of their texts are computed in
    tasks; at most SAMPLE slim rows reach the driver. Ids with contradicting labels are left out; repeated rows
    count once.
    """
    known = (labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id"))
             .agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("id", "y"))
    # SAMPLE ids at most, so they may be broadcast.
    known = F.broadcast(known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())],
                ["id", "y", "x"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(known, "id").select("id", "text", "y").mapInArrow(run, "id long, y int, x binary").distinct()
    rows = rows.orderBy(F.xxhash64("id", "x"), "id", "x").limit(SAMPLE).toPandas()
    x = np.array([np.frombuffer(v, np.float32) for v in rows["x"]], np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, rows["y"].to_numpy(np.float64))


def with_score(docs: DataFrame, model: Trees, name: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of the rows and the score. A column of that name is replaced."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        # Statistics are rounded as in training, so that a threshold treats both alike.
        return pd.Series(model.scores(features(texts.tolist()).astype(np.float32).astype(np.float64)))

    return docs.withColumn(name, score(F.col(f"`{text_col}`")))


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from PREDICT_AT on)."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, least: float = PREDICT_AT) -> DataFrame:
    """The rows whose score is `least` and more, with their own columns."""
    name = fresh(docs, "score")
    return with_score(docs, train(docs, labels), name).where(F.col(name) >= least).drop(name)


def fold_of(doc_id: int) -> int:
    """The fold of an id, as `held_out` sees it (0: held out)."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
