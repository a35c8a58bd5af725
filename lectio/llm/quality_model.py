"""Quality scores by Bradley-Terry pairwise ranking.

A document of label 1 is preferred to one of label 0. The probability of that is the logistic function of the difference
of the two scores, a score is a weighted sum of features, and the weights minimise the logistic loss over pairs, that is
over differences of features. Such scores rank only; the threshold is a quantile of the scores of the rows that the fit
saw, at the share of label 0 among them, and the score that is returned is the logistic function of the distance to it.

The fit is on the driver, on at most FIT_ROWS labelled rows (by the order of a hash) and PAIRS pairs, whatever the size
of the tables. Scoring reads each whole text once. No feature knows labels, lang, source or doc_id.

Defined results. A null text has the features of the empty one. Labels without a document, other than 0 and 1, or null
are not used; of a doc_id with several labels the larger counts. Without labels of both kinds every score is 0.5. Rows
that repeat a doc_id are scored each; a null doc_id is held out as the empty string would be. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.common import ship, table
from lectio.llm.quality_rules import measure

FIT_ROWS, PAIRS, RIDGE, STEPS = 10_000, 100_000, 1e-3, 30
UPPER, DIGITS, POINTS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?"
FEATURES = ("words", "chars_a_word", "symbols", "repeated_lines", "words_a_line", "repeated_words", "shouted", "upper", "digits", "points", "different_words", "wide")


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; ratios, so that long and short texts compare."""
    n, chars, symbols, dup_lines, lines, repeats, shouted = measure(text)
    data = (text or "").encode("utf-8", "surrogatepass")
    words, size = max(n, 1), max(len(data), 1)
    count = lambda of: len(data) - len(data.translate(None, of))
    return [
        np.log1p(n), chars / words, min(symbols / words, 3), dup_lines / max(lines, 1), np.log1p(n / max(lines, 1)), repeats / words, shouted / words,
        count(UPPER) / size, count(DIGITS) / size, count(POINTS) / size, len(set(data.split())) / words, (size - chars) / size,
    ]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the threshold."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Bradley-Terry by Newton steps on so many preference pairs."""
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    random = np.random.default_rng(seed)
    better, worse = z[y == 1], z[y == 0]
    diff = better[random.integers(0, len(better), pairs)] - worse[random.integers(0, len(worse), pairs)]
    w = np.zeros(d)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))  # that the better one wins
        gradient = diff.T @ (p - 1) / pairs + RIDGE * w
        curvature = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + RIDGE * np.eye(d)
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return Model(mean, scale, w, float(np.quantile(z @ w, (y == 0).mean())))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def feature_column() -> Column:
    ship()
    @F.arrow_udf("array<double>")
    def lectio_features(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return lectio_features("text")


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on at most so many of the labelled rows that aren't held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("lectio_id__"), "quality")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("lectio_id__"))  # at most `rows` ids
    got = texts.select("doc_id", "quality", feature_column().alias("x")).toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["quality"].to_numpy(int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs."""
    ship()

    @F.arrow_udf("double")
    def lectio_score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.array([features(t) for t in texts.to_pylist()]).reshape(-1, len(FEATURES))))

    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), lectio_score("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
