"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the rest of the corpus is unlabelled, a mixture whose share of good
documents is the class prior. The classifier minimises the non-negative unbiased risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
with the logistic loss over features of a text's shape, so labelled bad documents are never trained on. The prior is
estimated as the share of good ones among the labelled rows of the training fold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted, text_batches, unpacked
from .training import fold, labelled_rows, sample

#: Positives, and unlabelled documents, that the model is fitted on, at most (about).
MAX_POSITIVES = 8_000
MAX_UNLABELLED = 12_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SYMBOLS, _STOPS = b"#*$%&|<>~^@+={}[]\\", b".,;:?"
HIDDEN = 12


def features(text: str | None) -> list[float]:
    """Shape of a text, in numbers of about unit size; all zero for an empty one but for its length."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n, size = len(words), len(b)
    if not n:
        return [0.0] * 16

    def count(chars: bytes) -> int:
        return size - len(b.translate(None, chars))

    upper, lower = count(_UPPER), count(_LOWER)
    letters = upper + lower + count(bytes(range(128, 256))) + 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    distinct = len(set(words))
    return [
        math.log1p(n) / 5, upper / letters, count(_DIGITS) / size * 5, min(count(_SYMBOLS) / n, 1.0), min(count(b"!") / n, 1.0), min(count(b"|") / n, 1.0),
        min(count(_STOPS) / n, 1.0), sum(map(bytes.__eq__, words, words[1:])) / n, distinct / n, math.log1p(distinct) / math.log1p(n),
        size / n / 8, sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), min(n / len(lines) / 100, 2.0), len(set(lines)) / len(lines),
        min(count(b"\"'()-") / n, 1.0), min(sum(1 for w in words if len(w) > 24) / n * 5, 1.0),
    ]


class Model:
    """A network with one hidden layer over standardised features. score(x) is the probability of a good document."""

    def __init__(self, mean, scale, parameters):
        self.mean, self.scale, self.parameters = mean, scale, parameters

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, c, u, d = self.parameters
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ w + c) @ u + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Model:
    """The model of least non-negative risk. Without positives or unlabelled rows every score is the prior."""
    k = 16
    if not len(positive) or not len(unlabelled):
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(k), np.ones(k), (np.zeros((k, 1)), np.zeros(1), np.zeros(1), math.log(p / (1 - p))))
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    theta = [rng.normal(0, 1 / math.sqrt(k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]

    def sigmoid(g):
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))

    for step in range(1, steps + 1):
        w, c, u, d = theta
        hp, hu = np.tanh(zp @ w + c), np.tanh(zu @ w + c)
        gp, gu = hp @ u + d, hu @ u + d
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # Logistic loss: d/dg of log(1 + e^-g) is sigmoid(g) - 1, of log(1 + e^g) sigmoid(g).
        dp, du = prior * (sigmoid(gp) - 1) / len(gp), np.zeros(len(gu))
        if negative >= 0:
            dp, du = dp - prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
        else:  # the negative risk fits by chance: step back from it
            dp, du = prior * sigmoid(gp) / len(gp), -sigmoid(gu) / len(gu)
        bp, bu = np.outer(dp, u) * (1 - hp**2), np.outer(du, u) * (1 - hu**2)
        grads = [zp.T @ bp + zu.T @ bu + decay * w, bp.sum(0) + bu.sum(0), hp.T @ dp + hu.T @ du + decay * u, np.array([dp.sum() + du.sum()])]
        for i, g in enumerate(grads):
            m, v = moments[i]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
            moments[i] = m, v
            theta[i] = theta[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, (theta[0], theta[1], theta[2], float(theta[3][0])))


def sampled_features(rows: DataFrame) -> np.ndarray:
    """rows (__id, __text) -> one row of features each, in order of the id, nulls last. The texts stay on the executors:
    16 numbers a row come to the driver, however long the texts are."""
    text_batches(rows.sparkSession)

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    got = rows.select(F.col("__id").cast("long"), F.col("__text").cast("string")).mapInArrow(run, "id long, x array<double>").collect()
    return np.array([r[1] for r in sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]).reshape(-1, 16)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from the good rows outside the held-out fold, and from a sample of all documents without their labels.

    The sample is of the whole corpus, trained positives included, so that the prior is the share of good ones in it. At most
    about `positives` and `unlabelled` documents are drawn; of documents that share an id one is a positive, and repeated rows
    are one unlabelled document. Null ids and null labels are no positives, null texts are empty. Without positives or
    documents every score is the prior, and without labels that is one half.
    """
    learn = fold(F.col(id_col), FOLDS) != HELD_OUT
    shares = labels.where(learn & F.col(label_col).isNotNull()).agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    prior = min(max(shares if shares is not None else 0.5, 0.02), 0.98)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    good = labelled_rows(docs, labels, label_col, learn & (F.col(label_col) == 1), positives, id_col, text_col)
    return fit(sampled_features(good), sampled_features(sample(texts, "__id", "__text", unlabelled, "unlabelled")), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs, in one pass without a shuffle.

    Null and empty texts have the features of no words and get the score of those. Repeated rows come out alike. An
    empty table gives an empty result. Other columns are not looked at.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of threshold or more, columns unchanged, in one pass without a shuffle.

    A score of exactly the threshold stays. Null and empty texts have the score of no words. Repeated rows stay or go
    together. An empty table gives an empty result. Other columns, of any name, are passed on.
    """
    text_batches(docs.sparkSession)
    row, names = packed(docs)
    own = docs.select(row, quoted(text_col).cast("string").alias("t"))

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, 16)
            yield b.filter(pa.array(model.score(x) >= threshold)).select(["row"])

    return own.mapInArrow(run, own.select("row").schema).select(*unpacked(names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
