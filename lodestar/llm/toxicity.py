"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the words in it, and the document's is
the noisy-or of its sentences: 1 minus the product of (1 - sentence score). Document labels alone train it, so the
sentences that carry a label are found on the way; those at or over a threshold are reported with their places.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches
from .training import fold, labelled_rows

#: Labelled documents that the model is fitted on, at most (about).
MAX_TRAINING_DOCS = 12_000
#: Words and beginnings of words that a model has at most: those that tell most.
MAX_WORDS = 4_000
FOLDS = 5

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count beside the whole word, so that endings do not hide a stem.
STEMS = (3, 4, 5)


def units(words: set[str]) -> set[str]:
    """The features of a sentence's words: the words, and their beginnings, marked by a hyphen."""
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in STEMS))


class Model:
    """weights: word or beginning of a word -> weight; bias: the logit of a sentence without any of those words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.starts = {w[: min(STEMS)] for w in weights}
        self.quiet = math.log1p(math.exp(bias))  # -log(1 - score) of such a sentence

    def _known(self, text: str) -> bool:
        return not self.weights.keys().isdisjoint(units({w for w in set(WORD.findall(text.lower())) if w[: min(STEMS)] in self.starts}))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) in code points of the sentences that have words of the model."""
        out, weights = [], self.weights
        for m in SENTENCE.finditer(text):
            words = {w for w in WORD.findall(m[0].lower()) if w[: min(STEMS)] in self.starts}
            known = units(words) & weights.keys() if words else words
            if known:
                z = self.bias + sum(sorted(weights[w] for w in known))
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(min(z, 50), -50)))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and the sentences that have words of the model."""
        n = sum(1 for _ in SENTENCE.finditer(text))
        found = self.sentences(text) if self.weights and self._known(text) else []
        calm = (n - len(found)) * self.quiet - sum(math.log1p(-min(p, 1 - 1e-12)) for *_, p in found)
        return 1 - math.exp(-calm), found


def least_documents(n1: int) -> int:
    """In how many of n1 toxic documents a word occurs at least if it gets a weight."""
    return max(4, n1 // 100)


def lift(toxic: int, other: int, n1: int, n0: int) -> float:
    """How many times as often a word occurs in toxic documents as in others."""
    return (toxic + 0.5) / (n1 + 1) / ((other + 0.5) / (n0 + 1))


def choose(seen: list[tuple[str, int, int]], n1: int, n0: int, most_words: int) -> list[str]:
    """The words of seen (word, toxic documents, other documents) that get a weight, the most telling ones first."""
    told = [(w, k, lift(k, other, n1, n0)) for w, k, other in seen if k >= least_documents(n1)]
    return [w for w, k, x in sorted(told, key=lambda r: (-math.log(r[2]) * r[1], r[0])) if x > 5][:most_words]


def bag(text: str, index: dict[str, int]) -> tuple[list[list[int]], int]:
    """(features of each sentence that has some, number of the other sentences)."""
    out, quiet = [], 0
    for s in SENTENCE.findall(text.lower()):
        if known := units(set(WORD.findall(s))) & index.keys():
            out.append(sorted(index[w] for w in known))
        else:
            quiet += 1
    return out, quiet


def fit(rows: list[tuple[str, int]], most_words: int = MAX_WORDS) -> Model:
    """A model from (text, label) rows. Words that occur in few toxic documents, or hardly more often there than
    elsewhere, get no weight. Without rows of both labels the model has no words and scores (nearly) the base rate."""
    toxic, other = (Counter(u for t, y in rows if (y == 1) == one for u in units(set(WORD.findall(t.lower())))) for one in (True, False))
    n1 = sum(y == 1 for _, y in rows)
    chosen = choose([(w, k, other[w]) for w, k in toxic.items()], n1, len(rows) - n1, most_words)
    index = {w: i for i, w in enumerate(chosen)}
    return optimised(chosen, [(*bag(t, index), y) for t, y in rows])


def optimised(chosen: list[str], bags: list[tuple[list[list[int]], int, int]], steps: int = 300, rate: float = 0.15, decay: float = 5e-5) -> Model:
    """The model of least loss for bags of (features by sentence, number of other sentences, label)."""
    n1 = sum(y == 1 for *_, y in bags)
    if not n1 or n1 == len(bags):
        return Model({}, -20.0 if not n1 else 5.0)
    doc = [d for d, (found, _, _) in enumerate(bags) for _ in found]
    feature = [f for found, _, _ in bags for s in found for f in s]
    sentence = np.repeat(np.arange(len(doc)), [len(s) for found, _, _ in bags for s in found])
    quiet = np.array([q for _, q, _ in bags], np.float64)
    doc, feature, sentence = np.array(doc, np.int64), np.array(feature, np.int64), sentence.astype(np.int64)
    y = np.array([y == 1 for *_, y in bags], np.float64)
    w = np.full(len(chosen), 2.0)
    theta = np.concatenate([w, [-6.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(sentence, theta[feature], minlength=len(doc)) + theta[-1]
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        calm = np.bincount(doc, np.logaddexp(0, z), minlength=len(bags)) + quiet * np.logaddexp(0, theta[-1])
        toxic = np.clip(-np.expm1(-calm), 1e-9, 1)
        pull = np.where(y == 1, -np.exp(-calm) / toxic, 1.0)  # of the loss by each sentence's score, over that score
        by_sentence = p * pull[doc]
        grad = np.concatenate([np.bincount(feature, by_sentence[sentence], minlength=len(chosen)), [by_sentence.sum() + p0 * (quiet * pull).sum()]]) / len(bags)
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # a word can only add to a sentence
    return Model({w: float(x) for w, x in zip(chosen, theta[:-1], strict=True) if x > 0}, float(theta[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", locate_at: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences array<struct<start, end, score>>) of every row of docs, in one pass without a shuffle.

    sentences are those with a score of locate_at or more, in code points, end exclusive. Null and empty texts have no
    sentences and score 0. Repeated rows come out alike. An empty table gives an empty result. Other columns are not
    looked at.
    """
    text_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            got = [model.score(t or "") for t in b.column(1).to_pylist()]
            places = [[{"start": a, "end": e, "score": p} for a, e, p in found if p >= locate_at] for _, found in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array(places, kind)], names=["doc_id", "score", "sentences"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAINING_DOCS, most_words: int = MAX_WORDS) -> Model:
    """A model from the labels outside the held-out fold: of about `most` labelled documents at most, with most_words words
    and beginnings at most.

    Words are counted and looked up on the executors; the driver gets counts of the words that toxic documents have often,
    and numbers for the sentences that have chosen ones, but no text. Of rows that repeat an id one counts, in labels that
    with the smallest label. Null ids and null labels are left out, null texts are empty. An empty table, or labels of one
    kind alone, give a model without words.
    """
    text_batches(docs.sparkSession)
    rows = stored(labelled_rows(docs, labels, label_col, fold(F.col(id_col), FOLDS) != 0, most, id_col, text_col).select("__id", "__text", "__label"), "labelled")
    n, n1 = rows.agg(F.count("*"), F.count_if(F.col("__label") == 1)).first()

    def counted(batches):
        for b in batches:
            toxic, other = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if y == 1 else other).update(units(set(WORD.findall(t.lower()))))
            words = [*toxic, *(other.keys() - toxic.keys())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], names=["w", "toxic", "other"])

    by_word = rows.select("__text", "__label").mapInArrow(counted, "w string, toxic long, other long").groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    more = (F.col("toxic") + 0.5) / F.lit(n1 + 1) > 5 * (F.col("other") + 0.5) / F.lit(n - n1 + 1)
    often = by_word.where((F.col("toxic") >= least_documents(n1)) & more)
    telling = often.orderBy(F.desc(F.log((F.col("toxic") + 0.5) / (F.col("other") + 0.5)) * F.col("toxic")), "w").limit(2 * most_words)
    chosen = choose([tuple(r) for r in telling.collect()], n1, n - n1, most_words)
    index = {w: i for i, w in enumerate(chosen)}
    kind = pa.list_(pa.list_(pa.int32()))

    def bagged(batches):
        for b in batches:
            got = [bag(t, index) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], pa.int64()), b.column(2)], names=["id", "found", "quiet", "label"])

    bags = rows.mapInArrow(bagged, "id long, found array<array<int>>, quiet long, label int").collect()
    return optimised(chosen, [(r.found, r.quiet, r.label) for r in sorted(bags, key=lambda r: r.id)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(docs, model)
    return got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))
