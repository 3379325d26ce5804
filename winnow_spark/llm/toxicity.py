"""Toxicity by classifier chains of linear models.

The labels give toxic 0/1 and quality 0/1; from them come three categories, in
this order: ``toxic_junk`` (toxic and of low quality), ``toxic_prose`` (toxic,
of good quality) and ``toxic``. Category k's logistic model sees the document's
features and the probabilities of the categories before it. In training these
are out of fold: for each fold a model fitted on the other folds, over features
picked on the other folds, predicts it, so later models learn from honest
inputs. Any list of 0/1 label columns will do as a chain; the last category
decides.

Features are words and word beginnings (4 to 8 characters) that tell the
classes of some category apart in the sample, each as a saturating rate in the
whole text. They are picked by a distributed count over the sample, by fold;
the sample is bounded (``labelled.MAX_SAMPLE``), scoring covers every document
and does not shuffle.

Defined results for odd input: a null or empty text has no features, and so the
chain's intercept as score; without labels, or with one class only, nothing is
toxic; repeated rows are scored each; an empty table gives an empty result;
extra columns are carried, outputs replace columns of their name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.llm.labelled import labelled_sample
from winnow_spark.llm.workers import beside, give_back, quoted
from winnow_spark.session import cut_lineage, read_table

CATEGORIES = ("toxic_junk", "toxic_prose", "toxic")
MAX_FEATURES, LEAST_DOCS, FOLDS = 1024, 5, 3
#: A word at this rate or more has the feature's full value.
FULL_RATE = 0.01
BEGINNINGS = range(4, 9)
WORD = re.compile(r"[^\W\d_]+")
#: Documents scored at this or more are toxic.
LEAST_TOXIC = 0.5


def word_counts(text: str | None) -> tuple[Counter, int]:
    words = WORD.findall(text.lower()) if text else []
    return Counter(words), len(words)


def features_of(word: str) -> list[str]:
    """The word itself and, marked by a star, its beginnings."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


class Vocabulary:
    """Features with a cache of which of them a word has."""

    def __init__(self, names: list[str]):
        self.names, self.place, self.known = names, {n: i for i, n in enumerate(names)}, {}

    def __getstate__(self):
        return self.names

    def __setstate__(self, names):
        self.__init__(names)

    def rates(self, texts: pd.Series) -> np.ndarray:
        """Saturating rate of each feature in each text."""
        out = np.zeros((len(texts), len(self.names)), np.float32)
        place, known = self.place, self.known
        for row, text in zip(out, texts):
            counts, total = word_counts(text)
            for word, n in counts.items():
                at = known.get(word)
                if at is None:
                    at = known[word] = [place[f] for f in features_of(word) if f in place]
                for k in at:
                    row[k] += n
            if total:
                np.minimum(row / (FULL_RATE * total), 1.0, out=row)
        if len(known) > 100_000:
            known.clear()
        return out


def fold_of(ids: np.ndarray, folds: int) -> np.ndarray:
    return (pd.util.hash_array(np.asarray(ids, np.int64)) % folds).astype(int)


def pick_features(sample: DataFrame, categories: tuple[str, ...], folds: int = FOLDS, most: int = MAX_FEATURES) -> list[list[str]]:
    """For each fold, features whose presence in the other folds tells the classes of a category apart, strongest first; last, those of all rows."""
    width = 1 + len(categories)
    names = [f"c{f}_{k}" for f in range(folds) for k in range(width)]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, seen = {"": 0}, np.zeros((1 << 16, folds, width), np.int32)  # "" is in every text
        for batch in batches:
            marks = np.column_stack([np.ones(len(batch), np.int32), *[batch[c].to_numpy() > 0 for c in categories]])
            for text, fold, mark in zip(batch["text"], fold_of(batch["doc_id"], folds), marks):
                found = {f for word in word_counts(text)[0] for f in features_of(word)} | {""}
                at = [place.setdefault(name, len(place)) for name in found]
                if len(place) > len(seen):
                    seen = np.concatenate([seen, np.zeros((len(place), folds, width), np.int32)])
                seen[at, fold] += mark
        listed = list(place)
        for at in range(0, len(listed), 20_000):
            part = listed[at : at + 20_000]
            yield pd.DataFrame(seen[at : at + len(part)].reshape(len(part), -1), columns=names).assign(feature=part)
        del place, seen, listed
        give_back()

    counts = cut_lineage(sample.mapInPandas(counted, "feature string, " + ", ".join(f"{n} int" for n in names)).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]), slim=True)
    sums = counts.where("feature = ''").first()
    sizes = [[int(sums[f"c{f}_{k}"]) if sums else 0 for k in range(width)] for f in range(folds)]
    picked = []
    for held_out in [*range(folds), None]:
        used = [f for f in range(folds) if f != held_out]
        total = [sum(sizes[f][k] for f in used) for k in range(width)]
        having = [sum((F.col(f"c{f}_{k}") for f in used[1:]), F.col(f"c{used[0]}_{k}")) for k in range(width)]
        strengths = []
        for k in range(1, width):
            if 0 < total[k] < total[0]:
                expected = having[0] * (total[k] / total[0])
                strengths.append((having[k] - expected) * F.abs(having[k] - expected) / expected)
        if not strengths:
            picked.append([])
            continue
        chosen = counts.where(having[0] >= LEAST_DOCS).where("feature <> ''").select("feature", (F.greatest(*strengths) if len(strengths) > 1 else strengths[0]).alias("strength"))
        picked.append([r["feature"] for r in chosen.where("strength > 3.84").orderBy(F.desc("strength"), "feature").limit(most).collect()])
    return picked


def fit_logistic(x: np.ndarray, y: np.ndarray, used: np.ndarray, ridge: float = 1.0, steps: int = 1000, close: float = 1e-4) -> np.ndarray:
    """Weights of an L2-penalised logistic model on the rows ``used`` (0/1); x's last column is 1.

    Nesterov's method, until no weight's slope is over ``close`` a row used, or
    ``steps`` steps.
    """
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    used = used.astype(x.dtype)
    rows = max(float(used.sum()), 1.0)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):  # the largest curvature
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / (0.25 * float(np.linalg.norm(x @ v) ** 2) + ridge + 1e-9)
    w = look = np.zeros(x.shape[1])
    for k in range(steps):
        p = predict_logistic(x, look)
        slope = x.T @ (used * (p - y)).astype(x.dtype) + penalty * look
        after = look - rate * slope
        if np.abs(slope).max() <= close * rows:
            return after
        look, w = after + k / (k + 3) * (after - w), after
    return w


def predict_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30)))


class Chain:
    """A fitted chain: one weight vector a category, each with the earlier categories' probabilities as inputs."""

    def __init__(self, categories: tuple[str, ...], vocabulary: Vocabulary, weights: list[np.ndarray]):
        self.categories, self.vocabulary, self.weights = categories, vocabulary, weights

    def predict(self, texts: pd.Series) -> np.ndarray:
        first = len(self.vocabulary.names)
        inputs = np.zeros((len(texts), first + len(self.weights) + 1), np.float32)
        inputs[:, :first], inputs[:, -1] = self.vocabulary.rates(texts), 1
        for k, w in enumerate(self.weights):
            inputs[:, first + k] = predict_logistic(inputs, w)
        return inputs[:, first:-1].astype(float)


def fit_chain(sample: DataFrame, categories: tuple[str, ...], folds: int = FOLDS) -> Chain:
    """Fit on ``sample`` (doc_id, text and 0/1 columns named by ``categories``; one row an id)."""
    picked = pick_features(sample, categories, folds)
    vocabulary = Vocabulary(sorted(set().union(*picked)))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rates = vocabulary.rates(part["text"])
                full = [np.flatnonzero(r).astype(np.int32) for r in rates]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "at": [f.tobytes() for f in full], "rate": [r[f].tobytes() for r, f in zip(rates, full)], **{c: part[c].to_numpy() for c in categories}})

    rows = sample.mapInPandas(vectors, "doc_id long, at binary, rate binary, " + ", ".join(f"{c} int" for c in categories)).toPandas().sort_values("doc_id").reset_index(drop=True)
    fold, labels = fold_of(rows["doc_id"], folds), [rows[c].to_numpy(float) for c in categories]
    honest = np.zeros((len(rows), len(categories)), np.float32)  # out of fold

    def matrix(names: list[str]) -> np.ndarray:
        """Columns: the features ``names``, the categories' honest probabilities (0 until known), and 1."""
        to = np.full(len(vocabulary.names), -1)
        to[[vocabulary.place[n] for n in names]] = np.arange(len(names))
        x = np.zeros((len(rows), len(names) + len(categories) + 1), np.float32)
        x[:, len(names) : -1], x[:, -1] = honest, 1
        for row, at, rate in zip(x, rows["at"], rows["rate"]):
            place = to[np.frombuffer(at, np.int32)]
            row[place[place >= 0]] = np.frombuffer(rate, np.float32)[place >= 0]
        return x

    def fitted(x: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
        share = float(y[used].mean()) if used.any() else 0.0
        if x.shape[1] > len(categories) + 1 and 0 < share < 1:
            return fit_logistic(x, y, used)
        constant = np.zeros(x.shape[1])
        constant[-1] = 30.0 if share == 1 else -30.0
        return constant

    weights = []
    for k in range(len(categories)):
        weights.append(fitted(matrix(picked[-1]), labels[k], np.ones(len(rows), bool)))
        if k + 1 < len(categories):  # nothing learns from the last category's
            out = np.zeros(len(rows), np.float32)
            for f in np.unique(fold):
                x = matrix(picked[f])
                out[fold == f] = predict_logistic(x[fold == f], fitted(x, labels[k], fold != f))
                del x  # one at a time
            honest[:, k] = out
    return Chain(categories, Vocabulary(picked[-1]), weights)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of ``CATEGORIES`` from columns toxic and quality of ``labels``."""
    sample = labelled_sample(docs, labels, ["toxic", "quality"])
    good = F.col("quality") > 0
    sample = sample.select("doc_id", "text", (F.col("toxic") * (~good).cast("int")).alias("toxic_junk"), (F.col("toxic") * good.cast("int")).alias("toxic_prose"), "toxic")
    return fit_chain(sample, CATEGORIES)


def score_toxicity(df: DataFrame, chain: Chain, text: str = "text", least: float = LEAST_TOXIC) -> DataFrame:
    """``df`` with a probability ``p_<category>`` each and the verdict ``is_toxic``. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(chain)  # at most MAX_FEATURES features
    names = [f"p_{c}" for c in chain.categories]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [shared.value.predict(texts.iloc[at : at + 1000]) for at in range(0, len(texts), 1000)]
            yield pd.DataFrame(np.vstack(parts) if parts else np.zeros((0, len(names))), columns=names)
        shared.value.vocabulary.known.clear()
        give_back()

    return beside(df, run(F.col(quoted(text))), names, is_toxic=F.col(names[-1]) >= least)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, chain)
    return scored.select("doc_id", *[f"p_{c}" for c in CATEGORIES], F.col("is_toxic").alias("toxic"), (~F.col("is_toxic")).alias("kept"))
