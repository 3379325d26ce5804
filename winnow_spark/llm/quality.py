"""Quality rules: gradient-boosted trees over document statistics.

Statistics of a whole text (words, symbols, repeated lines and three-word
windows, case, variety) are computed in one vectorised pass. Two plain rules
(``base_failed``) come first; what they let through is scored by boosted trees
fitted to labelled documents. Fitted trees are flattened to numpy arrays of
node features, thresholds, children and values, so a batch of documents goes
down all trees together, level by level. Chosen features are monotonic: more
symbols, repeats, upper case or shouting never raise a score and more variety
never lowers it; splits that break this are not made, and children's values are
kept on their side of the parent's middle.

The trees are fitted on a bounded sample of labelled rows
(``labelled.MAX_SAMPLE``) and applied to every document, without a shuffle.

Defined results for odd input: a null or empty text has zero statistics, and so
fails the base rules; an empty or one-sided label table fits no trees and every
score is that share (1.0 without labels); repeated rows are judged each; an
empty table gives an empty result; extra columns are carried, outputs replace
columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.llm.labelled import labelled_sample
from winnow_spark.llm.workers import beside, give_back, quoted
from winnow_spark.session import read_table

SYMBOLS = b"#*$%&|<>"
UPPERS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = UPPERS + bytes(range(97, 123))
SPACES = b"\t\n\x0b\x0c\r "

#: Feature name and the direction of its effect on the score.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": -1,
    "shouts_per_word": -1,
    "distinct_share": 1,
    "top_word_share": -1,
    "digits_per_word": 0,
    "words_per_line": 0,
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Words that stand in a three-word window found twice or more."""
    if len(ids) < 4:
        return 0
    if kinds < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * kinds + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(ids), bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def document_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts of ``STATS`` and the values of ``FEATURES``."""
    if not text:
        return [0] * 5, [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space only
    count, lines = len(words), [line for line in raw.split(b"\n") if line.strip(SPACES)]
    without = lambda chars: len(raw.translate(None, chars))
    size = len(raw)
    chars = len(text) - (size - without(SPACES))
    symbols, dups = size - without(SYMBOLS), len(lines) - len(set(lines))
    places: dict[bytes, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, count)
    repeats = _repeated(ids, len(places))
    letters = size - without(LETTERS)
    per_word = 1.0 / max(count, 1)
    features = [
        float(np.log1p(count)),
        chars * per_word,
        symbols * per_word,
        dups / max(len(lines), 1),
        repeats * per_word,
        (size - without(UPPERS)) / max(letters, 1),
        raw.count(b"!") * per_word,
        len(places) * per_word,
        float(np.bincount(ids).max()) * per_word if count else 0.0,
        (size - without(DIGITS)) * per_word,
        count / max(len(lines), 1),
    ]
    return [count, chars, symbols, dups, repeats], features


def base_failed(count: int, repeats: int) -> bool:
    return count < 50 or 100 * repeats > 50 * count


@dataclass
class Trees:
    """Flattened boosted trees: row = tree, column = node; node n has children 2n+1 and 2n+2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 5.0, least: int = 10) -> Trees:
    """Second-order boosting of log loss with monotonic constraints."""
    nodes, inner = 2 ** (depth + 1) - 1, 2**depth - 1
    share = float(y.mean()) if len(y) else 1.0
    share_clipped = min(max(share, 1e-6), 1 - 1e-6)
    start = float(np.log(share_clipped / (1 - share_clipped)))
    if len(y) < 2 * least or share in (0.0, 1.0):
        trees, start = 0, 30.0 if share == 1.0 else start
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if trees else np.empty(0) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(cut, x[:, f], "left") for f, cut in enumerate(cuts)], 1) if trees else None
    feature, threshold, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    margin = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        best = lambda g, h: g / (h + ridge)
        gain = lambda g, h: g * g / (h + ridge)
        for n in range(inner):
            mine = np.flatnonzero(node == n)
            g, h = slope[mine].sum(), curve[mine].sum()
            value[t, n] = np.clip(best(g, h), low[n], high[n])
            top = (1e-9, -1, -1, 0.0, 0.0)
            for f, cut in enumerate(cuts):
                if not len(cut) or len(mine) < 2 * least:
                    continue
                code = codes[mine, f]
                gs, hs, ns = (np.bincount(code, w, len(cut) + 1).cumsum()[:-1] for w in (slope[mine], curve[mine], None))
                left, right = np.clip(best(gs, hs), low[n], high[n]), np.clip(best(g - gs, h - hs), low[n], high[n])
                gains = gain(gs, hs) + gain(g - gs, h - hs) - gain(g, h)
                gains[(ns < least) | (len(mine) - ns < least) | (directions[f] * (right - left) < 0)] = -1
                k = int(gains.argmax())
                if gains[k] > top[0]:
                    top = (gains[k], f, k, left[k], right[k])
            _, f, k, left, right = top
            a, b = 2 * n + 1, 2 * n + 2
            low[a] = low[b] = low[n]
            high[a] = high[b] = high[n]
            if f < 0:  # a leaf above the last level: everything goes left, to the same value
                low[a] = high[a] = value[t, n]
                node[mine] = a
                continue
            feature[t, n], threshold[t, n] = f, cuts[f][k]
            middle = (left + right) / 2
            if directions[f] > 0:
                high[a] = low[b] = middle
            elif directions[f] < 0:
                low[a] = high[b] = middle
            node[mine] = np.where(codes[mine, f] <= k, a, b)
        for n in range(inner, nodes):
            mine = node == n
            value[t, n] = np.clip(best(slope[mine].sum(), curve[mine].sum()), low[n], high[n])
        value[t] *= rate
        margin += value[t, node]
    return Trees(start, feature, threshold, value, depth)


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Trees:
    """Trees for P(good), from the labelled documents' statistics."""
    sample = labelled_sample(docs, labels, [target])
    width = len(FEATURES)

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [document_stats(text) for text in batch["text"]]
            kept = [not base_failed(s[0], s[4]) for s, _ in found]
            out = pd.DataFrame([f for _, f in found], columns=list(FEATURES), dtype=float)
            yield out.assign(doc_id=batch["doc_id"].to_numpy(), label=batch[target].to_numpy())[kept]

    rows = sample.mapInPandas(stats, ", ".join([*(f"{f} double" for f in FEATURES), "doc_id long", "label int"])).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES])
    x = rows[list(FEATURES)].to_numpy(float).reshape(-1, width)
    return fit_trees(x, rows["label"].to_numpy(float), list(FEATURES.values()))


#: Documents scored under this are rejected.
LEAST_SCORE = 0.5


def judge_quality(df: DataFrame, trees: Trees, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``df`` with the five statistics, ``base_failed``, ``score`` and ``kept``. No shuffle."""
    names = [*STATS, "base_failed", "score", "kept"]

    @F.pandas_udf(", ".join([*(f"{s} long" for s in STATS), "base_failed boolean", "score double", "kept boolean"]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [document_stats(text) for text in texts]
            out = pd.DataFrame([s for s, _ in found], columns=STATS, dtype="int64")
            out["base_failed"] = [base_failed(s[0], s[4]) for s, _ in found]
            out["score"] = trees.score(np.array([f for _, f in found], float).reshape(-1, len(FEATURES)))
            out["kept"] = ~out["base_failed"].astype(bool) & (out["score"] >= least)
            yield out
        give_back()

    return beside(df, run(F.col(quoted(text))), names)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return judge_quality(docs, trees).select("doc_id", *STATS, "base_failed", "kept", "score")
