"""BM25 over lines: each document's lines are the collection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow_spark.functions.tokens import Counter, count_tokens

K1, B = 1.5, 0.75
# Words that no query or line counts.
STOPWORDS = (
    "a an and are as at be but by for from has have if in into is it its of on or that the to was were will with this those "
    "i me my we our you your he she they them do does did not no yes so than then when where which who whom what how why"
).split()
SEPARATOR, WORD = r"[^a-z0-9_]+", r"[a-z0-9_]+"
ELISION = " … "


def stem(word: Column) -> Column:
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss")
    return F.when((F.length(word) > 4) & word.endswith("ing"), cut(3)).when(plural, cut(1)).otherwise(word)


def _line_words(line: Column) -> Column:
    # Found, not split at their separators, which takes many times longer; empty pieces would not count anyway.
    return F.filter(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def line_terms(line: Column) -> Column:
    return F.transform(_line_words(line), stem)


def query_words(query: str | None) -> list[str]:
    return [w for w in re.split(SEPARATOR, query.lower()) if len(w) > 1 and w not in STOPWORDS] if isinstance(query, str) else []


def _stemmed(word: str) -> str:
    if len(word) > 4 and word.endswith("ing"):
        return word[:-3]
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def _spellings(term: str) -> list[str]:
    """All words whose stem is ``term``."""
    return [w for w in (term, term + "s", term + "ing") if len(w) > 1 and w not in STOPWORDS and _stemmed(w) == term]


def _line_counts(line: Column, kinds: list[str]) -> Column:
    """A line's number of terms, and of each of ``kinds``: as by :func:`line_terms`, but only words that stem to one are looked at again."""
    met = {w: t for t in kinds for w in _spellings(t)}

    def counts(words: Column) -> Column:
        hits = F.filter(words, lambda w: w.isin(list(met))) if met else F.array().cast("array<string>")
        of = lambda found, t: F.size(F.filter(found, lambda w: w.isin(_spellings(t)) if _spellings(t) else F.lit(False)))
        each = lambda found: F.struct(F.size(words).alias("length"), *[of(found, t).alias(f"tf{i}") for i, t in enumerate(kinds)])
        return F.transform(F.array(hits), each)[0]

    # Bound by lambdas, so that words and hits are made once a line and not once a kind.
    return F.transform(F.array(_line_words(line)), counts)[0]


def line_scores(docs: DataFrame, query: str, window: int = 1) -> DataFrame:
    """id, line_no (from 0), line, own_score, score (with neighbours' decayed scores) and n_lines.

    Term and line counts need one document's lines together; the window is by
    document, so documents are the unit of distribution.
    """
    terms = [_stemmed(w) for w in query_words(query)]
    lines = docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    kinds = sorted(set(terms))
    whole = Window.partitionBy("id")
    lines = lines.select("id", "line_no", "line", _line_counts(F.col("line"), kinds).alias("c"))
    lines = lines.select("id", "line_no", "line", "c.length", *[f"c.tf{i}" for i in range(len(kinds))])
    frequent = [F.count(F.when(F.col(f"tf{i}") > 0, 1)).over(whole).alias(f"df{i}") for i in range(len(kinds))]
    lines = lines.select("*", F.count("*").over(whole).alias("n_lines"), F.avg("length").over(whole).alias("mean"), *frequent)
    mean = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))

    def part(i: int) -> Column:
        n, f = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log(1 + (F.col("n_lines") - n + 0.5) / (n + 0.5))
        return F.when(f > 0, idf * ((f * (K1 + 1)) / (f + K1 * (1 - B + B * (F.col("length") / mean))))).otherwise(0.0)

    parts = [part(kinds.index(t)) for t in terms]
    scored = lines.select("id", "line_no", "line", "n_lines", (sum(parts[1:], parts[0]) if parts else F.lit(0.0)).alias("own_score"))
    by_line = Window.partitionBy("id").orderBy("line_no")
    near = [F.coalesce(move("own_score", d).over(by_line), F.lit(0.0)) * 0.5**d for d in range(1, window + 1) for move in (F.lag, F.lead)]
    return scored.withColumn("score", F.greatest("own_score", *near) if near else F.col("own_score"))


def rank_lines(docs: DataFrame, query: str, window: int = 1) -> DataFrame:
    """Lines with a positive score and their ``rank``; ties after rounding go to the earlier line."""
    scored = line_scores(docs, query, window).where("score > 0").withColumn("score", F.round("score", 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "line_no")))


def select_by_relevance(docs: DataFrame, query: str, max_tokens: int | None = None, count: int | None = None, window: int = 1, elision: str = ELISION, counter: Counter | None = None) -> DataFrame:
    """id, excerpt, selected (line numbers), truncated: the best lines in their order, gaps marked.

    A document without a hit keeps its text; an excerpt over ``max_tokens`` is empty.
    """
    chosen = rank_lines(docs, query, window)
    if count is not None:
        chosen = chosen.where(F.col("rank") <= count)
    gathered = chosen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"), F.first("n_lines").alias("n_lines"))
    pieces = F.transform("lines", lambda x, i: F.when((i > 0) & (x["line_no"] > F.element_at("lines", F.greatest(i, F.lit(1)))["line_no"] + 1), F.concat(F.lit(elision + "\n"), x["line"])).otherwise(x["line"]))
    mark = F.lit(elision.strip())
    head = F.when(F.element_at("lines", 1)["line_no"] > 0, F.array(mark)).otherwise(F.array().cast("array<string>"))
    tail = F.when(F.element_at("lines", -1)["line_no"] < F.col("n_lines") - 1, F.array(mark)).otherwise(F.array().cast("array<string>"))
    gathered = gathered.select("id", F.array_join(F.concat(head, pieces, tail), "\n").alias("excerpt"), F.transform("lines", lambda x: x["line_no"]).alias("selected"), "n_lines")
    over = count_tokens(F.col("excerpt"), counter) > max_tokens if max_tokens is not None else F.lit(False)
    gathered = gathered.select("id", F.when(over, "").otherwise(F.col("excerpt")).alias("excerpt"), "selected", (over | (F.size("selected") < F.col("n_lines"))).alias("truncated"))
    out = docs.select("id", "text").join(gathered, "id", "left")
    return out.select("id", F.coalesce("excerpt", "text").alias("excerpt"), F.coalesce("selected", F.array().cast("array<int>")).alias("selected"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
