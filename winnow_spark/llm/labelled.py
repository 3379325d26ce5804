"""A bounded, repeatable sample of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow_spark.llm.workers import quoted
from winnow_spark.session import cut_lineage

#: Most labelled documents that a classifier is fitted on.
MAX_SAMPLE = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], id: str = "doc_id", text: str = "text", most: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, text and label ``columns`` (0/1) of at most ``most`` documents.

    Of the labels' ids, those with the least hashes are taken, so the sample
    does not depend on partitions or on reruns. Rows with a null label are left
    out; where an id is labelled twice, the greater label holds; of several
    texts of an id, one is taken (by hash), so rows are bounded as ids are. The
    ids are at most ``most``, so they are broadcast and only the sample's texts
    are shuffled.
    """
    known = labels.select(labels[id].alias("doc_id"), *[labels[c].cast("int").alias(c) for c in columns]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(quoted(id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
    one = met.agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"), *[F.first(c).alias(c) for c in columns])
    return cut_lineage(one.select("doc_id", "least.text", *columns), slim=True)
