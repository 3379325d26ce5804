"""The whole reduction: redact, drop duplicates, skeletonize, rank lines, fit to a budget; with a trace of tokens."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.functions.tokens import MARKER, Counter, count_tokens, counter_kind
from winnow_spark.operators.budget import allocate, resolve_budget
from winnow_spark.operators.dedupe import find_duplicates
from winnow_spark.operators.relevance import select_by_relevance
from winnow_spark.operators.secrets import redact, secret_findings
from winnow_spark.operators.skeleton import skeletonize
from winnow_spark.session import cut_lineage
from winnow_spark.sources.files import collect_files, text_rows

# Endings of source files.
CODE = r"(?i)\.(?:mjs|cjs|js|jsx|ts|tsx|py|rb|go|rs|java|kt|kts|swift|c|h|cc|cpp|hpp|cs|php|scala|sh|bash|zsh|sql|vue|svelte)$"


@dataclass
class Reduced:
    items: DataFrame
    trace: DataFrame
    totals: DataFrame
    dropped: DataFrame
    findings: DataFrame

    def context(self) -> DataFrame:
        """One row with the whole ``context``: items joined by a blank line. It is about as long as the budget, so one row holds it."""
        blocks = self.items.agg(F.array_sort(F.collect_list(F.struct("status", "ord", "rendered"))).alias("blocks"))
        return blocks.select(F.array_join(F.transform("blocks", lambda b: b["rendered"]), "\n\n").alias("context"))


def reduce_context(docs: DataFrame, budget: object = None, query: str | None = None, skeletons: bool = True, code: bool | None = None, min_tokens: float = 1, ceiling: float = 0.25, compat_relevance_noop: bool = False, counter: Counter | None = None) -> Reduced:
    """Reduce docs (ord, id, text, optional priority) to ``budget`` tokens.

    ``ord`` is any type that orders the documents. Tokens are counted by
    ``counter`` where there is one; truncated texts are measured by the estimate.
    """
    limit = resolve_budget(budget)
    tokens = lambda c: F.coalesce(count_tokens(F.col(c), counter), F.lit(0))
    base = docs if "priority" in docs.columns else docs.withColumn("priority", F.lit(0.0))
    base = base.select("ord", F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("raw"), "priority")
    redacted = base.select("ord", "id", "priority", "raw", tokens("raw").alias("t0"), redact(F.col("raw")).alias("text"))
    redacted = cut_lineage(redacted.withColumn("t1", F.when(F.col("text") == F.col("raw"), F.col("t0")).otherwise(tokens("text"))).drop("raw"))  # counted once, not by each step
    findings = secret_findings(base.withColumnRenamed("raw", "text"))
    verdicts = cut_lineage(find_duplicates(redacted))
    kept = redacted.join(verdicts.where("verdict = 'kept'").select("ord"), "ord", "left_semi")
    is_code = F.lit(code) if code is not None else F.col("id").rlike(CODE)
    if skeletons:
        kept = kept.withColumn("s", F.when(is_code, skeletonize(F.col("text"))))
        good = (F.col("s.lines_kept") > 0) & (F.col("s.lines_kept") < 0.9 * F.col("s.lines_total"))
        kept = kept.select("ord", "id", "priority", "t1", F.when(good, "declarations").otherwise("full").alias("mode"), F.when(good, F.col("s.text")).otherwise(F.col("text")).alias("text"))
    else:
        kept = kept.select("ord", "id", "priority", "t1", F.lit("full").alias("mode"), "text")
    kept = cut_lineage(kept.withColumn("t2", tokens("text")))
    if query and not compat_relevance_noop:
        picked = select_by_relevance(kept.select(F.col("ord").alias("id"), "text"), query, max_tokens=int(max(min_tokens, limit // 2)), counter=counter)
        picked = picked.select(F.col("id").alias("ord"), "excerpt", F.size("selected").alias("selected"))
        kept = kept.join(picked, "ord").withColumn("text", F.when(F.col("excerpt") == "", F.col("text")).otherwise(F.col("excerpt"))).drop("excerpt")
        kept = cut_lineage(kept.withColumn("tokens", F.when(F.col("selected") == 0, F.col("t2")).otherwise(tokens("text"))))
    else:
        kept = kept.withColumn("selected", F.lit(0)).withColumn("tokens", F.col("t2"))
    fitted = cut_lineage(allocate(kept, limit, ceiling=ceiling, min_tokens=min_tokens))
    items = fitted.join(kept.select("ord", "mode", "selected"), "ord")
    header = F.when(F.col("mode") == "declarations", F.concat("id", F.lit(" (declarations only)"))).otherwise(F.col("id"))
    marker = F.when(F.col("status") == "truncated", MARKER).otherwise("")
    # What is in the context: kept items, then truncated ones.
    items = items.where("status <> 'dropped'").withColumn("rendered", F.concat(header, F.lit("\n"), "out_text", marker)).orderBy("status", "ord")

    count = lambda df, *sums: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(a) for c, a in sums])
    one = count(redacted, ("t0", "t0"), ("t1", "t1")).crossJoin(count(kept, ("t1", "t1k"), ("t2", "t2"), ("tokens", "t3"), ("selected", "selected")))
    removed = verdicts.agg(F.count(F.when(F.col("verdict") != "kept", 1)).alias("removed"))
    one = one.crossJoin(removed).crossJoin(findings.agg(F.count("*").alias("n_findings"))).crossJoin(count(fitted.where("status <> 'dropped'"), ("allocated", "spent")))  # one row each
    none = F.lit(None).cast("long")
    row = lambda place, stage, before, after, saved, on, removed=none, selected=none, found=none: F.struct(F.lit(place).alias("place"), F.lit(stage).alias("stage"), before.alias("tokens_before"), after.alias("tokens_after"), saved.alias("saved"), on.alias("on"), removed.alias("removed"), selected.cast("long").alias("selected"), found.alias("findings"))
    c = F.col
    stages = [
        row(1, "secrets", c("t0"), c("t1"), F.lit(0.0), (c("t0") != c("t1")) | (c("n_findings") > 0), found=c("n_findings")),
        row(2, "dedupe", c("t1"), c("t1k"), c("t1") - c("t1k"), c("removed") > 0, removed=c("removed")),
        row(3, "skeletonize", c("t1k"), c("t2"), c("t1k") - c("t2"), c("t1k") != c("t2")),
        row(4, "relevance", c("t2"), c("t3"), c("t2") - c("t3"), F.lit(bool(query)), selected=c("selected")),
        row(5, "budget", c("t3"), c("spent"), c("t3") - c("spent"), F.lit(True)),
    ]
    trace = one.select(F.explode(F.array(*stages)).alias("s")).select("s.*").where("on").drop("on").orderBy("place").drop("place")
    totals = one.select(c("t0").alias("tokens_in"), c("spent").alias("tokens_out"), (c("t0") - c("spent")).alias("saved"), F.when(c("t0") > 0, 1 - c("spent") / c("t0")).otherwise(0.0).alias("reduction"), F.lit(counter_kind(counter)).alias("counter"), F.lit(float(limit)).alias("budget"), (c("spent") / float(limit)).alias("utilization"))
    repeats = verdicts.where("verdict <> 'kept'").select("id", F.format_string("duplicate (%s) of %s", "verdict", F.coalesce("duplicate_of", F.lit("null"))).alias("reason"))
    dropped = repeats.unionByName(fitted.where("status = 'dropped'").select("id", "reason"))
    return Reduced(items, trace, totals, dropped, findings)


def reduce_text(spark: SparkSession, text: str, id: str = "input", **options: object) -> Reduced:
    """:func:`reduce_context` of one text."""
    return reduce_context(text_rows(spark, [text], [id]), **options)


def optimize(spark: SparkSession, paths: Iterable[str] = (".",), budget: object = None, query: str | None = None, max_files: int | None = None) -> Reduced:
    """:func:`reduce_context` of the files and folders at ``paths``; without files, all results are empty or zero."""
    return reduce_context(cut_lineage(collect_files(spark, paths, max_files)), budget, query)
