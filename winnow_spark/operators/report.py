"""What a corpus costs and holds before anything is reduced, and how much a reduction takes away, measured again and again."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.functions.tokens import Counter, count_tokens, counter_kind
from winnow_spark.operators.budget import resolve_budget
from winnow_spark.operators.dedupe import find_duplicates
from winnow_spark.operators.reduce import reduce_context
from winnow_spark.operators.secrets import secret_findings
from winnow_spark.operators.skeleton import skeletonize
from winnow_spark.session import cut_lineage
from winnow_spark.sources.files import collect_files

# Rows of the largest files, drops, findings and changes that a report shows.
TOP_FILES, TOP_DROPS, TOP_FINDINGS, TOP_CHANGES = 15, 15, 20, 14


@dataclass
class Analysis:
    files: DataFrame
    totals: DataFrame
    issues: DataFrame


def file_costs(docs: DataFrame, counter: Counter | None = None, skeletons: bool = True) -> DataFrame:
    """ord, id, tokens, lines and, of each text's declarations (source code or not), skeleton_tokens and skeleton_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    made = docs.select("ord", "id", count_tokens(text, counter).alias("tokens"), F.size(F.split(text, "\n")).cast("long").alias("lines"), *([skeletonize(text).alias("s")] if skeletons else []))
    return made.select("ord", "id", "tokens", "lines", count_tokens(F.col("s.text"), counter).alias("skeleton_tokens"), F.col("s.lines_kept").cast("long").alias("skeleton_lines")) if skeletons else made


def duplicate_tokens(costs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row, ``duplicate_tokens``: what the documents cost that are no first of their kind, empty ones included."""
    dropped = verdicts.where("verdict <> 'kept'").select("ord")
    return costs.join(dropped, "ord", "left_semi").agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("duplicate_tokens"))


def list_issues(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """kind (secret or duplicate), id, and what is known of each: rule, line, fingerprint; reason, duplicate_of, distance."""
    duplicates = verdicts.where("verdict <> 'kept'").select(F.lit("duplicate").alias("kind"), "id", F.col("verdict").alias("reason"), "duplicate_of", "distance")
    return findings.select(F.lit("secret").alias("kind"), "id", "rule", "line", "fingerprint").unionByName(duplicates, allowMissingColumns=True)


def analyze(docs: DataFrame, budget: object = None, counter: Counter | None = None) -> Analysis:
    """Costs by file (dearest first), totals in one row, and issues of docs (ord, id, text), as they are, not redacted."""
    limit = resolve_budget(budget)
    costs = cut_lineage(file_costs(docs, counter))
    verdicts, findings = cut_lineage(find_duplicates(docs)), cut_lineage(secret_findings(docs))
    sums = costs.agg(F.count("*").alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("skeleton_tokens"), F.lit(0)).alias("skeleton_tokens"))
    totals = sums.crossJoin(duplicate_tokens(costs, verdicts)).crossJoin(findings.agg(F.count("*").alias("secrets")))  # one row each
    totals = totals.select(
        "files", "tokens", "skeleton_tokens", "duplicate_tokens", "secrets", F.lit(float(limit)).alias("budget"), F.lit(counter_kind(counter)).alias("counter"),
        F.when(F.col("tokens") > 0, 1 - F.col("skeleton_tokens") / F.col("tokens")).otherwise(0.0).alias("skeleton_reduction"), (F.col("tokens") > limit).alias("over_budget"),
    )
    return Analysis(costs.orderBy(F.desc("tokens"), "ord"), totals, list_issues(findings, verdicts))


def analyze_paths(spark: SparkSession, paths: Iterable[str] = (".",), budget: object = None, max_files: int | None = None) -> Analysis:
    return analyze(cut_lineage(collect_files(spark, paths, max_files)), budget)


def largest(costs: DataFrame, most: int = TOP_FILES) -> DataFrame:
    """The ``most`` dearest files."""
    return costs.orderBy(F.desc("tokens"), "ord").limit(most)


def benchmark(docs: DataFrame, budget: object = None, repeats: int = 3) -> tuple[DataFrame, DataFrame]:
    """(runs, summary) of ``repeats`` reductions, once at least.

    A run has tokens_in, tokens_out, reduction and the stages' savings; the
    summary their mean, the population's standard deviation and whether all runs
    agree. Savings in tokens say nothing of the quality of answers.
    """
    limit, runs = resolve_budget(budget), None
    for number in range(max(1, repeats)):
        reduced = reduce_context(docs, limit)
        saved = reduced.trace.agg(F.map_from_entries(F.collect_list(F.struct("stage", "saved"))).alias("stage_savings"))
        run = cut_lineage(reduced.totals.select(F.lit(number).alias("run"), "tokens_in", "tokens_out", "reduction", "counter", "budget").crossJoin(saved))  # one row each
        runs = run if runs is None else runs.unionByName(run)
    spread = F.stddev_pop("reduction")
    summary = runs.agg(F.count("*").alias("runs"), F.avg("reduction").alias("mean_reduction"), spread.alias("stdev"), (spread == 0).alias("deterministic"))
    return runs, summary


def report_lines(analysis: Analysis) -> list[str]:
    """A fixed-width report for people: totals, the dearest files, the first drops and findings."""
    totals = analysis.totals.first()
    share = lambda x: f"{100 * x:.1f}%"
    lines = [f"{'files':<18}{totals['files']:>12}", f"{'tokens':<18}{totals['tokens']:>12} ({totals['counter']})", f"{'declarations':<18}{totals['skeleton_tokens']:>12} ({share(totals['skeleton_reduction'])} smaller)"]
    lines += [f"{'duplicates':<18}{totals['duplicate_tokens']:>12}", f"{'secrets':<18}{totals['secrets']:>12}", f"{'budget':<18}{totals['budget']:>12.0f}" + (" (over)" if totals["over_budget"] else "")]
    lines += [f"{r['tokens']:>10}  {r['id']}" for r in largest(analysis.files).collect()]
    kind = lambda k, most: analysis.issues.where(F.col("kind") == k).orderBy("id", "line").limit(most).collect()
    lines += [f"duplicate ({r['reason']}) {r['id']} of {r['duplicate_of'] or '-'}" for r in kind("duplicate", TOP_DROPS)]
    return lines + [f"secret {r['rule']} {r['id']}:{r['line']} {r['fingerprint']}" for r in kind("secret", TOP_FINDINGS)]
