"""Queries on what a corpus costs and holds, repeated reductions, and nested configurations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.functions.tokens import estimate_tokens
from winnow_spark.operators import budget, configs, dedupe, reduce, report, secrets
from winnow_spark.plans import reduction_queries
from winnow_spark.plans.token_queries import SQL_ESTIMATE
from winnow_spark.session import cut_lineage, read_table

BUDGET = "medium"
#: Three settings of one tool, from lenient to strict; ``mine`` is a user's own file.
PROFILES = {
    "light": {"output": {"max_lines": 400, "max_bytes": 20000}, "share": 0.8, "tools": {"read": True}, "notes": ["a.md"]},
    "deep": {"output": {"max_lines": 200, "max_bytes": 10000}, "share": 0.5, "tools": {"read": True, "cache": {"ttl": 60}}, "notes": ["a.md", "b.md"]},
    "strict": {"output": {"max_lines": 80}, "share": 0.25, "tools": {"read": False, "cache": {"ttl": 5}}, "notes": []},
    "mine": {"output": {"max_lines": 999, "color": "auto"}, "tools": {"write": None}, "theme": "dark", "empty": {}},
}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "text")


def _turns_as_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as a small module: a function a turn, its text the body."""
    turns = read_table(spark, sf_dir, "conversations")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 \n.]", "")
    body = F.array_join(F.transform(F.split(body, "\n"), lambda line: F.concat(F.lit("  note "), line)), "\n")
    lines = F.concat(F.lit("function turn"), F.col("turn").cast("string"), F.lit("(role) {\n"), body, F.lit("\n}"))
    made = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", lines.alias("code")))).alias("parts"))
    return made.select(F.col("conv_id").alias("ord"), F.concat(F.lit("conversation_"), F.col("conv_id").cast("string"), F.lit(".js")).alias("id"), F.array_join(F.transform("parts", lambda p: p["code"]), "\n").alias("text"))


def analyze_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.file_costs(_docs(spark, sf_dir)).drop("ord")


def analyze_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.analyze(_docs(spark, sf_dir), BUDGET).totals


def analyze_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    issues = report.list_issues(secrets.secret_findings(docs), dedupe.find_duplicates(docs))
    return issues.withColumn("line", F.col("line").cast("double")).withColumn("distance", F.col("distance").cast("double"))


def largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's fifteen dearest files."""
    return report.largest(report.file_costs(_docs(spark, sf_dir), skeletons=False)).select("id", "tokens", "lines")


def over_budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = budget.resolve_budget(BUDGET)
    docs = read_table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(estimate_tokens(F.col("text"))).alias("tokens"))
    return docs.withColumn("over_budget", F.col("tokens") > limit)


def duplicate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return report.duplicate_tokens(report.file_costs(docs, skeletons=False), dedupe.find_duplicates(docs))


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reductions of all conversations' modules to 3,000 tokens, as one row."""
    return report.benchmark(cut_lineage(_turns_as_code(spark, sf_dir)), 3000, repeats=2)[1]


def reduce_code_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of a reduction in which source code is cut to its declarations."""
    return reduce.reduce_context(cut_lineage(_turns_as_code(spark, sf_dir)), 3000).trace


def reduce_code_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = reduce.reduce_context(cut_lineage(_turns_as_code(spark, sf_dir)), 3000).items
    return items.select("id", "status", "mode", "allocated", "rendered")


def _profiles(spark: SparkSession, *names: str) -> DataFrame:
    return configs.flatten(spark.createDataFrame([(n, json.dumps(PROFILES[n])) for n in names], "doc string, json string"))


def profile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict profile changes in a user's file."""
    one = lambda name: _profiles(spark, name).withColumn("doc", F.lit("mine"))
    return configs.apply_config(one("mine"), one("strict"))[1]


def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name: _profiles(spark, name).withColumn("doc", F.lit("mine"))
    return configs.deep_merge(one("mine"), one("deep"))


def profile_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.explain(_profiles(spark, "light", "deep", "strict"), ["light", "deep", "strict"])


def profile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = spark.createDataFrame([("share",), ("tools.cache",)], "path string")
    return configs.status(_profiles(spark, *PROFILES), owned).select("doc", "active", F.size("values").cast("long").alias("n_owned"))


def array_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes from the profiles when one note and all of the cache's settings are removed."""
    return configs.surgical_remove(_profiles(spark, "light", "deep", "strict"), ["tools.cache"], {"notes": lambda v: v == "a.md"})[1]


def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value looked up in each event's properties, and whether these equal the same ones in another spelling."""
    events = read_table(spark, sf_dir, "events")
    respelled = F.concat(F.lit("{ /* same */ "), F.substring("props", F.lit(2), F.length("props") - 2), F.lit(", }"))
    return events.select("event_id", configs.get_path(F.col("props"), "k").alias("k"), configs.deep_equal(F.col("props"), respelled).alias("same"), configs.deep_equal(F.col("props"), F.lit('{"k": 7}')).alias("is_seven"))


_FUNCTIONS = (
    analyze_files, analyze_totals, analyze_issues, largest_documents, over_budget_totals, duplicate_tokens, benchmark_summary, reduce_code_trace, reduce_code_items,
    profile_diff, profile_merge, profile_explain, profile_status, array_removals, property_values,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_SQL = reduction_queries.ORACLES


def _leaves(name: str) -> str:
    """Paths and values of a profile; of an array only the whole is a leaf, and empty objects are none."""
    return f"(SELECT substr(fullkey, 3) AS path, value::VARCHAR AS value FROM json_tree('{json.dumps(PROFILES[name])}'::JSON) WHERE type <> 'OBJECT' AND NOT contains(fullkey, '['))"


def _merged(name: str) -> str:
    """Those of the patch, and those of ``mine`` that no path of the patch is, is above or is below."""
    return f"""(SELECT path, value FROM {_leaves(name)} UNION ALL SELECT path, value FROM {_leaves("mine")} m
  WHERE NOT EXISTS (SELECT 1 FROM {_leaves(name)} p WHERE p.path = m.path OR starts_with(p.path, m.path || '.') OR starts_with(m.path, p.path || '.')))"""


#: DuckDB writes arrays without the space after a comma.
_SPACED = "replace(value, ',', ', ')"
ORACLES = {
    "largest_documents": f"SELECT CAST(doc_id AS VARCHAR) AS id, {SQL_ESTIMATE} AS tokens, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS lines FROM documents ORDER BY tokens DESC, doc_id LIMIT 15",
    "over_budget_totals": f"SELECT source, count(*) AS files, sum({SQL_ESTIMATE})::BIGINT AS tokens, sum({SQL_ESTIMATE}) > 16000 AS over_budget FROM documents GROUP BY source",
    "duplicate_tokens": f"SELECT coalesce(sum({SQL_ESTIMATE}), 0)::BIGINT AS duplicate_tokens FROM documents JOIN ({_SQL['near_duplicates']}) v ON CAST(doc_id AS VARCHAR) = v.id WHERE verdict <> 'kept'",
    "analyze_issues": f"""
SELECT 'secret' AS kind, id, rule, line::DOUBLE AS line, fingerprint, NULL::VARCHAR AS reason, NULL::VARCHAR AS duplicate_of, NULL::DOUBLE AS distance FROM ({_SQL['secret_findings']})
UNION ALL
SELECT 'duplicate', id, NULL, NULL, NULL, verdict, duplicate_of, distance FROM ({_SQL['near_duplicates']}) WHERE verdict <> 'kept'""",
    "profile_merge": f"SELECT 'mine' AS doc, path, {_SPACED} AS value FROM {_merged('deep')}",
    "profile_diff": f"""
SELECT 'mine' AS doc, coalesce(a.path, b.path) AS path, replace(a.value, ',', ', ') AS from_value, replace(b.value, ',', ', ') AS to_value,
       CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM {_leaves('mine')} a FULL JOIN {_merged('strict')} b ON a.path = b.path WHERE a.value IS DISTINCT FROM b.value OR a.path IS NULL OR b.path IS NULL""",
    "property_values": "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, true AS same, json_extract(props, '$.k')::VARCHAR = '7' AS is_seven FROM events",
    "array_removals": "WITH leaf AS (" + " UNION ALL ".join(f"SELECT '{n}' AS doc, path, value FROM {_leaves(n)}" for n in ("light", "deep", "strict")) + """),
kept AS (SELECT doc, path, value, CASE WHEN path = 'notes' AND contains(value, '"a.md"') THEN list_filter(from_json(value, '["VARCHAR"]'), lambda v: v <> 'a.md') END AS lists FROM leaf)
SELECT doc, path, replace(value, ',', ', ') AS from_value, CASE WHEN len(lists) > 0 THEN to_json(lists)::VARCHAR END AS to_value, CASE WHEN len(lists) > 0 THEN 'changed' ELSE 'removed' END AS change
FROM kept WHERE lists IS NOT NULL OR path = 'tools.cache' OR starts_with(path, 'tools.cache.')""",
    "profile_explain": "WITH leaf AS (" + " UNION ALL ".join(f"SELECT '{n}' AS doc, path, {_SPACED} AS value FROM {_leaves(n)}" for n in ("light", "deep", "strict")) + """)
SELECT path, coalesce(max(value) FILTER (doc = 'light'), '-') AS light, coalesce(max(value) FILTER (doc = 'deep'), '-') AS deep,
       coalesce(max(value) FILTER (doc = 'strict'), '-') AS strict FROM leaf GROUP BY path ORDER BY path""",
    "profile_status": "WITH leaf AS (" + " UNION ALL ".join(f"SELECT '{n}' AS doc, path FROM {_leaves(n)}" for n in PROFILES) + """)
SELECT doc, count(*) FILTER (path = 'share' OR starts_with(path, 'tools.cache')) > 0 AS active, count(*) FILTER (path = 'share' OR starts_with(path, 'tools.cache')) AS n_owned FROM leaf GROUP BY doc""",
}
