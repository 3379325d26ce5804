"""Queries on duplicates, secrets, relevance, budgets and the whole reduction over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.functions.tokens import estimate_tokens
from winnow_spark.operators import budget, configs, dedupe, reduce, relevance, secrets, skeleton
from winnow_spark.plans.token_queries import sql_estimate
from winnow_spark.session import read_table

QUERY = "licensed under the apache license, version and the public terms"
#: What the query comes to: stop words removed, then stemmed.
SQL_TERMS = "('licensed'), ('under'), ('apache'), ('license'), ('version'), ('public'), ('term')"
#: The skeleton's tests of single lines.
LINE_CLASSES = {"declarations": skeleton.DECLARATION, "always": skeleton.KEEP_ALWAYS, "noise": skeleton.NOISE, "comments": (skeleton.COMMENT,), "containers": (skeleton.CONTAINER,)}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "text")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(dedupe.normalize_text(F.col("text")), 256).alias("norm"))
    firsts = docs.groupBy("norm").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return docs.join(firsts, "norm").select("doc_id", "first_id", "copies", (F.col("doc_id") != F.col("first_id")).alias("duplicate"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.find_duplicates(_docs(spark, sf_dir)).select("id", "verdict", "duplicate_of", F.col("distance").cast("double").alias("distance"))


def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = read_table(spark, sf_dir, "documents").select("doc_id", dedupe.simhash(F.col("text")).alias("s"))
    return hashed.select("doc_id", "s.high", "s.low")


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe.shingles(dedupe.hash_words(F.col("text")))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_shingles"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_findings(_docs(spark, sf_dir))


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", secrets.redact(F.col("text")).alias("redacted"))
    return docs.where("text <> redacted").select("doc_id", "redacted", estimate_tokens(F.col("redacted")).alias("tokens"))


def bm25_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = relevance.line_scores(_docs(spark, sf_dir), QUERY).where("score > 0")
    return scored.select("id", F.col("line_no").cast("long").alias("line_no"), F.round("score", 4).alias("score"))


def relevance_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = relevance.select_by_relevance(_docs(spark, sf_dir), QUERY, max_tokens=400)
    return picked.select("id", "excerpt", F.size("selected").alias("n_selected"), "truncated")


def split_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("ord")).agg(F.sum(estimate_tokens(F.col("text"))).alias("tokens"))
    return budget.split_budget(items, 64_000)


def conversation_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a request of 400 tokens; later turns go first."""
    turns = read_table(spark, sf_dir, "conversations")
    items = turns.select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("id"), "text", estimate_tokens(F.col("text")).alias("tokens"), F.col("turn").alias("priority"))
    fitted = budget.allocate(items, 400, group="conv_id")
    return fitted.select("conv_id", F.col("ord").alias("turn"), "tokens", "status", "allocated", "reason")


def document_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one request of 64,000 tokens of four characters."""
    fitted = budget.allocate_documents(_docs(spark, sf_dir), 64_000)
    return fitted.select("id", "tokens", "status", "allocated", "reason")


def page_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each page the skeleton's tests take for declarations, lines kept always, noise, comments and containers."""
    lines = read_table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.regexp_replace("html", "([>;{}])", "$1\n"), "\n")).alias("line"))
    is_kind = lambda patterns: F.rlike("line", F.lit("^(?:" + "|".join(patterns) + ")"))
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"), *[F.count(F.when(is_kind(p), 1)).alias(name) for name, p in LINE_CLASSES.items()])


def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read_table(spark, sf_dir, "documents").select("doc_id", "text", skeleton.skeletonize(F.col("text")).alias("s"))
    return made.select("doc_id", estimate_tokens(F.col("text")).alias("tokens"), estimate_tokens(F.col("s.text")).alias("skeleton_tokens"), "s.lines_kept", "s.lines_total", F.size("s.symbols").alias("n_symbols"))


def event_property_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc"), F.col("props").alias("json"))
    return configs.flatten(events).groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def reduce_context_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = reduce.reduce_context(_docs(spark, sf_dir), "large", QUERY).trace
    return trace.select(*[F.col(c).cast("double").alias(c) if c in ("removed", "selected", "findings") else c for c in trace.columns])


def reduce_context_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_context(_docs(spark, sf_dir), "large").totals


_FUNCTIONS = (
    exact_duplicates, near_duplicates, simhashes, shingle_counts, secret_findings, redacted_documents, bm25_lines, relevance_excerpts,
    split_budget, conversation_budgets, document_budgets, page_line_classes, skeletons, event_property_paths, reduce_context_trace, reduce_context_totals,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_SQL_NORM = r"regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in relevance.STOPWORDS)
_TERM_LIST = SQL_TERMS.replace("(", "").replace(")", "")
_STEMMED = """CASE WHEN length(w) > 4 AND ends_with(w, 'ing') THEN left(w, -3)
                   WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, -1) ELSE w END"""
#: Windows of five words by document, as ``made`` (doc_id, s), and the SimHashes as ``prints``.
_SHINGLES = """
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END AS s
  FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 2) AS w FROM documents)"""


def _vote(column: str) -> str:
    return " + ".join(f"(CASE WHEN sum((({column} >> {b}) & 1) * 2 - 1) > 0 THEN {1 << b} ELSE 0 END)" for b in range(32))


_PRINTS = f"""made AS ({_SHINGLES}),
each AS (SELECT doc_id, unnest(s) AS s FROM made),
kinds AS (
  SELECT s, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS low,
         list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(s) + 1), lambda i: 0::BIGINT)), lambda h, c: (h * 16777619) & 4294967295) AS high
  FROM (SELECT DISTINCT s FROM each)),
prints AS (SELECT doc_id, ({_vote("high")})::BIGINT AS high, ({_vote("low")})::BIGINT AS low FROM each JOIN kinds USING (s) GROUP BY doc_id)"""
#: The assignment rule without its look-ahead, which comes as a test of its own; the tables hold no other secrets.
_ASSIGNED = r"""(?i)\b([A-Za-z0-9_]*(?:password|passwd|secret|token|api_?key)[A-Za-z0-9_]*["'']?\s*[:=]\s*["'']?)([^\s"'',;]{6,})"""
ORACLES = {
    "exact_duplicates": f"""
WITH docs AS (SELECT doc_id, sha256({_SQL_NORM}) AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS first_id, count(*) OVER (PARTITION BY norm) AS copies,
       doc_id <> min(doc_id) OVER (PARTITION BY norm) AS duplicate FROM docs""",
    "shingle_counts": f"""
WITH made AS ({_SHINGLES})
SELECT doc_id, len(s)::BIGINT AS n_shingles, len(list_distinct(s))::BIGINT AS n_distinct FROM made""",
    "bm25_lines": f"""
WITH lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
terms AS (
  SELECT id, line_no, list_transform(list_filter(regexp_split_to_array(lower(line), '[^a-z0-9_]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})),
    lambda w: {_STEMMED}) AS ts FROM lines),
stats AS (SELECT id, count(*) AS n, coalesce(nullif(avg(len(ts)), 0), 1) AS mean FROM terms GROUP BY id),
tf AS (SELECT id, line_no, q.term, len(list_filter(ts, lambda w: w = q.term)) AS f, len(ts) AS len FROM terms, (VALUES {SQL_TERMS}) q(term)),
df AS (SELECT id, term, count(*) FILTER (f > 0) AS d FROM tf GROUP BY ALL),
own AS (
  SELECT id, line_no, sum(CASE WHEN f > 0 THEN ln(1 + (n - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) * (f * 2.5::DOUBLE)
         / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) ELSE 0 END) AS own
  FROM tf JOIN df USING (id, term) JOIN stats USING (id) GROUP BY id, line_no),
boosted AS (
  SELECT id, line_no, greatest(own, coalesce(lag(own) OVER w, 0) * 0.5::DOUBLE, coalesce(lead(own) OVER w, 0) * 0.5::DOUBLE) AS score
  FROM own WINDOW w AS (PARTITION BY id ORDER BY line_no))
SELECT id, line_no::BIGINT AS line_no, round(score, 4) AS score FROM boosted WHERE score > 0""",
    "split_budget": """
WITH items AS (
  SELECT conv_id AS ord, sum(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0::DOUBLE
    + len(regexp_extract_all(text, '[^A-Za-z0-9_\\s]')) * 0.25::DOUBLE - len(regexp_extract_all(text, '[ \\t]{2,}')) * 0.1::DOUBLE)) END)::BIGINT AS tokens
  FROM conversations GROUP BY conv_id),
even AS (SELECT *, greatest(1, floor(64000.0 / count(*) OVER ()))::BIGINT AS per, count(*) OVER () AS n FROM items),
short AS (SELECT *, CASE WHEN tokens > per THEN tokens - per END AS need FROM even)
SELECT ord, tokens, per + CASE WHEN need IS NOT NULL AND row_number() OVER (ORDER BY need NULLS LAST, ord) <= 64000 - per * n THEN 1 ELSE 0 END AS share
FROM short""".replace("\\\\", "\\"),
    "conversation_budgets": f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, text, {sql_estimate("text")}::DOUBLE AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
steps AS (
  SELECT conv_id, 0::BIGINT AS place, 400.0::DOUBLE AS rest, NULL::BIGINT AS turn, NULL::DOUBLE AS tokens, NULL::VARCHAR AS status, NULL::DOUBLE AS allocated, NULL::VARCHAR AS reason
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, place, rest - coalesce(allocated, 0), turn, tokens, status, allocated, CASE WHEN status = 'dropped' THEN CASE WHEN rest < 1 THEN 'out of budget' ELSE 'does not fit and is not truncatable' END END
  FROM (
    SELECT *, CASE WHEN status = 'kept' THEN tokens WHEN status = 'truncated' THEN {sql_estimate("cut")} END AS allocated
    FROM (
      SELECT *, CASE WHEN rest < 1 THEN 'dropped' WHEN tokens <= allowance THEN 'kept' WHEN text IS NULL THEN 'dropped' ELSE 'truncated' END AS status,
             CASE WHEN from_end > 0 AND length(raw) - from_end >= floor(target * 0.8::DOUBLE) THEN substr(raw, 1, length(raw) - from_end + 1) ELSE raw END || chr(10) || '… [truncated]' AS cut
      FROM (
        SELECT *, substr(text, 1, target) AS raw, instr(reverse(substr(text, 1, target)), chr(10)) AS from_end
        FROM (
          SELECT *, greatest(1, greatest(1, floor(least(allowance, rest) * 4)) - 20)::BIGINT AS target
          FROM (
            SELECT t.*, s.rest, greatest(1.0::DOUBLE, least(s.rest - CASE WHEN t.place < t.n AND t.text IS NOT NULL THEN s.rest * 0.75::DOUBLE ELSE 0 END, t.tokens)) AS allowance
            FROM steps s JOIN turns t ON s.conv_id = t.conv_id AND t.place = s.place + 1))))))
SELECT conv_id, turn, tokens, status, allocated::DOUBLE AS allocated, reason FROM steps WHERE place > 0""",
    "near_duplicates": f"""
WITH RECURSIVE {_PRINTS},
norms AS (SELECT doc_id, {_SQL_NORM} AS norm FROM documents),
heads AS (SELECT norm, min(doc_id) AS head FROM norms WHERE norm <> '' GROUP BY norm),
sets AS (SELECT doc_id, list_distinct(s) AS s FROM made WHERE doc_id IN (SELECT head FROM heads)),
postings AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM postings a JOIN postings b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
edges AS (
  SELECT a, b, (bit_count(xor(x.high, y.high)) + bit_count(xor(x.low, y.low)))::INT AS distance
  FROM shared JOIN prints x ON x.doc_id = a JOIN prints y ON y.doc_id = b
  WHERE k / (na + nb - k) >= 0.8::DOUBLE AND bit_count(xor(x.high, y.high)) + bit_count(xor(x.low, y.low)) <= 12),
later AS (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS i FROM edges GROUP BY b),
decided AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS dropped
  UNION ALL
  SELECT l.i, CASE WHEN len(list_filter(l.before, lambda x: NOT list_contains(d.dropped, x))) > 0 THEN list_append(d.dropped, l.b) ELSE d.dropped END
  FROM decided d JOIN later l ON l.i = d.i + 1),
gone AS (SELECT unnest(arg_max(dropped, i)) AS doc_id FROM decided),
near AS (SELECT b, min(a) AS a, arg_min(distance, a) AS distance FROM edges WHERE b IN (SELECT doc_id FROM gone) AND a NOT IN (SELECT doc_id FROM gone) GROUP BY b)
SELECT CAST(n.doc_id AS VARCHAR) AS id, CASE WHEN n.norm = '' THEN 'empty' WHEN near.b IS NOT NULL THEN 'near' WHEN n.doc_id = head THEN 'kept' ELSE 'exact' END AS verdict,
       CAST(CASE WHEN near.b IS NOT NULL THEN near.a WHEN n.doc_id <> head THEN head END AS VARCHAR) AS duplicate_of,
       CASE WHEN near.b IS NOT NULL THEN near.distance WHEN n.doc_id <> head THEN 0 END::DOUBLE AS distance
FROM norms n LEFT JOIN heads USING (norm) LEFT JOIN near ON near.b = head""",
    "secret_findings": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
hits AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{_ASSIGNED}')) AS hit FROM lines)
SELECT CAST(doc_id AS VARCHAR) AS id, 'assignment' AS rule, line_no::INT AS line, left(sha256(hit), 8) AS fingerprint FROM hits
WHERE NOT regexp_matches(hit, '(?i)[:=]\\s*["'']?(\\[REDACTED|\\$|process\\.|os\\.|env\\b|your|example|changeme|<)')""",
    "redacted_documents": f"""
WITH made AS (SELECT doc_id, text AS raw, regexp_replace(text, '{_ASSIGNED}', '\\1[REDACTED]', 'g') AS redacted FROM documents)
SELECT doc_id, redacted, {sql_estimate("redacted")} AS tokens FROM made WHERE raw <> redacted""",
    "event_property_paths": """
SELECT path, count(*) AS n, count(DISTINCT value) AS n_values
FROM (SELECT j.key AS path, j.value AS value FROM events, json_each(props) j) GROUP BY path""",
    "simhashes": f"WITH {_PRINTS}\nSELECT d.doc_id, coalesce(high, 0) AS high, coalesce(low, 0) AS low FROM documents d LEFT JOIN prints USING (doc_id)",
    "relevance_excerpts": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no
  FROM documents),
terms AS (
  SELECT *, list_has_any(list_transform(list_filter(regexp_split_to_array(lower(line), '[^a-z0-9_]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})),
    lambda w: {_STEMMED}), [{_TERM_LIST}]) AS hit FROM lines),
near AS (SELECT *, hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS chosen, count(*) OVER (PARTITION BY doc_id) AS n FROM terms WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
gaps AS (SELECT *, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM near WHERE chosen),
made AS (
  SELECT doc_id, (CASE WHEN min(line_no) > 0 THEN '…' || chr(10) ELSE '' END)
         || string_agg(CASE WHEN before IS NOT NULL AND line_no > before + 1 THEN ' … ' || chr(10) ELSE '' END || line, chr(10) ORDER BY line_no)
         || (CASE WHEN max(line_no) < any_value(n) - 1 THEN chr(10) || '…' ELSE '' END) AS excerpt, count(*) AS n_selected, any_value(n) AS n
  FROM gaps GROUP BY doc_id),
sized AS (SELECT *, {sql_estimate("excerpt")} > 400 AS over FROM made)
SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN s.doc_id IS NULL THEN d.text WHEN over THEN '' ELSE excerpt END AS excerpt,
       coalesce(n_selected, 0)::INT AS n_selected, coalesce(over OR n_selected < n, false) AS truncated
FROM documents d LEFT JOIN sized s USING (doc_id)""",
}


def _one_request(budget: int, tokens: str, recount: str) -> str:
    """CTEs ``turns`` and ``steps`` of a fold over all ``items`` (doc_id, text) in one request."""
    step = ORACLES["conversation_budgets"].replace("400.0::DOUBLE AS rest", f"{budget}.0::DOUBLE AS rest").replace(sql_estimate("cut"), recount)
    step = step[step.index("steps AS (") : step.rindex("SELECT conv_id, turn")]
    return f"""turns AS (
  SELECT 0 AS conv_id, doc_id AS turn, text, {tokens}::DOUBLE AS tokens, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM items),
{step.rstrip()}"""


def _reduction(excerpts: str) -> str:
    """CTEs of a whole reduction to 64,000 tokens in one request: ``sums``, one row. The tables hold no source code, so nothing is cut to declarations."""
    return f"""
WITH RECURSIVE red AS (SELECT doc_id, regexp_replace(text, '{_ASSIGNED}', '\\1[REDACTED]', 'g') AS text FROM documents),
verdicts AS ({ORACLES["near_duplicates"].replace("FROM documents", "FROM red")}),
kept AS (SELECT red.* FROM red JOIN verdicts ON CAST(doc_id AS VARCHAR) = id WHERE verdict = 'kept'),
picked AS ({excerpts}),
items AS (SELECT doc_id, CASE WHEN excerpt = '' THEN text ELSE excerpt END AS text FROM kept JOIN picked ON CAST(doc_id AS VARCHAR) = picked.id),
{_one_request(64000, sql_estimate(), sql_estimate("cut"))},
sums AS (
  SELECT (SELECT sum({sql_estimate()}) FROM documents)::DOUBLE AS t0, (SELECT sum({sql_estimate()}) FROM red)::DOUBLE AS t1, (SELECT sum({sql_estimate()}) FROM kept)::DOUBLE AS t2,
         (SELECT sum(tokens) FROM turns)::DOUBLE AS t3, (SELECT sum(allocated) FROM steps)::DOUBLE AS spent, (SELECT count(*) FROM verdicts WHERE verdict <> 'kept')::DOUBLE AS removed,
         (SELECT sum(n_selected) FROM picked)::DOUBLE AS selected, (SELECT count(*) FROM ({ORACLES["secret_findings"]}))::DOUBLE AS found)"""


_QUARTERS = "ceil(length(coalesce({}, '')) / 4.0::DOUBLE)"
ORACLES["document_budgets"] = f"""
WITH RECURSIVE items AS (SELECT doc_id, text FROM documents),
{_one_request(64000, _QUARTERS.format("text"), _QUARTERS.format("cut"))}
SELECT CAST(turn AS VARCHAR) AS id, tokens, status, allocated::DOUBLE AS allocated, reason FROM steps WHERE place > 0"""
ORACLES["page_line_classes"] = "SELECT page_id, count(*) AS n_lines, " + ", ".join(f"count(*) FILTER (regexp_matches(line, '^(?:{'|'.join(p)})')) AS {name}" for name, p in LINE_CLASSES.items()) + r"""
FROM (SELECT page_id, unnest(string_split(regexp_replace(html, '([>;{}])', '\1' || chr(10), 'g'), chr(10))) AS line FROM pages) GROUP BY page_id"""
_UNPICKED = "SELECT CAST(doc_id AS VARCHAR) AS id, text AS excerpt, 0 AS n_selected FROM kept"
ORACLES["reduce_context_totals"] = f"""{_reduction(_UNPICKED)}
SELECT t0 AS tokens_in, spent AS tokens_out, t0 - spent AS saved, CASE WHEN t0 > 0 THEN 1 - spent / t0 ELSE 0 END AS reduction, 'estimated' AS counter, 64000.0::DOUBLE AS budget, spent / 64000 AS utilization FROM sums"""
ORACLES["reduce_context_trace"] = f"""{_reduction(ORACLES["relevance_excerpts"].replace("FROM documents", "FROM kept").replace("> 400 AS over", "> 32000 AS over"))}
SELECT 'secrets' AS stage, t0 AS tokens_before, t1 AS tokens_after, 0.0::DOUBLE AS saved, NULL::DOUBLE AS removed, NULL::DOUBLE AS selected, found AS findings FROM sums WHERE t0 <> t1 OR found > 0
UNION ALL SELECT 'dedupe', t1, t2, t1 - t2, removed, NULL, NULL FROM sums WHERE removed > 0
UNION ALL SELECT 'relevance', t2, t3, t2 - t3, NULL, selected, NULL FROM sums
UNION ALL SELECT 'budget', t3, spent, t3 - spent, NULL, NULL, NULL FROM sums"""
