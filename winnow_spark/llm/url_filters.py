"""URL filters: a trie over reversed host labels, then path segments.

Rules are compiled once into a :class:`UrlTrie`, broadcast, and walked once per
url. Of all rules that fit, the longest wins, whether it allows or blocks.
Rules of more than ``MAX_RULE_BYTES`` are not broadcast but joined with the
distinct (host, path) pairs, on the suffixes of hosts and those beginnings of
paths that are as long as some rule's path (:func:`judge_by_join`).

Defined results for odd input:

* null url, or one without ``://``: host and path are empty strings; no rule
  can fit, so the default verdict holds and ``rule`` is null;
* empty host or path: only rules that fit the empty string;
* the same rule given twice: counted once; given as allow *and* block: block;
* equally long rules that fit one url: the longer host, then block, wins;
* repeated rows: each is judged by itself; an empty table gives an empty one;
* extra columns of the input are carried through by :func:`judge_urls`, except
  that its own outputs replace columns of the same name.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.llm.workers import beside, others, quoted, unused
from winnow_spark.session import read_table

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of rules that are broadcast at most; as a trie they take some ten times that.
MAX_RULE_BYTES = 20_000_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def checked(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    rules = list(rules)
    for verdict, _ in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a rule's verdict is {ALLOW!r} or {BLOCK!r}, not {verdict!r}")
    return rules


class UrlTrie:
    """Rules ``(verdict, "host/path")`` as nested nodes.

    A node is ``[labels, segments, tails, sizes]``: children by host label,
    children by whole path segment, the rules that end here by the unfinished
    last segment of their path, and the sizes of these, so that a segment is
    looked up once a size and not compared with each rule.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: list = [{}, {}, {}, []]
        for verdict, rule in checked(rules):
            self._add(verdict, rule)

    def _add(self, verdict: str, rule: str) -> None:
        host, slash, rest = rule.partition("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node[0].setdefault(label, [{}, {}, {}, []])
        *whole, tail = (slash + rest).split("/")
        for segment in whole:
            node = node[1].setdefault(segment, [{}, {}, {}, []])
        rank = (len(rule), len(host), verdict == BLOCK)
        if len(tail) not in node[3]:
            insort(node[3], len(tail))
        if tail not in node[2] or rank > node[2][tail][0]:
            node[2][tail] = (rank, rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning ``(rule, verdict)``, or None."""
        best, segments, node = None, path.split("/"), self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            inner = node
            for segment in segments:
                for size in inner[3]:
                    if size > len(segment):
                        break
                    entry = inner[2].get(segment[:size])
                    if entry and (best is None or entry[0] > best[0]):
                        best = entry
                inner = inner[1].get(segment)
                if inner is None:
                    break
        return best and best[1:]


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", default: str = ALLOW) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` of each url. No shuffle, but for very many rules."""
    rules = checked(rules)
    if sum(len(rule) for _, rule in rules) > MAX_RULE_BYTES:
        return judge_by_join(df, df.sparkSession.createDataFrame(rules, "verdict string, rule string"), url, default)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find, none = trie.value.find, (None, default)
        for hosts, paths in batches:
            found = [(h, p, *(find(h, p) or none)) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=own, dtype=object)

    own = ["host", "path", "rule", "verdict"]
    whole = F.col(quoted(url))
    return beside(df, judged(url_host(whole), url_path(whole)), own)


def judge_by_join(df: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """:func:`judge_urls` for rules (verdict, rule) of any number."""
    host, path = F.substring_index("rule", "/", 1), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    rank = F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), (F.col("verdict") == BLOCK).alias("blocks"), "rule")
    split = rules.select("rule", "verdict", host.alias("rule_host"), path.alias("rule_path"))
    known = split.groupBy("rule_host", "rule_path").agg(F.max(rank).alias("rank"))
    sizes = [r["n"] for r in split.select(F.length("rule_path").alias("n")).distinct().collect()]  # at most as many as a path has characters
    whole = F.col(quoted(url))
    pairs = df.select(url_host(whole).alias("host"), url_path(whole).alias("path")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    begun = F.transform(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    places = pairs.select("host", "path", F.explode(suffixes).alias("rule_host")).select("host", "path", "rule_host", F.explode(begun).alias("rule_path"))
    best = places.join(known, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max("rank").alias("best"))
    found, keep = unused(df, "found"), others(df, ["host", "path", "rule", "verdict"])
    held = df.select(*[F.col(quoted(c)) for c in keep], F.struct(url_host(whole).alias("host"), url_path(whole).alias("path")).alias(found))
    best = best.select(F.struct("host", "path").alias("of"), F.col("best.rule").alias("rule"), F.when(F.col("best.blocks"), BLOCK).otherwise(ALLOW).alias("verdict"))
    out = held.join(best, F.col(found) == F.col("of"), "left")
    return out.select(*[F.col(quoted(c)) for c in keep], F.col(f"{found}.host"), F.col(f"{found}.path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules(verdict, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
ranked AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.verdict
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
  QUALIFY row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked
"""
