"""Nested configuration documents as rows: (doc, path, value) with JSON values; arrays are leaves."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?(?:\*/|$)', re.S)
_comma = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)


def _number(text: str) -> int | float:
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 2**53 else value  # 1.0 is 1


def parse_jsonc(text: str | None) -> object:
    """JSON with comments and trailing commas; blank text is an empty object."""
    bare = _token.sub(lambda m: m[0] if m[0][0] == '"' else "\n" * m[0].count("\n"), text or "")
    bare = _comma.sub(lambda m: m[0] if m[0][0] == '"' else "", bare)
    return json.loads(bare, parse_float=_number) if bare.strip() else {}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def leaves(value: object, prefix: str = "") -> list[tuple[str, str]]:
    if isinstance(value, dict):
        return [leaf for k, v in value.items() for leaf in leaves(v, f"{prefix}.{k}" if prefix else k)]
    return [(prefix, canonical(value))] if prefix else []


def _by_text(texts: pd.Series, made: Callable[[object], object]) -> pd.Series:
    """``made`` of each parsed text; null where a text is no JSON."""
    out = []
    for text in texts:
        try:
            out.append(made(parse_jsonc(text)))
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)


def flatten(docs: DataFrame) -> DataFrame:
    """doc, path, value of docs (doc, json); empty objects vanish.

    A document that is no JSON has no rows here; :func:`unreadable` lists it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, p, v) for d, found in zip(batch["doc"], _by_text(batch["json"], leaves)) for p, v in found or ()]
            yield pd.DataFrame(rows, columns=["doc", "path", "value"], dtype=object)

    return docs.select("doc", "json").mapInPandas(run, "doc string, path string, value string")


def unreadable(docs: DataFrame) -> DataFrame:
    """doc of the docs (doc, json) that are no JSON, even with comments and trailing commas."""
    return docs.where(~canonical_json(F.col("json")).isNotNull()).select("doc")


def canonical_json(text: Column) -> Column:
    """One spelling for equal values, whatever the order of keys; null where a text is no JSON."""
    return F.pandas_udf(lambda texts: _by_text(texts, canonical), "string")(text)


def deep_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold equal values; arrays keep their order, objects need not."""
    return F.coalesce(canonical_json(a) == canonical_json(b), F.lit(False))


def get_path(text: Column, path: str) -> Column:
    """The value at a dotted path, as JSON; null where there is none."""

    def got(value: object) -> str | None:
        for part in path.split("."):
            if not isinstance(value, dict) or part not in value:
                return None
            value = value[part]
        return canonical(value)

    return F.pandas_udf(lambda texts: _by_text(texts, got), "string")(text)


def rebuild(rows: DataFrame) -> DataFrame:
    """doc, json: the nested document of each doc's rows, two spaces a level and a newline at its end."""

    def nested(paths: pd.Series, values: pd.Series) -> str:
        out: dict = {}
        for path, value in sorted(zip(paths, values)):
            *above, last = path.split(".")
            node = out
            for part in above:
                node = node.setdefault(part, {})
            node[last] = json.loads(value)
        return json.dumps(out, indent=2, ensure_ascii=False) + "\n"

    kind = rows.schema["doc"].dataType.simpleString()
    made = lambda key, part: pd.DataFrame({"doc": [key[0]], "json": [nested(part["path"], part["value"])]})
    return rows.groupBy("doc").applyInPandas(made, f"doc {kind}, json string")


def read_configs(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """doc (the path), json of configuration files; a missing one is an empty object, one that is no JSON an error."""
    found = []
    for path in paths:  # a few, on the driver
        text = "{}"
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                text = file.read()
            try:
                parse_jsonc(text)
            except ValueError as bad:
                raise ValueError(f"{path!r} is no JSON: {bad}") from bad
        found.append((path, text))
    return spark.createDataFrame(found, "doc string, json string")


def deep_merge(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Rows (doc, path, value): the patch's, and those of the base that no patch path equals, contains or lies under."""
    above = lambda path: F.transform(F.sequence(F.lit(1), F.size(F.split(path, r"\."))), lambda i: F.array_join(F.slice(F.split(path, r"\."), F.lit(1), i), "."))
    under = base.select("doc", "path", F.explode(above(F.col("path"))).alias("at")).join(patch.select("doc", F.col("path").alias("at")), ["doc", "at"]).select("doc", "path")
    over = base.join(patch.select("doc", F.explode(above(F.col("path"))).alias("path")), ["doc", "path"], "left_semi").select("doc", "path")
    return base.join(under.unionByName(over), ["doc", "path"], "left_anti").select("doc", "path", "value").unionByName(patch.select("doc", "path", "value"))


def diff_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc, path, from_value, to_value, change of all paths that differ."""
    a = before.select("doc", "path", F.col("value").alias("from_value"), F.lit(True).alias("had"))
    b = after.select("doc", "path", F.col("value").alias("to_value"), F.lit(True).alias("has"))
    both = a.join(b, ["doc", "path"], "full_outer")
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("from_value").eqNullSafe(F.col("to_value")) | F.col("had").isNull() | F.col("has").isNull()).select("doc", "path", "from_value", "to_value", change.alias("change"))


def apply_config(base: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after the patch, what it changes); nothing is written."""
    after = deep_merge(base, patch)
    return after, diff_paths(base, after)


def remove_keys(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Rows without ``paths`` and all below them; objects so emptied vanish of themselves."""
    gone = F.lit(False)
    for path in paths:
        gone |= (F.col("path") == path) | F.col("path").startswith(f"{path}.")
    return rows.where(~gone)


def remove_from_arrays(rows: DataFrame, drops: dict[str, Callable[[object], bool]]) -> DataFrame:
    """Rows whose arrays at the paths of ``drops`` have lost the entries that its function is true for; emptied arrays go.

    Other values at these paths, and arrays that lose nothing, stay as they are.
    """

    @F.pandas_udf("string")
    def kept(paths: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for path, value in zip(paths, values):
            held = json.loads(value)
            left = [v for v in held if not drops[path](v)] if isinstance(held, list) else held
            out.append(value if left == held else canonical(left) if left else None)
        return pd.Series(out, dtype=object)

    asked = F.col("path").isin(list(drops))
    changed = rows.where(asked).withColumn("value", kept("path", "value")).where(F.col("value").isNotNull())
    return rows.where(~asked).unionByName(changed)


def remove_from_array(rows: DataFrame, key: str, drop: Callable[[object], bool]) -> tuple[DataFrame, DataFrame]:
    """(rows after, changes): entries removed from one top-level array."""
    after = remove_from_arrays(rows, {key: drop})
    return after, diff_paths(rows, after)


def surgical_remove(rows: DataFrame, paths: list[str], drops: dict[str, Callable[[object], bool]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows after, changes): array entries by ``drops``, then whole ``paths``."""
    after = remove_keys(remove_from_arrays(rows, drops) if drops else rows, paths)
    return after, diff_paths(rows, after)


def status(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """A row for each doc: ``active`` if it has any of the paths ``owned`` (path) or what is below them, and these ``values``."""
    mine = owned.select(F.col("path").alias("own")).distinct()
    held = rows.join(F.broadcast(mine), (F.col("path") == F.col("own")) | F.col("path").startswith(F.concat("own", F.lit("."))), "left")
    found = F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("path", "value"))))
    return held.groupBy("doc").agg(F.map_from_entries(F.array_distinct(found)).alias("values")).select("doc", (F.size("values") > 0).alias("active"), "values")


def pick(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Rows whose path is one of ``owned`` (path)."""
    return rows.join(owned.select("path").distinct(), "path", "left_semi").select("doc", "path", "value")


def format_cell(value: Column) -> Column:
    """A missing value is ``-``; a string stands without its quotes, any other value as JSON."""
    plain = F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    return F.coalesce(plain, F.lit("-"))


def format_percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def explain(rows: DataFrame, docs: list[str]) -> DataFrame:
    """One row a path, one column a doc; ``-`` where a doc lacks it."""
    wide = rows.groupBy("path").pivot("doc", docs).agg(F.first("value"))
    return wide.select("path", *[format_cell(F.col(f"`{d}`")).alias(d) for d in docs]).orderBy("path")


def prepend_if_absent(values: Column, value: str) -> Column:
    held = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(F.array_contains(held, value), held).otherwise(F.array_prepend(held, F.lit(value)))


def resolve(requested: str | None, known: Sequence[str], default: str, what: str) -> str:
    """``requested`` or the default; an unknown name is an error that lists the known ones."""
    if requested and requested not in known:
        raise ValueError(f"unknown {what} {requested!r}: known are {', '.join(known)}")
    return requested or default


def resolve_many(requested: Sequence[str] | None, known: Sequence[str], what: str) -> list[str]:
    """Those asked for in their order; all if none or ``all`` is asked for."""
    if not requested or "all" in requested:
        return list(known)
    return [resolve(name, known, "", what) for name in requested]


def rules_for(df: DataFrame, rules: DataFrame, profile: str = "profile", default: str = "deep") -> DataFrame:
    """``df`` with the ``rule`` (of rules: profile, rule) of its profile, or of the default one."""
    known = rules.select(F.col("profile").alias("_profile"), "rule")
    fallback = rules.where(F.col("profile") == default).select(F.col("rule").alias("_default"))
    joined = df.join(F.broadcast(known), F.col(profile) == F.col("_profile"), "left").join(F.broadcast(fallback), F.lit(True), "left")
    return joined.withColumn("rule", F.coalesce("rule", "_default")).drop("_profile", "_default")


def display_path(path: Column, home: str) -> Column:
    """With ``~`` for the home folder."""
    return F.when(path.startswith(home), F.concat(F.lit("~"), F.replace(F.substring(path, F.lit(len(home) + 1), F.length(path)), F.lit("\\"), F.lit("/")))).otherwise(path)


def rule_text(profile: Column, body: Column) -> Column:
    """A rule file: front matter with its activation (``always_on`` for balanced, else ``manual``), a blank line, the body."""
    mode = F.when(profile == "balanced", "always_on").otherwise("manual")
    return F.concat(F.lit("---\ntrigger: "), mode, F.lit("\n---\n\n"), F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit("\n"))


def read_mode(text: Column) -> Column:
    """The activation named in the first 400 characters; null if there is none."""
    found = F.regexp_extract(F.substring(text, 1, 400), r"trigger:\s*(\w+)", 1)
    return F.when(found != "", found)


BEGIN, END = "<!-- winnow:begin -->", "<!-- winnow:end -->"


def _around_block(text: Column) -> tuple[Column, Column, Column]:
    """Whether ``text`` has a block, and what stands before and after it."""
    start, end = F.instr(text, BEGIN), F.instr(text, END)
    after = F.substring(text, end + len(END), F.length(text))
    return (start > 0) & (end > start), F.substring(text, F.lit(1), start - 1), after


def _fewer_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def remove_block(text: Column) -> Column:
    """Text without its managed block, three or more newlines made two; null if nothing else was in it. Other text is unchanged."""
    held = F.coalesce(text, F.lit(""))
    has, before, after = _around_block(held)
    rest = _fewer_newlines(F.concat(before, after))
    return F.when(has, F.when(F.regexp_replace(rest, r"\s+", "") != "", rest)).otherwise(text)


def upsert_block(text: Column, body: Column) -> Column:
    """Text with ``body`` in its managed block: where the block is, else at the end."""
    held = F.coalesce(text, F.lit(""))
    has, before, after = _around_block(held)
    block = F.concat(F.lit(f"{BEGIN}\n"), F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(f"\n{END}"))
    rest = F.regexp_replace(held, r"\s+$", "")
    appended = F.when(rest == "", F.concat(block, F.lit("\n"))).otherwise(F.concat(rest, F.lit("\n\n"), block, F.lit("\n")))
    return F.when(has, _fewer_newlines(F.concat(before, block, after))).otherwise(appended)
