"""Fitting items into a token budget, by request group."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow_spark.functions.tokens import Counter, estimate_tokens
from winnow_spark.operators.ordering import numbered
from winnow_spark.session import cut_lineage

CEILING, MIN_TOKENS = 0.25, 1
#: Rows of a group that are folded at a time; Spark ranks so few before it shuffles.
FOLD_ROWS = 1000
OUT_OF_BUDGET = "out of budget"
# Fixed values.
PRESETS = {"small": 4_000, "medium": 16_000, "large": 64_000, "xl": 256_000}
CHARS_PER_TOKEN, MARKER = 4, "\n… [truncated]"
_symbol, _blanks = re.compile(r"[^\w\s]", re.ASCII), re.compile(r"[ \t]{2,}")


def resolve_budget(value: object = None) -> float:
    """None is 16,000; a positive number is itself; a preset's name; else leading digits."""
    if value is None:
        return PRESETS["medium"]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        number = value
    elif str(value).lower() in PRESETS:
        return PRESETS[str(value).lower()]
    else:
        digits = re.match(r"\s*\d+", str(value))
        number = int(digits[0]) if digits else 0
    if not (number > 0 and math.isfinite(number)):
        raise ValueError(f"not a budget: {value!r}")
    return number


def estimate(text: str | None) -> int:
    if not text:
        return 0
    return max(1, math.ceil(len(text) / 4 + len(_symbol.findall(text)) * 0.25 - len(_blanks.findall(text)) * 0.1))


def truncate(text: str, limit: float) -> str:
    if estimate(text) <= limit:
        return text
    target = max(1, max(1, math.floor(limit * CHARS_PER_TOKEN)) - estimate(MARKER) * CHARS_PER_TOKEN)
    cut = text[:target]
    newline = cut.rfind("\n", math.floor(target * 0.8))
    return (cut[: newline + 1] if newline >= 0 else cut) + MARKER


def split_budget(items: DataFrame, budget: float, ceiling: float = CEILING) -> DataFrame:
    """``items`` (ord, tokens) with ``share``: an even split, the rest one each to those least short of their need."""
    count = items.count()
    per = max(1, math.floor(budget / count)) if count else 1
    spare = math.ceil(budget - per * count)
    out = items.withColumn("share", F.lit(per).cast("long"))
    if spare <= 0 or math.floor(budget * ceiling) <= 0:
        return out
    short = items.where(F.col("tokens") > per).select("ord", (F.col("tokens") - per).alias("short"))
    turns = numbered(short, F.col("short"), F.col("ord"), name="turn").where(F.col("turn") <= spare).select("ord", F.lit(1).alias("extra"))
    return out.join(turns, "ord", "left").withColumn("share", F.col("share") + F.coalesce("extra", F.lit(0))).select(*out.columns)


def _fold(budget: float, ceiling: float, min_tokens: float, trimmable: bool, recount: Callable[[str], float]):
    """The greedy fold over a group's next rows, in order; a row's ``left`` is what remains after it."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn").reset_index(drop=True)
        left, out = float(rows["left"].iloc[0]), []
        for text, own, tokens, is_last in zip(rows["text"], rows["own"], rows["tokens"], rows["is_last"]):
            has_text = trimmable and isinstance(text, str)
            if left < min_tokens:
                out.append(("dropped", None, None, OUT_OF_BUDGET, left))
                continue
            reserve = left * (1 - ceiling) if not is_last and has_text else 0.0
            allowance = max(min_tokens, min(left - reserve, tokens))
            if tokens <= allowance:
                left -= tokens
                out.append(("kept", float(tokens), None, None, left))
            elif has_text:
                limit = min(allowance, left)
                cut = None if own <= limit else truncate(text, limit)
                cost = float(recount(text if cut is None else cut))
                if cost < min_tokens:
                    out.append(("dropped", None, None, "truncation too small to be useful", left))
                else:
                    left -= cost
                    out.append(("truncated", cost, cut, None, left))
            else:
                out.append(("dropped", None, None, "does not fit and is not truncatable", left))
        done = pd.DataFrame(out, columns=["status", "allocated", "cut", "reason", "left"], dtype=object)
        done[["allocated", "left"]] = done[["allocated", "left"]].astype(float)
        return pd.concat([rows[["key", "ord"]], done], axis=1)

    return fold


def allocate(items: DataFrame, budget: float, group: str | None = None, ceiling: float = CEILING, min_tokens: float = MIN_TOKENS, trimmable: bool = True, recount: Callable[[str], float] = estimate) -> DataFrame:
    """``items`` (ord, id, text, tokens, priority) with status, allocated, out_text and reason.

    A greedy fold in order of priority (then ``ord``): an item but the last may
    take at most ``ceiling`` of what remains. The fold is sequential by group (a
    request), but ends when the budget is spent, so it takes the first
    ``FOLD_ROWS`` rows of each group at a time: a task that ranks them keeps no
    more than that of a group, only they meet their texts (as much of them as the
    budget could hold), and all later rows are marked without a fold. What a
    truncated text costs is counted by ``recount``.
    """
    if not (budget > 0 and math.isfinite(budget)):
        raise ValueError("a budget is finite and above 0")
    key = F.col(group) if group else F.lit(0)
    base = items.select(key.alias("key"), "ord", F.col("id").cast("string").alias("id"), "text", F.col("tokens").cast("double").alias("tokens"), F.coalesce(F.col("priority").cast("double"), F.lit(0.0)).alias("priority"))
    base = base.withColumn("at", F.struct((-F.col("priority")).alias("p"), F.col("ord").alias("o")))
    slim = cut_lineage(base.select("key", "ord", "tokens", "at"))
    lasts = slim.groupBy("key").agg(F.max("at").alias("last"))
    kind = {f.name: f.dataType.simpleString() for f in slim.schema}
    schema = f"key {kind['key']}, ord {kind['ord']}, status string, allocated double, cut string, reason string, left double"
    texts = base.select("key", "ord", F.substring("text", 1, int(min(budget * CHARS_PER_TOKEN + 1, 2**31 - 1))).alias("text"), estimate_tokens(F.col("text")).alias("own"))
    waiting, spent, parts = slim.where("tokens > 0").withColumn("left", F.lit(float(budget))), None, []
    while True:
        turn = F.row_number().over(Window.partitionBy("key").orderBy("at"))
        batch = waiting.withColumn("turn", turn).where(F.col("turn") <= FOLD_ROWS).join(lasts, "key").withColumn("is_last", F.col("at") == F.col("last"))
        batch = batch.drop("last").join(texts, ["key", "ord"])
        now = batch.groupBy("key").applyInPandas(_fold(budget, ceiling, min_tokens, trimmable, recount), schema).join(slim.select("key", "ord", "at"), ["key", "ord"])
        parts.append(cut_lineage(now))
        ends = parts[-1].groupBy("key").agg(F.max("at").alias("upto"), F.min("left").alias("left"), F.count("*").alias("rows"), F.min(F.when(F.col("left") < min_tokens, F.col("at"))).alias("spent_at"))
        ends = ends.withColumn("going", (F.col("rows") >= FOLD_ROWS) & (F.col("left") >= min_tokens))
        spent = cut_lineage(ends if spent is None else spent.join(ends.select("key"), "key", "left_anti").withColumn("going", F.lit(False)).unionByName(ends))
        if not spent.where("going").head(1):
            break
        waiting = slim.where("tokens > 0").join(spent.where("going").select("key", "upto", "left"), "key").where(F.col("at") > F.col("upto")).drop("upto")
        if len(parts) > 20:
            parts = [cut_lineage(reduce(DataFrame.unionByName, parts))]
    folded = reduce(DataFrame.unionByName, parts)
    out = base.join(folded.drop("at", "left"), ["key", "ord"], "left").join(spent.select("key", "spent_at"), "key", "left")
    # Items of no cost are kept until the budget is spent; what was not folded comes after that.
    free = F.col("status").isNull() & (F.col("tokens") <= 0) & (F.col("spent_at").isNull() | (F.col("at") < F.col("spent_at")))
    status = F.coalesce("status", F.when(free, "kept").otherwise("dropped"))
    out_text = F.when(F.col("status") == "truncated", F.coalesce("cut", "text")).when((F.col("status") == "kept") | free, F.col("text"))
    done = out.select("key", "ord", "id", "tokens", status.alias("status"), F.when(free, F.lit(0.0)).otherwise(F.col("allocated")).alias("allocated"), out_text.alias("out_text"), F.when(F.col("status").isNull() & ~free, F.lit(OUT_OF_BUDGET)).otherwise(F.col("reason")).alias("reason"))
    return done.withColumnRenamed("key", group) if group else done.drop("key")


def quarter_characters(text: str) -> int:
    return math.ceil(len(text) / CHARS_PER_TOKEN)


def allocate_documents(docs: DataFrame, budget: float, counter: Counter | None = None, recount: Callable[[str], float] = quarter_characters, ceiling: float = CEILING, min_tokens: float = MIN_TOKENS) -> DataFrame:
    """:func:`allocate` for docs (ord, id, text, optional tokens and priority): tokens that are given win over counted ones.

    Other columns are carried. Without a counter, a token is a quarter of a
    character; ``recount`` is the counter for what is truncated.
    """
    counted = counter(F.col("text")) if counter else F.ceil(F.length("text") / CHARS_PER_TOKEN)
    counted = F.coalesce(counted, F.lit(0)).cast("double")
    tokens = F.coalesce(F.col("tokens").cast("double"), counted) if "tokens" in docs.columns else counted
    priority = F.col("priority") if "priority" in docs.columns else F.lit(0.0)
    items = cut_lineage(docs.withColumn("tokens", tokens).withColumn("priority", priority))
    done = allocate(items.select("ord", "id", "text", "tokens", "priority"), budget, ceiling=ceiling, min_tokens=min_tokens, recount=recount)
    more = [c for c in docs.columns if c not in ("ord", "id", "text", "tokens", "priority")]
    return done.join(items.select("ord", *more), "ord") if more else done
