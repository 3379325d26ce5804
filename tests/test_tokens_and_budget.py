import time

import pytest
from pyspark.sql import functions as F

from winnow_spark.functions.tokens import chunk_to_tokens, count_tokens, estimate_tokens, truncate_to_tokens
from winnow_spark.operators.budget import allocate, estimate, resolve_budget, split_budget


def test_estimate(spark):
    texts = ["", None, "a", "if (x) { y[0] += z->w; }", "a  b\t\tc", "word " * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", estimate_tokens(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [estimate(t) for t in texts]
    assert rows[0]["n"] == rows[1]["n"] == 0 and rows[2]["n"] == 1 and rows[3]["n"] > len(texts[3]) / 4


def test_counter_is_a_function(spark):
    with pytest.raises(TypeError):
        count_tokens(F.lit("x"), counter=3)


def test_truncate(spark):
    long = "\n".join(f"line {i}" for i in range(200))
    rows = spark.createDataFrame([(long,), ("short",), ("",)], "t string").select(truncate_to_tokens(F.col("t"), 50).alias("c"), estimate_tokens(truncate_to_tokens(F.col("t"), 50)).alias("n")).collect()
    assert rows[0]["c"].endswith("[truncated]") and rows[0]["n"] <= 50 and "\n\n… [truncated]" in rows[0]["c"]
    assert [r["c"] for r in rows[1:]] == ["short", ""]


def test_chunk(spark):
    text = "\n".join(f"some line {i}" for i in range(60))
    rows = spark.createDataFrame([(text,), ("fits",), ("",)], "t string").select(chunk_to_tokens(F.col("t"), 20).alias("c")).collect()
    assert len(rows[0]["c"]) > 1 and "\n".join(rows[0]["c"]) == text and all(estimate(c) <= 20 for c in rows[0]["c"])
    assert rows[1]["c"] == ["fits"] and rows[2]["c"] == []


def test_chunk_measures_a_line_once(spark):
    """One chunk of very many lines: measuring the chunk again for every line took minutes."""
    text = "\n".join(f"{i}; x" for i in range(30_000))
    begun = time.monotonic()
    rows = spark.createDataFrame([(text,)], "t string").repartition(2).select(chunk_to_tokens(F.col("t"), estimate(text) - 1).alias("c")).collect()
    assert "\n".join(rows[0]["c"]) == text and len(rows[0]["c"]) == 2 and time.monotonic() - begun < 30


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_chunks_by_estimate_and_by_counter(spark, limit):
    """The estimate as a counter takes the way on which nothing adds up; both give the same chunks."""
    texts = [None, "", "\n", "\n\n a", "\u00e9\U0001f600;\t\tx\n\n  b, c.\r\nword word word word\n", "a\n" * 9, "long line " * 9 + "\n;\n;\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunk_to_tokens(F.col("t"), limit).alias("c"), chunk_to_tokens(F.col("t"), limit, counter=estimate_tokens).alias("d")).collect()
    assert all(r["c"] == r["d"] and "\n".join(r["c"]) == (r["t"] or "") for r in rows)


@pytest.mark.parametrize("value,expected", [(None, 16000), ("LARGE", 64000), ("12abc", 12), (5, 5)])
def test_resolve(value, expected):
    assert resolve_budget(value) == expected


@pytest.mark.parametrize("value", ["none", 0, -1, float("inf")])
def test_resolve_refuses(value):
    with pytest.raises(ValueError):
        resolve_budget(value)


def items(spark, rows):
    return spark.createDataFrame(rows, "ord long, id string, text string, tokens double, priority double")


def test_split(spark):
    shares = lambda rows, b: [r["share"] for r in split_budget(items(spark, rows), b).orderBy("ord").collect()]
    three = [(i, str(i), None, 10.0, 0.0) for i in range(3)]
    assert sum(shares(three, 30)) == 30 and all(s >= 1 for s in shares(three, 0)) and shares([], 10) == []
    few = shares([(0, "a", None, 100.0, 0.0), (1, "b", None, 3.0, 0.0)], 10)
    assert few[1] >= 1 and sum(few) <= 11


def test_allocate(spark):
    run = lambda rows, b, **o: {r["id"]: r for r in allocate(items(spark, rows), b, **o).collect()}
    two = run([(0, "low", None, 50.0, 0.0), (1, "high", None, 50.0, 9.0)], 60)
    assert two["high"]["status"] == "kept" and two["low"]["status"] == "dropped"
    assert run([(0, "a", "word " * 400, 500.0, 0.0)], 100)["a"]["status"] == "truncated"
    assert run([(0, "a", None, 500.0, 0.0)], 10)["a"]["reason"] == "does not fit and is not truncatable"
    assert run([(0, "a", "x" * 4000, 1000.0, 0.0)], 1000)["a"]["status"] == "kept"
    both = [(0, "a", "word " * 100, 125.0, 0.0), (1, "b", "word " * 100, 125.0, 0.0)]
    assert run(both, 200, ceiling=0.9)["a"]["allocated"] > run(both, 200, ceiling=0.05)["a"]["allocated"]
    with pytest.raises(ValueError):
        allocate(items(spark, both), 0)


def plain_fold(rows, budget, ceiling=0.25, least=1, trimmable=True):
    """The allocation of one request, row by row."""
    from winnow_spark.operators.budget import truncate

    rows, left, out = sorted(rows, key=lambda r: (-(r[4] or 0.0), r[0])), float(budget), {}
    for k, (place, _, text, tokens, _) in enumerate(rows):
        has_text = trimmable and text is not None
        allowance = max(least, min(left - (left * (1 - ceiling) if k < len(rows) - 1 and has_text else 0), tokens))
        if left < least:
            out[place] = ("dropped", None, None, "out of budget")
        elif tokens <= allowance:
            out[place], left = ("kept", tokens, text, None), left - tokens
        elif has_text:
            cut = truncate(text, min(allowance, left))
            out[place], left = ("truncated", float(estimate(cut)), cut, None), left - estimate(cut)
        else:
            out[place] = ("dropped", None, None, "does not fit and is not truncatable")
    return out


@pytest.mark.parametrize("seed,budget,most", [(1, 60, 3), (2, 400, 20), (3, 3000, 50)])
def test_allocate_in_portions(spark, monkeypatch, seed, budget, most):
    """Few rows folded at a time, by several requests: as one fold of all rows. Ties, no text, no tokens, no priority."""
    import random

    from winnow_spark.operators import budget as module

    monkeypatch.setattr(module, "FOLD_ROWS", most)
    draw, rows = random.Random(seed), []
    for k in range(120):
        text = None if draw.random() < 0.1 else "\n".join("word " * draw.randrange(1, 9) for _ in range(draw.randrange(0, 9)))
        tokens = float(estimate(text)) if text is not None else float(draw.randrange(0, 30))
        rows.append((k, str(k), text, tokens, draw.choice([None, 0.0, 1.0, 2.5])))
    got = {r["ord"]: (r["status"], r["allocated"], r["out_text"], r["reason"]) for r in allocate(items(spark, rows), budget).collect()}
    assert got == plain_fold(rows, budget)
    grouped = items(spark, rows).withColumn("req", F.col("ord") % 3)
    got = {r["ord"]: (r["status"], r["allocated"], r["out_text"], r["reason"]) for r in allocate(grouped, budget, group="req").collect()}
    assert got == {k: v for g in range(3) for k, v in plain_fold([r for r in rows if r[0] % 3 == g], budget).items()}
    assert allocate(items(spark, rows).where("false"), budget).count() == 0


def test_allocate_documents(spark):
    from winnow_spark.operators.budget import allocate_documents

    docs = spark.createDataFrame([(0, "a", "x" * 40, "en"), (1, "b", None, "de")], "ord long, id string, text string, lang string")
    got = {r["id"]: r for r in allocate_documents(docs, 100).collect()}
    assert (got["a"]["tokens"], got["a"]["status"], got["a"]["lang"], got["b"]["tokens"], got["b"]["lang"]) == (10.0, "kept", "en", 0.0, "de")
    first = allocate_documents(docs.withColumn("text", F.lit("y" * 40)).withColumn("priority", F.col("ord").cast("double")), 10, ceiling=1.0)
    assert {r["id"]: r["status"] for r in first.collect()} == {"b": "kept", "a": "dropped"}
    given = allocate_documents(docs.drop("lang").withColumn("tokens", F.lit(5.0)), 100, counter=lambda c: F.length(c) * 2)
    assert {r["tokens"] for r in given.collect()} == {5.0}


def test_split_shares_are_even(spark):
    """The rest goes to those least short, in their order, over many parts."""
    rows = [(k, str(k), None, float(10 + k % 7), 0.0) for k in range(50)]
    shares = {r["ord"]: r["share"] for r in split_budget(items(spark, rows), 520).collect()}
    short = sorted((t - 10, k) for k, _, _, t, _ in rows if t > 10)[:20]
    assert shares == {k: 10 + ((t - 10, k) in short) for k, _, _, t, _ in rows}


def test_counters(spark):
    from winnow_spark.functions.tokens import counter_kind, is_reliable_estimate

    words = lambda c: F.regexp_count(c, F.lit(r"\w+"))
    row = spark.range(1).select(count_tokens(F.lit("one two"), words).alias("n"), is_reliable_estimate(F.lit("")).alias("empty"), is_reliable_estimate(F.lit("x")).alias("some"), F.size(chunk_to_tokens(F.lit("a b\nc d\ne"), 2, words)).alias("chunks")).first()
    assert tuple(row) == (2, False, True, 3) and (counter_kind(words), counter_kind()) == ("exact", "estimated")
