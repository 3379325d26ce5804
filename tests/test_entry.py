from pathlib import Path

import pytest

import __spark_entry__ as entry_points

DATA = Path("/root/testdata/sf0.001")


def test_names():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries) and all(map(callable, queries.values()))


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_entry(spark):
    assert entry_points.entry(spark).count() == 4


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from winnow_spark.streaming.running import first_texts, token_totals

    rows = spark.createDataFrame([(0, "one text"), (1, "one text "), (2, "other")], "k int, text string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("first", first_texts(stream), "append"), ("totals", token_totals(stream), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("first").count() == 2 and spark.table("totals").first()["n_documents"] == 3
