"""winnow_spark: measuring, filtering, deduplicating and shrinking text with Spark DataFrames."""
