"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target (words) and a weight schedule: its share of the
training stream at time t in [0, 1] is ``1 + ramp * (2t - 1)`` times its mean
share, so a positive ramp comes late and a negative one early. The integral of
that schedule is the source's cumulative token demand. A source's documents are
laid end to end in a fixed shuffled order (by MD5 of the id); the demand curve
is inverted at each document's offset, which gives its training position in
[0, 1], and the mix is all documents range-sorted by position.

A source wanted more than once is laid end to end again (a second pass), up to
``MAX_REPEATS`` passes. The document at which the target is reached is taken in
part, so each source's words meet ``floor(target)`` exactly.

Skew: a source may hold most rows. Offsets are prefix sums over (source, slice)
groups, a slice being a range of the MD5 order with a few thousand rows, plus
prefix sums over the slices' totals.

Defined results for odd input: a null or blank text has size 0, takes 0 words
and its position is that of its offset; a null source is a source of its own,
last in order; rows repeated in full are kept and follow one another; an empty
table, or one without words, gives targets of 0. Extra columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow_spark.llm.workers import quoted
from winnow_spark.session import cut_lineage, read_table

#: Weights and ramps repeat along the sources in code-point order.
WEIGHTS, RAMPS = (5.0, 2.0, 1.0), (-0.5, 0.0, 0.5)
SHARE, MAX_REPEATS = 1.5, 2
SLICE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def _cycle(values: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, share: float = SHARE, repeats: int = MAX_REPEATS, weights=WEIGHTS, ramps=RAMPS) -> DataFrame:
    """One row a source (source, source_size) with its ``target`` and ``ramp``.

    The shared words are split by weight; targets stop at ``repeats`` times the
    source's size and the excess is split again. Sorted by size over weight,
    the sources that stop are a prefix, so one running sum finds all targets.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("source", "source_size", _cycle(weights, F.col("place")).alias("weight"), _cycle(ramps, F.col("place")).alias("ramp"), (F.col("source_size") * float(repeats)).alias("most"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = ranked.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    level = level.withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    final = level.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), "level"))).over(every)["level"])
    # No source may be open (all full): then every target is its cap.
    return final.select("source", "source_size", "ramp", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("weight"))).alias("target"))


def _when(part: Column, ramp: Column) -> Column:
    """The time at which a share ``part`` of a source's demand is met.

    Demand up to t is t(1 - r) + r t²; its root in [0, 1].
    """
    curved = (ramp - 1.0 + F.sqrt((1.0 - ramp) * (1.0 - ramp) + 4.0 * ramp * part)) / (2.0 * ramp)
    return F.when(ramp == 0.0, part).otherwise(curved)


def curriculum(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_taken, position, again_position, hash; sorted by position.

    ``first_taken`` is what the first pass takes; ``taken`` minus that is what
    the second takes. The positions are where the passes meet the document;
    ``hash`` (of the text) and ``twin`` (a number among alike rows) tell rows of one id apart.
    """
    own_id, own_text, own_source = (F.col(quoted(c)) for c in (id, text, source))
    size = F.when(own_text.isNull(), 0).otherwise(F.regexp_count(own_text, F.lit(WORD))).cast("long")
    slim = cut_lineage(docs.select(own_id.alias("doc_id"), own_source.alias("source"), size.alias("size"), F.md5(own_id.cast("string").cast("binary")).alias("key"), F.xxhash64(own_text).alias("hash")))
    rows = slim.count()
    digits = max(0, math.ceil(math.log(max(1, rows / SLICE_ROWS), 16)))
    slim = slim.withColumn("slice", F.substring("key", 1, digits) if digits else F.lit(""))

    slices = slim.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    slices = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(Window.partitionBy("source").orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slices = cut_lineage(slices)
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), share)
    slices = slices.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "slice_size")
    slices = slices.select(F.col("source").alias("of"), F.col("slice").alias("of_slice"), "slice_start", "source_size", "target", "ramp")

    inside = Window.partitionBy("source", "slice").orderBy(F.col("key").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = slim.withColumn("inner_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.join(slices, F.col("source").eqNullSafe(F.col("of")) & F.col("slice").eqNullSafe(F.col("of_slice")))
    start, whole = F.col("slice_start") + F.col("inner_start"), F.floor("target")
    when = lambda begin: F.when(F.col("target") > 0, _when(F.least(F.lit(1.0), begin / F.col("target")), F.col("ramp"))).otherwise(0.0)
    part = lambda begin: F.greatest(F.lit(0), F.least(F.col("size"), whole - begin))
    taken = laid.select(
        "doc_id", "source", "size", "source_size", "target",
        (part(start) + part(start + F.col("source_size"))).cast("long").alias("taken"),
        part(start).cast("long").alias("first_taken"),
        when(start).alias("position"), when(start + F.col("source_size")).alias("again_position"), "hash",
    )
    return taken.orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is taken, in training order.

    Where the target is reached within a document, that last copy keeps only
    the words taken, with what stands between them (and ``n_chars``, if there,
    is set anew). Documents of which nothing is taken, and so those without words, go.
    """
    keys = ["__id", "__hash", "__source"]
    plan = curriculum(docs, id, text, source, share)
    twice = F.array(F.struct(F.col("first_taken").alias("words"), F.col("position").alias("at")), F.struct((F.col("taken") - F.col("first_taken")).alias("words"), F.col("again_position").alias("at")))
    plan = plan.select(F.col("doc_id").alias("__id"), F.coalesce("hash", F.lit(0)).alias("__hash"), F.coalesce("source", F.lit("\x00")).alias("__source"), "size", "taken", twice.alias("passes"))
    plan = cut_lineage(plan)
    own_id, own_text, own_source = (F.col(quoted(c)) for c in (id, text, source))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__row"), own_id.alias("__id"), F.coalesce(F.xxhash64(own_text), F.lit(0)).alias("__hash"), F.coalesce(own_source, F.lit("\x00")).alias("__source"))
    if plan.groupBy(*keys).count().where("count > 1").head(1):  # only then whole rows are shuffled for it
        alike = Window.partitionBy(*keys).orderBy("__hash")
        plan, rows = (df.withColumn("__twin", F.row_number().over(alike)) for df in (plan, rows))
        keys.append("__twin")
    plan = plan.where("taken > 0")
    on = rows["__id"].eqNullSafe(plan["__id"])
    for key in keys[1:]:
        on &= rows[key] == plan[key]
    copies = rows.join(plan.hint("shuffle_hash"), on).select("__row", "size", rows["__id"], F.explode("passes").alias("pass")).where("pass.words > 0")
    copies = copies.repartitionByRange(F.col("pass.at"), F.col("__id")).sortWithinPartitions("pass.at", "__id")
    whole = F.col("pass.words") == F.col("size")
    words = F.split(F.col("__row")[text], r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("pass.words").cast("int")), "")
    changed = {text: cut} | ({"n_chars": F.length(cut).cast("long")} if "n_chars" in docs.columns else {})
    value = lambda c: F.when(whole, F.col("__row")[c]).otherwise(changed[c]) if c in changed else F.col("__row")[c]
    return copies.select(*[value(c).alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return curriculum(docs).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
  FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, (source_size * 2)::DOUBLE AS most,
         CASE place WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         CASE place WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS ramp
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
final AS (
  SELECT *, (SELECT arg_min(level, most / weight) FROM levels WHERE level * weight <= most) AS final FROM levels),
targets AS (
  SELECT source, source_size, ramp,
         CASE WHEN final IS NULL THEN most ELSE least(most, final * weight) END AS target
  FROM final)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - start))
        + greatest(0, least(size, floor(target)::BIGINT - start - source_size)))::BIGINT AS taken,
       CASE WHEN target <= 0 THEN 0.0::DOUBLE
            WHEN ramp = 0 THEN least(1.0::DOUBLE, start / target)
            ELSE (ramp - 1.0::DOUBLE + sqrt((1.0::DOUBLE - ramp) * (1.0::DOUBLE - ramp)
                  + 4.0::DOUBLE * ramp * least(1.0::DOUBLE, start / target))) / (2.0::DOUBLE * ramp) END AS position
FROM laid JOIN targets ON laid.source IS NOT DISTINCT FROM targets.source
"""
