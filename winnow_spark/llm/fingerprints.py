"""I-Match document fingerprints, in DataFrame functions only.

Terms whose document frequency lies in a band (neither so common that every
text has them nor so rare that one edit drops them) form the lexicon. Several
random subsets of the lexicon are drawn (each term is in each subset with
probability ``KEEP``, by a hash of the term). A document's distinct lexicon
terms are sorted and, for each subset, those in it are hashed. The fingerprint
is all subset hashes; the likeness of two fingerprints is the share of equal
ones. A subset survives d changed lexicon terms with probability (1 - KEEP)^d,
so small subsets find near copies and many of them make it likely that one
does: with 15 % of the lexicon in each of twelve, nine times of ten for d up to
ten. A subset in which a text has no terms gets a hash of the whole text, so
that texts without lexicon terms are not alike by default.

Frequencies cover every document. The lexicon's size is bounded whatever the
corpus: a term in at least a share ``RARE`` of n documents takes ``RARE * n``
of the (document, term) pairs, so at most (mean distinct terms) / RARE terms
fit. It is counted, and only a count within ``MAX_LEXICON`` is broadcast; else
the same join shuffles.

Rows of equal id and text are one document; its result is given as often as it
is repeated. Defined results for odd input: a null text is an empty one; rows
of one id with different texts are ordered by a hash of the text; a single row
is its own next document; an empty table gives an empty result; extra columns
are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow_spark.llm.workers import quoted
from winnow_spark.session import cut_lineage, read_table

RARE, COMMON = 1 / 200, 1 / 10
SUBSETS, KEEP = 12, 0.15
MAX_LEXICON = 500_000
#: Ids to a range when documents are put in order, and ranges at most.
RANGE_ROWS, MAX_RANGES = 200_000, 50_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def distinct_terms(text: Column) -> Column:
    """Distinct words (lower case; letters beyond ASCII belong to words)."""
    return F.array_distinct(F.split(F.lower(text), SEPARATOR))


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """term (a 64-bit hash), number (its place by hash) and mask (the subsets it is in, as bits)."""
    every = F.count("*")
    counted = docs.select(F.explode(distinct_terms(F.coalesce(F.col(quoted(text)), F.lit("")))).alias("word")).where("word != ''")
    counted = counted.groupBy(F.xxhash64("word").alias("term")).agg(every.alias("df"))
    rows = docs.count()
    band = counted.where((F.col("df") >= max(2.0, RARE * rows)) & (F.col("df") <= max(2.0, COMMON * rows)))
    bits = [F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(1000)) < int(1000 * KEEP), 1 << k).otherwise(0) for k in range(SUBSETS)]
    return cut_lineage(band.select("term", sum(bits[1:], bits[0]).cast("int").alias("mask")))


def fingerprints(texts: DataFrame, words: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``likes`` (the fingerprint as subset hashes) and ``sha256`` of each row's text; keys tell rows apart.

    A text's last element is its own SHA-256 after "#", which no term has; it
    stays in the join whatever the lexicon is, so each row has a result and
    only lexicon terms are gathered.
    """
    small = words.count() <= MAX_LEXICON
    sentinel = words.sparkSession.range(1).select(F.xxhash64(F.lit("#")).alias("term"), F.lit(0).alias("mask"))
    words = words.unionByName(sentinel)
    body = F.coalesce(F.col(text), F.lit(""))
    terms = texts.select(*keys, F.explode(F.array_append(distinct_terms(body), F.concat(F.lit("#"), F.sha2(body, 256)))).alias("word"))
    whole = F.col("word").startswith("#")
    terms = terms.select(*keys, F.xxhash64(F.when(whole, F.lit("#")).otherwise(F.col("word"))).alias("term"), F.when(whole, F.substring("word", 2, 64)).alias("sha"))
    joined = terms.join(F.broadcast(words) if small else words, "term")
    found = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("mask") > 0, F.struct("term", "mask")))).alias("found"), F.max("sha").alias("sha256"))
    found = found.withColumn("met", F.aggregate("found", F.lit(0), lambda bits, t: bits.bitwiseOR(t["mask"])))
    subset = lambda k: F.filter("found", lambda t: t["mask"].bitwiseAND(F.lit(1 << k)) != 0)
    hashes = [F.when(F.col("met").bitwiseAND(F.lit(1 << k)) != 0, F.xxhash64(subset(k), F.lit(k))).otherwise(F.xxhash64("sha256", F.lit(-1 - k))) for k in range(SUBSETS)]
    return found.select(*keys, "sha256", F.array(*hashes).alias("likes"))


def spelled(likes: Column) -> Column:
    """The fingerprint as text."""
    return F.array_join(F.transform(likes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "-")


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets in which two fingerprints agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / float(SUBSETS)


def followers(keys: DataFrame) -> DataFrame:
    """For each (id, hash) of ``keys`` (unique): ``next``, that of the next in descending order of id; after the last comes the first.

    Ranges of the order are windowed by themselves; the first row of the range
    after each, one a range, is what meets in one place.
    """
    order = [F.col("missing").asc(), F.col("id").desc(), F.col("hash").asc()]
    ranges = max(1, min(MAX_RANGES, -(-keys.count() // RANGE_ROWS)), min(64, keys.sparkSession.sparkContext.defaultParallelism))
    ranged = cut_lineage(keys.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(*order)
    me = F.struct("id", "hash")
    ranked = ranged.withColumn("next", F.lead(me).over(inside)).withColumn("place", F.row_number().over(inside))
    heads = ranked.where("place = 1").select("range", me.alias("head"))
    around = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(around), F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    return ranked.join(F.broadcast(heads), "range").select("id", "hash", "missing", "n", "copies", F.coalesce("next", "head").alias("next"))


def compare_edited(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last half replaced by as many of the first code
    points of the next document.
    """
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    key, missing = F.coalesce(F.col(quoted(id)).cast("long"), F.lit(0)), F.col(quoted(id)).isNull()
    whole = docs.select(key.alias("id"), F.xxhash64(missing, body).alias("hash"), body.alias("body"))
    keys = docs.select(key.alias("id"), F.xxhash64(missing, body).alias("hash"), missing.alias("missing"), F.length(body).cast("long").alias("n"))
    keys = cut_lineage(keys.groupBy("id", "hash").agg(F.first("missing").alias("missing"), F.first("n").alias("n"), F.count("*").alias("copies")))
    repeated = bool(keys.where("copies > 1").head(1))
    after = cut_lineage(followers(keys))
    words = lexicon(whole, "body")

    # Each document learns who needs its beginning, and how much of it.
    wanted = after.select(F.col("next.id").alias("id"), F.col("next.hash").alias("hash"), F.col("id").alias("to_id"), F.col("hash").alias("to_hash"), F.floor(F.col("n") / 2).cast("int").alias("want"))
    texts = whole.dropDuplicates(["id", "hash"]) if repeated else whole
    pieces = texts.join(wanted.hint("shuffle_hash"), ["id", "hash"]).select(F.col("to_id").alias("id"), F.col("to_hash").alias("hash"), F.expr("substring(body, 1, want)").alias("piece"))
    both = texts.join(pieces, ["id", "hash"]).select("id", "hash", "body", F.expr("concat(substring(body, 1, length(body) - CAST(floor(length(body) / 2) AS INT)), piece)").alias("edited"))
    variants = both.select("id", "hash", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("body").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("value")))).alias("v"))
    prints = fingerprints(variants.select("id", "hash", "v.kind", "v.value"), words, ["id", "hash", "kind"], "value")
    take = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.col(column)))
    prints = prints.groupBy("id", "hash").agg(take(0, "likes").alias("likes"), take(1, "likes").alias("edited_likes"), take(1, "sha256").alias("edited_sha256"))
    prints = cut_lineage(prints)
    out = prints.join(after, ["id", "hash"])
    nexts = prints.select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("likes").alias("next_likes"))
    out = out.join(nexts, (out["next.id"] == nexts["next_id"]) & (out["next.hash"] == nexts["next_hash"]))
    out = out.select(
        F.when(~F.col("missing"), F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", spelled(F.col("likes")).alias("fingerprint"), spelled(F.col("edited_likes")).alias("edited_fingerprint"),
        likeness(F.col("likes"), F.col("edited_likes")).alias("near_edited"), likeness(F.col("likes"), F.col("next_likes")).alias("near_next"), "copies",
    )
    if repeated:
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.drop("copies")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_edited(docs)
