"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Two documents link if their sets of word shingles have a Jaccard similarity of
at least 0.8 (100 * intersection >= 80 * union, in whole numbers). The join
loses no link and never lists all pairs of a group:

1. Shingle frequencies are counted over all documents in a table of fixed size
   (2**24 counters by hash, kept as eighths of an octave in a byte each). They
   give one global order, rarest first; any one order gives exact results, a
   truer one fewer candidates.
2. Documents with equal sets form a class; its least id represents it.
3. A set of n shingles has a prefix of its n - ceil(0.8 n) + 1 first ones. Sets
   that link share a shingle of both prefixes, so classes meet on prefix
   shingles. Postings (shingle, class) are shuffled once; there a group's classes
   lie together, shingles that one class alone has are dropped, and each class
   meets its group's pivot. Postings of shingles that are frequent by the counters
   are dealt by shingle and salt; the salts' pivots then meet their first.
4. Pairs pass the length filter, the positional filter (what can still be
   shared from these positions on) and the suffix filter: each set has 1,024
   parity bits (how many of its shingles fall to each, modulo 2). Each shingle
   that one set alone has flips one bit, so the bits in which two sets differ
   are at most their symmetric difference; pairs with too many can't link.
   What passes is checked exactly on whole sets, once a pair; failed pairs are
   remembered.
5. Pairs of classes already in one component need no check. So classes meet a
   pivot each, round by round with other pivots (but for groups of two, which
   have then met), while this links a ``PROGRESS``th of the classes, and of a
   class's pairs the one with the fewest differing bits is checked; the others
   wait. Then all pairs across components that remain are checked: on each
   shingle, the classes outside its largest component against all. The first
   kind keeps a group of g near copies at g pairs a round, the second makes the
   result exact.

Shingles are compared by 64-bit hashes (see ``shingles``).

Defined results for odd input: a null, empty or blank text has no shingles and
links with nothing, so its component is its own id; rows of one id are one
document, which links if any of its texts does, and each row is given; rows
with a null id get a null component; an empty table gives an empty result.
Extra columns are not carried by :func:`link_components`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow_spark.llm.components import connected_components
from winnow_spark.llm.shingles import shingle_sets
from winnow_spark.llm.workers import give_back, quoted
from winnow_spark.session import cut_lineage, read_table, release_shuffles

#: Similarity in per cent.
PERCENT = 80
COUNTERS, BLOCK = 1 << 24, 1 << 16
#: A shingle with more than this many documents, by its counter, is dealt to a salt for each so many, 64 at most.
#: A counter that is below ``ABOVE_MEAN`` times the counters' mean tells nothing and doesn't make a shingle a frequent one.
HOT_DOCUMENTS, SALTS, ABOVE_MEAN = 2048, 64, 8
_SALT_STEP = 0x1E3779B97F4A7C15
#: Places in a prefix from this one on are not told apart, and sets with so many do without the positional filter.
MOST_PLACE = (1 << 24) - 1
STAR_ROUNDS, PROGRESS = 3, 50
#: Rounds in which, of the pairs that remain between two components, the most alike one is checked, before all are.
BEST_ROUNDS = 2
#: Rows of one or two ids that may be broadcast (a few MB); more are shuffled.
MAX_BROADCAST = 300_000
#: Words of 64 bits in a set's parity sketch.
SKETCH = [f"k{i}" for i in range(16)]
#: Those that rows carry where all pairs are met (folded to half as many bits).
FOLDED = SKETCH[:8]
_MOST_DOCS, _MOST_COUNT = 127, 128


def _portions(arrays: Iterator[np.ndarray], least: int = 100_000) -> Iterator[np.ndarray]:
    """Of at most 127 documents each, so that a byte that is 128 at most can't overflow by one."""
    held, size = [], 0
    for a in arrays:
        held.append(a)
        size += len(a)
        if size >= least or len(held) == _MOST_DOCS:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(8 * np.log2(counts + 1), 255).astype(np.uint8)


def shingle_frequencies(docs: DataFrame) -> np.ndarray:
    """How many documents have a shingle, in eighths of an octave, by its hash modulo ``COUNTERS``; over all of ``docs`` (text).

    A partition counts in one array, each counter up to 128; the arrays are added up by block.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.uint8)
        for batch in batches:
            for hashes in _portions(shingle_sets(batch["text"])):
                places = hashes & (COUNTERS - 1)
                np.add.at(counts, places, 1)
                counts[places] = np.minimum(counts[places], _MOST_COUNT)
        for first in range(0, COUNTERS // BLOCK, 64):
            parts = [(k, counts[k * BLOCK : (k + 1) * BLOCK]) for k in range(first, min(first + 64, COUNTERS // BLOCK))]
            parts = [(k, zlib.compress(part.tobytes(), 1)) for k, part in parts if part.any()]
            yield pd.DataFrame({"block": [k for k, _ in parts], "counts": pd.Series([p for _, p in parts], dtype=object)})
        del counts
        give_back()

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for held in parts["counts"]:
            total += np.frombuffer(zlib.decompress(held), np.uint8)
        return pd.DataFrame({"block": [key[0]], "counts": [zlib.compress(_level(total).tobytes(), 1)]})

    summed = docs.select("text").mapInPandas(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary")
    out = np.zeros(COUNTERS, np.uint8)
    for row in summed.toLocalIterator():  # COUNTERS / BLOCK rows at most
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out


def least_frequent(frequencies: np.ndarray) -> float:
    """Documents from which on a shingle is dealt to salts."""
    return max(float(HOT_DOCUMENTS), ABOVE_MEAN * float(np.mean(np.exp2(frequencies / 8.0) - 1)))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of the sketch's bits, the parity of the hashes that fall to it."""
    bits = 64 * len(SKETCH)
    places = (hashes.view(np.uint64) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def signed_sets(docs: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """doc_id, n, a 128-bit signature of the set (s1, s2), its parity sketch and its prefix, rarest first, with each shingle's level."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)  # 16 MB whatever the input

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part, rows, sketches = batch.iloc[at : at + 2000], [], []
                for hashes in shingle_sets(part["text"]):
                    s1, s2 = np.frombuffer(blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
                    levels = often[hashes & (COUNTERS - 1)]
                    order = np.argsort(levels, kind="stable")[: prefix_length(len(hashes))]
                    rows.append((len(hashes), s1, s2, hashes[order].tobytes(), levels[order].tobytes()))
                    sketches.append(parity_sketch(hashes))
                made = pd.DataFrame(rows, columns=["n", "s1", "s2", "prefix", "levels"])
                made.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield pd.concat([made, pd.DataFrame(np.array(sketches, np.int64).reshape(-1, len(SKETCH)), columns=SKETCH)], axis=1)
        give_back()

    return docs.select("doc_id", "text").mapInPandas(sign, "doc_id long, n int, s1 long, s2 long, prefix binary, levels binary, " + ", ".join(f"{k} long" for k in SKETCH))


def prefix_postings(classes: DataFrame, hot_from: float) -> DataFrame:
    """key, facts, rep for every shingle of the classes' prefixes.

    ``key`` is the shingle, for a frequent one (``hot_from`` documents or more) with a salt's multiple added;
    ``facts`` are the set's size (31 bits), the salt (8 bits, from 1; 0 is none) and the place in its prefix (24 bits).
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                sizes = [len(levels) for levels in part["levels"]]
                if not sum(sizes):
                    continue
                reps, shingles = np.repeat(part["rep"].to_numpy(), sizes), np.frombuffer(b"".join(part["prefix"]), np.uint64)
                salts = np.exp2(np.frombuffer(b"".join(part["levels"]), np.uint8) / 8.0) / hot_from
                salts = np.minimum(salts, SALTS - 2).astype(np.uint64)
                hot = np.flatnonzero(salts)
                salts[hot] = pd.util.hash_array(reps[hot]) % (salts[hot] + np.uint64(1)) + np.uint64(1)
                place = np.concatenate([np.minimum(np.arange(s, dtype=np.uint64), np.uint64(MOST_PLACE)) for s in sizes])
                facts = (np.repeat(part["n"].to_numpy(), sizes).astype(np.uint64) << np.uint64(32)) | (salts << np.uint64(24)) | place
                yield pd.DataFrame({"key": (shingles + salts * np.uint64(_SALT_STEP)).view(np.int64), "facts": facts.view(np.int64), "rep": reps})
        give_back()

    return classes.mapInPandas(spread, "key long, facts long, rep long")


def size_of(facts: Column) -> Column:
    return F.shiftright(facts, 32)


def place_of(facts: Column) -> Column:
    return facts.bitwiseAND(F.lit(MOST_PLACE))


def salt_of(facts: Column) -> Column:
    return F.shiftright(facts, 24).bitwiseAND(F.lit(255))


def shingle_of(key: str, facts: str) -> Column:
    # Modulo 2**64: with ANSI rules, sums that overflow would be errors, so 32 bits at a time.
    step = [(salt * _SALT_STEP) & (2**64 - 1) for salt in range(SALTS)]
    signed = [v - 2**64 if v >= 2**63 else v for v in step]
    added = F.element_at(F.array(*map(F.lit, signed)), (salt_of(F.col(facts)) + 1).cast("int"))
    low = F.col(key).bitwiseAND(F.lit(0xFFFFFFFF)) - added.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(key, 32) - F.shiftrightunsigned(added, 32) - F.when(low < 0, 1).otherwise(0)
    made = F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(salt_of(F.col(facts)) == 0, F.col(key)).otherwise(made)


def could_link(n: Column, place: Column, other_n: Column, other_place: Column) -> Column:
    """Length and positional filters for two sets that share the shingle at these places."""
    needed = PERCENT * (n + other_n)  # over 100 + PERCENT: the least intersection
    possible = F.least(place, other_place) + 1 + F.least(n - place - 1, other_n - other_place - 1)
    return (100 * n >= PERCENT * other_n) & (100 * other_n >= PERCENT * n) & (((100 + PERCENT) * possible >= needed) | (F.greatest(place, other_place) >= MOST_PLACE))


def differing_bits(x: str, y: str, bits: list[str]) -> Column:
    found = [F.bit_count(F.col(f"{x}.{k}").bitwiseXOR(F.col(f"{y}.{k}"))) for k in bits]
    return sum(found[1:], found[0])


def may_be_alike(differ: Column, x: str, y: str) -> Column:
    """Suffix filter on parity sketches: the bits that differ are at most the symmetric difference."""
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has at most ``MAX_BROADCAST`` rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _ordered(x: Column, y: Column) -> list[Column]:
    """Two ends as a and b, the lesser first."""
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def with_pivots(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (rep, facts) with the ``pivot`` of their group by ``key``, its least class. Each group is sorted, none is held."""
    inside = Window.partitionBy(key).orderBy("rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("pivot", F.first(F.struct("rep", "facts")).over(inside))


def with_drawn_pivots(rows: DataFrame, turn: int) -> DataFrame:
    """``rows`` (shingle, rep, facts, comp) of shingles with several components, with a pivot drawn anew for each.

    Pivots are found by a combined minimum and joined, so that a frequent
    shingle's rows may lie in many tasks.
    """
    drawn = F.min(F.struct(F.xxhash64("rep", "shingle", F.lit(turn)).alias("draw"), "rep", "facts", "comp")).alias("first")
    pivots = rows.groupBy("shingle").agg(drawn, F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    pivots = cut_lineage(pivots.select("shingle", F.struct("first.rep", "first.facts", "first.comp").alias("pivot")), slim=True)
    return rows.join(few(pivots), "shingle")


def star_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows and their pivots that are of different components and pass the filters."""
    apart = F.col("comp") != F.col("pivot.comp") if "comp" in rows.columns else F.col("rep") != F.col("pivot.rep")
    own, other = F.col("facts"), F.col("pivot.facts")
    met = rows.where(apart & could_link(size_of(own), place_of(own), size_of(other), place_of(other)))
    return met.select(*_ordered(F.col("pivot.rep"), F.col("rep")))


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and text of the documents whose id is in ``reps``.

    Few ids are broadcast. For more, a bit table of them (2 MB) spares most other
    documents the shuffle; the join then is exact.
    """
    texts, count = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "text"), reps.count()
    if count <= MAX_BROADCAST:
        return texts.join(F.broadcast(reps), "rep", "left_semi")
    bits = 1 << min(24, max(12, (16 * count).bit_length()))
    place = lambda ids: (pd.util.hash_array(ids.to_numpy(np.int64)) & np.uint64(bits - 1)).astype(np.int64)

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = place(batch["rep"])
            np.bitwise_or.at(held, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"part": np.arange(len(held) // 512), "held": [held[k : k + 512].tobytes() for k in range(0, len(held), 512)]})

    def either(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "held": [np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in parts["held"]]).tobytes()]})

    rows = reps.select("rep").mapInPandas(marked, "part int, held binary").groupBy("part").applyInPandas(either, "part int, held binary").collect()  # 2 MB
    shared = docs.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(r["held"] for r in sorted(rows, key=lambda r: r["part"])), np.uint8))

    @F.pandas_udf("boolean")
    def may_be_in(ids: pd.Series) -> pd.Series:
        at = place(ids)
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7))) & 1 > 0)

    return texts.where(may_be_in("rep")).join(reps, "rep", "left_semi")


def alike_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that pass the suffix filter, with the bits that ``differ``."""
    one = sketches.alias("x").join(few(pairs), F.col("x.rep") == F.col("b")).select("a", "b", F.struct("x.n", *[f"x.{k}" for k in SKETCH]).alias("x"))
    both = one.join(sketches.alias("y"), F.col("a") == F.col("y.rep"))
    differ = differing_bits("x", "y", SKETCH)
    return both.where(may_be_alike(differ, "x", "y")).select("a", "b", differ.alias("differ"))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, by whole sets, made again from the texts of those pairs alone.

    Texts are shipped, which take less room than their sets: a pivot's once, its partners' to it.
    """

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        pivot, own = None, None
        for ids, ones, others in batches:
            out = []
            for at in range(0, len(ids), 200):
                part = zip(ids.iloc[at : at + 200], ones.iloc[at : at + 200], shingle_sets(others.iloc[at : at + 200]))
                for id, text, other in part:
                    if id != pivot:  # a pivot's pairs come one after another
                        pivot, own = id, next(shingle_sets([text]))
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    out.append(100 * shared >= PERCENT * (len(own) + len(other) - shared))
            yield pd.Series(out, dtype=bool)
        give_back()

    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    texts = cut_lineage(texts_of(docs, ends))
    if not _one_row_an_id(texts):  # rows of one id have one set here
        texts = cut_lineage(texts.dropDuplicates(["rep"]))
    withb = texts.select(F.col("rep").alias("b"), F.col("text").alias("b_text")).join(few(pairs), "b")
    pivots = texts.select(F.col("rep").alias("a"), F.col("text").alias("a_text")).join(few(pairs.select("a").distinct()), "a", "left_semi")
    return withb.join(pivots, "a").select("a", "b", linked("a", "a_text", "b_text").alias("linked"))


def link_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    docs = docs.select(F.col(quoted(id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    frequencies = shingle_frequencies(docs)
    signed = cut_lineage(signed_sets(docs, frequencies))
    sets = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[f(s).alias(f"{f.__name__}_{s}") for f in (F.min, F.max) for s in ("s1", "s2")])
    if not sets.where("min_s1 <> max_s1 OR min_s2 <> max_s2").head(1):
        return _linked(docs, signed, least_frequent(frequencies))

    # An id with unlike texts: each text is linked by a key of its own, then the components of one id are tied.
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), "text")
    own = keyed.select(F.col("key").alias("doc_id"), "text")
    known = _linked(own, cut_lineage(signed_sets(own, frequencies)), least_frequent(frequencies)).select(F.col("doc_id").alias("key"), "n_shingles", "component_id").distinct()
    rows = cut_lineage(keyed.select("doc_id", "key").join(known, "key"))
    edges = rows.join(rows.groupBy("doc_id").agg(F.min("component_id").alias("v")), "doc_id").select(F.col("component_id").alias("u"), "v")
    tied = connected_components(edges).select(F.col("node").alias("component_id"), F.col("component").alias("tied"))
    rows = rows.join(tied, "component_id", "left").withColumn("tied", F.coalesce("tied", "component_id"))
    least = rows.groupBy("tied").agg(F.min("doc_id").alias("least"))
    nameless = signed.where("doc_id IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.join(least, "tied").select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(nameless)


def _linked(docs: DataFrame, signed: DataFrame, hot_from: float) -> DataFrame:
    """:func:`link_components` where rows of one id have one set."""
    held = signed.where("n > 0 AND doc_id IS NOT NULL").withColumnRenamed("doc_id", "rep")
    signatures = held.groupBy("s1", "s2").agg(F.min("rep").alias("rep"), F.count("*").alias("copies"))
    # Only copies are looked for: where they are few, no prefix is shuffled for it.
    several = signatures.where("copies > 1").select("s1", "s2", F.col("rep").alias("least"))
    copies = cut_lineage(held.select("s1", "s2", "rep").join(few(several), ["s1", "s2"]).where("rep <> least").select("rep"), slim=True)
    classes = held.join(few(copies), "rep", "left_anti").dropDuplicates(["rep"]) if not _one_row_an_id(held) else held.join(few(copies), "rep", "left_anti")
    components = linked_classes(docs, held, prefix_postings(classes.select("rep", "n", "prefix", "levels"), hot_from))

    signatures = signatures.drop("copies")
    if components is not None:
        signatures = signatures.join(components, "rep", "left").select("s1", "s2", F.coalesce("comp", "rep").alias("component"))
    else:
        signatures = signatures.withColumnRenamed("rep", "component")
    out = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1"), F.when(F.col("n") > 0, F.col("s2")).alias("s2"))
    out = out.join(signatures, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def _one_row_an_id(held: DataFrame) -> bool:
    return not held.groupBy("rep").count().where("count > 1").head(1)


class _Components:
    """rep and comp of the classes that links have moved to another class's component."""

    def __init__(self):
        self.moved: DataFrame | None = None

    def of(self, df: DataFrame, rep: str, comp: str) -> DataFrame:
        """``df`` with the component of its column ``rep``."""
        if self.moved is None:
            return df.withColumn(comp, F.col(rep))
        now = self.small if self.small is not None else self.moved
        return df.join(now.select(F.col("rep").alias(rep), F.col("comp").alias("_now")), rep, "left").withColumn(comp, F.coalesce("_now", rep)).drop("_now")

    def link(self, links: DataFrame) -> int:
        """Join the components of ``links`` (a, b); how many classes have moved by it."""
        edges = self.of(self.of(links, "a", "u"), "b", "v").select("u", "v")
        merged = connected_components(edges).where("node <> component")
        if self.moved is None:
            now = merged.select(F.col("node").alias("rep"), F.col("component").alias("comp"), F.lit(True).alias("new"))
        else:
            old = self.moved.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"), F.col("component").isNotNull().alias("new"))
            now = old.unionByName(merged.select(F.col("node").alias("rep"), F.col("component").alias("comp"), F.lit(True).alias("new")))
        now = cut_lineage(now, slim=True)
        self.moved = now.drop("new")
        self.small = F.broadcast(self.moved) if now.count() <= MAX_BROADCAST else None
        return now.where("new").count()

    small: DataFrame | None = None


def linked_classes(docs: DataFrame, held: DataFrame, postings: DataFrame) -> DataFrame | None:
    """rep, comp of the classes whose component is not their own, or None if there are none; ``held`` has their sketches, ``postings`` their prefixes."""
    first = with_pivots(postings, "key")
    is_salted = salt_of(F.col("facts")) > 0
    meeting = first.withColumn("size", F.when(is_salted, 3).otherwise(F.count("*").over(Window.partitionBy("key"))))
    meeting = cut_lineage(meeting.where("size > 1").withColumn("many", F.col("size") > 2).drop("size"))
    release_shuffles(docs.sparkSession)
    if not meeting.head(1):
        return None
    reps = cut_lineage(meeting.select("rep").distinct(), slim=True)
    sketches = cut_lineage(held.select("rep", "n", *SKETCH).join(few(reps), "rep", "left_semi").dropDuplicates(["rep"]), slim=True)
    classes, comps, refused, waiting = reps.count(), _Components(), None, None

    def check(alike: DataFrame) -> int:
        """Check pairs on whole sets, join what links, remember the rest; how many classes have moved."""
        nonlocal refused
        done = cut_lineage(verified(alike.select("a", "b"), docs), slim=True)
        failed, links = done.where("NOT linked").select("a", "b"), done.where("linked").select("a", "b")
        refused = failed if refused is None else refused.unionByName(failed)
        return comps.link(links) if links.head(1) else 0

    def unrefused(pairs: DataFrame) -> DataFrame:
        return pairs if refused is None else pairs.join(refused, ["a", "b"], "left_anti")

    pairs = star_pairs(meeting)
    salted = bool(meeting.where(is_salted).head(1))
    if salted:  # the pivots of a shingle's salts meet one of them
        pivots = meeting.where(is_salted & (F.col("rep") == F.col("pivot.rep"))).select(shingle_of("key", "facts").alias("shingle"), "rep", "facts")
        pairs = pairs.unionByName(star_pairs(with_pivots(pivots, "shingle")))
    meeting = meeting.where("many").select(shingle_of("key", "facts").alias("shingle"), "rep", "facts")
    for turn in range(STAR_ROUNDS):
        if turn:  # at first each group's least class is its pivot, then another for each shingle; groups of two have met
            meeting = cut_lineage(with_drawn_pivots(comps.of(meeting.select("shingle", "rep", "facts"), "rep", "comp"), turn))
            pairs = star_pairs(meeting)
        alike = cut_lineage(alike_pairs(cut_lineage(unrefused(pairs.distinct()), slim=True), sketches), slim=True)
        now = cut_lineage(alike.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a")).select("a", "b"), slim=True)
        moved = check(now) if now.head(1) else 0
        left = alike.join(now, ["a", "b"], "left_anti")
        waiting = left if waiting is None else waiting.unionByName(left)
        release_shuffles(docs.sparkSession)
        if PROGRESS * moved < classes and (turn or not salted):
            break

    # What remains: all pairs across components, on each shingle those outside its largest component against all.
    rows = comps.of(meeting.select("shingle", "rep", "facts"), "rep", "comp")
    shares = rows.groupBy("shingle", "comp").count().groupBy("shingle").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1")
    shares = cut_lineage(shares.drop("comps"), slim=True)  # by itself, so that the joins with it may be split
    rows = cut_lineage(rows.join(shares, "shingle").withColumn("n", size_of(F.col("facts"))))
    folded = sketches.select("rep", *[F.col(k).bitwiseXOR(F.col(SKETCH[len(FOLDED) + i])).alias(k) for i, k in enumerate(FOLDED)])
    rows = rows.join(folded, "rep")
    one, other = rows.where("comp <> largest").alias("x"), rows.alias("y")
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp"))
    on &= could_link(F.col("x.n"), place_of(F.col("x.facts")), F.col("y.n"), place_of(F.col("y.facts"))) & may_be_alike(differing_bits("x", "y", FOLDED), "x", "y")
    met = cut_lineage(unrefused(one.join(other, on).select(*_ordered(F.col("x.rep"), F.col("y.rep"))).distinct()), slim=True)
    waiting = cut_lineage(waiting.unionByName(alike_pairs(met, sketches)).dropDuplicates(["a", "b"]), slim=True)
    for turn in range(BEST_ROUNDS + 1):
        across = cut_lineage(unrefused(comps.of(comps.of(waiting, "a", "u"), "b", "v").where("u <> v")), slim=True)
        if not across.head(1):
            break
        now = across
        if turn < BEST_ROUNDS:
            best = F.min_by(F.struct("a", "b"), F.struct("differ", "a", "b")).alias("best")
            now = across.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(best).select("best.a", "best.b")
        check(cut_lineage(now.select("a", "b"), slim=True))
        waiting = across.select("a", "b", "differ")
    return comps.moved


def keep_representatives(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one of the least id; rows with a null id all stay.

    Where rows share an id and a text, one of them stays.
    """
    members = cut_lineage(link_components(docs, id, text))
    others = members.where("component_id <> doc_id").select(F.col("doc_id").alias("__other")).distinct()
    own = F.col(quoted(id))
    kept = docs.join(few(others), own.cast("long") == others["__other"], "left_anti")
    if members.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").head(1):
        kept = kept.where(own.isNotNull()).dropDuplicates([id, text]).unionByName(kept.where(own.isNull()))
    return kept


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
postings AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM postings a JOIN postings b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS least FROM documents
  UNION
  SELECT v, least FROM reached JOIN links ON doc_id = u)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.least AS component_id
FROM sets s JOIN (SELECT doc_id, min(least) AS least FROM reached GROUP BY doc_id) r USING (doc_id)
"""
