"""Order MinHash fingerprints, sensitive to edit distance, by DataFrame functions only.

A text is its sequence of k-mers of words, each numbered by its occurrence, so repeats are told apart.
Each of TUPLES components has an order of all numbered k-mers of its own: k-mers are dealt over TUPLES
lanes by their hash, and component t's order has lane t's first, by that hash, and all others behind
them by a hash seeded with t. A component takes the PER_TUPLE least distinct k-mers of its order (a text
with fewer has them all), puts them into the order of the text and hashes the tuple: it survives an edit
only if the k-mers and their order do. The order is the same for every text, however short; the seeded
hashes are only computed where a lane holds too few.

Everything happens in arrays of longs within a row: one sort brings equal k-mers together (their
occurrence numbers are distances to the start of their run, found by binary lifting), a second one
brings lanes together. Nothing is exploded, so no text is spread over rows or sorted by Spark.
A sorted long holds a hash above an index; the index has as many bits as the text's number of k-mers
needs, the hash has the rest of 63, and what is hashed further is looked up by the index, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.llm.runtime import cut

#: Words of a k-mer.
K = 5
#: Components of a fingerprint, and k-mers of each.
TUPLES, PER_TUPLE = 64, 2
_LANE_BITS = (TUPLES - 1).bit_length()
_POSITIVE = (1 << 63) - 1


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with column ``name``: TUPLES longs, or none for a text without words.

    Words are runs of characters other than white space (U+0009 to U+000D and the space); a text of
    fewer than K words has one k-mer of them all. A null text has no words. K-mers of one text are taken
    for equal if the first 63 - b bits of their hashes are, where b bits number the text's k-mers.
    """
    hashes, whole, mask, runs, numbers, lanes, dense = (f"__{name}_{x}" for x in ("h", "k", "m", "s", "n", "v", "d"))
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\t-\r ]+"), "")
    # Each step is a column of its own, so that Spark computes it once however often it is used.
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col(hashes)
    starts = F.slice(h, 1, F.when(F.size(h) >= K, F.size(h) - (K - 1)).otherwise(F.lit(1)))
    df = df.withColumn(whole, F.transform(starts, lambda x, i: F.xxhash64(F.slice(h, i + 1, K))))
    kmers = F.col(whole)
    df = df.withColumn(mask, F.expr(f"shiftleft(1L, length(bin(size(`{whole}`)))) - 1"))
    m = F.col(mask)
    above = F.bitwise_not(m).bitwiseAND(F.lit(_POSITIVE))
    pack = lambda value, i: value.bitwiseAND(above).bitwiseOR(i.cast("bigint"))
    top = lambda x: x.bitwiseAND(above)
    index = lambda x: x.bitwiseAND(m).cast("int")
    df = df.withColumn(runs, F.sort_array(F.transform(kmers, pack)))
    s = F.col(runs)

    def earlier_equals(x, i):
        """How many elements just before place i of the sorted array have the hash of x, by binary lifting."""
        powers = F.sequence(F.length(F.bin(m)), F.lit(0), F.lit(-1))
        step = lambda at, p: F.call_function("shiftleft", F.lit(1), p) + at
        return F.aggregate(powers, F.lit(0), lambda at, p: F.when(top(F.get(s, i - step(at, p))) == top(x), step(at, p)).otherwise(at))

    occurrence = lambda x, i: F.when(top(F.get(s, i - 1)) == top(x), earlier_equals(x, i)).otherwise(F.lit(0))
    df = df.withColumn(numbers, F.transform(s, lambda x, i: F.xxhash64(F.get(kmers, index(x)), occurrence(x, i))))
    numbered = F.col(numbers)
    df = df.withColumn(lanes, F.sort_array(F.transform(numbered, pack)))
    v = F.col(lanes)
    lane = lambda x: F.shiftright(x, 63 - _LANE_BITS).cast("int")
    # For each lane, the index of the first k-mer in it or behind it.
    before = lambda i: F.coalesce(lane(F.get(v, i - 1)), F.lit(-1))
    filled = F.flatten(F.transform(v, lambda x, i: F.array_repeat(i, lane(x) - before(i))))
    df = df.withColumn(dense, F.concat(filled, F.array_repeat(F.size(v), F.lit(TUPLES - 1) - lane(F.get(v, F.size(v) - 1)))))
    d = F.col(dense)
    # A place in the text above an index into the numbered k-mers.
    by_place = lambda x: F.shiftleft(F.get(s, index(x)).bitwiseAND(m), 32).bitwiseOR(x.bitwiseAND(m))

    def component(t):
        at = F.get(d, t)
        seeded = lambda x, i: F.when(lane(x) == t, i.cast("bigint")).otherwise(pack(F.xxhash64(F.get(numbered, index(x)), t), i))
        least = F.slice(F.sort_array(F.transform(v, seeded)), 1, PER_TUPLE)
        anywhere = F.transform(least, lambda p: F.get(v, index(p)))
        enough = F.coalesce(lane(F.get(v, at + (PER_TUPLE - 1))) == t, F.lit(False))
        chosen = F.when(enough, F.slice(v, at + 1, PER_TUPLE)).otherwise(anywhere)
        ordered = F.sort_array(F.transform(chosen, by_place))
        return F.xxhash64(F.transform(ordered, lambda y: F.get(numbered, y.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))).bitwiseAND(F.lit(0x7FFFFFFF))

    tuples = F.array(*[F.lit(t) for t in range(TUPLES)])
    df = df.withColumn(name, F.when(F.size(v) > 0, F.transform(tuples, component)).otherwise(F.expr("cast(array() as array<bigint>)")))
    return df.drop(hashes, whole, mask, runs, numbers, lanes, dense)


def likeness(a: str, b: str) -> Column:
    """Share of equal components, 0 to 1; two texts without words are alike."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: e)) / F.lit(float(TUPLES))
    one_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(one_empty, ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(both)


def in_hex(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """Per distinct doc_id (text not null): the hash of its first text, the id it is the next document of, and half that one's length.

    The order is by descending doc_id, and the first follows the last. Ids are range-partitioned, so
    each task orders its own; only the least id of each partition is looked at across partitions.
    """
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("chosen"), F.max(F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")).alias("half"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(ids.repartitionByRange(parts, F.col("doc_id")).withColumn("part", F.spark_partition_id()), "ids")
    # The document before d in descending order is the next greater id.
    after = Window.partitionBy("part").orderBy("doc_id")
    inner = ranged.withColumn("taker", F.lead("doc_id").over(after)).withColumn("taker_half", F.lead("half").over(after))
    edges = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "half")).alias("low"))
    whole = Window.partitionBy(F.lit(0)).orderBy("part")  # one row for each partition
    edges = edges.select(F.col("part").alias("of"), F.coalesce(F.lead("low").over(whole), F.first("low").over(whole)).alias("beyond"))
    out = inner.join(edges, F.col("part") == F.col("of"))
    return out.select(F.col("doc_id").alias("id"), "chosen", F.coalesce("taker", "beyond.doc_id").alias("taker"), F.coalesce("taker_half", "beyond.half").alias("taker_half"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) from the
    start of the next document by descending doc_id. Of rows that share a doc_id the one whose text
    has the smallest hash stands for the next document; rows without doc_id stand outside the order
    and have an empty next document. Null texts are empty, texts of any length are read whole, repeated
    rows come out repeated, an empty table gives none. Columns besides doc_id and text are not read.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Both uses below read this one exchange, so each text's own fingerprint is made once. Its columns
    # are never null and all used by both, or the two would be filtered and pruned differently.
    # Rows without doc_id are dealt by their text, so that they don't meet in one task.
    known = plain.select(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("key"), F.col("doc_id").isNull().alias("outside"), "text")
    texts = with_fingerprint(known, "text", "own").select("key", "outside", "text", F.transform("own", lambda x: x.cast("int")).alias("own")).repartition("key")
    # The hash is compared after the join, whose only key is the one that the texts are dealt by.
    chosen = F.when(F.col("outside"), F.lit(False)).otherwise(F.xxhash64("text").bitwiseXOR(F.col("chosen")) == 0)
    given = texts.join(neighbours(plain), (F.col("key") == F.col("id")) & chosen)
    given = given.select("taker", F.expr("left(text, taker_half)").alias("head"), F.col("own").alias("next_print"))
    given = given.groupBy("taker").agg(F.first("head").alias("head"), F.first("next_print").alias("next_print"))
    joined = texts.join(given, (F.col("key") == F.col("taker")) & ~F.col("outside"), "left")
    joined = joined.withColumn("doc_id", F.when(~F.col("outside"), F.col("key")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("head", F.lit("")), half))
    out = joined.select("doc_id", "text", "own", edited.alias("edited"), F.coalesce("next_print", F.expr("cast(array() as array<int>)")).alias("next_print"))
    out = with_fingerprint(out, "edited", "other").withColumn("other", F.transform("other", lambda x: x.cast("int")))
    return out.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        in_hex("own").alias("fingerprint"),
        in_hex("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next_print").alias("near_next"),
    )
