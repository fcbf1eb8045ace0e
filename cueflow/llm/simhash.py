"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within radius 2 share a variant within radius 1 of both. So every distinct
fingerprint emits itself and its 64 one-bit flips, equal variants meet by one shuffle, and each
meeting group holds at most 65 fingerprints (the ball round its variant), all within the radius of
each other: linking them to their smallest member keeps every connection without listing pairs.
Components come from alternating large-star and small-star steps over those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm.runtime import Cut, cut, in_batches
from cueflow.sources.staging import spread

RADIUS = 2
#: Texts are taken in pieces of about so many bytes, cut at white space.
PIECE = 1 << 18
SEED = 42


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    if len(text) <= PIECE:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end : end + 1].strip():
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; a bit is 1 if over half the shingles' hashes have it set. No words: 0."""
    from xxhash import xxh64_intdigest as xxh

    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):  # bytes.lower changes A-Z only
        words = tail + words
        tail = words[max(0, len(words) - shingle + 1) :]
        if len(words) >= shingle:
            hashes = np.array([xxh(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)], "<u8")
            n += len(hashes)
            for i in range(0, len(hashes), 1 << 14):
                ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not n:
        if not tail:
            return 0
        return xxh(b" ".join(tail), SEED)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed long) of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return in_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, fp bigint")


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct links (a, b), a < b, that connect all values of column ``fp`` within ``radius`` bits.

    ``values`` holds distinct longs, without null; the radius is 2. No values, no links.
    """
    if radius != 2:
        raise ValueError("variants within half the radius are one-bit flips: the radius is 2")
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)]
    # Dealt over all cores before they grow 65-fold.
    met = spread(values.select("fp")).select("fp", F.explode(F.array(*flips)).alias("variant")).groupBy("variant").agg(F.collect_list("fp").alias("ball"))
    met = met.filter(F.size("ball") > 1).select(F.array_min("ball").alias("a"), F.explode("ball").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return met.filter((F.col("a") < F.col("b")) & close).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Hubs are aggregated before they are shuffled, and every round is a table in the shared folder; rounds
    end when nothing changes, after about the logarithm of the longest chain of links.
    """
    state = Cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v != m").distinct(), "links")

    def mark(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = mark(state.df)
    while before[0]:
        both = state.df.unionAll(state.df.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("least")).select(F.col("v").alias("hub"), F.least("v", "least").alias("least"))
        large = both.filter("m > v").select(F.col("v").alias("hub"), F.col("m").alias("far")).join(least, "hub")
        large = Cut(large.select(F.col("far").alias("v"), F.col("least").alias("m")).distinct(), "large-star")
        least = large.df.groupBy("v").agg(F.min("m").alias("least"))
        small = large.df.join(least, "v")
        small = small.select(F.col("m").alias("v"), F.col("least").alias("m")).filter("v != m").unionAll(least.select("v", F.col("least").alias("m")))
        after = Cut(small.distinct(), "small-star")
        large.drop()
        state.drop()
        state = after
        now = mark(state.df)
        if now == before:
            break
        before = now
    return state.df.select(F.col("v").alias("node"), F.col("m").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id among the documents that chains of links of at most 2
    differing bits reach. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer words
    than a shingle is one shingle, a null or empty text has fingerprint zero and is linked like any
    other. Repeated rows stay repeated. A component whose ids are all null has a null id. Texts of any
    length are read whole, an empty table gives none, columns besides doc_id and text are not read.
    """
    prints = cut(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
