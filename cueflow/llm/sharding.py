"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

A uniform permutation of N rows sends a random number of each source partition's rows to each cell of
the result; those numbers follow the multivariate hypergeometric law with both margins fixed. The
driver draws that matrix (source partitions x cells, both bounded by parameters, never rows), each
partition permutes its rows and deals them out by its line of the matrix, the rows are exchanged, and
each cell permutes what it got. Sizes come out exact because the margins are exact. Cells are slices
of a shard, so no task ever holds a whole shard.

Everything that touches rows is DataFrame functions: two windows, and a search by halving in a class's running counts.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: numpy draws exactly below this population; above it the law is inverted term by term.
_NUMPY_LIMIT = 10**9


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are among the ``good`` of good + bad."""
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return n
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1)))
    lo, hi = max(0, n - bad, mode - int(12 * spread) - 12), min(n, good, mode + int(12 * spread) + 12)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(log_p - log_p.max())
    return lo + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, hi - lo))


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Counts from each source to each cell, uniform over all permutations; margins are kept exactly."""
    if sum(rows) != sum(columns):
        raise ValueError("the margins differ in their sums")
    rng = np.random.default_rng(seed)
    left = list(columns)
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        rest, population = n, sum(left)
        for j, have in enumerate(left):
            if rest == 0:
                break
            population -= have
            out[i, j] = draw_hypergeometric(rng, have, population, rest)
            rest -= int(out[i, j])
            left[j] -= int(out[i, j])
    return out


def even_sizes(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def uniform_shards(df: DataFrame, keys: list[Column], shards: int = 8, seed: int = 20, block_rows: int = 20_000, max_blocks: int = 1024) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most, and every arrangement is equally likely. ``keys`` are
    columns that tell rows apart; rows equal in all keys may swap places, which nothing can tell.
    Source partitions are hash classes of the keys, so a task that runs again deals alike. Null keys
    are ordinary values. An empty table gives an empty result. Source classes and cells number
    ``max_blocks`` at most, which bounds the matrix. ``df`` may not hold columns named ``shard``,
    ``slot`` or starting with ``__``.
    """
    clash = [c for c in df.columns if c in ("shard", "slot") or c.startswith("__")]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    # The number of classes follows the number of rows, which one pass over the table tells.
    fine = df.withColumn("__c", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(max_blocks)).cast("int"))
    found = sorted((r["__c"], r["n"]) for r in fine.groupBy("__c").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in found)
    sources = min(max_blocks, max(64, 1 << math.ceil(math.log2(max(1, total / block_rows)))))
    per_class = [0] * sources
    for c, n in found:
        per_class[c % sources] += n
    blocks = max(1, min(sources, max_blocks) // shards)
    cells = [size for n in even_sizes(total, shards) for size in even_sizes(n, blocks)]
    matrix = communication_matrix(per_class, cells, seed)
    in_shard = [int(x) for s in range(shards) for x in np.concatenate([[0], np.cumsum(cells[s * blocks : (s + 1) * blocks])[:-1]])]
    # A class's row of place r goes to the first cell whose running count passes r; both tables are constants of the plan.
    upto = F.from_json(F.lit(json.dumps(np.cumsum(matrix, axis=1).tolist())), "array<array<bigint>>")
    starts = F.from_json(F.lit(json.dumps(in_shard)), "array<bigint>")

    def cell(counts: Column, r: Column) -> Column:
        """How many of the rising ``counts`` are ``r`` or less, by halving."""
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cells).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(counts, at + step - 1) <= r, at + step).otherwise(at))

    def place(k: int, by: str) -> Column:
        mixed = F.xxhash64(F.lit(seed + k), *keys)
        return F.row_number().over(Window.partitionBy(by).orderBy(mixed, *keys)) - 1

    first = fine.withColumn("__c", (F.col("__c") % sources).cast("int")).withColumn("__r", place(1, "__c"))
    dealt = first.withColumn("__cell", cell(F.get(upto, F.col("__c")), F.col("__r").cast("bigint")))
    second = dealt.withColumn("__t", place(2, "__cell"))
    return second.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.floor(F.col("__cell") / blocks).cast("int").alias("shard"),
        (F.get(starts, F.col("__cell")) + F.col("__t")).cast("bigint").alias("slot"),
    )


def sharded_documents(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts differ by one at most. Equal texts need not meet in one shard, since
    a uniform shuffle treats every row alike. A null text has size 1 and the checksum of no bytes.
    """
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    placed = uniform_shards(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
