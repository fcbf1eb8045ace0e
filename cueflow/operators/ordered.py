"""Running values along keys of which one may hold any share of all rows.

A window over a key holds its rows in one task. Here a key's rows lie in slices along their order, a slice
is the most that a task holds of a key, and what a slice needs from those before or behind it comes from
one small row for each slice and key. Keys must not be null; ``order`` must tell a key's rows apart, or
rows that tie are taken in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.sources.staging import staged

SLICE = "__slice"
_FIRST, _LAST = Window.unboundedPreceding, -1


def sliced(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` as a table with its rows dealt by ranges of keys and order; ``__slice`` numbers the ranges.

    Ranges are drawn from a sample, so ``df`` is read twice. Nulls come first in the order.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return staged(df.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id()), name)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None, by: str = SLICE) -> DataFrame:
    """``df`` with the sum (or exclusive or) of each value over the rows of its key before the row.

    ``by`` is a column that does not fall along the order within a key; rows before the first sum up to 0.
    """
    made = {k: (F.sum, c, lambda a, b: a + b) for k, c in (sums or {}).items()} | {k: (F.bit_xor, c, lambda a, b: a.bitwiseXOR(b)) for k, c in (xors or {}).items()}
    inside = Window.partitionBy(*keys, by).orderBy(*order).rowsBetween(_FIRST, _LAST)
    earlier = Window.partitionBy(*keys).orderBy(by).rowsBetween(_FIRST, _LAST)
    none = F.lit(0).cast("bigint")
    slices = df.groupBy(*keys, by).agg(*[f(c).alias(f"__all_{k}") for k, (f, c, _) in made.items()])
    slices = slices.select(*keys, by, *[F.coalesce(f(f"__all_{k}").over(earlier), none).alias(f"__to_{k}") for k, (f, _, _) in made.items()])
    here = df.select("*", *[F.coalesce(f(c).over(inside), none).alias(f"__in_{k}") for k, (f, c, _) in made.items()])
    out = here.join(slices, [*keys, by])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[add(F.col(f"__to_{k}"), F.col(f"__in_{k}")).alias(k) for k, (_, _, add) in made.items()])


def following(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, by: str = SLICE) -> DataFrame:
    """``df`` with column ``name``: ``value`` of the next row of the key, null behind the last one."""
    inside, along = Window.partitionBy(*keys, by).orderBy(*order), Window.partitionBy(*keys).orderBy(by)
    first = df.groupBy(*keys, by).agg(F.min_by(value, F.struct(*order)).alias("__first"))
    first = first.select(*keys, by, F.lead("__first").over(along).alias("__beyond"))
    here = df.select("*", F.lead(value).over(inside).alias("__next"), F.lead(F.lit(True)).over(inside).alias("__more"))
    out = here.join(first, [*keys, by])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("__more"), F.col("__next")).otherwise(F.col("__beyond")).alias(name))
