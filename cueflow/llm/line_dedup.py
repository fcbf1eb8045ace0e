"""Line dedup by distinct-site spread.

A line that many sites carry is boilerplate. Its spread is estimated from one HyperLogLog sketch per
line hash, which partial aggregation merges before and after the shuffle, so a line that every
document holds costs one sketch per task. Lines whose estimate lies within the sketch's error of the
threshold get an exact count of distinct sites. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.llm.runtime import cut

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: Sketches have 2 ** LOG2_BUCKETS buckets; their relative standard error is 1.04 / sqrt(buckets).
LOG2_BUCKETS = 10
#: A line with more than 1 in SHARE of the rows to be joined meets them by a broadcast, of fewer than SHARE lines.
SHARE = 1024
#: Estimates within so many standard errors of the threshold are counted exactly.
SIGMAS = 5


def _key(site: str) -> Column:
    """A row's key; hashes pass nulls over, so it holds where they are."""
    columns = [F.col("doc_id"), F.col("text"), F.col(site)]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def _meeting(lines: DataFrame, few: DataFrame) -> DataFrame:
    """``lines`` joined with ``few`` (h1, h2, rows, ...), a table that has each line once and how many rows of ``lines`` it will meet."""
    all_rows = few.agg(F.sum("rows").alias("n")).first()["n"] or 0
    hot = F.col("rows") * SHARE > all_rows
    popular, rest = few.filter(hot).drop("rows"), few.filter(~hot).drop("rows")
    return lines.join(F.broadcast(popular), ["h1", "h2"]).unionByName(lines.join(F.broadcast(popular), ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row per non-blank line: document key, position, site and two hashes of the trimmed line."""
    key = _key(site)
    each = docs.select(key.alias("key"), "doc_id", F.col(site).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    return each.select("key", "doc_id", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(7)).alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` distinct sites, with the smallest doc_id that holds them and their number of rows.

    Null sites count as no site.
    """
    lines = _lines(docs, site)
    known = F.coalesce(F.col("site").cast("string"), F.lit(""))
    spread = (
        lines.groupBy("h1", "h2")
        .agg(F.count("site").alias("n"), F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.when(F.col("site").isNotNull(), known), F.lit(LOG2_BUCKETS)).alias("sketch"), F.min("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_sites)  # fewer rows than sites asked for can't reach them
        .select("h1", "h2", "keeper", "rows", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    margin = max(1.0, SIGMAS * 1.04 / 2 ** (LOG2_BUCKETS / 2) * min_sites)
    likely = cut(spread.filter(F.col("sites") >= min_sites - margin), "line-spread")
    sure = likely.filter(F.col("sites") > min_sites + margin).select("h1", "h2", "keeper", "rows")
    near = likely.filter(F.col("sites") <= min_sites + margin).select("h1", "h2", "keeper", "rows")
    counted = (
        _meeting(lines, near)
        .groupBy("h1", "h2", "keeper", "site")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("h1", "h2", "keeper")
        .agg(F.count("site").alias("exact"), F.sum("rows").alias("rows"))
        .filter(F.col("exact") >= min_sites)
        .select("h1", "h2", "keeper", "rows")
    )
    return sure.unionAll(counted)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus n_lines and n_removed (long).

    Lines compare without spaces at their ends; blank lines are never boilerplate. The first such line
    in the document with the smallest doc_id stays, so that no text is lost altogether; documents that
    share that doc_id all keep it. A null text stays null with 0 lines, an empty text has one line.
    Repeated rows are treated alike. Other columns pass through; columns of the input named n_lines or n_removed are replaced.
    """
    lines = _lines(docs, site)
    bad = cut(boilerplate(docs, min_sites, site), "boilerplate")
    hits = _meeting(lines, bad)
    kept_at = F.when(F.col("doc_id").eqNullSafe(F.col("keeper")), F.lit(True)).otherwise(F.lit(False))
    drops = (
        hits.groupBy("key", "h1", "h2", kept_at.alias("keeps"))
        .agg(F.collect_set("pos").alias("at"))
        .select("key", F.when(F.col("keeps"), F.array_except("at", F.array(F.array_min("at")))).otherwise(F.col("at")).alias("at"))
        .groupBy("key")
        .agg(F.flatten(F.collect_list("at")).alias("__drop"))
        .withColumnRenamed("key", "__key")
    )
    outputs = ("n_lines", "n_removed")
    row = docs.select(_key(site).alias("__key"), F.struct("*").alias("__row"))
    joined = row.join(drops, "__key", "left")
    parts, old = F.split("__row.text", "\n"), F.col("__row.text")
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull() | old.isNull(), old).otherwise(F.array_join(F.transform(keep, lambda i: F.get(parts, i)), "\n"))
    n_lines = F.when(old.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("bigint")
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns if c not in outputs],
        n_lines.alias("n_lines"),
        F.coalesce(F.size(F.col("__drop")), F.lit(0)).cast("bigint").alias("n_removed"),
    )
