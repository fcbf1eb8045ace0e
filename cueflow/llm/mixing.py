"""Mixing sources to target weights: exact block quotas, split over shards by a hypergeometric tree.

Each source gets a target number of words. Its documents are put into a random order and cut into blocks
of about equal numbers of words; a source whose target is a multiple of its size is passed over several
times, and the last pass stops before the document that would pass the target and takes a few others that close the gap. How many blocks of which
source go to which shard follows the law of a uniform deal of all blocks to shards of equal numbers of
blocks: a tree halves the shards, and at each node the quotas of the left half are drawn from the multivariate
hypergeometric law, source by source. Then each source's blocks are permuted and the first go to the first shard,
the next to the second, so that no block is drawn twice in a pass. In each shard blocks are permuted once
more, and documents change places within buffers of some neighbouring blocks.

Documents are handled by DataFrame functions only. The driver draws numbers for at most CLASSES classes of
sources; with more sources than that a class holds several, whose blocks are permuted together, which is the same law.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.llm.runtime import cut
from cueflow.llm.sharding import draw_hypergeometric, even_sizes
from cueflow.operators.ordered import SLICE, running, sliced

#: Weights of the sources in their order, repeating, and how often a source's words may be used.
WEIGHTS, MOST = (5, 2, 1), 3
#: Classes of sources and blocks in all passes, at most (besides one short block for each source and pass), and the least words of a block.
CLASSES, BLOCKS, BLOCK_WORDS = 1024, 1 << 20, 2048
#: Classes of sizes for each doubling, of which a source offers a document each to close its last gap.
SIZES = 16
#: Blocks whose documents change places.
BUFFER = 16
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"

_SOURCE = ["__none", "__source"]


def split_quotas(quotas: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Blocks of each source (lines) for each shard (columns): a uniform deal of all blocks to shards of the given sizes."""
    if sum(quotas) != sum(shards):
        raise ValueError("as many blocks as places are needed")
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), len(shards)), np.int64)

    def node(have: list[int], lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        left, rest, places = [], sum(have), sum(shards[lo:mid])
        for n in have:
            rest -= n
            left.append(draw_hypergeometric(rng, n, rest, places))
            places -= left[-1]
        node(left, lo, mid)
        node([n - x for n, x in zip(have, left, strict=True)], mid, hi)

    node(list(quotas), 0, len(shards))
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (``__none``, ``__source``, ``source_size``) with ``target``.

    Sources by code point, null last, have the weights in turn. Targets share the sum of all sizes by weight; one that passes
    ``most`` times its source's size stops there, and the excess is shared by weight among the others until none passes it.
    """
    ranked = running(sliced(sources.withColumn("__all", F.lit(1)), ["__all"], _SOURCE, "sources"), ["__all"], _SOURCE, {"__rank": F.lit(1)})
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights)).cast("int"))
    # The share that would make a source stop.
    full = (F.col("source_size") * most / weight).alias("__full")
    ranked = cut(ranked.select(*_SOURCE, "source_size", weight.alias("__weight"), full), "weights")
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    share, open_before = None, None
    while True:
        # Three numbers a round; rounds end when no more sources stop.
        free = F.lit(True) if share is None else F.col("__full") > share
        r = ranked.agg(
            F.sum(F.when(~free, F.col("source_size") * most).otherwise(0)).alias("stopped"), F.sum(F.when(free, F.col("__weight")).otherwise(0)).alias("weight"), F.count_if(free).alias("open"), F.count(F.lit(1)).alias("n")
        ).first()
        if not r["n"] or not r["weight"] or r["open"] == open_before:
            break
        open_before, rest, over = r["open"], total - r["stopped"], r["weight"]
        share = rest / over
    if share is None:
        return ranked.select(*_SOURCE, "source_size", F.lit(0.0).alias("target"))
    stop = (F.col("source_size") * most).cast("double")
    shared = F.lit(rest).cast("double") * F.col("__weight") / F.lit(over)
    return ranked.select(*_SOURCE, "source_size", F.when(F.col("__full") > share, shared).otherwise(stop).alias("target"))


def _mixed(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def _closing(known: DataFrame, most: int) -> DataFrame:
    """The documents (``__key``, ``__nth``) that the last pass takes beside its first ones to come nearer to the target.

    A source offers one document of each class of sizes; the largest that still fits is taken, then the next,
    and in the end one that overshoots by less than is missing.
    """
    missing = known.groupBy("__key").agg((F.first("target") - F.sum(F.col("size") * (F.col("__passes") + F.col("__last")))).alias("gap"))
    left = known.filter((F.col("size") > 0) & (F.col("__last") == 0) & (F.col("__passes") < most))
    offer = left.groupBy("__key", F.floor(F.log2("size") * SIZES).alias("__like")).agg(F.min_by(F.struct("size", "__nth"), "__order").alias("one"))
    # As many rows for a source as there are classes of sizes.
    offer = offer.groupBy("__key").agg(F.sort_array(F.collect_list("one"), asc=False).alias("offer")).join(missing, "__key")
    start = F.struct(F.col("gap").alias("gap"), F.expr("cast(array() as array<bigint>)").alias("took"))
    fill = F.aggregate("offer", start, lambda a, x: F.when(x["size"] <= a["gap"], F.struct((a["gap"] - x["size"]).alias("gap"), F.array_append(a["took"], x["__nth"]).alias("took"))).otherwise(a))
    offer = offer.withColumn("fill", fill)
    over = F.transform("offer", lambda x: F.struct((x["size"] - F.col("fill.gap")).alias("by"), x["__nth"].alias("nth")))
    over = F.array_min(F.filter(over, lambda x: (x["by"] > 0) & (x["by"] < F.col("fill.gap")) & ~F.array_contains("fill.took", x["nth"])))
    took = F.when(over.isNotNull(), F.array_append("fill.took", over["nth"])).otherwise(F.col("fill.took"))
    return offer.select("__key", F.explode(took).alias("__nth"), F.lit(1).alias("__extra"))


def mixture(docs: DataFrame, shards: int = 8, seed: int = 13, size: Column | None = None, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken and drawn of every row of ``docs``.

    ``drawn`` has a struct of pass, shard and slot for each time that the mix takes the document; slots of a shard are
    gapless from 0. ``taken`` is the size times the draws. The same rows give the same mix, wherever they lie.
    Documents of size 0 are not drawn. A null text has size 0, a null source is one of its own, rows without doc_id and
    repeated rows are drawn like others (which of equal rows is drawn can't be told). Without words all targets are 0. An empty table gives
    no rows. Texts of any length count whole; columns besides doc_id, text and ``source`` are not read.
    """
    words = size if size is not None else F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    src = F.col(f"`{source}`")
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())
    slim = cut(docs.select(src.isNull().alias("__none"), F.coalesce(src.cast("string"), F.lit("")).alias("__source"), F.col("doc_id").cast("bigint").alias("doc_id"), words.cast("bigint").alias("size"), row.alias("__row")), "sizes")
    # Sources' names meet once; from here on a source is a number.
    wanted = targets(slim.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size")), weights, most)
    wanted = cut(wanted.withColumn("__key", F.xxhash64(*_SOURCE)), "targets")
    total = wanted.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    block_words = max(BLOCK_WORDS, -(-total // BLOCKS))

    placed = slim.select(F.xxhash64(*_SOURCE).alias("__key"), _mixed(seed, "__row", "doc_id", "size").alias("__order"), "__row", "doc_id", "size")
    placed = sliced(placed, ["__key"], ["__order", "__row"], "permuted")
    # A slice of a source has one row here, so sources join without their documents.
    placed = running(placed, ["__key"], ["__order", "__row"], {"__at": F.col("size"), "__nth": F.lit(1)})
    per_slice = placed.groupBy(SLICE, "__key").agg(F.lit(1).alias("__one")).join(wanted.select("__key", "source_size", "target"), "__key").drop("__one")
    # Whole passes, and whether the last one, which stops before the target, has this document too.
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.try_divide("target", "source_size")), F.lit(most))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    last = F.when((F.col("size") > 0) & (F.col("__at") + F.col("size") <= rest), 1).otherwise(0)
    known = placed.join(per_slice, [SLICE, "__key"]).withColumn("__passes", F.coalesce(passes, F.lit(0)).cast("int"))
    known = cut(known.withColumns({"__last": F.coalesce(last, F.lit(0)), "__block": F.floor(F.col("__at") / block_words)}), "passes")
    more = _closing(known, most)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("__passes") + F.col("__last") + F.coalesce("__extra", F.lit(0)))
    known = cut(known.join(more, ["__key", "__nth"], "left").withColumn("copies", copies.cast("int")), "copies")

    # Each pass has its own permutation of the same blocks.
    draws = known.filter("copies > 0").select("__key", "__nth", "__block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__pass"))
    blocks = cut(draws.groupBy("__key", "__pass", "__block").agg(F.count(F.lit(1)).alias("__docs")).withColumn("__class", F.pmod("__key", F.lit(CLASSES)).cast("int")), "blocks")
    quotas = {r["__class"]: r["n"] for r in blocks.groupBy("__class").agg(F.count(F.lit(1)).alias("n")).collect()}  # CLASSES rows at most
    classes = sorted(quotas)
    plan = split_quotas([quotas[c] for c in classes], even_sizes(sum(quotas.values()), shards), seed)
    upto = dict(zip(classes, np.cumsum(plan, axis=1).tolist(), strict=True))
    table = F.from_json(F.lit(json.dumps({str(c): v for c, v in upto.items()})), "map<string,array<bigint>>")
    turn = F.row_number().over(Window.partitionBy("__class").orderBy(_mixed(seed + 1, "__key", "__pass", "__block"), "__key", "__pass", "__block")) - 1
    dealt = blocks.withColumn("__turn", turn).withColumn("shard", F.size(F.filter(F.element_at(table, F.col("__class").cast("string")), lambda x: x <= F.col("__turn"))))
    # Blocks are permuted in their shard; BUFFER of them share a buffer.
    by_shard = running(sliced(dealt.withColumn("__mix", _mixed(seed + 2, "__key", "__pass", "__block")), ["shard"], ["__mix", "__key", "__pass", "__block"], "dealt"), ["shard"], ["__mix", "__key", "__pass", "__block"], {"__before": F.col("__docs"), "__i": F.lit(1)})
    by_shard = by_shard.withColumn("__buffer", F.floor(F.col("__i") / BUFFER))
    start = F.min("__before").over(Window.partitionBy("shard", "__buffer"))
    homes = cut(by_shard.select("__key", "__pass", "__block", "shard", "__buffer", start.alias("__start")), "homes")
    local = F.row_number().over(Window.partitionBy("shard", "__buffer").orderBy(_mixed(seed + 3, "__key", "__nth", "__pass"), "__key", "__nth", "__pass")) - 1
    slots = draws.join(homes, ["__key", "__pass", "__block"]).withColumn("slot", F.col("__start") + local)
    one = F.struct(F.col("__pass").alias("pass"), "shard", "slot")
    drawn = slots.groupBy("__key", "__nth").agg(F.sort_array(F.collect_list(one)).alias("drawn"))
    out = known.join(drawn, ["__key", "__nth"], "left")
    none = F.expr("cast(array() as array<struct<pass:int,shard:int,slot:bigint>>)")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.coalesce("drawn", none).alias("drawn"))



