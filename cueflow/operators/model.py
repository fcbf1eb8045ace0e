"""Relational operators over a table of cues: shift, sort, fill, filter, look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions.text import has_visible_text
from cueflow.operators.ordered import SLICE, following, running, sliced


def shift(cues: DataFrame, offset_ms: int) -> DataFrame:
    """Start and end moved, each cut off at 0 by itself; a null end stays null. Offset 0 changes nothing."""
    if not offset_ms:
        return cues
    moved = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.col(c) + offset_ms))
    return cues.withColumns({"start_ms": moved("start_ms"), "end_ms": moved("end_ms")})


def shift_array(cues: Column, offset_ms: int) -> Column:
    """The same over the cue arrays of documents."""
    if not offset_ms:
        return cues
    moved = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0).cast("bigint"), v + offset_ms))
    return F.transform(cues, lambda c: c.withField("start_ms", moved(c["start_ms"])).withField("end_ms", moved(c["end_ms"])))


def by_start(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("start_ms", "cue_seq")


def sort_by_start(cues: DataFrame, *keys: str) -> DataFrame:
    """cue_seq renumbered from 0 by start; ties keep their order."""
    return cues.withColumn("cue_seq", (F.row_number().over(by_start(*keys)) - 1).cast("int"))


def resolve_missing_ends(cues: DataFrame, *keys: str, fallback_ms: int = 5000) -> DataFrame:
    """A null end becomes the next start if that is later, else start plus the fallback."""
    after = F.lead("start_ms").over(by_start(*keys))
    return cues.withColumn("end_ms", F.coalesce("end_ms", F.when(after > F.col("start_ms"), after), F.col("start_ms") + fallback_ms))


def sort_and_fill(cues: DataFrame, key: str, fallback_ms: int = 5000) -> DataFrame:
    """``sort_by_start`` and ``resolve_missing_ends`` in one, for documents of any length.

    A document's cues are spread over tasks by ranges of their starts, and a range takes the next start and
    the number of its first cue from its neighbours. Cues whose ``key`` is null are one document.
    """
    none, order = F.col(key).isNull(), ["start_ms", "cue_seq"]
    rows = sliced(cues.withColumns({"__none": none, "__doc": F.coalesce(F.col(key).cast("string"), F.lit(""))}), ["__none", "__doc"], order, "cues")
    rows = running(rows, ["__none", "__doc"], order, {"__n": F.lit(1)})
    rows = following(rows, ["__none", "__doc"], order, "start_ms", "__after")
    later = F.when(F.col("__after") > F.col("start_ms"), F.col("__after"))
    out = rows.withColumns({"end_ms": F.coalesce("end_ms", later, F.col("start_ms") + fallback_ms), "cue_seq": F.col("__n").cast("int")})
    return out.drop("__none", "__doc", "__n", "__after", SLICE)


def visible(cues: DataFrame) -> DataFrame:
    return cues.filter(has_visible_text(F.col("text")))


def malformed(cues: DataFrame) -> DataFrame:
    return cues.filter(F.col("end_ms") < F.col("start_ms"))


def counts(documents: DataFrame, *keys: str) -> DataFrame:
    return documents.select(*keys, F.size("cues").alias("n_cues"), (F.size("cues") == 0).alias("is_empty"))


def with_style(cues: DataFrame, styles: DataFrame, *keys: str) -> DataFrame:
    """Cues with their document's first style of exactly their name in ``style_fields``."""
    first = styles.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "name").orderBy("style_seq"))).filter("rank = 1")
    first = first.select(*keys, F.col("name").alias("style_ref"), F.col("fields").alias("style_fields"))
    return cues.join(first, [*keys, "style_ref"], "left")


def numeric_field(value: Column) -> Column:
    return F.trim(value).try_cast("double")
