"""Input paths and output names."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions.names import absolute_path, directory, join_path, normalized_path, target_name
from cueflow.functions.text import let
from cueflow.sources.staging import staged

ATTEMPTS = 500
TAKEN, WOULD_OVERWRITE = "a file of this name is there already", "the output would replace its own source"
NO_NAME, NO_OTHER_NAME = f"all names up to number {ATTEMPTS} are taken", f"the source keeps its name, and all names up to number {ATTEMPTS} are taken"
#: A name with a number that renaming may give, and where one is put.
_NUMBERED = r"\A([\s\S]*[^/\\]) \(([1-9][0-9]?|[1-4][0-9][0-9]|500)\)((?:\.[^./\\]*)?)\z"
_STEM = r"\A([\s\S]*?)((?<=[^/\\])\.[^./\\]*)?\z"
#: Later than any row.
_NEVER = (1 << 63) - 1
#: Parts that the rows of one name are dealt over before they are ranked.
_PARTS = 64


def dedupe(files: DataFrame, path: str = "path", order: str = "pos", fold_case: bool = False) -> DataFrame:
    """The first row of each normalized path."""
    key = normalized_path(F.col(path))
    first = Window.partitionBy(F.lower(key) if fold_case else key).orderBy(order)
    return files.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def requested(df: DataFrame, target: Column, path: str = "path", folder: Column | None = None, media: bool = False) -> DataFrame:
    """``df`` with ``out_dir`` and ``requested``, the output path that is asked for."""
    df = df.withColumn("out_dir", folder if folder is not None else directory(F.col(path)))
    return df.withColumn("requested", join_path(F.col("out_dir"), target_name(F.col(path), target, media)))


def _parent(name: Column) -> Column:
    """The name that ``name`` is a numbered form of; null if it is none."""
    return F.when(name.rlike(_NUMBERED), F.regexp_replace(name, _NUMBERED, "$1$3"))


def _form(name: Column, number: Column) -> Column:
    """``name`` itself for 0, else with the number in front of its extension."""
    parts = lambda k: F.regexp_extract(name, _STEM, k)
    return F.when(number == 0, name).otherwise(F.concat(parts(1), F.lit(" ("), number.cast("string"), F.lit(")"), parts(2)))


def _contenders(rows: DataFrame, n: int) -> DataFrame:
    """Of the rows (``o``, ``name``, ``barred``) that ask for a name those that can still get a form of it.

    A name has n - 1 forms or fewer. All free ones but the last go to the first rows; the last may be barred to some,
    so behind the first n rows the first one of each barred form counts too. A hot name is cut down in parts before its rows meet.
    """
    part = F.pmod(F.xxhash64("o"), F.lit(_PARTS))
    for keys in (["name", part], ["name"]):
        rows = rows.withColumn("late", F.row_number().over(Window.partitionBy(*keys).orderBy("o")) > n)
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "late", "barred").orderBy("o"))).filter(~F.col("late") | (F.col("nth") == 1)).drop("late", "nth")
    return rows


def _in_turn(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """o and number (null: none is left) of rows that take forms of their names one after another.

    ``blocked`` has name, number and until: rows after ``until`` can't have the form. Both sides of a name are arrays of
    a few hundred elements at most (see ``_contenders``), walked once.
    """
    shut = blocked.groupBy("name", "number").agg(F.min("until").alias("until")).groupBy("name").agg(F.collect_list(F.struct("number", "until")).alias("shut"))
    lists = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("o", "barred"))).alias("rows")).join(shut, "name", "left")
    entries = F.coalesce("shut", F.expr("cast(array() as array<struct<number:int,until:bigint>>)"))
    # The k-th row finds its form among the first k that are not shut, or the one behind them.
    most = F.least(F.lit(ATTEMPTS), F.size("rows") + F.size(entries) + 1)
    known = F.map_from_entries(entries)
    free = F.transform(F.sequence(F.lit(0), most), lambda i: F.struct(i.alias("number"), F.coalesce(F.try_element_at(known, i), F.lit(_NEVER)).alias("until")))
    free = F.filter(free, lambda f: f["until"] >= 0)
    out = F.expr("cast(array() as array<struct<o:bigint,number:int>>)")

    def step(a: Column, r: Column) -> Column:
        first = F.get(F.filter(a["free"], lambda f: (r["o"] < f["until"]) & (f["number"] != F.coalesce(r["barred"], F.lit(-1)))), F.lit(0))["number"]
        return let(first, lambda n: F.struct(F.filter(a["free"], lambda f: n.isNull() | (f["number"] != n)).alias("free"), F.array_append(a["out"], F.struct(r["o"].alias("o"), n.alias("number"))).alias("out")))

    taken = F.aggregate("rows", F.struct(free.alias("free"), out.alias("out")), step)["out"]
    return lists.select("name", F.explode(taken).alias("one")).select("name", "one.o", "one.number")


def assign(df: DataFrame, existing: DataFrame, policy: str, path: str = "path", order: str = "pos", folder: str | None = None) -> DataFrame:
    """``df`` (with ``requested``) with ``action`` (write or skip), ``output_path``, ``renamed`` and ``reason``.

    Rows take names in their order, and a name that a row has taken exists for the rows after it.
    ``existing`` has one column ``path``; ``order`` tells rows apart. A row's own source is never
    replaced: paths compare by their absolute form below ``folder`` (this process's folder, if null).

    The rows that ask for a name and its forms ``name (1)`` to ``name (500)`` are one list, settled in one step of arrays. A form may be a name
    that other rows ask for: it is theirs from the first of them on. Lists whose names are forms
    themselves come after the list that they are forms of, level by level, until none is left. No texts are moved if ``df`` holds none.
    """
    if policy not in ("autoRename", "overwrite", "skip"):
        raise ValueError(policy)
    same = lambda c: absolute_path(F.col(c), folder or os.getcwd())
    o = F.col(order).cast("bigint")
    asked = df.select(o.alias("o"), same("requested").alias("name"), same(path).alias("source"))
    asked = asked.withColumn("own", F.col("name") == F.col("source"))
    there = existing.select(same("path").alias("name")).distinct()
    first = asked.filter("NOT own").groupBy("name").agg(F.min("o").alias("until"))
    if policy == "skip":
        # The first row that asks for a free name writes; nothing is renamed, so names don't meet.
        numbers = first.join(there, "name", "left_anti").select(F.col("until").alias("o"), F.lit(0).alias("number"))
    else:
        numbers = _numbers(asked, there, first, policy).select("o", "number")
    out = df.join(numbers.withColumnRenamed("o", "__o"), o == F.col("__o"), "left")
    own, number = same("requested") == same(path), F.col("number")
    if policy == "overwrite":
        number = F.when(~own, F.lit(0)).otherwise(number)
    write = number.isNotNull()
    if policy == "skip":
        reason = F.when(own, F.lit(WOULD_OVERWRITE)).otherwise(F.lit(TAKEN))
    else:
        reason = F.when(own, F.lit(NO_OTHER_NAME)).otherwise(F.lit(NO_NAME))
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(write, "write").otherwise("skip").alias("action"),
        F.when(write, _form(F.col("requested"), number)).alias("output_path"),
        F.coalesce(number > 0, F.lit(False)).alias("renamed"),
        F.when(~write, reason).alias("reason"),
    )


def _numbers(asked: DataFrame, there: DataFrame, first: DataFrame, policy: str) -> DataFrame:
    """o and number of the rows whose names may be numbered; rows without one get no name."""
    barred = F.when(F.col("own"), 0).when(_parent(F.col("source")) == F.col("name"), F.regexp_extract("source", _NUMBERED, 2).try_cast("int"))
    rows = asked.withColumn("barred", barred)
    if policy == "overwrite":
        # Other rows write what they ask for, whether it is there or not.
        rows = rows.filter("own")
    rows = _contenders(rows.select("o", "name", "barred"), ATTEMPTS + 2)
    as_form = lambda df, until: df.select(_parent(F.col("name")).alias("name"), F.regexp_extract("name", _NUMBERED, 2).try_cast("int").alias("number"), until.alias("until")).filter("name IS NOT NULL")
    taken = F.lit(-1).cast("bigint")
    blocked = there.select("name", F.lit(0).alias("number"), taken.alias("until")).unionAll(as_form(there, taken)).unionAll(as_form(first, F.col("until")))
    if policy == "overwrite":
        return _in_turn(rows, blocked)
    left = staged(rows, "names")
    names = left.select("name").distinct()
    above = names.select(F.col("name").alias("upper"))
    if names.join(above, _parent(F.col("name")) == F.col("upper"), "left_semi").isEmpty():
        return _in_turn(left, blocked)
    out = None
    while not left.isEmpty():
        above = left.select(F.col("name").alias("upper")).distinct()
        is_form = _parent(F.col("name")) == F.col("upper")
        level = staged(_in_turn(left.join(above, is_form, "left_anti"), blocked), "named")
        # A form that went to the list above is gone for those who ask for it.
        gone = level.filter("number > 0").select(_form(F.col("name"), F.col("number")).alias("name"), F.lit(0).alias("number"), taken.alias("until"))
        blocked = blocked.unionAll(gone)
        left = staged(left.join(above, is_form, "left_semi"), "names")
        out = level if out is None else out.unionByName(level)
    return out
