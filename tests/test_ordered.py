"""Running values and next rows over slices against windows over whole keys."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueflow.operators import model
from cueflow.operators.ordered import following, running, sliced


def test_slices_equal_windows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 40)
    df = spark.range(6000).select(key.alias("k"), (F.col("id") * 7919 % 6007).alias("o"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    dealt = sliced(df, ["k"], ["o"], "test")
    assert dealt.filter("k = -1").select("__slice").distinct().count() > 1
    out = following(running(dealt, ["k"], ["o"], {"s": F.coalesce("v", F.lit(0)), "n": F.lit(1)}, {"x": F.col("o")}), ["k"], ["o"], "v", "next").drop("__slice")
    w = Window.partitionBy("k").orderBy("o")
    before, zero = w.rowsBetween(Window.unboundedPreceding, -1), F.lit(0).cast("bigint")
    want = df.select("*", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(before), zero).alias("s"), (F.row_number().over(w) - 1).cast("bigint").alias("n"), F.coalesce(F.bit_xor("o").over(before), zero).alias("x"), F.lead("v").over(w).alias("next"))
    assert out.columns == want.columns and out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    assert running(dealt.limit(0), ["k"], ["o"], {"s": F.col("v")}).count() == 0


def test_one_long_document(spark):
    key = F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.lit("long")).otherwise((F.col("id") % 30).cast("string"))
    cues = spark.range(8000).select(key.alias("doc"), F.col("id").alias("cue_seq"), (F.col("id") * 7919 % 3001).cast("bigint").alias("start_ms"), F.when(F.col("id") % 2 == 0, F.col("id")).cast("bigint").alias("end_ms"))
    got, want = model.sort_and_fill(cues, "doc"), model.sort_by_start(model.resolve_missing_ends(cues, "doc"), "doc")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
