"""What reading clock values and cues costs, beside what it gives."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from cueflow.functions.text import WS, trim_ws
from cueflow.functions.timecode import parse_ms
from cueflow.plans.parse import cues_of, parse
from cueflow.plans.sql_functions import register


def test_a_missing_hour_costs_no_more_than_a_given_one(spark):
    def seconds(clock: str) -> float:
        # A lambda, since only there expressions are interpreted.
        df = spark.range(0, 4000, 1, 1).select(F.transform(F.array_repeat(F.concat(F.lit(clock), (F.col("id") % 10).cast("string")), 50), lambda c: parse_ms(c, 2)).alias("ms"))
        took = []
        for _ in range(4):
            at = time.time()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.time() - at)
        return min(took)

    assert seconds("01:02.") < 2 * seconds("00:01:02.")


def test_clock_values(spark):
    values = ["01:02.5", "1:01:02.5", "60:00.0", "1:60:00.0", "00:01:02", "", None, "a", " 1 : 2 , 3456 ", "999:59:59.9"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string").orderBy("i")
    # A colon may mark the fraction too, as in the fifth.
    want_two = [62_500, 3_662_500, None, None, 1_020, None, None, None, 62_345, 3_599_999_900]
    want_three = [None, 3_662_500, None, None, None, None, None, None, None, 3_599_999_900]
    assert [r[0] for r in df.select(parse_ms(F.col("raw"), 2)).collect()] == want_two
    assert [r[0] for r in df.select(parse_ms(F.col("raw"))).collect()] == want_three
    register(spark)
    assert [tuple(r) for r in df.selectExpr("clock_ms(raw, 2)", "clock_ms(raw, 3)").collect()] == list(zip(want_two, want_three, strict=True))


def test_cues_are_made_once(spark):
    df = spark.createDataFrame([(1, "[00:01.00][00:03.00]a\n[00:02.00]b\n"), (2, "nothing"), (3, "[ti:x]\n")], "id int, text string")
    out = cues_of(parse(df, "lrc"), "id")
    assert sorted(tuple(r) for r in out.select("id", "cue_seq", "start_ms", "end_ms", "text").collect()) == [(1, 0, 1000, 2000, "a"), (1, 1, 2000, 3000, "b"), (1, 2, 3000, 8000, "a")]
    # The optimizer must not ask for the size of an array before it is made.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if re.match(r"\W*Filter .*regexp|\W*Filter .*RLIKE", line)]


def test_trimming_equals_its_pattern(spark):
    spaces = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2005, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
    texts = ["", "a", "\U0001f600", *[c + c + "a" + c + "b" + c for c in spaces], spaces, spaces + "x y" + spaces, chr(0x200B) + "z" + chr(0x200B), "\x00a\x1c"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert all(r[0] == r[1] for r in df.select(trim_ws(F.col("t")), F.regexp_replace("t", rf"\A{WS}+|{WS}+\z", "")).collect())
