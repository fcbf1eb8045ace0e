"""Emphasis in expressions against the scanner that reads token by token."""

import random

from pyspark.sql import functions as F

from cueflow.functions import markup
from cueflow.functions.emphasis import drawn_ass, drawn_html, scanned_html
from cueflow.plans.parse import documents_from_cues, parse
from cueflow.plans.write import write

PIECES = ["<i>", "</i>", "<b>", "</b>", "<em>", "</EM>", "<strong x='1'>", "</strong>", "<u>", "</u >", "<s>", "</del>", "<strike/>", "<font color=red>", "</font>", "<", ">", "&", "&amp;", "&lt;b&gt;", "&#65;", "&#x1F600;", "&#0;", "&nope;", "a", " b ", "\r\n", "\r", "\n", "\U00020000", "é", "<>", "< i>", "<1>"]


def test_random_markup(spark):
    rng = random.Random(8)
    texts = ["", "plain", "<b>" * 30 + "x" + "</b>" * 31, "<i>" + "long text " * 20000 + "</i>"]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").repartition(8)
    for entities in (False, True):
        got = {r.i: r.s for r in df.select("i", scanned_html(F.col("raw"), entities).alias("s")).collect()}
        for i, raw in enumerate(texts):
            text, ranges = markup.scan_html(raw, entities)
            want = [(s, e, [x for x in markup.STYLES if x in st]) for s, e, st in ranges]
            assert (got[i].text, [(r.start, r.end, r.styles) for r in got[i].inline_styles]) == (text, want), raw[:200]


def test_no_python_in_the_plan(spark):
    for fmt in ("srt", "vtt", "sbv", "lrc"):
        plan = parse(spark.range(1).select(F.lit("x").alias("text")), fmt)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_random_ranges_are_drawn_as_by_the_plain_writers(spark):
    rng = random.Random(5)
    alphabet = ["a", "b ", "<", "&", "{", "}", "\n", "\r\n", "\u00a0", "\u00e9", "\\"]
    rows = [(0, "", [], None), (1, "x", [(0, 1, ["bold"])], (None, 1e7, 0.5)), (2, "x", [(-3, 9, ["italic"])], (8, None, None)), (3, "ab", [(1, 1, ["bold"])], (2, -0.25, 3.0))]
    for i in range(4, 900):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))
        if i % 5 == 0:  # a character of two units, at the end so that no range cuts it
            text = text.replace("\r", "") + "\U00020000"
        n = len(text.replace("\r\n", "\n"))
        ranges = [(a := rng.randint(0, n), rng.randint(a, n), rng.sample(markup.STYLES, rng.randint(1, 3))) for _ in range(rng.randint(0, 5))]
        if i % 5 == 0:
            ranges = [(a, e if e < n else n + 1, st) for a, e, st in ranges if a < n]
        place = None if i % 3 else (rng.choice([None, 1, 9]), float(rng.randint(-5, 5)), rng.randint(-999, 999) / 8)
        rows.append((i, text, ranges, place))
    df = spark.createDataFrame(rows, "i int, text string, r array<struct<start:int,end:int,styles:array<string>>>, p struct<alignment:int,x:double,y:double>").repartition(8)
    t, r = F.col("text"), F.col("r")
    got = {x.i: x for x in df.select("i", drawn_html(t, r).alias("plain"), drawn_html(t, r, True).alias("escaped"), drawn_ass(t, r, F.col("p")).alias("ass")).collect()}
    for i, text, ranges, place in rows:
        own = [(s, e, frozenset(st)) for s, e, st in ranges]
        want = (markup.render_html(text, own), markup.render_html(text, own, True), markup.render_ass(text, own, place))
        assert (got[i].plain, got[i].escaped, got[i].ass) == want, (text, ranges)


def test_no_python_in_the_writers(spark):
    """A worker for each writer of a query, on each core, with batches of 10,000 files, was most of an executor's memory."""
    cues = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(0).alias("cue_seq"), F.lit(0).cast("bigint").alias("start_ms"), F.lit(9).cast("bigint").alias("end_ms"), F.lit("x").alias("text"))
    for fmt in ("srt", "vtt", "ass", "ssa"):
        plan = write(documents_from_cues(cues, "doc_id"), fmt)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_files_reach_the_scanner_in_small_batches(spark):
    """Batches of 10,000 files were held as Python objects at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        parse(spark.range(1).select(F.lit("x").alias("text")), "ass")
        assert int(spark.conf.get(name)) <= 1024
    finally:
        spark.conf.set(name, before)
