"""ASS files in expressions against the same lines read one by one."""

import random

from pyspark.sql import functions as F

from cueflow.functions.asslines import with_sections
from tests.plain_ass import read_sections

HEADS = ["[Script Info]", "[ script info ]", "[V4+ Styles]", "[v4 styles]", "[Events]", "[EVENTS] ", "[Fonts]", "[]", "[a] b]", "[open", "\u2003[Events]\u00a0"]
ROWS = [
    "Format: Layer, Start, End, Style, Text", "format :Start,End , ,Text,START", "Format:", "Format: Name, Fontname, name", "FORMAT: Text", "Dialogue: 0,0:00:01.00,0:00:02.00,Main,Hello, world", "dialogue:1,2", "Dialogue:  ", "Comment: 0,1,2,3,4",
    "Style: Main, Arial,x", "style:Side", "Style Main,Arial", "; Format: Start, End, Text", ";Title: no", "Title: One", "title: Two: three", "Title:", ": nothing", "Key : v", "Key: w", "KEY: x", "", "  ", "\t; c", "Dialogue: a,b,c,,e,f,g", "x\u2028Dialogue: 1,2,3,4,5", "Dialogue:a\u0085b,c,d,e,f",
]


def _plain(r):
    return {"title": r["__title"], "info": [e.asDict() for e in r["__fields"]], "styles": [{"name": s.name, "fields": [e.asDict() for e in s["fields"]]} for s in r["__styles"]], "events": [e.asDict(recursive=True) for e in r["__events"]]}


def test_sections_equal_plain_reading(spark):
    rng = random.Random(5)
    texts = ["", "\n", "[Events]", "Dialogue: 1"]
    for _ in range(400):
        texts.append("\n".join(rng.choice(HEADS if rng.random() < 0.25 else ROWS) for _ in range(rng.randint(1, 25))))
    texts.append("[Events]\nFormat: Start, End, Text\n" + "Dialogue: 0:00:01.00,0:00:02.00,x\n" * 20000)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    got = {r.i: _plain(r) for r in with_sections(df, "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == read_sections(t), t[:500]


def test_no_python_in_the_plan(spark):
    from cueflow.plans.parse import parse

    plan = parse(spark.range(1).select(F.lit("x").alias("text")), "ass").select("fields", "styles")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
