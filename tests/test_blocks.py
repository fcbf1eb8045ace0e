"""Blocks of SRT and WebVTT cut by position, against the patterns that say what they are."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cueflow.functions.text import normalize
from cueflow.plans.parse import blocks, parse

_HS = "[ \\t\\x0b\\f\u00a0\u3000\ufeff]"
_SRT = re.compile(rf"\A(?:{_HS}*([0-9]+){_HS}*\n)?([^\n]*)(?:\n([\s\S]*))?\Z")
_VTT = re.compile(r"\A(?:((?:(?!-->)[^\n])*)\n)?((?:(?!-->)[^\n])*-->[^\n]*)(?:\n([\s\S]*))?\Z")
_TIME = {"srt": "00:00:01,000 --> 00:00:02,500", "vtt": "00:01.000 --> 00:00:02.500 line:3"}


def _plain_blocks(text: str) -> list[str]:
    text = re.sub(r"\r\n?", "\n", text.removeprefix("\ufeff"))
    inner = re.sub(rf"\A(?:{_HS}*\n)+|(?:\n{_HS}*)+\Z", "", text)
    return [b for b in re.split(rf"\n(?:{_HS}*\n)+", inner) if re.search(rf"[^\n{_HS[1:]}", b)]


def _texts(fmt: str, n: int = 400) -> list[str]:
    rnd, out = random.Random(fmt), ["", "\n", " \n ", "\ufeff\ufeffa", "a\r\r\nb", "7", "7\n", "-->"]
    pieces = ["1", " 007 ", "x", "a b", "two\nlines", "end  ", "12", "\u3000", "--> no"]
    breaks = ["\n\n", "\n \n", "\r\n\r\n", "\n\n\n", "\n\t\n\n", "\r\r"]
    for _ in range(n):
        some = ["\n".join(rnd.sample(pieces, rnd.randrange(2)) + [_TIME[fmt]] * (rnd.random() < 0.97) + rnd.sample(pieces, rnd.randrange(3))) for _ in range(rnd.randrange(1, 5))]
        body = "".join(b + rnd.choice(breaks) for b in some)
        out.append(rnd.choice(["", "\ufeff", "\n", " \n\n"]) + body.rstrip("\n") + rnd.choice(["", "\n", " ", "\n  ", "\n\n"]))
    return out


@pytest.mark.parametrize("fmt", ["srt", "vtt"])
def test_blocks_equal_their_patterns(spark, fmt):
    texts = _texts(fmt)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    cut = {r[0]: list(r[1]) for r in df.select("id", blocks(normalize(F.col("text")))).collect()}
    assert cut == {i: _plain_blocks(t) for i, t in enumerate(texts)}
    head = "WEBVTT\n\n" if fmt == "vtt" else ""
    docs = parse(df.withColumn("text", F.concat(F.lit(head), "text")), fmt).select("id", "error", F.transform("cues", lambda c: F.struct(c["start_ms"], c["end_ms"], c["text"], F.map_from_entries(c["metadata"]))).alias("cues"))
    good = 0
    for r in docs.collect():
        found, bad = [], False
        for b in _plain_blocks(head + texts[r["id"]])[1 if head else 0 :]:
            m = (_VTT if head else _SRT).match(b)
            bad = bad or not m or m[2].strip(chr(0xFEFF) + " ") != _TIME[fmt]
            name = m and m[1] and (m[1] if head else m[1].lstrip("0") or "0")
            meta = ({"vtt.identifier" if head else "srt.index": name} if name else {}) | ({"vtt.settings": "line:3"} if head else {})
            found.append((1000, 2500, m and (m[3] or ""), meta))
        assert (r["error"] is not None) == (bad or (not head and not found)), texts[r["id"]]
        if r["error"] is None:
            assert [tuple(c) for c in r["cues"]] == found
            good += len(found)
    assert good > 200


@pytest.mark.parametrize("fmt", ["srt", "vtt"])
def test_no_pattern_runs_over_the_texts_of_cues(spark, fmt):
    plan = parse(spark.createDataFrame([("a",)], "text string"), fmt)._jdf.queryExecution().optimizedPlan().toString()
    assert r"[\s\S]*" not in plan
