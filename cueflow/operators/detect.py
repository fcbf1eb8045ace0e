"""Format detection: weighted signatures and the file's extension, ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions.names import FORMATS, format_of
from cueflow.functions.recorded import recorded
from cueflow.functions.text import HS, WS, fold_newlines

EXTENSION_BONUS = 30


@dataclass(frozen=True)
class Signature:
    fmt: str
    id: str
    weight: int
    kind: str  # contains, pattern, lines (at least `least` of them) or first_line
    what: str
    least: int = 1


_DOT, _COMMA = r"\d{1,3}:\d{2}:\d{2}\.\d{1,3}", r"\d{1,3}:\d{2}:\d{2},\d{1,3}"
_SHORT = r"(?:\d{1,3}:)?\d{1,2}:\d{2}\.\d{1,3}"
#: What each format is known by, and how much that weighs.
SIGNATURES = [
    Signature("srt", "srt.timing-arrow", 60, "pattern", rf"(?m)^{WS}*{_COMMA}{WS}*-->{WS}*{_COMMA}"),
    Signature("vtt", "vtt.header", 100, "first_line", "WEBVTT"),
    Signature("vtt", "vtt.timing-arrow", 40, "pattern", rf"(?m)^{WS}*{_SHORT}{WS}*-->{WS}*{_SHORT}"),
    Signature("lrc", "lrc.timestamp-lines", 60, "lines", rf"(?m)^{HS}*\[\d{{1,3}}:[0-5]\d(?:[.:]\d{{1,3}})?\]", 2),
    Signature("lrc", "lrc.id-tag", 40, "contains", "[ti:"),
    Signature("ass", "ass.script-info", 100, "contains", "[script info]"),
    Signature("ass", "ass.v4plus-styles", 100, "pattern", rf"(?i)\[V4\+{WS}*Styles\]"),
    Signature("ass", "ass.script-type", 100, "pattern", rf"(?i)ScriptType:{WS}*v4\.00\+"),
    Signature("ass", "ass.dialogue", 60, "contains", "dialogue:"),
    Signature("ssa", "ssa.v4-styles", 100, "pattern", rf"(?i)\[V4{WS}+Styles\]"),
    Signature("ssa", "ssa.script-type", 100, "pattern", rf"(?i)ScriptType:{WS}*v4\.00{WS}*(?:\n|\z)"),
    Signature("ssa", "ssa.dialogue", 60, "contains", "dialogue:"),
    Signature("sbv", "sbv.timing-comma", 60, "pattern", rf"(?m)^{WS}*{_DOT}{WS}*,{WS}*{_DOT}{WS}*(?:\n|\z)"),
]


def matches(s: Signature, text: Column) -> Column:
    if s.kind == "contains":
        return F.contains(F.lower(text), F.lit(s.what.lower()))
    if s.kind == "first_line":
        return text.rlike(rf"\A{WS}*{s.what}")
    if s.kind == "lines":
        return F.regexp_count(text, F.lit(s.what)) >= s.least
    return text.rlike(s.what)


def ranking(bits: Column, ext: Column, signatures: tuple[Signature, ...]) -> Column:
    """Formats, best first, of a file whose matching signatures are ``bits`` and whose extension's format is ``ext``.

    Formats rank by score, then matching extension, then number of matches, then registration.
    """
    ranked = []
    for order, fmt in enumerate(FORMATS):
        own = [(1 << i, s.weight) for i, s in enumerate(signatures) if s.fmt == fmt]
        mine = bits.bitwiseAND(F.lit(sum(b for b, _ in own)))
        by_ext = F.coalesce(ext == fmt, F.lit(False))
        score = F.when(by_ext, F.lit(EXTENSION_BONUS)).otherwise(0)
        for b, weight in own:
            score = score + F.when(mine.bitwiseAND(F.lit(b)) != 0, F.lit(weight)).otherwise(0)
        ranked.append(F.struct((-score).alias("rank"), (~by_ext).alias("no_ext"), (-F.bit_count(mine)).alias("few"), F.lit(order).alias("order"), F.lit(fmt).alias("format"), mine.alias("own")))
    return F.sort_array(F.array(*ranked))


def detect(df: DataFrame, text: str = "text", name: str = "path") -> DataFrame:
    """``df`` with ``format``, ``score``, ``evidence``, ``ext_matched``, ``runner_up``, ``runner_up_score`` and ``ambiguous``."""
    return _detected(df, text, name, tuple(SIGNATURES), tuple(FORMATS.values()))


@recorded
def _detected(df: DataFrame, text: str, name: str, signatures: tuple, formats: tuple) -> DataFrame:
    df = df.withColumn("__folded", fold_newlines(F.coalesce(F.col(text), F.lit(""))))
    # Each signature looks at the text once: its bit says whether it matched.
    bits = [F.when(matches(s, F.col("__folded")), F.lit(1 << i)).otherwise(0) for i, s in enumerate(signatures)]
    df = df.withColumns({"__bits": sum(bits[1:], bits[0]), "__ext": format_of(F.coalesce(F.col(name), F.lit("")))})
    df = df.withColumn("__ranked", ranking(F.col("__bits"), F.col("__ext"), signatures))
    first, second = F.get("__ranked", F.lit(0)), F.get("__ranked", F.lit(1))
    known, other = first["rank"] < 0, second["rank"] < 0
    ids = F.array(*[F.lit(s.id) for s in signatures])
    evidence = F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(signatures) - 1)), lambda i: F.getbit(first["own"].cast("bigint"), i) == 1), lambda i: F.get(ids, i))
    return df.withColumns({
        "format": F.when(known, first["format"]),
        "score": F.when(known, -first["rank"]).otherwise(0),
        "evidence": F.when(known, evidence).otherwise(F.expr("cast(array() as array<string>)")),
        "ext_matched": known & ~first["no_ext"],
        "runner_up": F.when(known & other, second["format"]),
        "runner_up_score": F.when(known & other, -second["rank"]).otherwise(0),
        "ambiguous": known & other & (first["rank"] == second["rank"]),
    }).drop("__folded", "__bits", "__ext", "__ranked")
