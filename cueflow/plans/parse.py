"""Parsers: a column of texts becomes a column of documents, one row each.

A parsed row holds ``title``, ``language``, ``fields``, ``styles``, ``cues`` and ``error``; cues and styles
are arrays, so parsing is a narrow projection that streams, shuffles nothing and keeps a file's cues
together. ``cues_of`` gives the relational form. A file that breaks its format's rules has a non-null
``error`` and no cues; nothing is raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions import markup
from cueflow.functions.asslines import with_sections
from cueflow.functions.emphasis import scanned_html
from cueflow.functions.recorded import recorded
from cueflow.functions.text import HS, WS, ass_plain, field_ci, has_visible_text, last_wins, let, normalize, strip_overrides, strip_tags, trim_ws
from cueflow.functions.timecode import parse_ms
from cueflow.sources.staging import bound_batches, spread

FALLBACK_MS = 5000
PAIR = "struct<k:string,v:string>"
RAW = f"struct<start_ms:bigint,end_ms:bigint,raw:string,style_ref:string,metadata:array<{PAIR}>>"
STYLE = f"struct<name:string,fields:array<{PAIR}>>"
RANGES = "array<struct<start:int,end:int,styles:array<string>>>"
POSITION = "struct<alignment:int,x:double,y:double>"
CUE = f"struct<start_ms:bigint,end_ms:bigint,text:string,inline_styles:{RANGES},style_ref:string,position:{POSITION},metadata:array<{PAIR}>>"
ERROR = "struct<failure:string,detail:string>"

_TOKEN_TIME = rf"\d{{1,3}}{WS}*:{WS}*[0-5]?\d{WS}*:{WS}*[0-5]?\d{WS}*[.,]{WS}*\d{{1,6}}"
_NOT_WS = WS.replace("[", "[^", 1)


def none(kind: str) -> Column:
    return F.expr(f"cast(null as {kind})")


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def pair(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def raw_cue(start: Column, end: Column, raw: Column, style_ref: Column | None = None, metadata: Column | None = None) -> Column:
    s = F.struct(
        start.alias("start_ms"),
        end.alias("end_ms"),
        raw.alias("raw"),
        (style_ref if style_ref is not None else none("string")).alias("style_ref"),
        (metadata if metadata is not None else empty(PAIR)).alias("metadata"),
    )
    return s.cast(RAW)


def blocks(text: Column) -> Column:
    """Maximal runs of non-blank lines."""
    # With blank lines at both ends one pattern cuts there too.
    return F.filter(F.split(F.concat(F.lit("\n\n"), text, F.lit("\n\n")), rf"\n(?:{HS}*+\n)++"), has_visible_text)


def syntax_error(detail: Column) -> Column:
    return F.struct(F.lit("invalidSubtitleSyntax").alias("failure"), detail.alias("detail")).cast(ERROR)


def _whole_file(cues: Column, label: str, what: str, empty_detail: str | None) -> Column:
    """The error of a file in which every block must parse."""
    bad = F.exists(cues, lambda c: c["start_ms"].isNull() | c["end_ms"].isNull())
    out = F.when(bad, syntax_error(F.lit(f"{label}: a block has no valid {what}.")))
    return out if empty_detail is None else F.when(F.size(cues) == 0, syntax_error(F.lit(empty_detail))).otherwise(out)


def _finish(df: DataFrame, scan: str) -> DataFrame:
    """Turns ``raw_cues`` into ``cues``. Only files with markup are sent to the scanner."""
    marks = "{\\" if scan == "ass" else "<{\r&" if scan == "html_entities" else "<{\r"
    holds = lambda r: reduce(lambda a, b: a | b, [F.contains(r, F.lit(m)) for m in marks])
    strip = (lambda r: r) if scan == "ass" else strip_overrides
    marked = F.exists("raw_cues", lambda c: holds(c["raw"])) & F.col("error").isNull()
    df = df.withColumn("__texts", F.when(marked, F.transform("raw_cues", lambda c: strip(c["raw"]))))
    # Override blocks hold nested parentheses, which take a scanner in Python.
    scanned = markup.scanner(scan)(F.col("__texts")) if scan == "ass" else F.transform("__texts", lambda t: scanned_html(t, scan == "html_entities"))
    df = df.withColumn("__scanned", scanned)

    def cue(c: Column, text: Column, ranges: Column, position: Column) -> Column:
        return F.struct(c["start_ms"], c["end_ms"], text, ranges, c["style_ref"], position, c["metadata"]).cast(CUE)

    plain = F.transform("raw_cues", lambda c: cue(c, c["raw"], empty(RANGES[6:-1]), none(POSITION)))
    scanned = F.zip_with("raw_cues", "__scanned", lambda c, s: cue(c, s["text"], s["inline_styles"], s["position"]))
    cues = F.when(F.col("error").isNotNull(), empty(CUE)).when(F.col("__scanned").isNotNull(), scanned).otherwise(plain)
    return df.withColumn("cues", cues).drop("raw_cues", "__texts", "__scanned")


def _document(df: DataFrame, raw_cues: Column, error: Column | None, title: Column | None = None, language: Column | None = None, fields: Column | None = None, styles: Column | None = None) -> DataFrame:
    return df.withColumns({
        "raw_cues": raw_cues.cast(f"array<{RAW}>"),
        "title": title if title is not None else none("string"),
        "language": language if language is not None else none("string"),
        "fields": fields if fields is not None else empty(PAIR),
        "styles": styles if styles is not None else empty(STYLE),
        "error": error if error is not None else none(ERROR),
    })


_SRT_BLOCK = rf"\A(?:{HS}*(\d+){HS}*\n)?([^\n]*)(?:\n([\s\S]*))?\z"


def _before(line: Column, mark: str) -> Column:
    return F.substring_index(line, mark, 1)


def _after(line: Column, mark: str) -> Column:
    return F.when(F.instr(line, mark) > 0, F.substr(line, F.instr(line, mark) + len(mark)))


def _first_line(block: Column) -> Column:
    return F.substring_index(block, "\n", 1)


def _below(block: Column) -> Column:
    """What stands below the first line; empty if there is nothing."""
    return F.when(F.instr(block, "\n") > 0, F.substr(block, F.instr(block, "\n") + 1)).otherwise("")


# Patterns look at a block's first lines only; the text below is cut off by position.


@recorded
def parse_srt(df: DataFrame) -> DataFrame:
    def cue(b: Column) -> Column:
        number = F.when(F.instr(b, "\n") > 0, F.regexp_extract(_first_line(b), rf"\A{HS}*(\d+){HS}*\z", 1)).otherwise("")

        def timed(n: Column, body: Column) -> Column:
            meta = F.when(n != "", F.array(pair(F.lit("srt.index"), F.regexp_replace(n, r"\A0+(?=\d)", "")))).otherwise(empty(PAIR))
            return let(_first_line(body), lambda line: raw_cue(
                F.when(F.instr(line, "-->") > 0, parse_ms(trim_ws(_before(line, "-->")))),
                parse_ms(F.regexp_extract(_after(line, "-->"), _TOKEN_TIME, 0)),
                _below(body), metadata=meta,
            ))

        return let(number, lambda n: let(F.when(n != "", _below(b)).otherwise(b), lambda body: timed(n, body)))

    df = df.withColumn("__blocks", blocks(normalize(F.col("text"))))
    df = df.withColumn("__cues", F.transform("__blocks", cue))
    cues = F.col("__cues")
    return _finish(_document(df, cues, _whole_file(cues, "SRT", "timing line", "SRT content is empty.")), "html").drop("__blocks", "__cues")


@recorded
def parse_sbv(df: DataFrame) -> DataFrame:
    def cue(b: Column) -> Column:
        text = strip_tags(strip_overrides(_below(b)))
        return let(_first_line(b), lambda line: raw_cue(F.when(F.instr(line, ",") > 0, parse_ms(trim_ws(_before(line, ",")))), parse_ms(trim_ws(_after(line, ","))), text))

    df = df.withColumn("__blocks", blocks(normalize(F.col("text"))))
    df = df.withColumn("__cues", F.transform("__blocks", cue))
    cues = F.col("__cues")
    out = _document(df, cues, _whole_file(cues, "SBV", "timing line", "SBV content is empty."))
    return _unmarked(out).drop("__blocks", "__cues")


def _unmarked(df: DataFrame) -> DataFrame:
    """``raw_cues`` are texts already; emphasis is not kept."""
    cues = F.transform("raw_cues", lambda c: F.struct(c["start_ms"], c["end_ms"], c["raw"], empty(RANGES[6:-1]), c["style_ref"], none(POSITION), c["metadata"]).cast(CUE))
    return df.withColumn("cues", F.when(F.col("error").isNotNull(), empty(CUE)).otherwise(cues)).drop("raw_cues")


_VTT_HEADER = rf"\A(?:{HS}*\n)*{HS}*WEBVTT[^\n]*(?:\n((?:(?!{HS}*(?:\n|\z))(?:(?!-->)[^\n])*+(?:\n|\z))*+))?"


@recorded
def parse_vtt(df: DataFrame) -> DataFrame:
    df = df.withColumn("__text", normalize(F.col("text")))
    text = F.col("__text")
    is_vtt = text.rlike(_VTT_HEADER)
    df = df.withColumn("__head", F.filter(F.split(F.regexp_extract(text, _VTT_HEADER, 1), "\n"), lambda x: x != ""))
    df = df.withColumn("__blocks", F.when(is_vtt, blocks(F.regexp_replace(text, _VTT_HEADER, ""))).otherwise(empty("string")))
    at = lambda x: F.regexp_instr(x, F.lit("[:=]"))
    entries = F.transform(F.filter("__head", lambda x: at(x) > 0), lambda x: pair(trim_ws(F.substr(x, F.lit(1), at(x) - 1)), trim_ws(F.substr(x, at(x) + 1))))
    fields = last_wins(F.filter(entries, lambda e: e["k"] != ""))
    first = F.get("__head", F.lit(0))
    title = F.when(at(first) == 0, trim_ws(first))
    df = df.withColumn("__fields", fields)
    language = F.nullif(field_ci(F.col("__fields"), "Language"), F.lit(""))

    def kept(b: Column) -> Column:
        line = trim_ws(F.substring_index(b, "\n", 1))
        return ~(line.rlike(r"\ANOTE(?:\z|[ \t])") | line.isin("STYLE", "REGION"))

    def cue(b: Column) -> Column:
        settings = lambda after: trim_ws(F.regexp_replace(after, rf"\A{WS}*{_NOT_WS}+", ""))
        known = lambda k, value: let(value, lambda v: F.when(F.coalesce(v, F.lit("")) != "", F.array(pair(F.lit(k), v))).otherwise(empty(PAIR)))

        def of(identifier: Column, line: Column, after: Column, text: Column) -> Column:
            meta = F.concat(known("vtt.identifier", identifier), known("vtt.settings", settings(after)))
            start = F.when(line.isNotNull(), parse_ms(trim_ws(_before(line, "-->")), 2))
            return raw_cue(start, parse_ms(F.regexp_extract(after, rf"{_NOT_WS}+", 0), 2), F.when(line.isNotNull(), text).otherwise(""), metadata=meta)

        def timed(identifier: Column, body: Column) -> Column:
            line = F.when(F.instr(_first_line(body), "-->") > 0, _first_line(body))
            return let(line, lambda x: of(F.when(x.isNotNull(), identifier), x, _after(x, "-->"), _below(body)))

        # A first line without an arrow is an identifier.
        return let(F.when(F.instr(_first_line(b), "-->") > 0, "").otherwise(_first_line(b)), lambda n: let(F.when(n != "", _below(b)).otherwise(b), lambda body: timed(n, body)))

    df = df.withColumn("__cues", F.transform(F.filter("__blocks", kept), cue))
    error = F.when(~is_vtt, syntax_error(F.lit("Not a WebVTT file: the first line must start with WEBVTT."))).otherwise(_whole_file(F.col("__cues"), "WebVTT", "timing line", None))
    out = _document(df, F.col("__cues"), error, title, language, F.col("__fields"))
    return _finish(out, "html_entities").drop("__text", "__head", "__blocks", "__fields", "__cues")


_LRC_TAGS = r"\A(?:\[[^\[\]]*\])+"
# A tag that is a time, one that is metadata, and the time of a word.
_LRC_TIME = r"\A\d{1,3}:[0-5]\d(?::[0-5]\d)?(?:[.:]\d{1,3})?\z"
_LRC_META = r"\A([A-Za-z][A-Za-z0-9_-]*):(.*)\z"
_LRC_WORD = r"<\d{1,3}:[0-5]\d(?::[0-5]\d)?(?:[.:]\d{1,3})?>"


@recorded
def parse_lrc(df: DataFrame, fallback_ms: int = FALLBACK_MS) -> DataFrame:
    """Cues come sorted by start with their ends filled, as this format has none."""
    lines = F.filter(F.split(normalize(F.col("text")), "\n"), lambda x: x.rlike(_LRC_TAGS))

    def tags(line: Column) -> Column:
        run = F.regexp_extract(line, _LRC_TAGS, 0)
        rest = strip_tags(strip_overrides(F.regexp_replace(F.substr(line, F.length(run) + 1), _LRC_WORD, "")))
        return F.transform(F.regexp_extract_all(run, F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), lambda t: F.struct(t.alias("tag"), rest.alias("rest")))

    df = df.withColumn("__tags", F.flatten(F.transform(lines, tags)))
    stamp = lambda t: F.coalesce(parse_ms(t, 2), parse_ms(F.concat(t, F.lit(".0")), 2))
    starts = F.transform(F.filter("__tags", lambda t: t["tag"].rlike(_LRC_TIME)), lambda t, i: F.struct(stamp(t["tag"]).alias("s"), i.alias("i"), t["rest"].alias("rest")))
    df = df.withColumn("__starts", F.sort_array(F.filter(starts, lambda s: s["s"].isNotNull())))
    s = F.col("__starts")
    metas = F.filter("__tags", lambda t: (~t["tag"].rlike(_LRC_TIME)) & t["tag"].rlike(_LRC_META))
    df = df.withColumn("__metas", F.transform(metas, lambda t: pair(F.regexp_extract(t["tag"], _LRC_META, 1), F.regexp_extract(t["tag"], _LRC_META, 2))))
    title = F.element_at(F.concat(F.array(none("string")), F.transform(F.filter("__metas", lambda e: F.lower(e["k"]) == "ti"), lambda e: e["v"])), -1)

    def cue(c: Column, after: Column) -> Column:
        following = after["s"]
        return raw_cue(c["s"], F.when(following > c["s"], following).otherwise(c["s"] + fallback_ms), c["rest"])

    nothing = (F.size(s) == 0) & (F.size("__metas") == 0)
    error = F.when(nothing, syntax_error(F.lit("Not an LRC file: no timestamp tags or metadata tags found.")))
    out = _document(df, F.zip_with(s, F.slice(s, 2, F.size(s)), cue), error, title, fields=last_wins(F.col("__metas")))
    return _unmarked(out).drop("__tags", "__starts", "__metas")


@recorded
def parse_ass(df: DataFrame) -> DataFrame:
    """ASS and SSA: either dialect's style section is read."""
    df = with_sections(df.withColumn("__text", normalize(F.col("text"))), "__text")
    cue = lambda e: raw_cue(parse_ms(e["start"]), parse_ms(e["end"]), e["text"], e["style"], e["rest"])
    df = df.withColumn("__cues", F.transform("__events", cue))
    bad = F.exists("__cues", lambda c: c["start_ms"].isNull() | c["end_ms"].isNull())
    error = F.when(bad, syntax_error(F.lit("Invalid start or end time of a dialogue line.")))
    out = _document(df, F.col("__cues"), error, F.col("__title"), fields=F.col("__fields"), styles=F.col("__styles"))
    return _finish(out, "ass").drop("__text", "__title", "__fields", "__styles", "__events", "__cues")


PARSERS = {"srt": parse_srt, "vtt": parse_vtt, "lrc": parse_lrc, "sbv": parse_sbv, "ass": parse_ass, "ssa": parse_ass}


def parse(df: DataFrame, fmt: str) -> DataFrame:
    """``df`` (with a ``text`` column) as documents of one format; ``text`` is dropped."""
    if PARSERS[fmt] is parse_ass and isinstance(df, DataFrame):
        bound_batches(df.sparkSession)
    return PARSERS[fmt](df.withColumn("text", F.coalesce("text", F.lit("")))).withColumn("format", F.lit(fmt)).drop("text")


def by_format(df: DataFrame, fmt: str, step: Callable[[str, DataFrame], DataFrame], formats: Iterable[str] | None = None) -> DataFrame:
    """The union over formats of ``step(format, its rows of df)``; column ``fmt`` names a row's format.

    Each branch is a plan of its own size. ``df`` is read once a format, so it should be a table.
    """
    return reduce(DataFrame.unionByName, [step(f, df.filter(F.col(fmt) == f)) for f in formats or list(PARSERS)])


def _elements(documents: DataFrame, array: str, at: str, one: str, *keys: str) -> DataFrame:
    """A row for each element of an array.

    Over the plain form the optimizer first filters by the array's size, and so makes the whole array twice.
    """
    each = documents.select(*keys, F.posexplode_outer(array).alias(at, one))
    return each.filter(F.col(at).isNotNull()).select(*keys, at, f"{one}.*")


def cues_of(documents: DataFrame, *keys: str) -> DataFrame:
    """One row per cue: the keys, cue_seq (from 0) and the cue's columns."""
    return _elements(documents, "cues", "cue_seq", "cue", *keys)


def styles_of(documents: DataFrame, *keys: str) -> DataFrame:
    return _elements(documents, "styles", "style_seq", "style", *keys)


def documents_from_cues(cues: DataFrame, *keys: str, fmt: str = "srt") -> DataFrame:
    """Documents of a table of cues (keys, cue_seq, start_ms, end_ms, text; style_ref if there is one)."""
    style = F.col("style_ref") if "style_ref" in cues.columns else none("string")
    cue = F.struct("start_ms", "end_ms", "text", empty(RANGES[6:-1]), style, none(POSITION), empty(PAIR)).cast(CUE)
    rows = cues.select(*keys, F.struct(F.col("cue_seq").alias("seq"), cue.alias("cue")).alias("row"))
    docs = spread(rows, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    docs = docs.withColumn("cues", F.transform("rows", lambda r: r["cue"])).drop("rows")
    return _document(docs, empty(RAW), None).drop("raw_cues").withColumn("format", F.lit(fmt))


__all__ = ["PARSERS", "parse", "cues_of", "styles_of", "documents_from_cues", "ass_plain"]
