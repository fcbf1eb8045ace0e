"""Writers: documents (see ``parse``) become texts, row by row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions.emphasis import drawn_ass, drawn_html
from cueflow.functions.recorded import recorded
from cueflow.functions.text import ass_escape, escape_entities, field_ci, fold_newlines, has_visible_text, let, trim_ws
from cueflow.functions.timecode import ass_time, lrc_time, sbv_time, srt_time, vtt_time
from cueflow.plans.parse import CUE, FALLBACK_MS, PAIR, STYLE, empty

# Sections, fields in their order, and what a missing one is written as.
STYLE_FIELDS = {
    "ass": "Name Fontname Fontsize PrimaryColour SecondaryColour OutlineColour BackColour Bold Italic Underline StrikeOut ScaleX ScaleY Spacing Angle BorderStyle Outline Shadow Alignment MarginL MarginR MarginV Encoding".split(),
    "ssa": "Name Fontname Fontsize PrimaryColour SecondaryColour TertiaryColour BackColour Bold Italic BorderStyle Outline Shadow Alignment MarginL MarginR MarginV AlphaLevel Encoding".split(),
}
EVENT_FIELDS = {
    "ass": "Layer Start End Style Name MarginL MarginR MarginV Effect Text".split(),
    "ssa": "Marked Start End Style Name MarginL MarginR MarginV Effect Text".split(),
}
STYLE_DEFAULTS = {
    "Name": "Default", "Fontname": "Arial", "Fontsize": "20", "PrimaryColour": "&H00FFFFFF", "SecondaryColour": "&H000000FF",
    "OutlineColour": "&H00000000", "TertiaryColour": "&H00000000", "BackColour": "&H00000000", "Bold": "0", "Italic": "0",
    "Underline": "0", "StrikeOut": "0", "ScaleX": "100", "ScaleY": "100", "Spacing": "0", "Angle": "0", "BorderStyle": "1",
    "Outline": "2", "Shadow": "0", "Alignment": "2", "MarginL": "10", "MarginR": "10", "MarginV": "10", "AlphaLevel": "0", "Encoding": "1",
}
SCRIPT_TYPE = {"ass": "v4.00+", "ssa": "v4.00"}
STYLE_SECTION = {"ass": "[V4+ Styles]", "ssa": "[V4 Styles]"}
PLAY_RES = {"ass": ("1920", "1080"), "ssa": ("384", "288")}
LRC_FIRST = ("ti", "ar", "al", "by", "offset", "length")


def with_ends(cues: Column, fallback_ms: int = FALLBACK_MS) -> Column:
    """Cues in their order, each missing end filled by the next later start, else by the fallback."""
    def filled(c: Column) -> Column:
        order = F.array_sort(F.transform(c, lambda x, i: F.struct(x["start_ms"].alias("s"), i.alias("i"))))
        after = let(order, lambda o: F.zip_with(o, F.slice(o, 2, F.size(o)), lambda x, y: F.struct(x["i"].alias("i"), F.when(y["s"] > x["s"], y["s"]).otherwise(x["s"] + fallback_ms).alias("end"))))
        return F.zip_with(c, F.array_sort(after), lambda x, e: x.withField("end_ms", F.coalesce(x["end_ms"], e["end"])))

    return let(cues, lambda c: F.when(F.exists(c, lambda x: x["end_ms"].isNull()), filled(c)).otherwise(c))


def _visible(df: DataFrame, cues: Column) -> DataFrame:
    return df.withColumn("__cues", F.filter(cues, lambda c: has_visible_text(c["text"])))


def _rendered(df: DataFrame, kind: str, plain) -> DataFrame:
    """``__lines``: the texts of ``__cues``, with tags or override blocks where a cue has emphasis or a position."""
    def drawn(c: Column) -> Column:
        if kind == "ass":
            return drawn_ass(c["text"], c["inline_styles"], c["position"])
        return drawn_html(c["text"], c["inline_styles"], kind == "html_escaped")

    def line(c: Column) -> Column:
        marked = (F.size(c["inline_styles"]) > 0) | (c["position"].isNotNull() if kind == "ass" else F.lit(False))
        return F.when(marked, drawn(c)).otherwise(plain(c["text"]))

    return df.withColumn("__lines", F.transform("__cues", line))


def _blocks(df: DataFrame, block) -> Column:
    """Blocks of (cue, its text, number from 0) joined by blank lines, ended by a line feed."""
    both = F.transform(F.arrays_zip("__cues", "__lines"), lambda z, i: block(z["__cues"], z["__lines"], i))
    return F.when(F.size("__cues") == 0, F.lit("")).otherwise(F.concat(F.array_join(both, "\n\n"), F.lit("\n")))


@recorded
def write_srt(df: DataFrame) -> DataFrame:
    df = _rendered(_visible(df, with_ends(F.col("cues"))), "html", fold_newlines)
    block = lambda c, t, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(c["start_ms"]), F.lit(" --> "), srt_time(c["end_ms"]), F.lit("\n"), t)
    return df.withColumn("content", _blocks(df, block))


def meta(c: Column, key: str) -> Column:
    return F.get(F.filter(c["metadata"], lambda e: e["k"] == key), F.lit(0))["v"]


@recorded
def write_vtt(df: DataFrame) -> DataFrame:
    df = _rendered(_visible(df, with_ends(F.col("cues"))), "html_escaped", lambda t: escape_entities(fold_newlines(t)))

    def block(c: Column, t: Column, i: Column) -> Column:
        name, settings = F.coalesce(meta(c, "vtt.identifier"), F.lit("")), F.coalesce(meta(c, "vtt.settings"), F.lit(""))
        return F.concat(
            F.when(name != "", F.concat(name, F.lit("\n"))).otherwise(""),
            vtt_time(c["start_ms"]), F.lit(" --> "), vtt_time(c["end_ms"]),
            F.when(settings != "", F.concat(F.lit(" "), settings)).otherwise(""),
            F.lit("\n"), t,
        )

    head = F.concat(F.lit("WEBVTT\n"), F.array_join(F.transform("fields", lambda e: F.concat(e["k"], F.lit(": "), e["v"], F.lit("\n"))), ""))
    return df.withColumn("content", F.when(F.size("__cues") == 0, head).otherwise(F.concat(head, F.lit("\n"), _blocks(df, block))))


@recorded
def write_sbv(df: DataFrame) -> DataFrame:
    df = _visible(df, with_ends(F.col("cues"))).withColumn("__lines", F.transform("__cues", lambda c: c["text"]))
    return df.withColumn("content", _blocks(df, lambda c, t, i: F.concat(sbv_time(c["start_ms"]), F.lit(","), sbv_time(c["end_ms"]), F.lit("\n"), t)))


@recorded
def write_lrc(df: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.transform("cues", lambda c, i: F.struct(c["start_ms"].alias("s"), i.alias("i"), c["text"].alias("text")))), lambda x: x)
    lines = F.transform(F.filter(ordered, lambda x: has_visible_text(x["text"])), lambda x: F.concat(F.lit("["), lrc_time(x["s"]), F.lit("]"), F.array_join(F.transform(F.split(x["text"], "\n"), trim_ws), " ")))
    named = lambda key: F.slice(F.filter("fields", lambda e: F.lower(e["k"]) == key), 1, 1)
    df = df.withColumn("__first", F.concat(*[named(k) for k in LRC_FIRST]))
    rest = F.filter("fields", lambda e: ~F.array_contains(F.transform("__first", lambda x: x["k"]), e["k"]))
    df = df.withColumn("__tags", F.transform(F.concat("__first", rest), lambda e: F.concat(F.lit("["), e["k"], F.lit(":"), e["v"], F.lit("]")))).withColumn("__cue_lines", lines)
    blank = F.when((F.size("__tags") > 0) & (F.size("__cue_lines") > 0), F.array(F.lit(""))).otherwise(empty("string"))
    whole = F.concat("__tags", blank, "__cue_lines")
    return df.withColumn("content", F.when(F.size(whole) == 0, F.lit("")).otherwise(F.concat(F.array_join(whole, "\n"), F.lit("\n"))))


def _meta_ci(c: Column, key: str) -> Column:
    return F.get(F.filter(c["metadata"], lambda e: F.lower(e["k"]) == key.lower()), F.lit(0))["v"]


@recorded
def write_ass(df: DataFrame, dialect: str = "ass") -> DataFrame:
    df = _rendered(_visible(df, with_ends(F.col("cues"))), "ass", ass_escape)
    taken = ["scripttype", "title"]
    lower = F.transform("fields", lambda e: F.lower(e["k"]))
    kept = F.filter("fields", lambda e, i: (~F.lower(e["k"]).isin(*taken)) & (trim_ws(e["k"]) != "") & (F.array_position(lower, F.lower(e["k"])) == i + 1))
    line = lambda k, v: F.concat(k, F.lit(": "), v, F.lit("\n"))
    width, height = PLAY_RES[dialect]
    info = [
        F.lit(f"[Script Info]\nScriptType: {SCRIPT_TYPE[dialect]}\n"),
        line(F.lit("Title"), F.coalesce("title", field_ci(F.col("fields"), "Title"), F.lit(""))),
        F.array_join(F.transform(kept, lambda e: line(e["k"], e["v"])), ""),
        *[F.when(F.array_contains(lower, k.lower()), F.lit("")).otherwise(F.lit(f"{k}: {v}\n")) for k, v in (("WrapStyle", "0"), ("ScaledBorderAndShadow", "yes"), ("PlayResX", width), ("PlayResY", height))],
    ]
    names = STYLE_FIELDS[dialect]
    styles = F.when(F.size("styles") > 0, F.col("styles")).otherwise(F.array(F.struct(F.lit("Default").alias("name"), empty(PAIR).alias("fields")).cast(STYLE)))

    def style_line(s: Column) -> Column:
        values = [F.when(s["name"] == "", F.lit("Default")).otherwise(s["name"])] + [F.coalesce(field_ci(s["fields"], n), F.lit(STYLE_DEFAULTS[n])) for n in names[1:]]
        return F.concat(F.lit("Style: "), F.concat_ws(",", *values), F.lit("\n"))

    own, other = ("Layer", "Marked") if dialect == "ass" else ("Marked", "Layer")

    def layer(c: Column) -> Column:
        raw = F.coalesce(_meta_ci(c, own), _meta_ci(c, other), F.lit(""))
        if dialect == "ass":
            return F.when(raw == "", F.lit("0")).otherwise(raw)
        return F.when(raw == "", F.lit("Marked=0")).when(trim_ws(raw).rlike(r"\A[+-]?\d+\z"), F.concat(F.lit("Marked="), raw)).otherwise(raw)

    def event_line(c: Column, text: Column) -> Column:
        number = lambda k: F.coalesce(F.nullif(_meta_ci(c, k), F.lit("")), F.lit("0"))
        word = lambda k: F.coalesce(_meta_ci(c, k), F.lit(""))
        style = F.coalesce(F.nullif(trim_ws(c["style_ref"]), F.lit("")), F.lit("Default"))
        values = [layer(c), ass_time(c["start_ms"]), ass_time(c["end_ms"]), style, word("Name"), number("MarginL"), number("MarginR"), number("MarginV"), word("Effect"), text]
        return F.concat(F.lit("Dialogue: "), F.concat_ws(",", *values), F.lit("\n"))

    content = F.concat(
        *info,
        F.lit(f"\n{STYLE_SECTION[dialect]}\nFormat: {', '.join(names)}\n"),
        F.array_join(F.transform(styles, style_line), ""),
        F.lit(f"\n[Events]\nFormat: {', '.join(EVENT_FIELDS[dialect])}\n"),
        F.array_join(F.zip_with("__cues", "__lines", event_line), ""),
    )
    return df.withColumn("content", content)


WRITERS = {"srt": write_srt, "vtt": write_vtt, "lrc": write_lrc, "sbv": write_sbv, "ass": write_ass, "ssa": lambda df: write_ass(df, "ssa")}


def write(documents: DataFrame, fmt: str) -> DataFrame:
    """``documents`` with their text in one format in column ``content``."""
    out = WRITERS[fmt](documents)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


__all__ = ["WRITERS", "write", "with_ends", "CUE"]
