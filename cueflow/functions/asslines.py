"""The lines of an ASS or SSA file: sections, and the ``Format:`` lines that name the columns below them.

What a line means depends on the section and the format line above it. A text is cut at its headers, the pieces of one
kind are put together, and they are cut again at their format lines, so each row stands in the piece of its columns. All of
it is built-in expressions, each a pass over the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions.text import HS, last_wins, let, trim_ws

_PAIR = "struct<k:string,v:string>"
_HEADER = rf"(?md)^{HS}*\[([^\n]*)\]{HS}*$"
#: Section headers by what their lines are read as; others are passed over.
_KINDS = {"info": ("script info",), "style": ("v4+ styles", "v4 styles"), "event": ("events",)}
_EVENT = f"struct<start:string,end:string,text:string,style:string,rest:array<{_PAIR}>>"
_SPECIAL = ("start", "end", "text", "style")


def _line(key: str) -> str:
    """Lines of a key, whatever its case; the group is what stands behind the colon."""
    return rf"(?mid)^{HS}*{key}{HS}*:([^\n]*)$"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _cells(names: Column, row: Column) -> Column:
    """The row's values under their names; the last one keeps its commas, missing ones are empty."""
    parts = F.split(row, ",", F.size(names))
    return let(parts, lambda p: F.transform(names, lambda n, i: F.struct(n.alias("k"), trim_ws(F.coalesce(F.get(p, i), F.lit(""))).alias("v"))))


def _first(cells: Column, name: str) -> Column:
    """The value under a name, in lower case; of names that differ in case only the first counts."""
    return F.get(F.filter(cells, lambda c: F.lower(c["k"]) == name), F.lit(0))["v"]


def _events(names: Column, found: Column, none: Column) -> Column:
    """The rows below a format line as events; none where a column that they need is missing.

    Where each value stands is settled once a format line, not once a row. Of columns named twice the last one counts.
    """
    at = lambda name: F.array_position(F.transform(names, F.lower), name).cast("int") - 1
    others = F.filter(F.transform(names, lambda n, i: F.struct(n.alias("k"), i.alias("v"))), lambda e: ~F.lower(e["k"]).isin(*_SPECIAL))
    places = F.struct(*[at(n).alias(n) for n in _SPECIAL], F.size(names).alias("n"), last_wins(others).alias("others"))

    def event(x: Column, parts: Column) -> Column:
        value = lambda i: trim_ws(F.coalesce(F.get(parts, i), F.lit("")))
        style = let(value(x["style"]), lambda v: F.when((x["style"] >= 0) & (v != ""), v))
        rest = F.transform(x["others"], lambda e: F.struct(e["k"].alias("k"), value(e["v"]).alias("v")))
        return F.struct(*[value(x[n]).alias(n) for n in ("start", "end", "text")], style.alias("style"), rest.alias("rest")).cast(_EVENT)

    def events(x: Column) -> Column:
        whole = (x["start"] >= 0) & (x["end"] >= 0) & (x["text"] >= 0)
        return F.when(whole, F.transform(found, lambda row: let(F.split(row, ",", x["n"]), lambda parts: event(x, parts)))).otherwise(none)

    return let(places, events)


def with_sections(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__title``, ``__info``, ``__styles`` and ``__events`` of a text with LF line ends. Of keys given twice
    the last value counts, at the first one's place."""
    df = df.withColumns({"__heads": F.transform(_all(F.col(text), _HEADER), lambda h: F.lower(trim_ws(h))), "__pieces": F.split(F.col(text), _HEADER)})
    # The piece before the first header is nobody's.
    both = F.zip_with("__heads", F.slice("__pieces", 2, F.greatest(F.size("__pieces") - 1, F.lit(0))), lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    df = df.withColumn("__both", both)
    of = lambda kind: F.array_join(F.transform(F.filter("__both", lambda x: x["h"].isin(*_KINDS[kind])), lambda x: x["p"]), "\n")
    df = df.withColumns({f"__{kind}": of(kind) for kind in _KINDS})

    def rows(kind: str, key: str, one, none: str) -> Column:
        """``one(names, rows, none)`` over format lines, with the rows of ``key`` below each."""
        formats = F.transform(_all(F.col(f"__{kind}"), _line("format")), lambda f: F.filter(F.transform(F.split(f, ","), trim_ws), lambda n: n != ""))
        pieces = F.split(F.col(f"__{kind}"), _line("format"))
        each = F.zip_with(formats, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda names, p: one(names, _all(p, _line(key)), F.expr(f"cast(array() as array<{none}>)")))
        return F.flatten(each)

    cells = lambda names, found, none: F.when(F.size(names) > 0, F.transform(found, lambda row: _cells(names, row))).otherwise(none)
    df = df.withColumns({"__style_rows": rows("style", "style", cells, f"array<{_PAIR}>"), "__events": rows("event", "dialogue", _events, _EVENT)})
    lines = F.filter(F.transform(F.split("__info", "\n"), trim_ws), lambda x: (F.instr(x, ":") > 1) & ~x.startswith(";"))
    entries = F.transform(lines, lambda x: F.struct(trim_ws(F.substring_index(x, ":", 1)).alias("k"), trim_ws(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    df = df.withColumn("__entries", F.filter(entries, lambda e: e["k"] != ""))
    titles = F.transform(F.filter("__entries", lambda e: F.lower(e["k"]) == "title"), lambda e: e["v"])
    styles = F.transform("__style_rows", lambda c: F.struct(F.coalesce(_first(c, "name"), F.lit("")).alias("name"), last_wins(c).alias("fields")))
    df = df.withColumns({"__title": F.try_element_at(titles, F.lit(-1)), "__fields": last_wins(F.col("__entries")), "__styles": styles})
    return df.drop("__heads", "__pieces", "__both", *[f"__{k}" for k in _KINDS], "__style_rows", "__entries")
