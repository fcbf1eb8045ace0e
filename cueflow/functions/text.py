"""Text operators on string columns. Everything here is built-in expressions, usable inside lambdas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming and blank lines know, in Java's regular expressions.
_SPACES = r" \t\x0B\f\r\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = rf"[{_SPACES}\n]"
#: White space within a line.
HS = rf"[{_SPACES}]"
# The same as characters.
_TRIMMED = " \t\x0b\f\r\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff\n"

# Override commands that mark a brace block as one of ASS.
ASS_COMMANDS = (
    "alpha", "fade", "move", "clip", "bord", "shad", "blur", "frz", "fsp", "pos", "org", "fad",
    "fr", "fn", "fs", "fe", "be", "kf", "ko", "an", "1c", "2c", "3c", "4c", "t", "k", "K", "b",
    "i", "u", "s", "r", "p", "q", "c", "a",
)
_COMMANDS = "|".join(ASS_COMMANDS)
# What an override block looks like, closed, or open up to the end of its line. They are
# written without looking ahead within a block, so that RE2 engines can run them too.
OVERRIDE_BLOCK = r"\{(?:[^{}\\]|\\.)*?\\(?:" + _COMMANDS + r")(?:[^A-Za-z{}][^{}]*)?\}"
OVERRIDE_TO_LINE_END = r"\{\\(?:" + _COMMANDS + r")(?:[^A-Za-z{}\n][^{}\n]*)?(?=\n|\z)"

# What a well-formed tag looks like.
TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?\s*>"

# The named entities that are decoded, and what they stand for.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "lrm": "\u200e", "rlm": "\u200f", "amp": "&"}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_ws(c: Column) -> Column:
    """Without Unicode white space and byte order marks at both ends."""
    return F.trim(c, F.lit(_TRIMMED))


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{_SPACES}\n]")


def has_visible_text(c: Column) -> Column:
    return c.rlike(rf"[^{_SPACES}\n]")


def fold_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize(c: Column) -> Column:
    """Without a leading byte order mark, and with LF line ends."""
    return let(c, lambda t: fold_newlines(F.when(F.startswith(t, F.lit("\ufeff")), F.substr(t, F.lit(2))).otherwise(t)))


def _where(c: Column, mark: str, use) -> Column:
    """``use`` of texts that hold ``mark``, without which its patterns match nothing; looking for it takes no pattern."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(mark)), use(t)).otherwise(t))


def strip_tags(c: Column) -> Column:
    """The text without well-formed tags, newlines folded."""
    return fold_newlines(_where(c, "<", lambda t: F.regexp_replace(t, TAG, "")))


def strip_overrides(c: Column) -> Column:
    """Without ASS override blocks, closed or cut off at the end of a line."""
    return _where(c, "{", lambda t: F.regexp_replace(F.regexp_replace(t, OVERRIDE_BLOCK, ""), OVERRIDE_TO_LINE_END, ""))


def escape_entities(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def decode_entities(c: Column) -> Column:
    """Named entities of any case and numeric ones, in one pass; unknown ones stay.

    The text is cut into entities and what lies between, so that what an entity decodes to is not
    read again.
    """
    pieces = F.regexp_extract_all(c, F.lit(r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-zA-Z][a-zA-Z0-9]{1,31};|[^&]+|&"), F.lit(0))

    def one(piece: Column) -> Column:
        number = F.when(piece.rlike(r"\A&#[0-9]+;\z"), F.regexp_extract(piece, r"(\d+)", 1).try_cast("bigint")).when(
            piece.rlike(r"\A&#[xX]"), F.conv(F.regexp_extract(piece, r"#[xX](.*);", 1), 16, 10).try_cast("bigint")
        )
        named = F.lower(F.regexp_extract(piece, r"\A&([a-zA-Z][a-zA-Z0-9]*);\z", 1))
        out = F.when((number > 0) & (number <= 0x10FFFF), code_point(number))
        for name, value in ENTITIES.items():
            out = out.when(named == name, F.lit(value))
        return out.otherwise(piece)

    return F.when(F.instr(c, "&") == 0, c).otherwise(F.array_join(F.transform(pieces, one), ""))


def code_point(n: Column) -> Column:
    """The character of a code point; its four UTF-32 bytes are decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")


def ass_escape(c: Column) -> Column:
    """As the text field of an ASS line."""
    for old, new in (("\n", "\\N"), ("{", "\\{"), ("}", "\\}"), ("\u00a0", "\\h")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def ass_plain(c: Column) -> Column:
    """The visible text of an ASS text field: blocks dropped, escapes read, in one pass."""
    tokens = F.regexp_extract_all(c, F.lit(r"\{[^}]*\}|\\[Nnh{}]|[^{\\]+|[\s\S]"), F.lit(0))

    def one(t: Column) -> Column:
        return (
            F.when(t.isin("\\N", "\\n"), F.lit("\n"))
            .when(t == "\\h", F.lit("\u00a0"))
            .when(t.isin("\\{", "\\}"), F.substring(t, 2, 1))
            .when(t.startswith("{") & (F.length(t) > 1), F.lit(""))
            .otherwise(t)
        )

    return F.when(~c.rlike(r"[{\\]"), c).otherwise(F.array_join(F.transform(tokens, one), ""))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def field_ci(entries: Column, key: str) -> Column:
    """Value of a key in ARRAY<STRUCT<k,v>>: the exact key first, else the first that differs in case only."""
    exact = F.get(F.filter(entries, lambda e: e["k"] == key), F.lit(0))["v"]
    alike = F.get(F.filter(entries, lambda e: F.lower(e["k"]) == key.lower()), F.lit(0))["v"]
    return F.coalesce(exact, alike)


def last_wins(entries: Column) -> Column:
    """ARRAY<STRUCT<k,v>> with one entry a key: at the first one's place, with the last one's value."""
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["k"]), e["k"]) == i + 1)
    return F.transform(first, lambda e: F.struct(e["k"].alias("k"), F.element_at(F.filter(entries, lambda x: x["k"] == e["k"]), -1)["v"].alias("v")))
