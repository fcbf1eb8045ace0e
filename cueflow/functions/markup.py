"""Inline emphasis as ranges: reading it from tags and override blocks, normalizing and rendering it.

Offsets count UTF-16 code units. The scanners are small state machines over tokens, run on Arrow
batches, and callers send them only texts that hold markup at all; text-only forms are in ``text``,
and what plans read tags and render with is in ``emphasis``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueflow.functions.text import ENTITIES, TAG

#: In the order in which tags open.
STYLES = ("bold", "italic", "underline", "strikethrough")
# Tags and override commands by style.
OF_TAG = {"i": "italic", "em": "italic", "b": "bold", "strong": "bold", "u": "underline", "s": "strikethrough", "strike": "strikethrough", "del": "strikethrough"}
_TAG_OF = {"bold": "b", "italic": "i", "underline": "u", "strikethrough": "s"}
_OF_COMMAND = {"b": "bold", "i": "italic", "u": "underline", "s": "strikethrough"}
_ASS_ORDER = ("italic", "bold", "underline", "strikethrough")

RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("styles", T.ArrayType(T.StringType()))])
POSITION = T.StructType([T.StructField("alignment", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SCANNED = T.StructType([T.StructField("text", T.StringType()), T.StructField("inline_styles", T.ArrayType(RANGE)), T.StructField("position", POSITION)])

Range = tuple[int, int, frozenset]


def units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def normalize_ranges(length: int, ranges: list[Range]) -> list[Range]:
    """Disjoint ranges in order, clamped to the text; equal neighbours are one."""
    inside = [(max(0, s), min(length, e), st) for s, e, st in ranges]
    inside = [r for r in inside if r[0] < r[1]]
    edges = sorted({x for s, e, _ in inside for x in (s, e)})
    out: list[Range] = []
    for a, b in zip(edges, edges[1:], strict=False):
        styles = frozenset().union(*(st for s, e, st in inside if s <= a and b <= e))
        if styles and out and out[-1][1] == a and out[-1][2] == styles:
            out[-1] = (out[-1][0], b, styles)
        elif styles:
            out.append((a, b, styles))
    return out


_TOKEN = re.compile(rf"(?P<tag>{TAG})|(?P<entity>&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[a-zA-Z][a-zA-Z0-9]{{1,31}});)|(?P<text>\r\n?|[^<&\r]+|[<&])")


def _entity(body: str) -> str | None:
    if body[:2] in ("#x", "#X"):
        n = int(body[2:], 16)
    elif body[0] == "#":
        n = int(body[1:])
    else:
        return ENTITIES.get(body.lower())
    return chr(n) if 0 < n <= 0x10FFFF else None


def scan_html(raw: str, entities: bool = False) -> tuple[str, list[Range]]:
    """Text without tags, and the emphasis they gave. A closing tag ends its style's latest opening."""
    out, at, ranges, open_ = [], 0, [], []
    for m in _TOKEN.finditer(raw):
        if m["tag"]:
            style = OF_TAG.get(m[3].lower())
            if style and not m[2]:
                open_.append((style, at))
            elif style:
                for i in reversed(range(len(open_))):
                    if open_[i][0] == style:
                        ranges.append((open_.pop(i)[1], at, frozenset([style])))
                        break
            continue
        piece = m[0]
        if m["entity"]:
            piece = (_entity(piece[1:-1]) if entities else None) or piece
        elif piece[0] == "\r":
            piece = "\n"
        out.append(piece)
        at += units(piece)
    ranges += [(start, at, frozenset([style])) for style, start in open_]
    return "".join(out), normalize_ranges(at, ranges)


_ASS_TOKEN = re.compile(r"\{([^}]*)\}|\\([Nnh{}])|([^{\\]+|[\s\S])")
_COMMAND = re.compile(r"\\[0-9]*([A-Za-z]*)")


def _commands(block: str):
    """(name, arguments) of each command of an override block; parentheses may nest."""
    at = 0
    while (at := block.find("\\", at)) >= 0:
        m = _COMMAND.match(block, at)
        at = m.end()
        if block[at : at + 1] == "(":
            depth, end = 0, at
            while end < len(block):
                depth += {"(": 1, ")": -1}.get(block[end], 0)
                end += 1
                if not depth:
                    break
        else:
            end = block.find("\\", at)
            end = len(block) if end < 0 else end
        yield m[1].lower(), block[at:end]
        at = end


def _number(text: str) -> float | None:
    try:
        return float(text) if "_" not in text else None
    except ValueError:
        return None


def scan_ass(raw: str) -> tuple[str, list[Range], tuple | None]:
    """Text, emphasis and position of an ASS text field."""
    out, at, ranges, since = [], 0, [], {}
    alignment = x = y = None

    def off(style):
        if style in since:
            ranges.append((since.pop(style), at, frozenset([style])))

    for m in _ASS_TOKEN.finditer(raw):
        if m[1] is not None:
            for name, args in _commands(m[1]):
                if name in _OF_COMMAND:
                    digits = re.match(r"[+-]?\d+", args.strip())
                    if digits is None or int(digits[0]):
                        since.setdefault(_OF_COMMAND[name], at)
                    else:
                        off(_OF_COMMAND[name])
                elif name == "r":
                    for style in list(since):
                        off(style)
                elif name == "an" and re.fullmatch(r"[+-]?\d+", args.strip()) and 1 <= int(args) <= 9:
                    alignment = int(args)
                elif name == "pos":
                    parts = re.sub(r"[()]", "", args).split(",")
                    both = [_number(p.strip()) for p in parts[:2]]
                    if len(both) == 2 and None not in both:
                        x, y = both
            continue
        piece = {"N": "\n", "n": "\n", "h": "\u00a0"}.get(m[2], m[2]) if m[2] else m[3]
        out.append(piece)
        at += units(piece)
    for style in list(since):
        off(style)
    place = (alignment, x, y) if alignment is not None or x is not None else None
    return "".join(out), normalize_ranges(at, ranges), place


def _cut(text: str, ranges: list[Range]):
    """(piece, styles) of the whole text in order."""
    data = text.encode("utf-16-le", "surrogatepass")
    piece = lambda a, b: data[2 * a : 2 * b].decode("utf-16-le", "surrogatepass")
    at = 0
    for s, e, styles in ranges:
        if s > at:
            yield piece(at, s), frozenset()
        yield piece(s, e), styles
        at = e
    if 2 * at < len(data):
        yield piece(at, len(data) // 2), frozenset()


def render_html(text: str, ranges: list[Range], escape: bool = False) -> str:
    """Styles open in one order; at a border those that end are closed, the latest first, and no other."""
    text = re.sub(r"\r\n?", "\n", text)
    safe = (lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) if escape else (lambda t: t)
    out, stack = [], []
    for piece, styles in _cut(text, normalize_ranges(units(text), ranges)):
        out += [f"</{_TAG_OF[s]}>" for s in reversed(stack) if s not in styles]
        stack = [s for s in stack if s in styles]
        for s in STYLES:
            if s in styles and s not in stack:
                stack.append(s)
                out.append(f"<{_TAG_OF[s]}>")
        out.append(safe(piece))
    out += [f"</{_TAG_OF[s]}>" for s in reversed(stack)]
    return "".join(out)


def _plain_number(v: float) -> str:
    return str(int(v)) if v == int(v) else repr(v)


def ass_text(text: str) -> str:
    return text.replace("\n", "\\N").replace("{", "\\{").replace("}", "\\}").replace("\u00a0", "\\h")


def render_ass(text: str, ranges: list[Range], position: tuple | None = None) -> str:
    out, active = [], frozenset()
    if position:
        alignment, x, y = position
        if alignment is not None:
            out.append(f"{{\\an{alignment}}}")
        if x is not None and y is not None:
            out.append(f"{{\\pos({_plain_number(x)},{_plain_number(y)})}}")
    command = {v: k for k, v in _OF_COMMAND.items()}
    for piece, styles in _cut(text, normalize_ranges(units(text), ranges)):
        out += [f"{{\\{command[s]}0}}" for s in reversed(_ASS_ORDER) if s in active and s not in styles]
        out += [f"{{\\{command[s]}1}}" for s in _ASS_ORDER if s in styles and s not in active]
        active = styles
        out.append(ass_text(piece))
    out += [f"{{\\{command[s]}0}}" for s in reversed(_ASS_ORDER) if s in active]
    return "".join(out)


def _row(text: str, ranges: list[Range], place: tuple | None = None) -> dict:
    return {
        "text": text,
        "inline_styles": [{"start": s, "end": e, "styles": [x for x in STYLES if x in st]} for s, e, st in ranges],
        "position": dict(zip(("alignment", "x", "y"), place, strict=True)) if place else None,
    }


def scanner(kind: str):
    """Arrow UDF from ARRAY<STRING> to ARRAY<SCANNED>; kind: html, html_entities or ass. Null stays null."""

    def one(raw: str) -> dict:
        return _row(*scan_ass(raw)) if kind == "ass" else _row(*scan_html(raw, kind == "html_entities"))

    @F.pandas_udf(T.ArrayType(SCANNED))
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda a: None if a is None else [one(t) for t in a])

    return scan.asNondeterministic()  # else the optimizer copies the call into every expression that reads it
