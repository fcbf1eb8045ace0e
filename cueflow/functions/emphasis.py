"""Emphasis in expressions: tags as ranges, and ranges as tags or override commands.

Reading is a sweep over tag events with a mask of styles. A text is cut into tags, entities and what lies between.
One fold over these tokens keeps the place (in UTF-16 units), the openings that wait for their end, and the ranges
that have ended; the ranges' borders cut the text into segments, each with the mask of the styles that cover it,
and neighbours of one mask become one.
Writing is a fold over such segments, with the styles that are open as a short string of their letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.functions.markup import OF_TAG, STYLES
from cueflow.functions.text import TAG, ass_escape, decode_entities, escape_entities, fold_newlines, let, utf16_length

_TOKEN = rf"{TAG}|&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[a-zA-Z][a-zA-Z0-9]{{1,31}});|\r\n?|[^<&\r]+|[<&]"
_IS_TAG = rf"\A{TAG}\z"
_SPAN = "struct<s:int,e:int,mask:int>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _bit(token: Column) -> Column:
    """1 for bold, 2 for italic, ... of a tag of emphasis, else 0."""
    name, out = F.lower(F.regexp_extract(token, _IS_TAG, 2)), F.lit(0)
    for style in reversed(STYLES):
        out = F.when(name.isin(*[t for t, s in OF_TAG.items() if s == style]), F.lit(1 << STYLES.index(style))).otherwise(out)
    return out


def _events(raw: Column, entities: bool) -> Column:
    """For each token bit, closes, and piece, the text that it stands for."""
    text = lambda t: F.when(F.startswith(t, F.lit("\r")), F.lit("\n")).otherwise(decode_entities(t) if entities else t)

    def event(t: Column) -> Column:
        tag = t.rlike(_IS_TAG)
        return F.struct(F.when(tag, _bit(t)).otherwise(0).alias("bit"), F.startswith(t, F.lit("</")).alias("closes"), F.when(tag, F.lit("")).otherwise(text(t)).alias("piece"))

    return F.transform(F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0)), event)


def _swept(events: Column) -> Column:
    """(at, ranges): the length of the text and every range of one style, those that are still open at the end included."""
    state = lambda at, opened, ended: F.struct(at.alias("at"), opened.alias("open"), ended.alias("ended"))
    span = lambda s, e, mask: F.struct(s.alias("s"), e.alias("e"), mask.alias("mask")).cast(_SPAN)

    def step(a: Column, e: Column) -> Column:
        # The place of the style's latest opening, counted from the end; 0 if there is none.
        back = F.array_position(F.transform(F.reverse(a["open"]), lambda o: o["mask"]), e["bit"]).cast("int")

        def closed(n: Column) -> Column:
            at = F.size(a["open"]) - n
            return state(a["at"], F.filter(a["open"], lambda o, i: i != at), F.array_append(a["ended"], span(F.get(a["open"], at)["s"], a["at"], e["bit"])))

        opened = state(a["at"], F.array_append(a["open"], span(a["at"], a["at"], e["bit"])), a["ended"])
        return F.when(e["bit"] == 0, state(a["at"] + utf16_length(e["piece"]), a["open"], a["ended"])).when(~e["closes"], opened).otherwise(let(back, lambda n: F.when(n > 0, closed(n)).otherwise(a)))

    end = F.aggregate(events, state(F.lit(0), _none(_SPAN), _none(_SPAN)), step)
    return let(end, lambda a: F.concat(a["ended"], F.transform(a["open"], lambda o: span(o["s"], a["at"], o["mask"]))))


def disjoint(spans: Column) -> Column:
    """Disjoint spans in order, of the union of the masks that cover them; empty ones are gone, equal neighbours are one."""
    real = F.filter(spans, lambda r: r["s"] < r["e"])

    def cut(rs: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.flatten(F.transform(rs, lambda r: F.array(r["s"], r["e"])))))
        over = lambda s, e: F.aggregate(rs, F.lit(0), lambda m, r: F.when((r["s"] <= s) & (r["e"] >= e), m.bitwiseOR(r["mask"])).otherwise(m))
        pieces = let(edges, lambda x: F.zip_with(x, F.slice(x, 2, F.size(x)), lambda s, e: F.struct(s.alias("s"), e.alias("e"), over(s, e).alias("mask")).cast(_SPAN)))
        return F.filter(pieces, lambda p: p["e"].isNotNull() & (p["mask"] != 0))

    def join(out: Column, p: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        longer = F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.struct(last["s"].alias("s"), p["e"].alias("e"), p["mask"].alias("mask")).cast(_SPAN))
        return F.when(F.coalesce((last["e"] == p["s"]) & (last["mask"] == p["mask"]), F.lit(False)), longer).otherwise(F.array_append(out, p))

    return F.aggregate(let(real, cut), _none(_SPAN), join)


def scanned_html(raw: Column, entities: bool = False) -> Column:
    """STRUCT<text, inline_styles, position> of a text with tags; a closing tag ends its style's latest opening."""
    named = lambda mask: F.filter(F.array(*map(F.lit, STYLES)), lambda s, i: F.getbit(mask, i) == 1)
    ranges = lambda events: F.transform(disjoint(_swept(events)), lambda r: F.struct(r["s"].alias("start"), r["e"].alias("end"), named(r["mask"]).alias("styles")))
    position = F.expr("cast(null as struct<alignment:int,x:double,y:double>)")
    return let(_events(raw, entities), lambda e: F.struct(F.array_join(F.transform(e, lambda x: x["piece"]), "").alias("text"), ranges(e).alias("inline_styles"), position.alias("position")))


#: The letters of tags, in the order in which they open, and of override commands, in theirs; bits as in STYLES.
_HTML_LETTERS, _ASS_LETTERS = (("b", 0), ("i", 1), ("u", 2), ("s", 3)), (("i", 1), ("b", 0), ("u", 2), ("s", 3))


def _without(letters: Column, others: Column) -> Column:
    return F.call_function("translate", letters, others, F.lit(""))


def _drawn(text: Column, ranges: Column, letters: tuple, opening: str, closing: str, nested: bool, safe) -> Column:
    """``text`` with ``opening`` and ``closing`` (of a letter, $1) where styles begin and end; offsets beyond the text are clamped.

    ``nested``: styles end in the reverse order of their beginning, else in the reverse order of ``letters``.
    """
    length = utf16_length(text)

    def drawn(t: Column) -> Column:
        n = t["n"]
        plain = n == F.char_length(t["text"])
        wide = lambda a, b: F.decode(F.substring(F.encode(t["text"], "UTF-16BE"), 2 * a + 1, 2 * (b - a)), "UTF-16BE")
        piece = lambda a, b: safe(F.when(plain, F.substring(t["text"], a + 1, b - a)).otherwise(wide(a, b)))
        bits = lambda styles: sum((F.when(F.array_contains(styles, s), F.lit(1 << i)).otherwise(0) for i, s in enumerate(STYLES)), F.lit(0))
        spans = F.transform(ranges, lambda r: F.struct(F.greatest(r["start"], F.lit(0)).alias("s"), F.least(r["end"], n).alias("e"), bits(r["styles"]).alias("mask")).cast(_SPAN))
        named = lambda mask: F.concat(*[F.when(F.getbit(mask, F.lit(i)) == 1, F.lit(c)).otherwise("") for c, i in letters])
        tags = lambda those, what: F.regexp_replace(those, "(.)", what)
        ends = lambda those: tags(F.reverse(those), closing)
        state = lambda at, out, stack: F.struct(at.alias("at"), out.alias("out"), stack.alias("stack"))

        def styled(p: Column, out: Column, stack: Column, own: Column) -> Column:
            after = F.concat(_without(stack, _without(stack, own)), _without(own, stack)) if nested else own
            return state(p["e"], F.concat(out, ends(_without(stack, own)), tags(_without(own, stack), opening), piece(p["s"], p["e"])), after)

        def step(a: Column, p: Column) -> Column:
            # What lies between two ranges has no style.
            between = state(p["s"], F.concat(a["out"], ends(a["stack"]), piece(a["at"], p["s"])), F.lit(""))
            return let(F.when(p["s"] > a["at"], between).otherwise(a), lambda b: let(named(p["mask"]), lambda own: styled(p, b["out"], b["stack"], own)))

        return let(F.aggregate(disjoint(spans), state(F.lit(0), F.lit(""), F.lit("")), step), lambda a: F.concat(a["out"], ends(a["stack"]), piece(a["at"], n)))

    return let(F.struct(text.alias("text"), length.alias("n")), drawn)


def drawn_html(text: Column, ranges: Column, escape: bool = False) -> Column:
    """``text`` with tags; styles open in one order, and at a border those that end are closed, the latest first, and no other."""
    return let(fold_newlines(text), lambda t: _drawn(t, ranges, _HTML_LETTERS, "<$1>", "</$1>", True, escape_entities if escape else lambda p: p))


def _number(v: Column) -> Column:
    """Whole numbers without their point, others in digits alone."""
    far = F.regexp_replace(v.try_cast("decimal(38,18)").cast("string"), r"\.?0+\z", "")
    return F.when(v == F.floor(v), v.try_cast("decimal(38,0)").cast("string")).when(F.abs(v).between(0.001, 9_999_999), v.cast("string")).otherwise(F.coalesce(far, v.cast("string")))


def drawn_ass(text: Column, ranges: Column, position: Column) -> Column:
    """The text field of an ASS line: override blocks for a position, an alignment and emphasis, and the escaped text."""
    aligned = F.when(position["alignment"].isNotNull(), F.concat(F.lit("{\\an"), position["alignment"].cast("string"), F.lit("}"))).otherwise("")
    placed = F.when(position["x"].isNotNull() & position["y"].isNotNull(), F.concat(F.lit("{\\pos("), _number(position["x"]), F.lit(","), _number(position["y"]), F.lit(")}"))).otherwise("")
    return F.concat(aligned, placed, _drawn(text, ranges, _ASS_LETTERS, "{\\\\$11}", "{\\\\$10}", False, ass_escape))
