"""Character decoding of file contents.

Byte order marks and valid UTF-8, nearly all files, are decoded by built-in expressions; only what is left
is sent to Python, where byte counts and code tables of old encodings are needed.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueflow.functions.recorded import recorded

DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])

_C0 = r"\x00-\x08\x0b\x0c\x0e-\x1f"
_BAD = re.compile(rf"[{_C0}\ufffd]")
_HARD = re.compile(rf"[{_C0}\ufffd\ud800-\udfff\ue000-\uf8ff]")
# The scripts that text in UTF-16 without a mark may be made of.
_PLAUSIBLE = re.compile(
    r"[\t\n\r\x20-\x7e\u00a0-\u024f\u2000-\u206f\u20a0-\u20cf\u2100-\u214f\u2190-\u21ff\u2200-\u22ff\u2460-\u24ff\u2500-\u257f\u25a0-\u26ff"
    r"\u3000-\u303f\u3040-\u30ff\u3200-\u32ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef\U00020000-\U0002fa1f]+"
)
_IDEOGRAPH = re.compile(r"[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\U00020000-\U0002fa1f]")
_KANA = re.compile(r"[\u3040-\u30ff]")
_WIDE = re.compile(r"[\u3000-\u303f\uff00-\uff60\uffa0-\uffef]")
_LATIN = re.compile(r"[A-Za-z ]")
_CONTROL = re.compile(rf"[{_C0}\ud800-\udfff\ue000-\uf8ff]")


def score(text: str, bonus: int = 0, penalty: int = 0) -> int:
    """How much a decoded text looks like one."""
    n = lambda p: len(p.findall(text))
    return min(60, 3 * n(_IDEOGRAPH)) + min(60, 6 * n(_KANA)) + min(20, 2 * n(_WIDE)) + min(10, n(_LATIN)) - 40 * n(_CONTROL) + bonus - penalty


def _try(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except (UnicodeDecodeError, LookupError):
        return None


#: Runs of ASCII, and what starts with another byte: two bytes, or four if the second is a digit; what is cut off is no character.
_GB_TOKEN = re.compile(rb"[\x00-\x7f]+|\x80|[\x81-\xff][0-9](?:[\s\S]{2})?|[\x81-\xff][\s\S]?")
#: Lead bytes of pairs that other encodings use too.
_DOUBTFUL = frozenset([*range(0x81, 0xA0), *range(0xE0, 0xF0)])


def decode_gb18030(data: bytes) -> tuple[str | None, bool, int]:
    """(text or None if invalid, whether any four-byte sequence, pairs that other encodings use too).

    The bytes are cut into sequences by one pattern; each distinct sequence is looked up once.
    """
    tokens = _GB_TOKEN.findall(data)
    counts = Counter(tokens)
    pairs = [t for t in counts if t[0] > 0x80]
    table = {t: t.decode("ascii") if t[0] < 0x80 else "\u20ac" for t in counts if t[0] <= 0x80}
    table |= {t: _try(t, "gb18030" if len(t) == 4 else "gbk") or "" for t in pairs}
    four = any(len(t) == 4 for t in pairs)
    doubtful = sum(counts[t] for t in pairs if len(t) == 2 and t[0] in _DOUBTFUL)
    if any(len(table[t]) != 1 for t in pairs):
        return None, four, doubtful
    return "".join(map(table.__getitem__, tokens)), four, doubtful


def _windows1252(data: bytes, most: float) -> str | None:
    text = _try(data, "cp1252")
    if not text:
        return None
    controls = len(re.findall("[\x00-\x08\x0b\x0c\x0e-\x1f\x80-\x9f]", text))
    return text if controls / len(text) <= most else None


def _utf16_without_mark(data: bytes) -> tuple[str, str] | None:
    head = data[:64]
    even, odd = head[0::2].count(0), head[1::2].count(0)
    if even + odd >= 2 and not (even and odd):
        little = odd > even
        text = data.decode("utf-16-le" if little else "utf-16-be", "replace")
        return None if _BAD.search(text) else (text, "UTF-16 LE" if little else "UTF-16 BE")
    if len(data) >= 4 and len(data) % 2 == 0:
        texts = {name: data.decode(codec, "replace") for name, codec in (("UTF-16 LE", "utf-16-le"), ("UTF-16 BE", "utf-16-be"))}
        good = [name for name, t in texts.items() if _PLAUSIBLE.fullmatch(t)]
        if len(good) == 1 and not any(_HARD.search(t) for name, t in texts.items() if name != good[0]):
            return texts[good[0]], good[0]
    return None


def guess(data: bytes) -> tuple[str | None, str | None]:
    """(text, encoding) of bytes that are neither marked nor UTF-8; (None, None) if nothing fits."""
    if wide := _utf16_without_mark(data):
        return wide
    candidates = []
    text, four, doubtful = decode_gb18030(data)
    if text is not None:
        candidates.append((score(text, 50 * four, 4 * doubtful), text, "GB18030" if four else "GBK"))
    for codec, name in (("shift_jis", "Shift_JIS"), ("euc_jp", "EUC-JP")):
        if (text := _try(data, codec)) is not None:
            candidates.append((score(text), text, name))
    if (text := _windows1252(data, 0.33)) is not None:
        candidates.append((score(text), text, "Windows-1252"))
    if candidates:
        best = max(candidates, key=lambda c: c[0])  # of equal scores the first
        return best[1], best[2]
    text = _windows1252(data, 0.5)
    return (text, "Windows-1252") if text is not None else (None, None)


@F.pandas_udf(DECODED)
def _guessed(contents: pd.Series) -> pd.DataFrame:
    found = [(None, None) if c is None else guess(bytes(c)) for c in contents]
    return pd.DataFrame(found, columns=["text", "encoding"])


@recorded
def decode(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``text``, ``encoding``, ``had_bom`` and ``error``; a mark is binding, so a bad body is an error."""
    raw = F.col(content)
    starts = lambda mark: F.substring(F.hex(F.substring(raw, 1, 4)), 1, len(mark)) == mark
    body = lambda n: F.substring(raw, n + 1, 2147483647)
    wide = lambda n, charset: F.when(_well_formed(body(n), charset), F.decode(body(n), charset))
    mark = (
        F.when(starts("EFBBBF"), F.lit("UTF-8 BOM"))
        .when(starts("FFFE0000"), F.lit("UTF-32 LE"))
        .when(starts("0000FEFF"), F.lit("UTF-32 BE"))
        .when(starts("FFFE"), F.lit("UTF-16 LE"))
        .when(starts("FEFF"), F.lit("UTF-16 BE"))
    )
    df = files.withColumn("__mark", mark)
    m = F.col("__mark")
    plain = m.isNull() & F.is_valid_utf8(raw.cast("string")) & ~raw.cast("string").rlike(r"\x00")
    df = df.withColumn("__plain", plain)
    df = df.withColumn("__guess", _guessed(F.when(m.isNull() & ~F.col("__plain"), raw)))
    marked = (
        F.when(m == "UTF-8 BOM", F.when(F.is_valid_utf8(body(3).cast("string")), body(3).cast("string")))
        .when(m == "UTF-32 LE", F.when(_well_formed(body(4), "UTF-32LE"), F.decode(raw, "UTF-32")))  # the mark tells the order
        .when(m == "UTF-32 BE", F.when(_well_formed(body(4), "UTF-32BE"), F.decode(raw, "UTF-32")))
        .when(m == "UTF-16 LE", wide(2, "UTF-16LE"))
        .when(m == "UTF-16 BE", wide(2, "UTF-16BE"))
    )
    text = F.when(m.isNotNull(), marked).when(F.col("__plain"), raw.cast("string")).otherwise(F.col("__guess.text"))
    name = F.when(m.isNotNull(), m).when(F.col("__plain"), F.lit("UTF-8")).otherwise(F.col("__guess.encoding"))
    df = df.withColumn("text", text)
    failed = F.struct(F.lit("encodingDetectionFailed").alias("failure"), F.lit("The text encoding of this file could not be determined.").alias("detail"))
    return (
        df.withColumn("encoding", F.when(F.col("text").isNotNull(), name))
        .withColumn("had_bom", F.col("text").isNotNull() & m.isNotNull())
        .withColumn("error", F.when(F.col("text").isNull(), failed))
        .drop("__mark", "__plain", "__guess")
    )


def _well_formed(data: Column, charset: str) -> Column:
    """Whether bytes decode without loss: they come back from the text, which has no control characters."""
    size = 4 if "32" in charset else 2
    if size == 4:
        units = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(data) / 4 - 1, F.lit(0)).cast("int")), lambda i: F.substr(F.hex(data), i * 8 + 1, F.lit(8)))
        value = lambda u: F.conv(u if charset.endswith("BE") else F.concat(F.substr(u, F.lit(7), F.lit(2)), F.substr(u, F.lit(5), F.lit(2)), F.substr(u, F.lit(3), F.lit(2)), F.substr(u, F.lit(1), F.lit(2))), 16, 10).cast("bigint")
        good = F.forall(units, lambda u: (value(u) <= 0x10FFFF) & ~value(u).between(0xD800, 0xDFFF) & (value(u) != 0xFFFD))
        return (F.octet_length(data) % 4 == 0) & ((F.octet_length(data) == 0) | good)
    return (F.octet_length(data) % 2 == 0) & _wide_units_pair(data, charset)


def _wide_units_pair(data: Column, charset: str) -> Column:
    """High surrogates are followed by low ones, low ones by nothing alone, and no control characters."""
    order = (lambda h: h) if charset.endswith("BE") else (lambda h: F.regexp_replace(h, "(..)(..)", "$2$1"))
    units = F.regexp_replace(order(F.hex(data)), "(....)", "$1 ")
    pairs = F.regexp_replace(units, "D[89AB].. D[C-F].. ", "")
    return ~pairs.rlike(r"(?:\A| )(?:D[89A-F]..|FFFD|00(?:0[0-8BCEF]|1[0-9A-F])) ")


def encode(text: Column, bom: bool = False) -> Column:
    body = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lit("EFBBBF")), body) if bom else body
