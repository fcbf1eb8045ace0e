"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

Values are found by shape and validated (check digits, issuer prefixes, calendar, ranges); what fails
is left as it is. A valid value is read as a number within its format, permuted by a keyed Feistel
network over just that range (cycle walking), and written back in the same shape with its check digits
anew. A permutation has no collisions and needs no state, so equal values stay equal in every
document and different ones stay different, in any partition and on any retry.

What is equal is told by the value, not by how it is written: a date in any notation, a card with or
without spaces, a phone number with or without separators. Ten-digit phone numbers without a country
code count as North American and link with their +1 form; a trunk zero in brackets does not link.
"""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm.runtime import in_batches, row_and

KINDS = ("card", "ssn", "phone", "ipv4", "iban", "date", "email")
ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


class Feistel:
    """Keyed permutations of 0 .. size - 1, one for each domain name."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, domain: str, size: int, r: int, half: int, width: int) -> int:
        msg = f"{domain}|{size}|{r}|{half}".encode()
        out = int.from_bytes(blake2b(msg, key=self.key, digest_size=64).digest(), "big")
        while width > 512:  # longer halves are filled from further digests
            msg += b"+"
            out = (out << 512) | int.from_bytes(blake2b(msg, key=self.key, digest_size=64).digest(), "big")
            width -= 512
        return out

    def permute(self, domain: str, x: int, size: int, inverse: bool = False) -> int:
        if size < 2:
            return x
        width = ((size - 1).bit_length() + 1) // 2
        mask = (1 << width) - 1
        while True:
            left, right = x >> width, x & mask
            for r in range(ROUNDS) if not inverse else reversed(range(ROUNDS)):
                if inverse:
                    left, right = right ^ (self._round(domain, size, r, left, width) & mask), left
                else:
                    left, right = right, left ^ (self._round(domain, size, r, right, width) & mask)
            x = (left << width) | right
            if x < size:
                return x


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


#: Issuer prefixes of card numbers and their lengths.
_ISSUERS = (
    (re.compile(r"4"), (13, 16, 19)),
    (re.compile(r"5[1-5]"), (16,)),
    (re.compile(r"222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720"), (16,)),
    (re.compile(r"3[47]"), (15,)),
    (re.compile(r"6011|65|64[4-9]"), (16, 19)),
    (re.compile(r"35(?:2[89]|[3-8]\d)"), (16,)),
    (re.compile(r"30[0-5]|36|3[89]"), (14,)),
)
_CLASSES = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7),
    "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
)
_CLASS_OF = {c: alphabet for alphabet in _CLASSES for c in alphabet}


def _shaped(f: Feistel, domain: str, text: str, inverse: bool) -> str:
    """Permutes all texts of the same shape: classes of characters by position, others stand."""
    shape = "".join(str(_CLASSES.index(_CLASS_OF[c])) if c in _CLASS_OF else c for c in text)
    x, size = 0, 1
    for c in text:
        if c in _CLASS_OF:
            x = x * len(_CLASS_OF[c]) + _CLASS_OF[c].index(c)
            size *= len(_CLASS_OF[c])
    x = f.permute(f"{domain}|{shape}", x, size, inverse)
    out = []
    for c in reversed(text):
        if c in _CLASS_OF:
            x, at = divmod(x, len(_CLASS_OF[c]))
            c = _CLASS_OF[c][at]
        out.append(c)
    return "".join(reversed(out))


def _refill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _card(f, s, inverse):
    digits = re.sub(r"\D", "", s)
    for prefix, lengths in _ISSUERS:
        m = prefix.match(digits)
        if m and len(digits) in lengths and luhn_digit(digits[:-1]) == digits[-1]:
            body = digits[m.end() : -1]
            new = m[0] + str(f.permute(f"card|{m[0]}|{len(digits)}", int(body), 10 ** len(body), inverse)).zfill(len(body))
            return _refill(s, new + luhn_digit(new))
    return None


def _ssn(f, s, inverse):
    area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x = f.permute("ssn", x, 898 * 99 * 9999, inverse)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Country calling codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(f, s, inverse):
    digits = re.sub(r"\D", "", s)
    if not 10 <= len(digits) <= 15:
        return None
    if s[0] == "+":
        code = kept = digits[0] if digits[0] in "17" else digits[:2] if digits[:2] in _TWO_DIGITS else digits[:3]
    else:
        code, kept = "1", ""
    body = digits[len(kept) :]
    return _refill(s, kept + str(f.permute(f"phone|{code}|{len(body)}", int(body), 10 ** len(body), inverse)).zfill(len(body)))


def _ipv4(f, s, inverse):
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute("ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, inverse)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(f, s, inverse):
    bare = s.replace(" ", "")
    if not 15 <= len(bare) <= 34 or _mod97(bare) != 1:
        return None
    body = _shaped(f, f"iban|{bare[:2]}", bare[4:], inverse)
    new = iter(f"{bare[:2]}{98 - _mod97(bare[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


def _date_class(day: date) -> tuple[bool, int]:
    """What a notation may tell of a date: whether its month, and whether its day, has one digit, and whether the day can't be a month."""
    return day.month > 9, 0 if day.day < 10 else 1 if day.day <= 12 else 2


@lru_cache(1)
def _dates() -> tuple[dict, dict]:
    """Dates by class, and each date's place within its class."""
    classes: dict[tuple[bool, int], list[date]] = {}
    for n in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1):
        classes.setdefault(_date_class(date.fromordinal(n)), []).append(date.fromordinal(n))
    return classes, {d: i for all_of in classes.values() for i, d in enumerate(all_of)}


def _date(f, s, inverse):
    fields = re.split(r"[-/.]", s)
    sep = s[len(fields[0])]
    # A day that can't be a month tells the order; without one a slash means month first, other signs day first.
    for order in ("ymd",) if len(fields[0]) == 4 else ("mdy", "dmy") if sep == "/" else ("dmy", "mdy"):
        at = dict(zip(order, map(int, fields), strict=True))
        try:
            day = date(at["y"], at["m"], at["d"])
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # All notations share one permutation, so a date stays linked with itself however it is written. It keeps
        # the date's class, so that the notation, and the width of each field, fit the new date too.
        classes, place = _dates()
        kind = _date_class(day)
        new = classes[kind][f.permute(f"date|{kind}", place[day], len(classes[kind]), inverse)]
        value = {"y": new.year, "m": new.month, "d": new.day}
        return sep.join(str(value[k]).zfill(len(old)) for k, old in zip(order, fields, strict=True))
    return None


def _email(f, s, inverse):
    local, _, domain = s.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{_shaped(f, 'email', local, inverse)}@{_shaped(f, 'email host', host, inverse)}.{top}"


#: Shapes in the order in which they are tried at a place in the text.
_SHAPES = re.compile(
    r"(?P<email>[\w.+\-]{1,64}(?<=\w)@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})"
    r"|(?<![\w.])(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?<![\w\-/.])(?P<date>\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/]|[.\-]\d)"
    r"|(?<![\w\-])(?P<ssn>\d{3}-\d\d-\d{4})(?![\w\-])"
    r"|(?<![\w])(?P<iban>[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w+\-])(?P<card>\d(?:[ \-]?\d){12,18})(?![\w]|[ \-]\d)"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ \-.]?(?:\(\d{1,4}\)[ \-.]?)?\d{2,4}(?:[ \-.]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[\-.]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\w|-\d)"
)
_WRITE = {"card": _card, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "iban": _iban, "date": _date, "email": _email}
_ANY = re.compile(r"[0-9@]")
#: A shape has fewer characters than this before its first digit or @.
_REACH = 80


class Pseudonymiser:
    def __init__(self, key: bytes, inverse: bool = False):
        f = Feistel(key)
        self._one = lru_cache(1 << 16)(lambda kind, s: _WRITE[kind](f, s, inverse))

    def __call__(self, text: str | None) -> tuple[str | None, list[int]]:
        """(the text with pseudonyms, how many of each of KINDS)."""
        found = dict.fromkeys(KINDS, 0)
        if not text or not _ANY.search(text):
            return text, list(found.values())
        out, at = [], 0
        while m := _ANY.search(text, at):
            # A shape begins at most _REACH before its first digit or @, and is read as far as it goes: an end
            # put to the search would cut values and pass for the end of the text.
            hit = _SHAPES.search(text, max(at, m.start() - _REACH))
            if not hit:
                break
            new = self._one(hit.lastgroup, hit[0])
            if new is None:
                # Not valid: another shape may still begin within it, after its first digit run.
                skip = hit.start() + len(re.match(r"\D*\d*", hit[0])[0]) or hit.start() + 1
                out.append(text[at : max(skip, hit.start() + 1)])
                at = max(skip, hit.start() + 1)
                continue
            found[hit.lastgroup] += 1
            out += [text[at : hit.start()], new]
            at = hit.end()
        out.append(text[at:])
        return "".join(out), list(found.values())


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in its text column, plus ``n_<kind>`` (int) for each of KINDS.

    Null and empty texts stay as they are. Rows are independent of each other, so repeated rows come
    out equal. Columns of the input named like the counts are replaced; others pass through. Texts of
    any length are read whole, an empty table gives none. ``inverse=True`` with the same key restores
    the values. Dates from FIRST_DAY to LAST_DAY are personal, others are left as they are.
    """
    counts = [f"n_{k}" for k in KINDS]
    rest = [c for c in docs.columns if c not in counts]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest if c != text]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        import pyarrow as pa

        change = Pseudonymiser(key, inverse)
        for b in batches:
            done = [change(t) for t in b.column(1).to_pylist()]
            numbers = [pa.array([n[i] for _, n in done], pa.int32()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), *numbers], ["row", "text", *counts])

    out = in_batches(packed, run, row_and(packed, "row", "text string, " + ", ".join(f"{c} int" for c in counts)))
    return out.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in rest], *counts)
