"""Values keep their pseudonym wherever and however they stand."""

import random
import re
from datetime import date, timedelta

import pytest

from cueflow.llm import pii

VALUES = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "378282246310005"],
    "ssn": ["123-45-6789"],
    "phone": ["+44 20 7946 0958", "(212) 555-0123", "212-555-0123"],
    "ipv4": ["192.168.100.200"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "date": ["2021-03-14", "14.03.2021", "3/14/2021", "1/5/2020"],
    "email": ["someone.long.name@mail.example.org"],
}


@pytest.mark.parametrize("kind", pii.KINDS)
def test_distance_from_a_digit(kind):
    change = pii.Pseudonymiser(b"test")
    for value in VALUES[kind]:
        alone, counts = change(value)
        want = [int(k == kind) for k in pii.KINDS]
        assert counts == want and alone != value
        for n in range(401):
            around = "7 " + "x" * n, " end " + "y" * 300
            assert change(f"{around[0]} {value}{around[1]}") == (f"{around[0]} {alone}{around[1]}", want), (value, n)


def test_what_only_looks_valid_stays():
    change = pii.Pseudonymiser(b"test")
    for text in ["123-45-67890", "4111111111111112", "300.1.2.3", "2021-02-30", "31.04.2021", "000-12-3456", "DE00370400440532013000", "1799-01-01", "no@where"]:
        for n in (0, 1, 79, 80, 147, 148, 149, 400):
            whole = f"1 {'x' * n} {text} end"
            assert change(whole) == (whole, [0] * len(pii.KINDS)), (text, n)


def test_dates_link_across_notations():
    rng, change = random.Random(3), pii.Pseudonymiser(b"test")
    back = pii.Pseudonymiser(b"test", inverse=True)
    days = {date(1900, 1, 1) + timedelta(rng.randrange(73049)) for _ in range(1000)}
    new = {}
    for day in days:
        forms = [f"{day:%Y-%m-%d}", f"{day:%Y/%m/%d}", f"{day:%m/%d/%Y}", f"{day:%d.%m.%Y}", f"{day:%d-%m-%Y}", f"{day.month}/{day.day}/{day.year}", f"{day.day}.{day.month}.{day.year}"]
        if day.day > 12:
            forms += [f"{day:%d/%m/%Y}", f"{day:%m-%d-%Y}"]
        out = [change(x)[0] for x in forms]
        assert [re.sub(r"\d", "0", x) for x in out] == [re.sub(r"\d", "0", x) for x in forms]
        assert [back(x)[0] for x in out] == forms
        new[day] = date.fromisoformat(out[0])
        d = new[day]
        again = [f"{d:%Y-%m-%d}", f"{d:%Y/%m/%d}", f"{d:%m/%d/%Y}", f"{d:%d.%m.%Y}", f"{d:%d-%m-%Y}", f"{d.month}/{d.day}/{d.year}", f"{d.day}.{d.month}.{d.year}", f"{d:%d/%m/%Y}", f"{d:%m-%d-%Y}"]
        assert out == again[: len(out)]
    assert len(set(new.values())) == len(days)


def test_phone_numbers_link_across_forms():
    change = pii.Pseudonymiser(b"test")
    digits = lambda s: re.sub(r"\D", "", change(s)[0])
    assert {digits(x)[-10:] for x in ("+1 555-123-4567", "555-123-4567", "(555) 123-4567", "555.123.4567", "+1 (555) 123-4567")} == {digits("555-123-4567")}
    assert digits("+44 20 7946 0958") == digits("+44 207946 0958") == digits("+44-20-7946-0958")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_permutes(size):
    f = pii.Feistel(b"test")
    out = [f.permute("d", x, size) for x in range(size)]
    assert sorted(out) == list(range(size))
    assert [f.permute("d", y, size, inverse=True) for y in out] == list(range(size))


def test_pseudonymise_and_back(spark):
    texts = [None, "", "none", *[f"7 {'x' * 144} {v} end" for vs in VALUES.values() for v in vs], "word " * 400_000 + VALUES["iban"][0]]
    rows = [(d, t, 5, "kept") for d, t in enumerate(texts)] + [(None, VALUES["ssn"][0], 5, "kept"), (4, texts[4], 5, "kept")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_card int, `a.b` string")
    there = pii.pseudonymise(docs, b"test").cache()
    assert there.columns == ["doc_id", "text", "a.b", *[f"n_{k}" for k in pii.KINDS]] and there.filter("`a.b` = 'kept'").count() == len(rows)
    extra = {"iban": 1, "ssn": 1, pii.KINDS[0]: 1}  # the long text, the row without id, the repeated row
    assert [sum(r[f"n_{k}"] for r in there.collect()) for k in pii.KINDS] == [len(VALUES[k]) + extra.get(k, 0) for k in pii.KINDS]
    back = sorted(((r.doc_id, r.text) for r in pii.pseudonymise(there, b"test", inverse=True).collect()), key=repr)
    assert back == sorted(((r[0], r[1]) for r in rows), key=repr)
    assert pii.pseudonymise(docs.limit(0), b"test").count() == 0
