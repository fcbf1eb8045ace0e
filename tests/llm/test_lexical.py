"""Ranked search against a plain scoring of all pairs, on odd rows and in blocks of any size."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cueflow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, top=20):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    many, words = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for (doc, c), n in zip(counts, lengths, strict=True):
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (100 - 25 + 25 * n * many // words))) for t in _terms(text) if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return Counter(out)


DOCS = [(1, "the Cat sat on the mat"), (2, "THE cat"), (2, "THE cat"), (None, "the cat"), (None, "the cat"), (3, None), (4, ""), (5, " -- \x7f\x00"), (6, "été café ÉTÉ cat9 9cat"), (7, "cat " * 5000 + "dog"), (8, "x" * 70 + " " + "y" * 70), (9, "dog dog bird"), (10, "İstanbul cat_dog")]
ITEMS = [(1, "cat dog Dog"), (2, None), (3, "--"), (None, "the bird"), (4, "x" * 70 + " café " + "x" * 69), (1, "été 9CAT"), (5, "İSTANBUL CAT")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id bigint, text string, score int, term int")
    return docs, spark.createDataFrame([(*i, 3) for i in ITEMS], "item_id bigint, text string, rank int")


@pytest.mark.parametrize("most_words", [1, 8, lexical.BLOCK_WORDS])
def test_search_equals_plain(tables, most_words):
    docs, items = tables
    got = Counter((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(docs, items, most_words=most_words).collect())
    assert got == plain(DOCS, ITEMS)


def test_few_of_many(spark, monkeypatch):
    """Ties at the last place, runs of one document each, and more documents than a heap holds."""
    monkeypatch.setattr(lexical, "RUN", 1)
    docs = [(i, ("a b " if i % 3 else "a ") + "c " * (i % 2)) for i in range(200)]
    items = [(0, "a b"), (1, "c c"), (2, "zzz")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = Counter((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(df, spark.createDataFrame(items, "item_id bigint, text string"), top=7).collect())
    assert got == plain(docs, items, 7)


def test_empty(tables):
    docs, items = tables
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.filter("doc_id = 3"), items).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_radix_order(keys):
    keys = np.array(keys, np.uint64)
    assert lexical.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    block = lexical.Block(["ab cd", "ef ab"], 0)
    data, starts, ends, _ = lexical.terms(pa.array(["cd xx ab ef abc"]))
    found = block.find(data, starts, ends)
    name = lambda t: block.bytes[block.begin[t] : block.begin[t] + 2].tobytes().decode()
    assert [name(t) if t >= 0 else None for t in found] == ["cd", None, "ab", "ef", None]
