"""Every operator on odd rows: nulls, repeated rows and ids, clashing columns, one very long text, an empty table."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cueflow.llm import bpe, decontaminate, language_id, line_dedup, order_minhash, pii, quality, sharding, simhash, substring_dedup

RANKS, MULTI = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))
LONG = "A long line of many words, again and again.\n" * 100_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "one two three four five six seven", "en"), (0, "one two three four five six seven", "en"), (0, "other", "en"), (None, "no id here", None), (None, "no id here", None), (None, None, None), (1, None, "en"), (2, "", None), (3, " \t\n", "de"), (4, LONG, "en"), (5, "\U0001f600 é́ مرحبا", "de")]
    clash = [("score", 1), ("key", 2), ("ids", 3), ("fp", 4), ("row", 5), ("salt", 6), ("words", 7), ("label", 8), ("a.b", 9)]
    names = ", ".join(f"`{n}` int" for n, _ in clash)
    return spark.createDataFrame([(*r, "s", *[v for _, v in clash]) for r in rows], f"doc_id bigint, text string, lang string, source string, {names}")


def _items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (1, "one two three four five six seven")], "item_id bigint, text string")


def _labels(spark):
    return spark.createDataFrame([(0, 1), (4, 0), (None, 1), (0, 1), (5, None)], "doc_id bigint, quality int")


OPERATORS = {
    "language": lambda s, d: language_id.identify_documents(d, MULTI),
    "minhash": lambda s, d: order_minhash.edited_likeness(d),
    "substrings": lambda s, d: substring_dedup.remove_repeats(d),
    "quality": lambda s, d: quality.score_quality(d, _labels(s)),
    "bpe": lambda s, d: bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "lines": lambda s, d: line_dedup.remove_boilerplate(d),
    "pii": lambda s, d: pii.pseudonymise(d, b"key"),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "shards": lambda s, d: sharding.sharded_documents(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_for_each(spark, docs, name):
    got = OPERATORS[name](spark, docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    repeated = [tuple(r) for r in got if r.doc_id is None]
    if name != "shards":  # every row has a slot of its own
        assert max(Counter(map(repr, repeated)).values()) >= 2
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_leaks(spark, docs):
    got = decontaminate.leaks(docs, _items(spark)).collect()
    assert [(r.doc_id, r.item_id, r.common, r.from_word) for r in got] == [(0, 1, 1.0, 0)]
    assert decontaminate.leaks(docs.limit(0), _items(spark)).count() == 0
    assert decontaminate.leaks(docs, _items(spark).limit(0)).count() == 0
    stay = decontaminate.without_leaks(docs, _items(spark))
    assert stay.columns == docs.columns and stay.count() == docs.count() - 2


def test_bpe_blocks_of_any_size(spark, docs, monkeypatch):
    want = sorted(map(repr, bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()))
    small = docs.repartition(5, F.xxhash64("text", "doc_id"))
    assert sorted(map(repr, bpe.round_trip(small, RANKS, public_tokenizers.PATTERN).collect())) == want
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())


def test_slots_are_uniform(spark):
    """Each row meets each shard about equally often over seeds."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"))
    seen = Counter()
    for seed in range(30):
        for r in sharding.uniform_shards(docs, [F.col("doc_id")], 4, seed, block_rows=4, max_blocks=16).collect():
            seen[r.doc_id % 2, r.shard] += 1
    expected = 40 * 30 / 8
    # Chi-square of 8 cells: 30 is past any usual doubt.
    assert sum((seen[k, s] - expected) ** 2 / expected for k in (0, 1) for s in range(4)) < 30


def test_shards_follow_the_law_of_a_uniform_shuffle(spark):
    """Over seeds every row meets every slot about equally often, and two rows share a shard as often as they should."""
    docs = spark.range(12).select(F.col("id").alias("doc_id"))
    seeds, at, together = 120, Counter(), 0
    for seed in range(seeds):
        rows = {r.doc_id: (r.shard, r.slot) for r in sharding.uniform_shards(docs, [F.col("doc_id")], 3, seed, block_rows=2, max_blocks=8).collect()}
        assert sorted(rows.values()) == [(s, i) for s in range(3) for i in range(4)]
        at.update((d, *x) for d, x in rows.items())
        together += sum(rows[a][0] == rows[b][0] for a in range(12) for b in range(a))
    expected = seeds / 12
    # 144 cells with 121 degrees of freedom: 200 is past any usual doubt.
    assert sum((at[d, s, i] - expected) ** 2 / expected for d in range(12) for s in range(3) for i in range(4)) < 200
    assert together == seeds * 3 * 6


def test_lines_of_rows_told_apart_by_nulls(spark):
    """A null text and a null source don't make one row of two; a line of every document is popular and still goes."""
    rows = [(200, "a", None), (200, None, "a")] + [(i, f"own {i}\nsame\n{'often' if i % 2 else 'rare'} line", f"s{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {(r.doc_id, r.source): (r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got[200, None] == ("a", 1, 0) and got[200, "a"] == (None, 0, 0)
    assert got[0, "s0"] == ("own 0\nsame\nrare line", 3, 0) and got[1, "s1"] == ("own 1\noften line", 3, 1) and got[2, "s2"] == ("own 2", 3, 2)
