"""Leaks against the longest common subsequence of every item with every stretch of every text."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from cueflow.llm import decontaminate as dc


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_short_items_amid_rare_words(spark):
    rng = random.Random(8)
    common = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    prose = lambda n: rng.choices(common, weights, k=n)
    rare = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    items = [prose(n) for n in (15, 16, 17, 18, 19, 20, 40, 90) for _ in range(3)]
    texts = [prose(rng.randint(30, 120)) for _ in range(60)]
    for item in items:
        fewer = [w for i, w in enumerate(item) if i % 8 != 3]  # an edited copy
        texts += [rare(40) + item + rare(40), rare(rng.randint(0, 60)) + fewer + rare(rng.randint(0, 60)), prose(50) + item + prose(50), prose(300) + rare(20) + item + rare(20)]
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            # Stretches of an item's length, so that nothing counts that is spread over a text.
            n = len(item)
            pieces = (text[s : s + n] for s in range(max(1, len(text) - n + 1)))
            if any(_common(item, p) >= dc.SURE * n for p in pieces if (Counter(p) & Counter(item)).total() >= dc.SURE * n):
                want.add((d, i))
    assert len(want) >= 4 * len(items)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r for r in dc.leaks(docs, bench).collect()}
    assert not want - set(found)
    for (d, i), r in found.items():
        assert abs(r.common - _common(items[i], texts[d][r.from_word : r.to_word]) / len(items[i])) < 1e-9


def test_the_space_is_fitted_on_every_passage(spark):
    """The image of a matrix with a row for each passage of each text, against plain products; before, passages were drawn."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(n)) for n in (0, 1, 47, 48, 49, 96, 700, 3000)] + [None]
    known = np.unique(dc.words_of(" ".join(f"w{i}" for i in range(40))))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = dc._statistics(docs, spark.sparkContext.broadcast(known)).collect()
    want = [w[s : s + dc.WINDOW].tolist() for t in texts for w in [dc.word_ids(pa.array([t or ""]))[0]] for s in range(0, len(w), dc.WINDOW)]
    look, columns = dc.Lookup(known), len(known) + (1 << dc.BUCKET_BITS)
    want = sorted(look(np.array(w, np.uint64)).tolist() for w in want)
    got, out = [], np.zeros((columns, 5))
    idf, right = np.linspace(0.1, 2, columns), np.random.default_rng(1).standard_normal((columns, 5)).astype(np.float32)
    for r in rows:
        if r.words is not None:
            ids, size = np.frombuffer(r.words, np.int32), np.frombuffer(r.sizes, np.int32)
            got += [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
            dc.add_image(ids, size, 0.5, idf, right, out)
    assert sorted(got) == want and sum(r.n for r in rows if r.column == -1) == len(want)
    plain = np.zeros_like(out)
    for w in want:
        a = np.bincount(w, minlength=columns) * idf
        a *= 0.5 / np.linalg.norm(a)
        plain += np.outer(a, a @ right)
    assert np.allclose(out, plain, atol=1e-4)


def test_sums_of_rows_are_plain_products_of_runs_of_any_length():
    """Before, every 64 passages were a dense matrix of all columns that they have."""
    rng = np.random.default_rng(5)
    size = np.array([1, 2, 3, 48, dc.TERMS, dc.TERMS + 1, 1000, 7])
    index, weight = rng.integers(0, 50, size.sum()), rng.random(size.sum()).astype(np.float32)
    dense = rng.random((50, 6)).astype(np.float32)
    ends = np.cumsum(size)
    want = [weight[e - n : e] @ dense[index[e - n : e]] for n, e in zip(size, ends, strict=True)]
    assert np.allclose(dc.sums_of(index, weight, size, dense), want, rtol=1e-4)


def test_columns_of_hashes_that_begin_alike():
    rng = np.random.default_rng(6)
    known = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2), (np.uint64(7) << np.uint64(50)) + np.arange(40, dtype=np.uint64)]))
    rng.shuffle(known)
    look = dc.Lookup(known)
    assert look(known).tolist() == list(range(len(known)))
    others = np.setdiff1d(np.append(known + np.uint64(1), rng.integers(0, 1 << 63, 500, np.uint64)), known)
    assert (look(others) == len(known) + (others >> np.uint64(64 - dc.BUCKET_BITS)).astype(int)).all()
    assert (dc.Lookup(known[:0])(others) == (others >> np.uint64(64 - dc.BUCKET_BITS)).astype(int)).all()


def test_search_reads_the_words_that_the_space_was_fitted_on(spark):
    """Leaks are found in the stored columns; before, every text was read and hashed a second time."""
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (None, "One, two; three four five six SEVEN"), (2, ""), (3, None), (4, "none of it")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "one two three four five six seven")], "item_id bigint, text string")
    stored = [r for r in dc._statistics(docs, spark.sparkContext.broadcast(dc._known(items))).collect() if r.words is not None]
    kept = {(d, int(n)) for r in stored for d, n in zip(r.docs, np.frombuffer(r.lengths, np.int32), strict=True)}
    assert {(1, 7), (None, 7), (4, 3)} <= kept
    found = dc.leaks(docs, items)
    assert {(r.doc_id, r.item_id, r.common) for r in found.collect()} == {(1, 9, 1.0), (None, 9, 1.0)}
    assert "text" not in found._jdf.queryExecution().optimizedPlan().toString()
