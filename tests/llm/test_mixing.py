"""The mix: targets against plain water-filling, exact quotas and slots, the law of the tree, odd rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueflow.llm import mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share[s] if s in share else 3.0 * sizes[s] for s in order}
        stopped |= over


def _docs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, n, most in (("big", 400, 40), ("a", 30, 60), ("é", 25, 300), ("z", 3, 5), ("\U0001f600", 40, 50), ("￿", 20, 50), (None, 60, 40), ("one", 1, 900), ("empty", 5, 1)):
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.integers(0, most))), s) for i in range(n)]
    rows += [(None, "no id", "a"), (None, "no id", "a"), (0, "same id", "a"), (7, None, "a"), (8, "", None), (9, " \n\t", "big"), (10, "long " * 300_000, "long")]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, source string, size int, taken int, target int")


@pytest.mark.parametrize("few", [False, True])
def test_mix(spark, monkeypatch, few):
    if few:  # several sources in a class, blocks of a few documents
        monkeypatch.setattr(mixing, "CLASSES", 2)
        monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
        monkeypatch.setattr(mixing, "BLOCKS", 10**6)
        monkeypatch.setattr(mixing, "BUFFER", 3)
    docs = _docs(spark)
    rows = mixing.mixture(docs).collect()
    of = Counter((r.doc_id, len((r.text or "").split())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"]) for r in rows) == of
    sizes, owner = Counter(), defaultdict(set)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    for r in rows:
        owner[r.source_size, r.target].add(r.doc_id)
    want = plain_targets(sizes)
    assert {(n, round(t, 6)) for n, t in owner} == {(sizes[s], round(want[s], 6)) for s in sizes}
    taken, largest, slots = Counter(), Counter(), defaultdict(list)
    for r in rows:
        assert r.taken == r["size"] * len(r.drawn) <= 3 * r["size"]
        assert len({x["pass"] for x in r.drawn}) == len(r.drawn)
        taken[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r["size"])
        for x in r.drawn:
            slots[x.shard].append(x.slot)
    for (n, t), got in taken.items():
        assert abs(got - t) <= max(2, min(largest[n, t] / 2, 0.02 * t if n > 100 * 10 and largest[n, t] < n / 4 else n)), (n, t, got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = mixing.mixture(docs.repartition(7, "text")).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, rows))


def test_nothing_to_mix(spark):
    docs = _docs(spark)
    assert mixing.mixture(docs.limit(0)).count() == 0
    rows = mixing.mixture(docs.filter("source = 'empty'")).collect()
    assert rows and all(r.taken == 0 and r.drawn == [] and r.target == 0 for r in rows)


def test_quotas_are_exact_and_follow_the_law():
    quotas, shards = [50, 30, 20, 0], [34, 33, 33]
    seen = np.array([mixing.split_quotas(quotas, shards, s) for s in range(4000)])
    assert (seen.sum(axis=2) == quotas).all() and (seen.sum(axis=1) == shards).all()
    n, k, m = 100, quotas[0], shards[0]
    mean, var = m * k / n, m * k / n * (1 - k / n) * (n - m) / (n - 1)
    first = seen[:, 0, 0]
    assert abs(first.mean() - mean) < 5 * (var / 4000) ** 0.5 and abs(first.var() / var - 1) < 0.15
    # Two sources in one shard, and one source in two shards, have the law's covariances.
    both = np.cov(seen[:, 0, 0], seen[:, 1, 0])[0, 1]
    assert abs(both + m * (50 / 100) * (30 / 100) * (n - m) / (n - 1)) < 0.4
    apart = np.cov(seen[:, 0, 0], seen[:, 0, 1])[0, 1]
    assert abs(apart + shards[0] * shards[1] * 50 * 50 / (n * n * (n - 1))) < 0.4


def test_rows_spread_evenly_over_shards(spark):
    """Over seeds each document meets each shard, and each half of its shard, about equally often."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    seen, n = Counter(), 0
    for seed in range(5):
        for r in mixing.mixture(docs, shards=2, seed=seed, weights=(1,)).collect():
            for x in r.drawn:
                seen[x.shard, x.slot < 15] += 1
                n += 1
    assert n == 5 * 60 and sum((seen[s, h] - n / 4) ** 2 / (n / 4) for s in (0, 1) for h in (True, False)) < 40
