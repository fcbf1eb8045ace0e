"""The trie against one built with plain tuples: branches, copies, one long conversation, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cueflow.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, owner int, h1 int"


def plain(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    for own in convs.values():
        own.sort(key=lambda z: z[:2])
    made, members, below = {}, defaultdict(list), defaultdict(set)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(x[2:] for x in convs.get(c - c % 5, [])[:h] + own[h:])
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    for k in members:
        if k:
            below[k[:-1]].add(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        ends = ",".join(str(c) for c in members[k] if len(made[c]) == len(k))
        out[k] = (
            members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(below[k]),
            sum(out[x][5] for x in below[k]) if below[k] else 1, own + sum(out[x][6] for x in below[k]), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in pt.prefix_trie(df).collect()), key=repr)


def _random(seed, convs, depth, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for c in range(convs) for t in range(rng.randint(1, depth))]


@pytest.mark.parametrize("slices", [False, True])
def test_trie_equals_plain(spark, monkeypatch, slices):
    if slices:
        monkeypatch.setattr(pt, "SLICE_TURNS", 3)
        monkeypatch.setattr(pt, "PIECE", 4)
        monkeypatch.setattr(pt, "SHARE", 4)
    rows = _random(1, 120, 12, ["a", "b", "é" * 5, ""])
    # Copies, a long conversation, missing donors, null and unordered turns, null roles and texts.
    rows += [(200 + 5 * i, t, "user", "same") for i in range(30) for t in range(3)]
    rows += [(400, t, "user", f"turn {t}") for t in range(300)]
    rows += [(1003, 2, None, None), (1003, None, "user", "first"), (1003, 1, "", ""), (-7, 0, "user", "below zero"), (None, 0, "user", "nobody's")]
    random.Random(2).shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_deep_branches(spark):
    """Each conversation leaves the one before it a turn later, so that runs hang on runs."""
    base = [("user", f"t{i}") for i in range(30)]
    rows = []
    for i in range(25):
        # Turns past the ninth are a conversation's own, so those before them are the same in all.
        turns = base[: 9 + (i + 9) // 3] + [("bot", f"own {100 - i} {j}") for j in range(i % 4)]
        rows += [(5 * (100 - i), t, *x) for t, x in enumerate(turns)]
    assert got(spark, rows) == plain(rows)


def test_ties_and_empty(spark):
    rows = [(0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "bot", "y"), (5, 3, "user", "z" * 2_000_000)]
    out = got(spark, rows)
    assert len(out) == 1 + 3 + 1 and [r[3] for r in out if r[1] == 0] == [2]
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
