"""Removed words against windows counted one by one, with every limit crossed."""

import random
from collections import Counter

import pytest

from cueflow.llm import substring_dedup as sd


def _brute_force(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(12)
    word = lambda m: f"w{rng.randrange(m)}"
    prose = lambda n, m=10**6: [word(m) for _ in range(n)]
    passage, other = prose(60), prose(36)
    texts = [None, "", " \n ", "one", "x " * 34, "x " * 35, "x " * 36, "ab " * 400, "p q r " * 60]
    # A passage quoted amid different words: its rim is one minimizer with very many spans.
    texts += [" ".join(prose(rng.randint(0, 30)) + passage + prose(rng.randint(0, 30))) for _ in range(700)]
    texts += [" ".join(prose(20) + other[: rng.randint(33, 36)] + prose(20)) for _ in range(30)]
    texts += [" ".join(prose(rng.randint(1, 120), 40)) for _ in range(40)]
    texts += [" ".join(prose(90) + ["w" * 5000 + str(i % 2)] + prose(10)) for i in range(4)]
    long = " ".join(prose(30_000))
    texts += [long, long + " end", " ".join(["cut", *long.split()[5000:9000]])]
    rows = list(enumerate(texts))
    return rows + [rows[-4], rows[20], rows[20], (None, texts[30]), (None, texts[30]), (None, "short text")]


@pytest.mark.parametrize("shard_spans", [512, 3])
def test_against_windows_counted(spark, shard_spans):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, `key` int, salt int")
    got = sd.remove_repeats(docs, shard_spans=shard_spans).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == _brute_force(rows, sd.WINDOW)


def test_other_windows(spark):
    rng = random.Random(1)
    rows = [(d, " ".join(f"w{rng.randrange(4)}" for _ in range(rng.randint(0, 60)))) for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for window in (3, 7, 20):
        got = sd.remove_repeats(docs, window=window).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == _brute_force(rows, window)


def test_automaton_counts_factors():
    rng = random.Random(2)
    for _ in range(50):
        shard = [([rng.randrange(3) for _ in range(rng.randint(4, 12))], rng.choice([1, 1, 2])) for _ in range(4)]
        seen = Counter()
        for words, weight in shard:
            for i in range(len(words) - 3):
                seen[tuple(words[i : i + 4])] += weight
        want = [sum(1 << i for i in range(len(words) - 3) if seen[tuple(words[i : i + 4])] > 1) for words, _ in shard]
        assert sd.repeated_masks(shard, 4) == want
