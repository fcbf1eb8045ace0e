"""The near-duplicate stage of the pipeline against brute force over all pairs."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from cueflow.llm.shingle_dedup import close_prints, prefix_sizes


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_from_0_8_up(spark, sf_dir):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one", "One", "a b c", "a b d"]
    for n in (40, 90, 150, 300, 600):
        for _ in range(12):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for edits in {1, max(1, n // 90), max(1, n // 60), max(1, n // 45), n // 30, n // 20}:
                copy = list(base)
                for i in rng.sample(range(n), edits):
                    copy[i] = rng.choice(words)
                texts.append(" ".join(copy))
    # A group too large for looking at all its pairs.
    base = [rng.choice(words) for _ in range(200)]
    for _ in range(40):
        copy = list(base)
        copy[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(copy))
    sets = [_shingles(t) for t in texts]
    root, linked = list(range(len(texts))), []
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if _similar(sets[a], sets[b]) >= 0.8:
                linked.append(_similar(sets[a], sets[b]))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sum(0.8 <= s < 0.95 for s in linked) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()}
    assert got == {d for d in range(len(texts)) if find(d) == d}


def _families(rng, families, members):
    """Texts of one family share a template and are about 0.75 to 0.79 alike; one pair of each is 0.8 or more alike."""
    words = [f"w{i}" for i in range(20000)]
    texts = []
    for _ in range(families):
        template = [rng.choice(words) for _ in range(rng.randint(170, 230))]
        tail = round(len(template) * 0.135)
        own = lambda n=tail: [rng.choice(words) for _ in range(n)]  # noqa: B023, E731
        group = [template + own() for _ in range(members)]
        twin = list(group[0])
        for i in rng.sample(range(len(template), len(twin)), 2):
            twin[i] = rng.choice(words)
        texts += [" ".join(t) for t in [*group, twin]]
    return texts


@pytest.mark.parametrize("families, members", [(40, 14), (3, 120)])
def test_families_just_below(spark, sf_dir, families, members):
    """Groups of many that are no links, each with one that is: none is lost to the size of its group."""
    texts = _families(random.Random(families), families, members)
    sets = [_shingles(t) for t in texts]
    size = members + 1
    drop, near = set(), 0
    for f in range(families):
        for a in range(f * size, (f + 1) * size):
            for b in range(a + 1, (f + 1) * size):
                s = _similar(sets[a], sets[b])
                near += 0.74 < s < 0.8
                if s >= 0.8:
                    drop.add(b)
    assert len(drop) >= families and near > families * members * (members - 1) * 0.4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()}
    assert set(range(len(texts))) - got == drop


@given(st.sets(st.integers(0, 40), min_size=1), st.sets(st.integers(0, 40), min_size=1), st.sampled_from([0.5, 0.8, 0.9]))
def test_similar_sets_share_a_first_element(a, b, least):
    """Of similar sets the smaller one's short prefix and the larger one's whole prefix have an element in common."""
    if _similar(a, b) >= least:
        x, y = sorted((sorted(a), sorted(b)), key=len)
        short, whole = prefix_sizes(len(x), least)[0], prefix_sizes(len(y), least)[1]
        first = min(set(x) & set(y))
        i, j = x.index(first), y.index(first)
        assert i < short and j < whole and min(len(x) - i, len(y) - j) >= least / (1 + least) * (len(x) + len(y)) - 1e-6


def test_fingerprints_within_the_radius_are_pairs(spark):
    """The stage has the pairs of the operator's SimHash balls, of nodes with one fingerprint as of close ones; it had none of them."""
    rng = random.Random(2)
    prints = [rng.getrandbits(63) for _ in range(40)]
    prints += [p ^ (1 << rng.randrange(63)) for p in prints[:20]] + [p ^ 0b11 for p in prints[20:30]] + [p ^ 0b111 << 20 for p in prints[30:]] + prints[:5]
    rows = [(i * 3, p) for i, p in enumerate(prints)]
    got = {(r.a, r.b) for r in close_prints(spark.createDataFrame(rows, "node bigint, fp bigint")).collect()}
    of = dict(rows)
    assert got and all(a < b and (of[a] ^ of[b]).bit_count() <= 2 for a, b in got)
    root = {n: n for n in of}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in got:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a in of for b in of if (of[a] ^ of[b]).bit_count() <= 2)
