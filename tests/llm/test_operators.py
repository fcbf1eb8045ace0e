"""Operators against brute-force versions on small fixtures with nulls, ties, copies and clashing columns."""

import hashlib
import random
from collections import Counter

import pytest

from cueflow.llm import bpe, order_minhash, quality, sharding, simhash, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(50))
    out = [None, "", " \n\t ", "one", "a b", "Ünïcode  wörds here", passage, passage, passage + " end", "start " + passage, "x y " * 60]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)], SCHEMA)


def _words(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, texts):
    seen = Counter(tuple(w[i : i + 35]) for w in map(_words, texts) for i in range(len(w) - 34))
    want = {}
    for d, w in enumerate(map(_words, texts)):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_simhash(docs, texts):
    prints = {d: simhash.fingerprint(t) for d, t in enumerate(texts)}
    root = {d: d for d in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{prints[d]:016x}", root[d]) for d in prints}


def test_bpe_equals_tiktoken(docs, texts):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for d, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        want[d] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    assert got == want


def test_sharding_is_exact_and_gapless(docs, texts):
    rows = sharding.sharded_documents(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert {r.doc_id: r.size for r in rows} == {d: len((t or "").encode()) + 1 for d, t in enumerate(texts)}


def test_order_minhash_edits(docs, texts):
    got = {r.doc_id: r for r in order_minhash.edited_likeness(docs).collect()}
    last = len(texts) - 1
    for d, t in enumerate(texts):
        own, following = t or "", texts[d - 1 if d else last] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert got[d].n_chars == len(own)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[6].fingerprint == got[7].fingerprint and got[7].near_next == 1.0


def test_quality_without_labels_is_even(spark, docs, texts):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == len(texts) and {r.score for r in rows} == {0.5}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0
    assert sharding.sharded_documents(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert order_minhash.edited_likeness(none).count() == 0
