"""Order MinHash of short texts tells the order of their words."""

import random

from pyspark.sql import functions as F

from cueflow.llm import order_minhash as om


def test_swapped_halves_of_short_texts(spark):
    rng, rows = random.Random(9), []
    for n in (14, 30, 45, 80, 100):
        for _ in range(8):
            w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2]), " ".join(w[:-1] + ["end"])))
    df = spark.createDataFrame(rows, "n int, a string, b string, c string")
    for c in "abc":
        df = om.with_fingerprint(df, c, f"f{c}")
    got = df.groupBy("n").agg(F.avg(om.likeness("fa", "fb")).alias("swapped"), F.avg(om.likeness("fa", "fc")).alias("last")).collect()
    for r in got:
        # A tuple survives if both its k-mers do and they are of the same half: about 0.3 to 0.45.
        assert r.swapped < 0.55, r
        # The last word changes one of k k-mers: a tuple stays if its two are among the k - 1 of k + 1 in both texts.
        k = r.n - 4
        assert abs(r.last - (k - 1) * (k - 2) / ((k + 1) * k)) < 0.1, r


def test_every_tuple_has_the_least_of_its_order(spark):
    rng = random.Random(4)
    texts = ["one", "a b c d e f", *(" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (12, 45, 200, 900))]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    prints = [r.f for r in om.with_fingerprint(df, "a", "f").select("f").collect()]
    assert all(len(p) == om.TUPLES for p in prints)
    # With ten or more k-mers hardly any two tuples have the same pair in the same order.
    assert [len(set(p)) for p in prints[:2]] == [1, 1]
    assert all(len(set(p)) > 0.6 * om.TUPLES for p in prints[3:])


def _xxh(*values):
    """Spark's xxhash64 of ints (Python's int pairs (value, bytes)) and strings, each seeded with the hash before."""
    from xxhash import xxh64_intdigest

    seed = 42
    for v in values:
        seed = xxh64_intdigest(v.encode() if isinstance(v, str) else (v[0] & ((1 << 8 * v[1]) - 1)).to_bytes(v[1], "little"), seed)
    return seed


def _brute_force(text):
    words = [_xxh(w) for w in text.split()]
    if not words:
        return []
    kmers = [_xxh(*((w, 8) for w in words[i : i + om.K])) for i in range(max(1, len(words) - om.K + 1))]
    seen, numbered = {}, []
    for k in kmers:
        seen[k] = seen.get(k, -1) + 1
        numbered.append(_xxh((k, 8), (seen[k], 4)))
    positive, out = (1 << 63) - 1, []
    for t in range(om.TUPLES):
        order = sorted(range(len(numbered)), key=lambda i: (0, numbered[i] & positive) if (numbered[i] & positive) >> 57 == t else (1, _xxh((numbered[i], 8), (t, 4)) & positive))
        out.append(_xxh(*((numbered[i], 8) for i in sorted(order[: om.PER_TUPLE]))) & 0x7FFFFFFF)
    return out


def test_every_component_by_brute_force(spark):
    rng = random.Random(6)
    texts = ["", "one", "a b c d", "a b c d e", "x y " * 40, "z " * 300, *(" ".join(f"w{rng.randrange(m)}" for _ in range(n)) for n in (6, 30, 64, 129, 700) for m in (3, 50, 10**6))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    got = {r.i: list(r.f) for r in om.with_fingerprint(df, "a", "f").select("i", "f").collect()}
    for i, t in enumerate(texts):
        assert got[i] == _brute_force(t), t[:40]


def test_ids_missing_and_repeated(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (3, "x y z"), (3, "x y z"), (9, "q " * 50)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, `key` int")
    got = om.edited_likeness(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    assert {r.fingerprint for r in got if r.doc_id is None} == {"".join(f"{x:08x}" for x in _brute_force(rows[0][1]))}
