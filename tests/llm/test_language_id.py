"""Language identification: the recursion against all segmentations, held-out accuracy, odd texts."""

import math
import random

import numpy as np
import public_tokenizers
import pytest

from cueflow.llm import language_id as li

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return li.Vocabulary(PATH)


def _segmentations(word, vocabulary):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in vocabulary.place:
            for rest in _segmentations(word[n:], vocabulary):
                yield [vocabulary.place[word[:n]], *rest]


def test_all_segmentations(vocabulary):
    rng = np.random.default_rng(1)
    p = rng.random((len(vocabulary), 3))
    p /= p.sum(axis=0)
    words = [li.as_bytes(w) for w in ("a", "the", "straße", "información", "дом", "xqzj")]
    got = li.log_likelihood(words, vocabulary, p)
    counts = np.array([1.0, 2, 3, 1, 5, 1])
    expected = np.zeros(len(vocabulary))
    for w, row, n in zip(words, got, counts, strict=True):
        every = list(_segmentations(w, vocabulary))
        each = np.array([p[s].prod(axis=0) for s in every])
        assert np.allclose(row, np.log(each.sum(axis=0)))
        for s, share in zip(every, each[:, 0] / each[:, 0].sum(), strict=True):
            for k in s:
                expected[k] += n * share
    assert np.allclose(li.expected_pieces(words, counts, vocabulary, p[:, 0]), expected)


def test_long_words_as_short_ones(vocabulary, monkeypatch):
    rng = random.Random(2)
    p = np.random.default_rng(3).random((len(vocabulary), 2)) ** 6 + 1e-9
    p /= p.sum(axis=0)
    words = [li.as_bytes("".join(rng.choice("abcdeößжш") for _ in range(n))) for n in (1, 5, 20, 30, 31)]
    short, pieces = li.log_likelihood(words, vocabulary, p), li.expected_pieces(words, np.ones(5), vocabulary, p[:, 1])
    monkeypatch.setattr(li, "SHORT", 2)
    assert np.allclose(li.log_likelihood(words, vocabulary, p), short)
    assert np.allclose(li.expected_pieces(words, np.ones(5), vocabulary, p[:, 1]), pieces)
    assert math.isfinite(li.log_likelihood([b" " + b"abcde" * 4000], vocabulary, p)[0, 0])


def test_probabilities_beyond_the_scale(vocabulary):
    """A script that no language was learned from, under a model of very small probabilities."""
    p = np.full((len(vocabulary), 2), 0.05 / 1e8)
    p[vocabulary.place[b"a"]] = 0.9
    word = li.as_bytes("\u1200" * 21)
    assert len(word) == li.SHORT
    got = li.log_likelihood([word, b" a"], vocabulary, p)
    assert np.isfinite(got).all() and np.allclose(got[0], li._logs_of_one(word, vocabulary, p)[-1])
    pieces = li.expected_pieces([word], np.ones(1), vocabulary, p[:, 0])
    assert np.isfinite(pieces).all() and pieces.sum() > 0
    model = li.LanguageModel(("a", "b"), vocabulary, p, np.zeros(2))
    assert li.Scorer(model)(["\u1200" * 21]) == (["a"], [0.5])


def test_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = li.identify_documents(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred != 'und'").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_odd_texts(spark):
    rng = random.Random(5)
    en, de = "the and with that from which have this".split(), "und der die nicht mit auch eine werden".split()
    rows = [(i, " ".join(rng.choices(w, k=30)), lang, 1) for i, (w, lang) in enumerate([(en, "en"), (de, "de")] * 30)]
    odd = [None, "", " \n", "12 345 6.7", "\u00bd \u2461 \u00b2 \u2167", "_ _", "!?"]
    rows += [(1000 + i, t, "en", 1) for i, t in enumerate(odd)]
    rows += [(None, "the and with", None, 1), (3, rows[3][1], "de", 1), (2000, "nicht " * 300_000 + "w" * 5000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = li.identify_documents(docs, PATH).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[1000 + i].lang_pred == "und" and by_id[1000 + i].score == 0 for i in range(len(odd)))
    assert by_id[None].lang_pred == "en" and by_id[2000].lang_pred == "de" and by_id[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    assert li.identify_documents(docs.limit(0), PATH).count() == 0
    assert {r.lang_pred for r in li.identify_documents(docs.withColumn("lang", docs.lang.substr(9, 1)), PATH).collect()} <= {"und", ""}
