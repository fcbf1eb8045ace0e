"""The pipeline's stages one by one on odd rows, and the whole on the small tables."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cueflow.llm import bpe, quality

PROSE = "The river ran past the old mill, and nobody in the village remembered who had built it or why. "


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    rows = [(i, PROSE * (3 + i % 4) + f"Ending number {i} of many.\nShare this page", f"s{i % 12}") for i in range(24)]
    rows += [(100, None, "s1"), (101, "", "s2"), (None, PROSE + "No id.", None), (None, PROSE + "No id.", None), (5, rows[5][1], rows[5][2]), (5, "Another text with a used id.", "s0")]
    rows += [(102, PROSE + item, "s3"), (None, "Before it. " + item, "s4"), (103, PROSE * 3000, "s5")]
    return spark.createDataFrame([(d, t, "en", s, 0, 1, 2, 3) for d, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, ids int, `a.b` int")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, sf_dir, docs, name, stage):
    out = stage(spark, docs, sf_dir)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    rows = out.collect()
    if name != "bpe":
        assert out.columns == docs.columns
    if name == "quality":
        model, _ = quality.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
        assert model is None or len(rows) <= docs.count()
    if name == "line_dedup":
        assert len(rows) == docs.count()
        assert sum("Share this page" in (r.text or "") for r in rows) == 1
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    if name == "near_dedup":
        texts = [r.text for r in rows]
        assert len(set(texts)) == len(texts) and sum(not t for t in texts) == 1
        assert sum("No id" in (t or "") for t in texts) == 1 and sum(r.doc_id == 5 for r in rows) <= 2
    if name == "decontamination":
        want = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 102 and "Before it" not in (r.text or "")]
        assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(want, key=repr)
    if name == "bpe":
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
        want = [(r.doc_id, plain.encode_ordinary(r.text or ""), r.text or "") for r in docs.collect()]
        assert sorted(((r.doc_id, list(r.ids), r.text) for r in rows), key=repr) == sorted(want, key=repr)
        assert all(r.n_tokens == len(r.ids) for r in rows)


def test_whole(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert 0 < len(out) <= len(given) and len({r.doc_id for r in out}) == len(out)
    lines = {r.doc_id: set((given[r.doc_id] or "").split("\n")) for r in out}
    assert all(set(r.text.split("\n")) <= lines[r.doc_id] | {""} for r in out)
    assert len({hashlib.sha256(r.text.encode()).digest() for r in out}) == len(out)


def test_quality_stage_keeps_what_scores(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted}
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in kept} == good and len(kept) == len(good) and 0 < len(good) < docs.count()
    given = {r.doc_id: r for r in docs.collect()}
    assert all(r == given[r.doc_id] for r in kept)
