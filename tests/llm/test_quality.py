"""The discriminant against numpy's, and on held-out rows."""

import numpy as np

from cueflow.llm import quality
from cueflow.llm.runtime import held_out


def _plain(x, y, to_pooled=0.3, to_identity=0.05):
    d = x.shape[1]
    cov = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
    n = {k: int((y == k).sum()) for k in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / len(y)

    def log_density(k, z):
        c = (1 - to_pooled) * cov[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        c = z - x[y == k].mean(axis=0), np.linalg.inv(c), np.linalg.slogdet(c)[1]
        return np.log(n[k] / len(y)) - c[2] / 2 - np.einsum("ij,jk,ik->i", c[0], c[1], c[0]) / 2

    return lambda z: 1 / (1 + np.exp(np.clip(log_density(0, z) - log_density(1, z), -500, 500)))


def test_against_numpy_and_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    stats = {r.doc_id: np.array([r[f] for f in quality.FEATURES]) for r in quality.with_statistics(docs.select("doc_id", "text")).collect()}
    out = {r.doc_id: r.h for r in docs.select("doc_id", held_out().alias("h")).collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    train = [d for d in label if d in stats and not out[d]]
    score = _plain(np.array([stats[d] for d in train]), np.array([label[d] for d in train]))
    ids = sorted(stats)
    assert np.allclose([got[d].score for d in ids], score(np.array([stats[d] for d in ids])), atol=1e-6)
    held = [d for d in label if d in stats and out[d]]
    assert all(got[d].held_out == out[d] and got[d].predicted == int(got[d].score >= 0.5) for d in ids)
    assert len(held) > 80 and sum(got[d].predicted == label[d] for d in held) >= 0.95 * len(held)
    # The held-out labels teach nothing.
    flipped = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).filter(held_out()).unionByName(labels.filter(~held_out()).withColumn("quality", labels["quality"].cast("int")))
    again = {r.doc_id: r.score for r in quality.score_quality(docs, flipped).collect()}
    assert all(abs(again[d] - got[d].score) < 1e-9 for d in ids)
