"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass turns each text into a short vector of statistics. Class means and covariances are sums that
Spark aggregates over all labelled rows; covariances shrink towards the pooled one and towards a
multiple of the identity; their Cholesky factors are inverted once on the driver and cached in the
model as plain numbers. A score is the difference of two log-densities, each a Mahalanobis distance
by triangular products in one SQL expression, so scoring needs no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.llm.runtime import cut, held_out, in_batches, row_and, space_table, span_hashes, text_bytes, word_spans

FEATURES = (
    "log_words",
    "log_word_length",
    "word_length_spread",
    "letters",
    "capitals",
    "digits",
    "punctuation",
    "symbols",
    "log_words_per_line",
    "vocabulary",
    "repeated_lines",
    "short_words",
)

#: Texts whose statistics are made at once.
ROWS = 256

_SPACE = space_table()
_CLASSES = np.full(256, 6, np.int64)  # 6: symbols
_CLASSES[list(b" \t\x0b\x0c\r")] = 0
_CLASSES[ord("\n")] = 1
_CLASSES[ord("a") : ord("z") + 1] = 2
_CLASSES[ord("A") : ord("Z") + 1] = 3
_CLASSES[ord("0") : ord("9") + 1] = 4
_CLASSES[list(b".,;:'\"-?()")] = 5
_CLASSES[0x80:0xC0] = 7  # further bytes of a character
_CLASSES[0xC0:] = 2
_NEWLINE = np.zeros(256, bool)
_NEWLINE[ord("\n")] = True


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    keys = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    return np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One line of FEATURES per text; a text without words has statistics too (ratios are 0)."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * 8 + _CLASSES[data], minlength=n * 8).reshape(n, 8).astype(float)
    starts, ends = word_spans(data, offsets, _SPACE)
    of = np.searchsorted(offsets, starts, side="right") - 1
    length = (ends - starts).astype(float)
    words = np.bincount(of, minlength=n).astype(float)
    total, squares = np.bincount(of, length, n), np.bincount(of, length**2, n)
    short = np.bincount(of, length <= 3, n)
    distinct = _distinct(of, span_hashes(data, starts, ends), n)
    ls, le = word_spans(data, offsets, _NEWLINE)
    line_of = np.searchsorted(offsets, ls, side="right") - 1
    lines = np.bincount(line_of, minlength=n).astype(float)
    distinct_lines = _distinct(line_of, span_hashes(data, ls, le), n)
    some = np.maximum(words, 1)
    mean = total / some
    letters = counts[:, 2] + counts[:, 3]
    visible = np.maximum(counts[:, 2:7].sum(axis=1), 1)
    arc = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    return np.stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.log1p(np.sqrt(np.maximum(squares / some - mean**2, 0))),
            arc(letters / visible),
            arc(counts[:, 3] / np.maximum(letters, 1)),
            arc(counts[:, 4] / visible),
            arc(counts[:, 5] / visible),
            arc(counts[:, 6] / visible),
            np.log1p(words / np.maximum(lines, 1)),
            np.log1p(distinct) / np.maximum(np.log1p(words), 1),
            arc(1 - distinct_lines / np.maximum(lines, 1)),
            arc(short / some),
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key column and FEATURES (double) of every row; a null text counts as empty."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                m = statistics(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[:, i]) for i in range(len(FEATURES)))], [key, *FEATURES])

    return in_batches(docs.select(key, "text"), run, row_and(docs, key, ", ".join(f"{f} double" for f in FEATURES)))


@dataclass(frozen=True)
class Discriminant:
    """For each class: mean, inverse of the Cholesky factor, and the constant of its log-density."""

    mean: tuple
    inverse: tuple
    constant: tuple

    def log_odds(self) -> Column:
        """Log-density of class 1 less that of class 0, with the priors, over the FEATURES columns."""
        parts = []
        for k in (0, 1):
            centred = [F.col(f) - F.lit(float(m)) for f, m in zip(FEATURES, self.mean[k], strict=True)]
            z = [sum((c * F.lit(float(w)) for c, w in zip(centred[: i + 1], row[: i + 1], strict=True)), F.lit(0.0)) for i, row in enumerate(self.inverse[k])]
            parts.append(F.lit(float(self.constant[k])) - sum((x * x for x in z), F.lit(0.0)) / 2)
        return parts[1] - parts[0]


def fit(labelled: DataFrame, label: str = "label", to_pooled: float = 0.3, to_identity: float = 0.05) -> Discriminant | None:
    """Fits over all rows of ``labelled`` (FEATURES and a 0/1 label); None unless both classes occur.

    Covariances become (1 - to_pooled) own + to_pooled pooled, then (1 - to_identity) of that plus
    to_identity times the mean variance on the diagonal.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r["k"]: r for r in labelled.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    if set(found) != {0, 1}:
        return None
    n, mean, cov = {}, {}, {}
    for k, r in found.items():
        n[k] = r["n"]
        mean[k] = np.array([r[f"s{i}"] for i in range(d)]) / n[k]
        cov[k] = np.zeros((d, d))
        for i, j in pairs:
            cov[k][i, j] = cov[k][j, i] = r[f"p{i}_{j}"] / n[k] - mean[k][i] * mean[k][j]
    total = n[0] + n[1]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    inverse, constant = {}, {}
    for k in (0, 1):
        c = (1 - to_pooled) * cov[k] + to_pooled * pooled
        # The identity is scaled feature by feature: by the pooled variances, with a floor for constants.
        c = (1 - to_identity) * c + to_identity * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(c)
        inverse[k] = np.linalg.inv(factor)
        constant[k] = math.log(n[k] / total) - float(np.log(np.diag(factor)).sum())
    t = lambda m: tuple(map(tuple, m.tolist()))
    return Discriminant((tuple(mean[0].tolist()), tuple(mean[1].tolist())), (t(inverse[0]), t(inverse[1])), (constant[0], constant[1]))


def one_label(labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and label of the ids whose labels are known and agree."""
    agreed = labels.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("top")).filter(F.col("label") == F.col("top"))
    return agreed.select(F.col("doc_id").alias("labelled"), "label")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Discriminant | None, DataFrame]:
    """The model learned from the labelled rows that are not held out, and the statistics of all rows by doc_id."""
    known = cut(with_statistics(docs), "statistics")
    return fit(known.filter(~held_out()).join(one_label(labels), F.col("doc_id") == F.col("labelled"))), known


def _score(model: Discriminant | None) -> Column:
    odds = model.log_odds() if model else F.lit(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), -odds))))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Labels are learned from rows that are not held out; without labels of both classes every score is
    0.5. Null and empty texts are scored as texts without words, repeated rows each get their row, and
    columns besides doc_id and text are not read.
    """
    model, known = learn(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels)
    scored = known.select("doc_id", held_out().alias("held_out"), _score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, each judged by its own text; repeated rows stay repeated."""
    model, _ = learn(docs.select("doc_id", "text"), labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return with_statistics(rows, "row").filter(_score(model) >= 0.5).select("row.*")
