"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, by the forward recursion
``alpha[i] = sum over pieces ending at i of alpha[start] * p(piece)``; that of a text is the product
over its words. Words are runs of letters, in lower case, each with the space before it, which many
pieces begin with. Pieces are byte strings and all single bytes are among them, so every word has a
segmentation. Probabilities come from expectation-maximisation over word counts of a bounded sample,
each step one Spark aggregation.

The recursion runs for many words at once: a piece is found by a rolling hash of its bytes among the
pieces of its length; words repeat so much that a task computes few of them anew. Very long words go
one by one, by the same recursion.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm.runtime import cut, held_out, in_batches

#: Bytes of the longest words that are taken many at once, and remembered.
SHORT = 64
#: Probabilities are scaled by this for each byte, so that those of short words stay within floating point.
PER_BYTE = 1e4
#: Sums below this are taken by logarithms instead: some of their parts may have left floating point.
LEAST_SUM = 1e-200
#: Rows per language that probabilities are learned from, in expectation.
SAMPLE_ROWS = 3000
#: Words a task remembers.
REMEMBERED = 400_000
LETTERS = r"\p{L}+"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a rank file, and all single bytes; found by length and rolling hash, or by their bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        pieces |= {bytes([i]) for i in range(256)}
        self.place = {p: i for i, p in enumerate(sorted(pieces - {b""}))}
        by_length: dict[int, list[bytes]] = {}
        for p in self.place:
            by_length.setdefault(len(p), []).append(p)
        self.tables = {}
        for n, some in by_length.items():
            # The last byte counts once, each one before it a factor more.
            flat = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), n).astype(np.uint64)
            keys = np.zeros(len(some), np.uint64)
            for k in range(n):
                keys = keys * _FACTOR + flat[:, k]
            order = np.argsort(keys)
            # A first test by a bitmap spares most keys the search.
            maybe = np.zeros(1 << 16, bool)
            maybe[self._slot(keys)] = True
            self.tables[n] = keys[order], np.array([self.place[p] for p in some])[order], maybe
        self.lengths = np.zeros(len(self.place), np.int64)
        for piece, i in self.place.items():
            self.lengths[i] = len(piece)
        self.longest = max(self.tables)
        self.factors = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.longest, _FACTOR)]), dtype=np.uint64)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)

    def __len__(self) -> int:
        return len(self.place)

    def scaled(self, p: np.ndarray) -> np.ndarray:
        return p * (PER_BYTE ** self.lengths.astype(float)).reshape(-1, *[1] * (p.ndim - 1))

    def in_many(self, flat: np.ndarray, first: np.ndarray):
        """For each end i in the words' bytes (a matrix): i and a list of (size, rows, pieces). Rows before first[i] end before i."""
        for i in range(1, flat.shape[1] + 1):
            lo, found = int(first[i]), []
            key = np.zeros(len(flat) - lo, np.uint64)
            for size in range(1, min(self.longest, i) + 1):
                key = key + flat[lo:, i - size].astype(np.uint64) * self.factors[size - 1]
                if size not in self.tables:
                    continue
                keys, pieces, maybe = self.tables[size]
                some = np.flatnonzero(maybe[self._slot(key)])
                at = np.searchsorted(keys, key[some])
                at[at == len(keys)] = 0
                right = keys[at] == key[some]
                if right.any():
                    found.append((size, some[right] + lo, pieces[at[right]]))
            yield i, found

    def in_one(self, word: bytes):
        """For each end i in a word: the starts and the pieces."""
        sizes = sorted(self.tables)
        for i in range(1, len(word) + 1):
            pieces = [(i - n, self.place.get(word[i - n : i])) for n in sizes if n <= i]
            yield i, [(a, k) for a, k in pieces if k is not None]


def as_bytes(word: str) -> bytes:
    return b" " + word.encode()


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by length, lengths in that order, matrix of bytes)."""
    length = np.array([len(b) for b in words], np.int64)
    order = np.argsort(length, kind="stable")
    wide = int(length.max())
    flat = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in order.tolist()), np.uint8).reshape(len(words), wide)
    return order, length[order], flat


def _logs_of_one(word: bytes, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log forward sums at every place of a word, by language: (bytes + 1) x languages."""
    log_p = np.log(p)
    out = np.full((len(word) + 1, p.shape[1]), -np.inf)
    out[0] = 0
    for i, found in vocabulary.in_one(word):
        starts, pieces = zip(*found, strict=True)
        each = out[list(starts)] + log_p[list(pieces)]
        top = each.max(axis=0)
        out[i] = top + np.log(np.exp(each - top).sum(axis=0))
    return out


def log_likelihood(words: list[bytes], vocabulary: Vocabulary, p: np.ndarray, scaled: np.ndarray | None = None) -> np.ndarray:
    """log p(word | language) for each word (rows) and language (columns); ``p``: pieces x languages, none of them 0.

    ``scaled`` is ``vocabulary.scaled(p)``, if it is there already.
    """
    out = np.zeros((len(words), p.shape[1]))
    long = [i for i, w in enumerate(words) if len(w) > SHORT]
    for i in long:
        out[i] = _logs_of_one(words[i], vocabulary, p)[-1]
    short = [i for i, w in enumerate(words) if len(w) <= SHORT]
    if not short:
        return out
    order, length, flat = _matrix([words[i] for i in short])
    scaled = vocabulary.scaled(p) if scaled is None else scaled
    alpha = np.zeros((flat.shape[1] + 1, len(flat), p.shape[1]))
    alpha[0] = 1
    # Words are sorted by length: those shorter than i are done before place i.
    done = np.searchsorted(length, np.arange(flat.shape[1] + 2))
    for i, found in vocabulary.in_many(flat, done):
        for size, rows, pieces in found:
            alpha[i, rows] += alpha[i - size, rows] * scaled[pieces]
    sums, at = alpha[length, np.arange(len(flat))], np.array(short)[order]
    low = np.flatnonzero((sums < LEAST_SUM).any(axis=1))
    sums[low] = 1
    out[at] = np.log(sums) - length[:, None] * np.log(PER_BYTE)
    # Where the scale doesn't hold the sums of some language, logarithms do.
    for i in at[low].tolist():
        out[i] = _logs_of_one(words[i], vocabulary, p)[-1]
    return out


def expected_pieces(words: list[bytes], counts: np.ndarray, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of the words, weighted by ``counts``.

    ``p`` is one language's probabilities, none of them 0.
    """
    out = np.zeros(len(vocabulary))

    def by_logs(w: bytes, n: float) -> None:
        forward = _logs_of_one(w, vocabulary, p[:, None])[:, 0]
        ends = list(vocabulary.in_one(w))
        backward = np.full(len(w) + 1, -np.inf)
        backward[-1] = 0
        for i, found in reversed(ends):
            for a, k in found:
                through = np.log(p[k]) + backward[i]
                out[k] += n * np.exp(forward[a] + through - forward[-1])
                backward[a] = np.logaddexp(backward[a], through)

    for w, n in zip(words, counts, strict=True):
        if len(w) > SHORT:
            by_logs(w, n)
    short = [i for i, w in enumerate(words) if len(w) <= SHORT]
    if not short:
        return out
    order, length, flat = _matrix([words[i] for i in short])
    counts, scaled = np.asarray(counts)[np.array(short)[order]], vocabulary.scaled(p)
    wide, n = flat.shape[1], len(flat)
    places = list(vocabulary.in_many(flat, np.searchsorted(length, np.arange(wide + 2))))
    forward, backward = np.zeros((wide + 1, n)), np.zeros((wide + 1, n))
    forward[0] = 1
    for i, found in places:
        for size, rows, pieces in found:
            forward[i, rows] += forward[i - size, rows] * scaled[pieces]
    backward[length, np.arange(n)] = 1
    whole = forward[length, np.arange(n)]
    low = np.flatnonzero(whole < LEAST_SUM)
    for i in low.tolist():
        by_logs(words[short[order[i]]], counts[i])
    counts = np.where(whole < LEAST_SUM, 0.0, counts)
    whole[low] = 1
    for i, found in reversed(places):
        for size, rows, pieces in found:
            through = scaled[pieces] * backward[i, rows]
            backward[i - size, rows] += through
            np.add.at(out, pieces, forward[i - size, rows] * through / whole[rows] * counts[rows])
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    vocabulary: Vocabulary
    pieces: np.ndarray  # vocabulary x languages
    log_prior: np.ndarray


def _normalised(counts: np.ndarray, smoothing: float) -> np.ndarray:
    return (counts + smoothing) / (counts + smoothing).sum()


def learn(rows: DataFrame, vocabulary_path: str, sample_rows: int = SAMPLE_ROWS, steps: int = 3, smoothing: float = 0.05) -> LanguageModel:
    """Learns from columns doc_id, text and lang of ``rows`` (lang not null).

    Of each language about ``sample_rows`` rows are used, those whose hashed id is below a threshold;
    a language of fewer rows is used whole. The model has the size vocabulary x languages.
    """
    spark = rows.sparkSession
    vocabulary = Vocabulary(vocabulary_path)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), vocabulary, np.zeros((len(vocabulary), 0)), np.zeros(0))
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / counts[lang]))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20))
    each = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word"))
    words = cut(each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    of = {lang: i for i, lang in enumerate(languages)}
    p = np.full((len(vocabulary), len(languages)), 1.0 / len(vocabulary))
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((vocabulary, p, of))

        def expect(batches, shared=shared):
            import pyarrow as pa

            vocabulary, p, of = shared.value
            sums = np.zeros(p.shape)
            for b in batches:
                langs = np.array([of[x] for x in b.column(0).to_pylist()], np.int64)
                n = b.column(2).to_numpy().astype(float)
                text = [as_bytes(w) for w in b.column(1).to_pylist()]
                for k in range(p.shape[1]):
                    mine = np.flatnonzero(langs == k)
                    for at in range(0, len(mine), 4096):
                        some = mine[at : at + 4096]
                        sums[:, k] += expected_pieces([text[i] for i in some], n[some], vocabulary, p[:, k])
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(sums[piece, lang])], ["piece", "lang", "n"])

        found = in_batches(words, expect, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros(p.shape)
        sums[found["piece"].to_numpy(np.int64), found["lang"].to_numpy(np.int64)] = found["n"].to_numpy()
        p = np.stack([_normalised(sums[:, k], smoothing) for k in range(p.shape[1])], axis=1)
        shared.unpersist()
    # A flat prior: a hot language is not likelier for being common in the sample.
    return LanguageModel(languages, vocabulary, p, np.zeros(len(languages)))


class Scorer:
    """Texts to languages with a bounded memory of words."""

    def __init__(self, model: LanguageModel, remembered: int = REMEMBERED):
        import regex

        self.model, self.remembered, self.place = model, remembered, {}
        self.known = np.zeros((0, len(model.languages)))
        self.scaled = model.vocabulary.scaled(model.pieces)
        self.words = regex.compile(LETTERS).findall

    def _learn(self, words: list[str]) -> None:
        rows = [log_likelihood([as_bytes(w) for w in words[i : i + 8192]], self.model.vocabulary, self.model.pieces, self.scaled) for i in range(0, len(words), 8192)]
        self.place.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.known = np.vstack([self.known, *rows])

    @staticmethod
    def _short(word: str) -> bool:
        return len(word) < SHORT // 4 or len(as_bytes(word)) <= SHORT

    def total(self, words: list[str]) -> np.ndarray:
        """The sum of the words' log-likelihoods; taken in stretches, so that what is new at once is bounded."""
        out = self.model.log_prior.copy()
        at = list(map(self.place.get, words))
        if None not in at:
            return out + self.known[at].sum(axis=0)
        for lo in range(0, len(words), self.remembered // 4):
            some = words[lo : lo + self.remembered // 4]
            long = [as_bytes(w) for w in some if not self._short(w)]
            if long:
                out += log_likelihood(long, self.model.vocabulary, self.model.pieces, self.scaled).sum(axis=0)
                some = [w for w in some if self._short(w)]
            new = sorted(set(some).difference(self.place))
            if len(self.place) + len(new) > self.remembered:
                self.place, self.known = {}, self.known[:0]
                new = sorted(set(some))
            if new:
                self._learn(new)
            if some:
                out += self.known[[self.place[w] for w in some]].sum(axis=0)
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = self.model
        words = [self.words(t.lower()) if t else [] for t in texts]
        # New words of a group of texts are learned together.
        new: set[str] = set()
        for w in words if model.languages else []:
            new.update(w)
            if len(new) > self.remembered // 4:
                break
        new = {w for w in new if w not in self.place and self._short(w)}
        if new and len(self.place) + len(new) <= self.remembered:
            self._learn(sorted(new))
        names, scores = [], []
        for w in words:
            if not w or not model.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.total(w)
            best = int(total.argmax())
            names.append(model.languages[best])
            scores.append(float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum()))
        return names, scores


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row: the posterior of the best language, ``und`` and 0 without letters."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        score = Scorer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                names, values = score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["doc_id", "lang_pred", "score"])

    return in_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, lang_pred string, score double")


def identify_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from the rows of ``docs`` that are not held out.

    Rows without lang or text teach nothing; if none is left, every prediction is ``und`` with score
    0. Equal likelihoods go to the language first in the alphabet. Repeated rows each get their row, texts
    of any length are read whole, an empty table gives none, columns besides doc_id, text and lang are
    not read.
    """
    train = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return identify(docs, learn(train, vocabulary_path)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
