"""Benchmark decontamination by latent semantic retrieval.

All of the corpus, cut into passages, and the whole benchmark make a TF-IDF matrix, in which the
benchmark's rows weigh more. Its columns are the benchmark's words and hash buckets for all other words;
document frequencies of both are counted over all documents. A randomised SVD of the whole matrix (subspace
iteration from a random start) is one Spark aggregation a step, whose result has the size columns x rank.
A query is the low-rank image of a benchmark passage; a window of a document is a candidate if the
cosine between the two is high enough. The window's norm is taken over its words that the benchmark has:
no other word can be part of a match, and rare words around a short item must not hide it.
A candidate is a leak if the longest common subsequence of words covers enough of the item, or a
little less and the item's answer is there too.

The search is narrow: a document's windows, candidates and checks stay in its task. Windows that can't
be near a leak, by a bound that loses nothing, are not projected. Benchmark items are taken in blocks of
a bounded number of words, each with its own space, so what is broadcast is bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm.runtime import Cut, give_back, in_batches, space_table, span_hashes, text_bytes, word_spans

#: Words of a window, and words between the starts of two windows of a document.
WINDOW, STRIDE = 48, 16
RANK, EXTRA = 128, 16
#: Passes of the subspace iteration.
STEPS = 2
#: Weight of a document's passage as a row of the matrix; a benchmark passage's is 1. Of more passages than
#: BACKGROUND_ROWS each weighs less, so that all together weigh as much as so many: the benchmark's rows must not drown.
BACKGROUND, BACKGROUND_ROWS = 0.2, 1 << 16
#: Columns of the matrix that the words outside the benchmark are hashed into.
BUCKET_BITS = 14
#: Rows of the matrix that are multiplied at once, and terms of a sum that are gathered at once.
AT_ONCE, TERMS = 1 << 13, 64
#: Least cosine, as a share of the query's own cosine with its passage.
COSINE = 0.28
#: A leak: so much of the item in common order, or so much and the answer.
SURE, WITH_ANSWER, ANSWER = 0.75, 0.55, 0.8
#: Words of the items that are handled together, in expectation: what bounds the model that is broadcast.
BLOCK_WORDS = 1 << 16
#: Rare words of an item that a region is asked for before it is projected.
RARE = 5

_APART = space_table(bytes(c for c in range(128) if not chr(c).isalnum()))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def word_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, offsets by text); words are runs of letters and digits."""
    data, offsets = text_bytes(column)
    starts, ends = word_spans(data, offsets, _APART)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def words_of(text: str) -> np.ndarray:
    import pyarrow as pa

    return word_ids(pa.array([text.lower()], pa.string()))[0]


def answer_of(text: str) -> str:
    """The item's last sentence of at least three words; an item of one sentence has none.

    An assumption: benchmark tables of (item_id, text) don't mark the answer, and it stands last.
    """
    parts = [p for p in _SENTENCE.split(text.strip()) if len(p.split()) >= 3]
    return parts[-1] if len(parts) > 1 else ""


class Sequence:
    """Words of an item, ready to be compared with many regions."""

    def __init__(self, words: np.ndarray):
        self.n, self.places = len(words), {}
        for i, w in enumerate(words.tolist()):
            self.places[w] = self.places.get(w, 0) | (1 << i)

    def common(self, region: list[int]) -> int:
        """Length of the longest common subsequence, by bit-parallel dynamic programming."""
        full = (1 << self.n) - 1
        row = full
        for hit in filter(None, map(self.places.get, region)):
            both = row & hit
            row = ((row + both) | (row - both)) & full
        return self.n - row.bit_count()


class Lookup:
    """Columns of 64-bit hashes: the place in a fixed list of distinct ones, or a bucket behind that list."""

    def __init__(self, known: np.ndarray):
        self.order = np.argsort(known).astype(np.int32)
        self.sorted = known[self.order]
        # Hashes that begin alike stand together, and few do.
        self.bits = 4 + len(known).bit_length()
        self.first = np.searchsorted(self.sorted >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) + np.int32(len(self.sorted))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int32)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            right = self.sorted[at] == hashes[left]
            out[left[right]] = self.order[at[right]]
            at = at + 1
            more = ~right & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out


@dataclass
class Model:
    known: np.ndarray  # hashes of the benchmark's words
    idf: np.ndarray  # of those and of the buckets behind them
    basis: np.ndarray  # as many x rank, columns orthonormal


def _windows(n: int) -> list[tuple[int, int]]:
    """Windows of a text of n words: every STRIDE words, the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def sums_of(index: np.ndarray, weight: np.ndarray, size: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """For each run of ``size`` (1 or more) places the sum of the rows ``index`` of ``dense``, each times its weight."""
    # Runs are cut into pieces; pieces of about one length are a stack of small products.
    pieces = -(-size // TERMS)
    first = np.cumsum(pieces) - pieces
    run = np.repeat(np.arange(len(size)), pieces)
    skipped = (np.arange(len(run)) - first[run]) * TERMS
    begin, length = (np.cumsum(size) - size)[run] + skipped, np.minimum(size[run] - skipped, TERMS)
    out = np.empty((len(run), dense.shape[1]), np.float32)
    shorter = 0
    for width in (1, 2, 4, 8, 16, 32, 48, TERMS):
        mine, place = np.flatnonzero((length > shorter) & (length <= width)), np.arange(width)
        shorter = width
        for lo in range(0, len(mine), 2048 // width):
            some = mine[lo : lo + 2048 // width]
            at = np.minimum(begin[some, None] + place, len(index) - 1)
            terms = np.where(place < length[some, None], weight[at], np.float32(0))
            rows = dense.take(index[at].ravel(), axis=0, mode="clip").reshape(*at.shape, -1)
            out[some] = np.matmul(terms[:, None], rows)[:, 0]
    return out if len(run) == len(size) else np.add.reduceat(out, first, axis=0)


def add_image(ids: np.ndarray, size: np.ndarray, weight: float | np.ndarray, idf: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
    """Adds A' (A ``right``) to ``out``, where A has a TF-IDF row of norm ``weight`` for each passage (``size`` words of ``ids``)."""
    ends, weight = np.cumsum(size), np.broadcast_to(weight, len(size))
    for lo in range(0, len(size), AT_ONCE):
        part = size[lo : lo + AT_ONCE]
        key = np.sort(np.repeat(np.arange(len(part)), part) * len(idf) + ids[ends[lo] - size[lo] : ends[lo + len(part) - 1]])
        if not len(key):
            continue
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        tf, key = np.diff(starts, append=len(key)), key[starts]
        row = key // len(idf)
        column = key - row * len(idf)
        value = tf * idf[column]
        norm = np.sqrt(np.bincount(row, value**2, len(part)))
        value = (value * (weight[lo : lo + len(part)] / np.maximum(norm, 1e-12))[row]).astype(np.float32)
        held = np.bincount(row, minlength=len(part))
        left = sums_of(column, value, held[held > 0], right)
        # The same entries by columns; a row's number now counts those that have words.
        bits = len(key).bit_length()
        order = np.sort((column << bits) + np.arange(len(key))) & ((1 << bits) - 1)
        count = np.bincount(column)
        used = np.flatnonzero(count)
        sums = sums_of((np.cumsum(held > 0) - 1)[row[order]], value[order], count[used], left)
        for k in range(0, len(used), 1024):
            out[used[k : k + 1024]] += sums[k : k + 1024]


def _gather(df: DataFrame, n: int, width: int) -> np.ndarray:
    """Sums by ``row`` of the vectors ``v`` of the rows of ``df``; n x width."""
    # Element-wise sums of short arrays: each row of the result is one group, of one row per task.
    total = df.groupBy("row").agg(F.collect_list("v").alias("all")).select("row", F.aggregate("all", F.array_repeat(F.lit(0.0), width), lambda a, x: F.zip_with(a, x, lambda p, q: p + q.cast("double"))).alias("v"))
    # Sums are made in doubles and sent as floats, as their parts were.
    found = total.select("row", F.col("v").cast("array<float>")).toArrow()
    out = np.zeros((n, width))
    for rows, v in zip(found["row"].chunks, found["v"].chunks, strict=True):
        out[rows.to_numpy()] = v.flatten().to_numpy().reshape(-1, width)
    return out


def _known(items: DataFrame) -> np.ndarray:
    # A word of an answer may end where the item's goes on, at a space that is none between words.
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(words_of(x) for r in items.select("text").distinct().collect() for x in (r["text"], answer_of(r["text"])))]))


def _bytes(numbers: np.ndarray) -> bytes:
    """As 32-bit numbers."""
    return numbers.astype(np.int32).tobytes()


def _statistics(docs: DataFrame, known: Broadcast) -> DataFrame:
    """In one reading of ``docs`` (text; doc_id if it is there): rows (column, n) with the documents of a task that hold each column, a row of
    column -1 with the number of its passages, and rows with all texts: their words in order, the sizes of their passages, and by text its doc_id and number of words."""

    def run(batches):
        import pyarrow as pa

        kinds, names = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()), ["column", "n", "words", "sizes", "docs", "lengths"]
        look, columns = Lookup(known.value), len(known.value) + (1 << BUCKET_BITS)
        df, total = np.zeros(columns, np.int64), 0
        for part in _small_parts(batches):
            h, at = word_ids(part.column(0))
            ids, n = look(h), np.diff(at)
            for lo in range(0, len(n), 16):
                own = n[lo : lo + 16]
                held = np.zeros((len(own), columns), bool)
                held[np.repeat(np.arange(len(own)), own), ids[at[lo] : at[lo + len(own)]]] = True
                df += np.count_nonzero(held, axis=0)
            # The words of all texts in a row, cut every WINDOW words of a text.
            passages = -(-n // WINDOW)
            size = np.full(int(passages.sum()), WINDOW)
            size[np.cumsum(passages)[n > 0] - 1] = (n - (passages - 1) * WINDOW)[n > 0]
            total += len(size)
            if len(size):
                row = (None, None, _bytes(ids), _bytes(size), part.column(1).to_pylist() if part.num_columns > 1 else None, _bytes(n))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)
        row = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(row, -1)), pa.array(np.append(df[row], total)), *(pa.nulls(len(row) + 1, t) for t in kinds[2:])], names)

    texts = docs.select(F.lower("text").alias("text"), *[c for c in docs.columns if c == "doc_id"])
    return in_batches(texts, run, "column bigint, n bigint, words binary, sizes binary, docs array<bigint>, lengths binary")


def _numbers(binary) -> np.ndarray:
    return np.frombuffer(binary.as_buffer(), np.int32)


def fit(docs: DataFrame, items: DataFrame, rank: int = RANK) -> tuple[Model, Cut]:
    """The latent space of all ``docs`` (text) and all ``items`` (text), and the table of ``_statistics``.

    Document frequencies are those of all documents, and every passage of every document is a row of the matrix, as every item's are.
    """
    spark = docs.sparkSession
    known = _known(items)
    columns = len(known) + (1 << BUCKET_BITS)
    vocabulary = spark.sparkContext.broadcast(known)
    stored = Cut(_statistics(docs, vocabulary), "passages")
    df = np.zeros(columns)
    counted = stored.df.filter("column IS NOT NULL").groupBy("column").agg(F.sum("n").alias("n")).toArrow()
    column, n = counted["column"].to_numpy(), counted["n"].to_numpy()
    df[column[column >= 0]] = n[column >= 0]
    n_passages = int(n[column < 0].sum())
    idf = np.log((1 + docs.count()) / (1 + df)) + 0.05

    look = Lookup(known)
    windows = [look(w[s:e]) for w in (words_of(r["text"]) for r in items.select("text").collect()) for s, e in _windows(len(w))]
    packed = [(_bytes(np.concatenate([np.zeros(0, np.int32), *windows])), _bytes(np.array([len(w) for w in windows])))]
    own = spark.createDataFrame(packed, "words binary, sizes binary").withColumn("weight", F.lit(1.0)).coalesce(1)
    weight = BACKGROUND * math.sqrt(min(1.0, BACKGROUND_ROWS / max(1, n_passages)))
    # A task for each core: its sums have the size columns x rank, however many passages it reads.
    passages = stored.df.filter("words IS NOT NULL").select("words", "sizes", F.lit(weight).alias("weight")).coalesce(spark.sparkContext.defaultParallelism).unionAll(own)

    width = rank + EXTRA
    shared = spark.sparkContext.broadcast(idf)

    # Subspace iteration on A' A: each step is one pass that sums A' (A right), then a QR of a small matrix.
    right = np.linalg.qr(np.random.default_rng(7).standard_normal((columns, width)))[0]
    for _ in range(STEPS):
        held = spark.sparkContext.broadcast(right.astype(np.float32, order="C"))
        give_back()

        def step(batches, held=held):
            import pyarrow as pa

            out = np.zeros((columns, width))
            waiting: list[tuple] = []

            def add():
                words, sizes, weights = (np.concatenate(x) for x in zip(*waiting, strict=True))
                add_image(words, sizes, weights, shared.value, held.value, out)
                waiting.clear()

            for b in batches:
                for words, sizes, weight in zip(*b.columns, strict=True):
                    size = _numbers(sizes)
                    waiting.append((_numbers(words), size, np.full(len(size), weight.as_py())))
                    if sum(len(x[1]) for x in waiting) >= AT_ONCE:
                        add()
                # What waits is a view of the batch.
                if waiting:
                    add()
            rows = np.flatnonzero(np.abs(out).sum(axis=1))
            for some in np.array_split(rows, -(-len(rows) // 2048) or 1):
                flat = pa.array(np.ascontiguousarray(out[some]).ravel().astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.FixedSizeListArray.from_arrays(flat, width).cast(pa.list_(pa.float32()))], ["row", "v"])

        image = _gather(in_batches(passages, step, "row bigint, v array<float>"), columns, width)
        held.destroy()
        # Directions by their share of the rows' energy (Rayleigh-Ritz); the weakest, EXTRA ones, go at the end.
        small = right.T @ image
        value, vector = np.linalg.eigh((small + small.T) / 2)
        image = image @ vector[:, np.argsort(value)[::-1]]
        del right
        right, factor = np.linalg.qr(image)
        del image
        give_back()
    strong = np.abs(np.diag(factor))
    keep = [i for i in range(rank) if strong[i] > 1e-9 * max(strong[0], 1e-300)]
    # Row by row in memory: rows are taken by the million, and taking some of an array that lies column by column copies all of it.
    basis = np.ascontiguousarray(right[:, keep], np.float32)
    del right
    give_back()
    return Model(known, idf, basis), stored


class Target:
    """An item; its words, as a document's, are columns, and all of them have one of their own."""

    def __init__(self, item_id: int, text: str, look: Lookup):
        self.item_id, self.words = item_id, look(words_of(text))
        self.item, self.answer = Sequence(self.words), Sequence(look(words_of(answer_of(text))))


def _queries(model: Model, targets: list[Target]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions of the items' passages in the latent space, their items, and their own cosines."""
    rows, of, own = [], [], []
    for i, t in enumerate(targets):
        for s, e in _windows(len(t.words)):
            ids = t.words[s:e]
            v = (model.basis[ids] * model.idf[ids, None]).sum(axis=0)
            norm = np.linalg.norm(v)
            if norm > 0:
                rows.append(v / norm)
                of.append(i)
                own.append(norm / np.sqrt((model.idf[ids] ** 2).sum()))
    return np.array(rows, np.float32).reshape(len(rows), model.basis.shape[1]), np.array(of, np.int64), np.array(own, np.float32)


def _least_common(n: int) -> int:
    """Words in common order that a leak of an item of n words has at least."""
    return max(1, math.ceil(WITH_ANSWER * n - 1e-9))


class Search:
    """Candidates and checks over many texts' words; built once in a task.

    Windows that can't be near a leak are not projected. Of an item's n words a leak has ``need`` or more,
    so of any n - need + RARE of them it has RARE or more; for those, the item's rarest words are taken.
    A window stays if the region that would be compared holds so many of one item's, repeated words
    counted once. Nothing is lost.
    """

    def __init__(self, model: Model, targets: list[Target], queries: tuple, cosine: float):
        self.model, self.targets = model, targets
        self.q, self.of, own = queries
        self.least = (cosine * own).astype(np.float32)
        self.weighted = (model.basis * model.idf[:, None]).astype(np.float32)
        self.square = np.where(np.arange(len(model.idf)) < len(model.known), model.idf**2, 0).astype(np.float32)
        self.lengths = np.array([t.item.n for t in targets], np.int64)
        self.asked = np.array([min(RARE, _least_common(t.item.n)) for t in targets], np.int64)
        column, target, times = [], [], []
        for i, t in enumerate(targets):
            ids = t.words
            rare = ids[np.argsort(-model.idf[ids], kind="stable")[: t.item.n - _least_common(t.item.n) + int(self.asked[i])]]
            values, counts = np.unique(rare, return_counts=True)
            column += values.tolist()
            target += [i] * len(values)
            times += counts.tolist()
        order = np.argsort(column, kind="stable")
        self.rare_target, self.rare_times = np.array(target, np.int64)[order], np.array(times, np.int64)[order]
        self.rare_count = np.bincount(column, minlength=len(model.idf)) if column else np.zeros(len(model.idf), np.int64)
        self.rare_first = np.cumsum(self.rare_count) - self.rare_count

    def rare_hits(self, ids: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, ...]:
        """(target, place, times, earlier), sorted, of every rare word of an item in the texts.

        ``times`` is how often the item has the word among its rarest, ``earlier`` the place of the word before in its text.
        """
        place = np.flatnonzero(self.rare_count[ids])
        word = ids[place]
        # Sorted with their numbers, in one go.
        order = np.sort((word.astype(np.int64) << 32) + np.arange(len(place))) & 0xFFFFFFFF
        same = (np.diff(word[order]) == 0) & (np.diff(text_of[place[order]]) == 0)
        earlier = np.full(len(place), -1)
        earlier[order[1:][same]] = place[order[:-1][same]]
        many = self.rare_count[word]
        which = np.repeat(self.rare_first[word], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        target, place, earlier = self.rare_target[which], np.repeat(place, many), np.repeat(earlier, many)
        order = np.argsort((target << 32) + place)
        return target[order], place[order], self.rare_times[which][order], earlier[order]

    def live_windows(self, hits: tuple[np.ndarray, ...], text_of: np.ndarray, at: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """True for each window (one every STRIDE words) whose region holds enough different rare words of one item."""
        target, place, times, earlier = hits
        first = np.concatenate([[0], np.cumsum(blocks)])
        text = text_of[place]
        asked, reach = self.asked[target], WINDOW + 2 * self.lengths[target]
        # From each hit on: the place where enough words are together, a repeated one counted once.
        count, end = times.copy(), np.where(times >= asked, place, -1)
        open_, step = np.flatnonzero(end < 0), 0
        while len(open_):
            step += 1
            open_ = open_[open_ + step < len(target)]
            to = open_ + step
            near = (target[to] == target[open_]) & (text[to] == text[open_]) & (place[to] - place[open_] < reach[open_])
            open_, to = open_[near], to[near]
            count[open_] += np.where(earlier[to] < place[open_], times[to], 0)
            full = count[open_] >= asked[open_]
            end[open_[full]] = place[to[full]]
            open_ = open_[~full]
        some = np.flatnonzero(end >= 0)
        of, n = text[some], self.lengths[target[some]]
        # The region of a window from s reaches from s - n to s + WINDOW + n.
        begin = np.clip(-(-(end[some] - WINDOW - n + 1 - at[of]) // STRIDE), 0, blocks[of])
        stop = np.clip((place[some] + n - at[of]) // STRIDE + 1, 0, blocks[of])
        good = begin < stop
        size = int(first[-1]) + 1
        edge = np.bincount(first[of[good]] + begin[good], minlength=size) - np.bincount(first[of[good]] + stop[good], minlength=size)
        return np.cumsum(edge[:-1]) > 0

    def windows(self, ids: np.ndarray, text: np.ndarray, at: np.ndarray, blocks: np.ndarray, live: np.ndarray):
        """(texts of the live windows, their first words, latent sums, norms)."""
        first = np.concatenate([[0], np.cumsum(blocks)])
        n = int(first[-1])
        text_of = np.repeat(np.arange(len(at) - 1), blocks)
        chosen = np.flatnonzero(live)
        needed = np.zeros(n + WINDOW // STRIDE, bool)
        for k in range(WINDOW // STRIDE):
            needed[chosen + k] = True
        block_of = first[text] + (np.arange(len(ids)) - at[text]) // STRIDE
        some = np.flatnonzero(needed[block_of])
        block, ids = block_of[some], ids[some]
        sums = np.zeros((n, self.q.shape[1]), np.float32)
        squares = np.bincount(block, self.square[ids], n).astype(np.float32)
        size = np.bincount(block, minlength=n)
        sums[size > 0] = sums_of(ids, np.ones(len(ids), np.float32), size[size > 0], self.weighted)
        total, norms = sums[chosen], squares[chosen]
        for k in range(1, WINDOW // STRIDE):
            same = np.flatnonzero(text_of[np.minimum(chosen + k, n - 1)] == text_of[chosen])
            same = same[chosen[same] + k < n]
            total[same] += sums[chosen[same] + k]
            norms[same] += squares[chosen[same] + k]
        return text_of[chosen], at[text_of[chosen]] + (chosen - first[text_of[chosen]]) * STRIDE, total, np.sqrt(norms)

    def __call__(self, ids: np.ndarray, at: np.ndarray):
        """Yields (text, target, first word of the region, its end, common share, answer's share) of texts, given as their words' columns and offsets."""
        if not len(ids) or not len(self.q):
            return
        words_text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        blocks = -(-np.diff(at) // STRIDE)
        hits = self.rare_hits(ids, words_text)
        if not len(hits[0]):
            return
        text_of, start, total, norm = self.windows(ids, words_text, at, blocks, self.live_windows(hits, words_text, at, blocks))
        keys = hits[0] * (len(ids) + 1) + hits[1]
        cover = np.concatenate([[0], np.cumsum(hits[2])])
        best: dict[tuple[int, int], tuple] = {}
        for lo in range(0, len(start), 4096):
            some = slice(lo, lo + 4096)
            close = total[some] @ self.q.T >= norm[some, None] * self.least
            r, c = np.nonzero(close & (norm[some, None] > 0))
            r += lo
            t, which = text_of[r], self.of[c]
            a = np.maximum(at[t], start[r] - self.lengths[which])
            b = np.minimum(at[t + 1], start[r] + WINDOW + self.lengths[which])
            base = which * (len(ids) + 1)
            enough = cover[np.searchsorted(keys, base + b)] - cover[np.searchsorted(keys, base + a)] >= self.asked[which]
            for t, which, a, b in zip(*(x[enough].tolist() for x in (t, which, a, b)), strict=True):
                item = self.targets[which].item
                old = best.get((t, which))
                if old and (old[2] >= item.n or (old[0] <= a and b <= old[1])):
                    continue
                common = item.common(ids[a:b].tolist())
                if not old or common > old[2]:
                    best[t, which] = (a, b, common)
        for (t, which), (a, b, common) in best.items():
            answer = self.targets[which].answer
            share = answer.common(ids[a:b].tolist()) / answer.n if answer.n else 0.0
            yield t, which, a - int(at[t]), b - int(at[t]), common / self.targets[which].item.n, share


def is_leak(common: float, share: float) -> bool:
    return common >= SURE or (common >= WITH_ANSWER and share >= ANSWER)


def _searches(docs: DataFrame, items: DataFrame, cosine: float) -> Iterator:
    """For each block of items the broadcast arguments of its Search and the table of ``_statistics``; none without items."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("text").isNotNull())
    words = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"]
    blocks = -(-(words or 0) // BLOCK_WORDS)
    for k in range(blocks):
        some = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        model, stored = fit(docs, some)
        look = Lookup(model.known)
        targets = [t for t in (Target(r["item_id"], r["text"], look) for r in some.distinct().collect()) if t.item.n]
        yield spark.sparkContext.broadcast((model, targets, _queries(model, targets), cosine)), stored


def _small_parts(batches):
    for b in batches:
        yield from (b.slice(i, 256) for i in range(0, b.num_rows, 256))


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", cosine: float = COSINE) -> DataFrame:
    """One row per leaked pair: doc_id, item_id, common (share of the item's words in common order),
    answer (share of the answer's), from_word and to_word (the region that was compared).

    Null and empty texts match nothing, repeated rows match alike (pairs come once: of regions of one
    share the first), items without words are never found, an empty table gives none. Texts of any
    length are read whole. Columns besides the keys and text are not read.
    """
    docs = docs.select(F.col(f"`{doc_key}`").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, common double, answer double, from_word int, to_word int"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared, stored in _searches(docs, items, cosine):

        def run(batches, shared=shared):
            import pyarrow as pa

            search = Search(*shared.value)
            for words, lengths, doc_ids in (x for b in batches for x in zip(*b.columns, strict=True)):
                ids, rows = doc_ids.as_py(), []
                for t, target, a, z, common, share in search(_numbers(words), np.append(0, np.cumsum(_numbers(lengths), dtype=np.int64))):
                    if is_leak(common, share):
                        rows.append((ids[t], search.targets[target].item_id, common, share, a, z))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "common", "answer", "from_word", "to_word"])

        # The words that the space was fitted on: no text is read again.
        out = out.unionAll(in_batches(stored.df.filter("words IS NOT NULL").select("words", "lengths", "docs"), run, schema))
    # Repeated rows give equal pairs; one of each stays.
    values = ("common", "answer", "from_word", "to_word")
    best = F.max_by(F.struct(*values), F.struct("common", "answer", -F.col("from_word"), -F.col("to_word"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[F.col(f"best.{v}") for v in values])


def without_leaks(docs: DataFrame, items: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, each judged by its own text.

    Nulls in any column and repeated doc_ids change nothing: rows of one text are kept or dropped alike.
    """
    for shared, stored in _searches(docs.select("text"), items, cosine):
        stored.drop()
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lower("text").alias("text"))

        def run(batches, shared=shared):
            import pyarrow as pa
            import pyarrow.compute as pc

            search, look = Search(*shared.value), Lookup(shared.value[0].known)
            for part in _small_parts(batches):
                h, at = word_ids(part.column(1))
                bad = {t for t, _, _, _, common, share in search(look(h), at) if is_leak(common, share)}
                clean = pa.array([t not in bad for t in range(part.num_rows)], pa.bool_())
                yield pa.RecordBatch.from_arrays([pc.filter(part.column(0), clean)], ["row"])

        docs = in_batches(packed, run, packed.select("row").schema).select("row.*")
    return docs
