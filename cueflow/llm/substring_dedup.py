"""Substring dedup: removes every window of W words whose word sequence also starts elsewhere.

The reference of each document is the whole corpus, so broadcasting the automata of all reference
shards to all documents would cost the square of the corpus. Instead, shards are cut by content: a
window belongs to its minimizer (the smallest hash among its short word runs), which equal windows
share. Consecutive windows of one minimizer form a span. Minimizers seen once are dropped by a count;
identical spans are collapsed to one with a weight, which settles most of them. Where different spans
share a minimizer, they form a shard: its suffix automaton, with weighted occurrence counts, gives
every span's matching statistics, and windows no longer than the longest repeated suffix are
repeated. A minimizer with very many different spans (the rim of a passage that everybody quotes) is
counted window by window instead, which aggregates before the shuffle and needs no group in one task.
Joins on minimizers and spans are on a salt too: an aggregate keeps, in the bits of a long, which salts
a key has, so a key that much of the corpus shares is dealt over many tasks without copies of the rest.

Windows compare by two 64-bit hashes, the minimizer's and their own, words by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.llm.runtime import cut, in_batches, mix, space_table, span_hashes, text_bytes, word_spans

WINDOW = 35
#: Words of the runs that minimizers are chosen from.
RUN = 8
#: Windows of a span at most, so that a mask of them fits in a long.
SPAN = 28
#: Different spans of a minimizer that one automaton takes.
SHARD_SPANS = 512
#: Parts that the rows of a key are dealt over in joins; one bit each in a long.
SALTS = 64
#: Texts handled together in a task.
TEXTS = 256
#: Windows that a task sums up before it sends them on.
HELD_WINDOWS = 2_000_000

_SPACE = space_table()
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    starts, ends = word_spans(data, offsets, _SPACE)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def _range_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of h[start:end] for each pair; they depend on the words and their number only."""
    if not len(h):
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h) - 1, _MULTIPLIER)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h) - 1, _INVERSE)]), dtype=np.uint64)
    run = np.concatenate([[np.uint64(0)], np.cumsum(h * up, dtype=np.uint64)])
    return mix((run[ends] - run[starts]) * down[np.minimum(starts, len(h) - 1)] + (ends - starts).astype(np.uint64))


def spans(h: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, minimizer, hash, loop) of every span of the texts h[at[i]:at[i+1]].

    ``loop`` is 1 where a span may hold one window twice, as periodic texts do.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(h)
    if n < window:
        return none
    run = min(RUN, window)
    g = np.zeros(n - run + 1, np.uint64)
    for j in range(run):
        g = g * _MULTIPLIER + h[j : n - run + 1 + j]
    g = mix(g)
    # The least of `width` neighbours, by doubling.
    width, low, size = window - run + 1, g, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    least = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    least = least[: n - window + 1]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    good = text[: n - window + 1] == text[window - 1 :]
    place = np.flatnonzero(good)
    if not len(place):
        return none
    value, of = least[place], text[place]
    new = np.concatenate([[True], (np.diff(place) != 1) | (value[1:] != value[:-1]) | (of[1:] != of[:-1])])
    began = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
    new |= (np.arange(len(place)) - began) % SPAN == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    start = place[first]
    hashes = _range_hashes(h, start, start + count + window - 1)
    # Equal windows of a span have equal runs less than SPAN apart.
    near = np.zeros(len(g) + 1, np.int64)
    for d in range(1, min(SPAN, len(g))):
        near[1 : len(g) - d + 1] |= g[:-d] == g[d:]
    near = np.cumsum(near)
    loop = near[np.minimum(start + count + window - run, len(g))] > near[start]
    return of[first], start - at[of[first]], count, value[first].view(np.int64), hashes.view(np.int64), loop.astype(np.int64)


class SuffixAutomaton:
    """Of several word sequences, each with a weight; counts how often each factor occurs."""

    def __init__(self):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w) -> int:
        """A copy of q for the factors that end in p's factors followed by w."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, words, weight: int) -> list[int]:
        """Adds a sequence; the states of its prefixes."""
        last, path = 0, []
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
                last = new
            self.count[last] += weight
            path.append(last)
        return path

    def finish(self) -> list[int]:
        """For each state the length of its longest suffix that occurs at least twice."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.link[s] >= 0:
                self.count[self.link[s]] += self.count[s]
        repeated = [0] * len(self.length)
        for s in order:
            repeated[s] = self.length[s] if self.count[s] >= 2 else repeated[self.link[s]]
        return repeated

    def statistics(self, words, repeated: list[int]) -> list[int]:
        """Matching statistics: for each position the longest repeated factor that ends there.

        ``words`` must be one of the sequences added, so every step has a transition.
        """
        state, out = 0, []
        for w in words:
            state = self.next[state][w]
            out.append(repeated[state])
        return out


def repeated_masks(shard: list[tuple[list[int], int]], window: int = WINDOW) -> list[int]:
    """For each (words, weight) of a shard the mask of its windows that occur at least twice."""
    automaton = SuffixAutomaton()
    for words, weight in shard:
        automaton.add(words, weight)
    repeated = automaton.finish()
    return [sum(1 << i for i, n in enumerate(automaton.statistics(words, repeated)[window - 1 :]) if n >= window) for words, _ in shard]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def _occurrences(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys = b.column(0).to_numpy()
            for i in range(0, b.num_rows, TEXTS):
                of, start, count, least, hashes, loop = spans(*_words(b.column(1).slice(i, TEXTS)), window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i : i + TEXTS][of]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(least), pa.array(hashes), pa.array(loop.astype(np.int32))],
                    ["key", "start", "windows", "least", "span", "loop"],
                )

    return in_batches(keyed.select("key", "text"), run, "key bigint, start int, windows int, least bigint, span bigint, loop int")


def _span_words(wanted: DataFrame, window: int) -> DataFrame:
    """Rows (key, start, windows, least, copies, crowded, words) from texts joined with their wanted spans."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                h, at = _words(part.column(1))
                h = h.view(np.int64)
                want, flat = part.column(2), part.column(2).flatten()
                n = np.diff(np.asarray(want.offsets))
                keys = np.repeat(part.column(0).to_numpy(), n)
                start, windows = flat.field("start").to_numpy(), flat.field("windows").to_numpy()
                lo = np.repeat(at[:-1], n) + start
                words = [h[a : a + w + window - 1] for a, w in zip(lo.tolist(), windows.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), flat.field("start"), flat.field("windows"), flat.field("least"), flat.field("copies"), flat.field("crowded"), pa.array(words, pa.list_(pa.int64()))],
                    ["key", "start", "windows", "least", "copies", "crowded", "words"],
                )

    return in_batches(wanted, run, "key bigint, start int, windows int, least bigint, copies bigint, crowded boolean, words array<bigint>")


def _match_shards(rows: DataFrame, window: int) -> DataFrame:
    """(key, start, mask) of the spans with one copy; ``rows`` are grouped by ``least`` within tasks."""

    def run(batches):
        import pyarrow as pa

        def settle(group):
            masks = repeated_masks([(words, copies) for _, _, copies, words in group], window)
            return [(key, start, m) for (key, start, copies, _), m in zip(group, masks, strict=True) if m and copies == 1]

        def emit(out):
            k, s, m = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int32()), pa.array(m, pa.int64())], ["key", "start", "mask"])

        current, group, out = None, [], []
        for b in batches:
            for least, key, start, copies, words in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if least != current:
                    out += settle(group) if group else []
                    current, group = least, []
                group.append((key, start, copies, words))
            yield emit(out)
            out = []
        yield emit(settle(group) if group else [])

    return in_batches(rows.select("least", "key", "start", "copies", "words"), run, "key bigint, start int, mask bigint")


def _single_windows(rows: DataFrame, window: int) -> DataFrame:
    """(least, hash, copies, places): the windows of the rows' spans, equal ones of a task summed up.

    ``places`` lists (key, start) of those from spans with one copy, the only ones still to be judged.
    """

    def run(batches):
        import pyarrow as pa

        def send(parts):
            least, key, start, copies, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((hashes, least))
            least, key, start, copies, hashes = (x[order] for x in (least, key, start, copies, hashes))
            new = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(hashes) != 0)]))
            judged = copies == 1
            ends = np.concatenate([[0], np.cumsum(np.add.reduceat(judged.astype(np.int64), new))])
            places = pa.StructArray.from_arrays([pa.array(key[judged]), pa.array(start[judged].astype(np.int32))], ["key", "start"])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places)
            return pa.RecordBatch.from_arrays([pa.array(least[new]), pa.array(hashes[new]), pa.array(np.add.reduceat(copies, new)), lists], ["least", "hash", "copies", "places"])

        parts, held = [], 0
        for b in batches:
            count = b.column(4).to_numpy().astype(np.int64)
            flat = b.column(5).flatten().to_numpy().view(np.uint64)
            begin = np.concatenate([[0], np.cumsum(count + window - 1)])[:-1]
            within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            first = np.repeat(begin, count) + within
            hashes = _range_hashes(flat, first, first + window).view(np.int64)
            each = [np.repeat(b.column(i).to_numpy().astype(np.int64), count) for i in range(4)]
            parts.append((each[0], each[1], each[2] + within, each[3], hashes))
            held += len(hashes)
            if held > HELD_WINDOWS:
                yield send(parts)
                parts, held = [], 0
        if held:
            yield send(parts)

    return in_batches(rows.select("least", "key", "start", "copies", "windows", "words"), run, "least bigint, hash bigint, copies bigint, places array<struct<key:bigint,start:int>>")


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _salts() -> Column:
    """Aggregates column ``salt``: the bits of those that occur."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("salt"))).alias("salts")


def _each_salt() -> Column:
    """Explodes column ``salts`` again."""
    bits = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return F.explode(F.filter(bits, lambda i: F.getbit("salts", i) == 1)).alias("salt")


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """doc_id, n_words, n_removed (long) and kept (string) of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``; kept words are joined by one space. Null and empty texts have no
    words; texts shorter than a window lose none; a repeated row repeats all its windows, so both rows
    lose them. Other columns are not read.
    """
    keyed = _keyed(docs)
    found = _occurrences(keyed, window).withColumn("salt", _salt("key"))
    often = found.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.max("loop").alias("loops"), _salts()).filter("n > 1 OR loops = 1").select("least", _each_salt())
    live = cut(found.drop("loop").join(often, ["least", "salt"]), "spans")
    # Equal spans collapse; any one of them stands for all.
    one = [F.first(c).alias(c) for c in ("key", "start", "windows")]
    distinct = cut(live.groupBy("least", "span").agg(F.count(F.lit(1)).alias("copies"), *one, _salts()), "distinct-spans")
    mine = distinct.drop("salts").withColumn("salt", _salt("span"))
    mixed = mine.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copies") == 1).alias("single"), _salts()).filter("single > 0")
    wanted = mine.join(mixed.select("least", "n", _each_salt()), ["least", "salt"]).withColumn("crowded", F.col("n") > shard_spans)
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "least", "copies", "crowded")).alias("want"))
    texts = keyed.select("key", "doc_id", "text")
    # Repeated rows have one key; one of them is enough to read the words from.
    once = texts.join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("want").alias("want"))
    words = cut(_span_words(once, window), "span-words")
    by_shard = words.filter(~F.col("crowded")).repartition(F.col("least")).sortWithinPartitions("least")
    matched = _match_shards(by_shard, window)
    crowd = cut(_single_windows(words.filter("crowded"), window), "windows")
    again = crowd.groupBy("least", "hash").agg(F.sum("copies").alias("n")).filter("n > 1").select("least", "hash")
    counted = crowd.filter(F.size("places") > 0).join(again, ["least", "hash"]).select(F.inline("places")).withColumn("mask", F.lit(1).cast("bigint"))
    whole = live.join(distinct.filter("copies > 1").select("least", "span", _each_salt()), ["least", "span", "salt"])
    whole = whole.select("key", "start", (F.expr("shiftleft(1L, windows)") - 1).alias("mask"))
    # Repeated rows say the same of one key; it is said once.
    removed = whole.unionAll(matched).unionAll(counted).groupBy("key", "start").agg(F.bit_or("mask").alias("mask"))
    removed = removed.groupBy("key").agg(F.collect_list(F.struct("start", "mask")).alias("gone"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if not gone:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                start = np.array([g["start"] for g in gone], np.int64)
                mask = np.array([g["mask"] for g in gone], np.int64)
                for bit in range(SPAN):
                    hit = start[(mask >> bit) & 1 == 1] + bit
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                n_removed.append(int((~stay).sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = texts.join(removed, "key", "left").select("doc_id", "text", "gone")
    return in_batches(joined, run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
