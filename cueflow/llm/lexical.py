"""Ranked lexical search by sort-based accumulation.

A first pass over the texts keeps, for each document, its length and the counts of the terms that some
item asks for; it is written as postings, from which the document frequencies come. A second pass takes
the documents in runs: the impacts of all (item, document) pairs that share a term are concatenated,
their keys (the item's number above the document's) are radix sorted, and the impacts of equal keys are
summed up by ``reduceat``. Each task keeps a heap of the best documents of each item. What the heaps hold
is dealt by ranges of (item, score), selected once more by heaps in each range, and ranked.

Tasks hold the terms of one block of items, whose number of words is bounded; larger sets of items are
searched block by block. Terms meet by a hash and count only if their bytes are equal.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueflow.llm.runtime import Cut, in_batches, span_hashes, text_bytes, word_spans
from cueflow.operators.ordered import sliced

#: Items and words of a block of items; an item of more words is a block by itself.
BLOCK_ITEMS, BLOCK_WORDS = 1 << 13, 1 << 19
#: Impacts that are sorted at once, if one document has no more.
RUN = 1 << 20
TOP = 20

#: Bytes between terms. All bytes of characters beyond ASCII belong to terms.
_GAP = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first) of the terms of an Arrow column of texts: text i has terms first[i] to first[i + 1]."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends = word_spans(data, offsets, _GAP)
    return data, starts, ends, np.searchsorted(starts, offsets)


class Block:
    """Items whose terms are held in every task: the terms' hashes and bytes, and for each term the items that have it, repeats included."""

    def __init__(self, texts: list[str | None], first: int):
        import pyarrow as pa

        data, starts, ends, at = terms(pa.array(texts, pa.string()))
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(data[a:b].tobytes(), len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        items = np.repeat(np.arange(len(texts)), np.diff(at))
        words = list(number)
        lengths = np.array([len(w) for w in words], np.int64)
        joined = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        hashes = span_hashes(joined, begin, begin + lengths)
        by = np.argsort(hashes, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.first, self.size = first, len(words)
        self.hashes, self.begin, self.lengths, self.bytes = hashes[by], begin[by], lengths[by], joined
        order = np.argsort(place[which], kind="stable")
        self.items = items[order].astype(np.uint32)
        self.bounds = np.searchsorted(place[which][order], np.arange(len(by) + 1))
        #: Terms of one hash stand side by side; so many at most.
        self.alike = int(np.unique(hashes, return_counts=True)[1].max(initial=0))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 if no item has it."""
        out = np.full(len(starts), -1, np.int64)
        if not self.size:
            return out
        hashes = span_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, hashes)
        for _ in range(self.alike):
            ok = np.flatnonzero((at < self.size) & (out < 0))
            ok = ok[(self.hashes[at[ok]] == hashes[ok]) & (self.lengths[at[ok]] == ends[ok] - starts[ok])]
            ok = ok[self._equal(data, starts[ok], at[ok])]
            out[ok] = at[ok]
            at = at + 1
        return out

    def _equal(self, data: np.ndarray, starts: np.ndarray, term: np.ndarray) -> np.ndarray:
        same, lengths, begin = np.ones(len(term), bool), self.lengths[term], self.begin[term]
        left, j = np.arange(len(term)), 0
        while j < 64 and len(left := left[lengths[left] > j]):
            same[left] &= data[starts[left] + j] == self.bytes[begin[left] + j]
            j += 1
        for i in left[lengths[left] > j]:
            same[i] &= np.array_equal(data[starts[i] : starts[i] + lengths[i]], self.bytes[begin[i] : begin[i] + lengths[i]])
        return same


_POSTINGS = "doc_id array<bigint>, n array<bigint>, size array<int>, term array<int>, tf array<int>, docs bigint, words bigint, in_docs array<struct<term:int,df:bigint>>"


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """For each batch of documents their ids, lengths and counts of the block's terms; for each task its number of
    documents with terms, of their terms, and of the documents that hold each of the block's."""
    import pyarrow as pa

    names = [p.split()[0] for p in _POSTINGS.split(", ")]

    def row(**parts):
        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "size": pa.int32(), "term": pa.int32(), "tf": pa.int32()}
        cells = [pa.array([parts.get(k)], pa.list_(kinds[k])) for k in names[:5]] + [pa.array([parts.get(k)], pa.int64()) for k in names[5:7]]
        cells.append(pa.array([parts.get("in_docs")], pa.list_(pa.struct([("term", pa.int32()), ("df", pa.int64())]))))
        return pa.RecordBatch.from_arrays(cells, names)

    def run(batches):
        found, many, words = np.zeros(block.size, np.int64), 0, 0
        for b in batches:
            data, starts, ends, at = terms(b.column(1))
            n = np.diff(at)
            many, words = many + int((n > 0).sum()), words + int(n.sum())
            term = block.find(data, starts, ends)
            doc = np.repeat(np.arange(len(n)), n)[term >= 0]
            key, tf = np.unique(doc * max(block.size, 1) + term[term >= 0], return_counts=True)
            doc, term = key // max(block.size, 1), key % max(block.size, 1)
            found += np.bincount(term, minlength=block.size)
            size = np.bincount(doc, minlength=len(n))
            # Documents without such a term can't score.
            kept = np.flatnonzero(size)
            yield row(doc_id=b.column(0).take(pa.array(kept)).to_pylist(), n=n[kept], size=size[kept], term=term, tf=tf)
        some = np.flatnonzero(found)
        yield row(docs=many, words=words, in_docs=[{"term": int(t), "df": int(found[t])} for t in some])

    return in_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, _POSTINGS)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, 16 bits at a time; digits that are the same in all keys are passed over."""
    order, high = np.arange(len(keys)), int(keys.max(initial=0))
    for shift in range(0, 64, 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        # What is in order already stays so under a stable sort of the digits above.
        if high >> shift and not (digit[order][1:] >= digit[order][:-1]).all():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def accumulate(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, sum of impacts) of all pairs, in order."""
    keys = (items.astype(np.uint64) << np.uint64(32)) | docs.astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(impacts[order], first) if len(first) else impacts[:0]
    return (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), sums


class Best:
    """A heap of the ``top`` best (score, doc_id) of each item; equal scores go by ascending id, rows without id last."""

    def __init__(self, top: int):
        self.top, self.heaps = top, {}

    def add(self, item: int, scores, ids) -> None:
        heap = self.heaps.setdefault(item, [])
        for s, d in zip(scores, ids, strict=True):
            entry = (s, d is not None, -(d or 0))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def floor(self, item: int) -> int:
        heap = self.heaps.get(item, ())
        return heap[0][0] if len(heap) == self.top else 1

    def rows(self):
        for item, heap in self.heaps.items():
            yield from ((item, -d if known else None, s) for s, known, d in heap)


_SCORED = "item bigint, doc_id bigint, score bigint"


def _rows(best: Best):
    import pyarrow as pa

    rows = list(best.rows())
    cells = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays(cells, ["item", "doc_id", "score"])


def _scored(found: DataFrame, block: Block, weights: np.ndarray, many: int, words: int, top: int) -> DataFrame:
    """The best documents of each item (by number) in each task."""

    def run(batches):
        best = Best(top)
        lists = np.diff(block.bounds)
        for b in batches:
            for r in range(b.num_rows):
                ids, n, size, term, tf = (b.column(i)[r].values for i in range(5))
                size, term, tf = (np.asarray(x).astype(np.int64) for x in (size, term, tf))
                m = np.array([75 + 25 * x * many // words for x in n.to_pylist()], np.int64)
                doc = np.repeat(np.arange(len(size)), size)
                impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                each = lists[term]
                upto, at = np.cumsum(each), 0
                while at < len(term):
                    # As many whole documents as give a run of impacts, one at least.
                    limit = (int(upto[at - 1]) if at else 0) + RUN
                    stop = int(np.searchsorted(upto, limit, side="right"))
                    stop = len(term) if stop == len(term) else max(int(np.searchsorted(doc, doc[stop])), int(np.searchsorted(doc, doc[at], side="right")))
                    part, count = slice(at, stop), each[at:stop]
                    total = int(count.sum())
                    where = np.repeat(block.bounds[term[part]] - (np.cumsum(count) - count), count) + np.arange(total)
                    select(best, ids, *accumulate(block.items[where], np.repeat(doc[part], count), np.repeat(impact[part], count)))
                    at = stop
        yield _rows(best)

    def select(best, ids, items, docs, sums):
        edges = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1], [True]])) if len(items) else [0]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            item, scores = int(items[a]), sums[a:z]
            least = best.floor(item)
            if z - a > top:
                least = max(least, int(np.partition(scores, z - a - top)[z - a - top]))
            good = np.flatnonzero(scores >= least)
            if len(good):
                best.add(item, scores[good].tolist(), ids.take(docs[a:z][good]).to_pylist())

    return in_batches(found.filter("term IS NOT NULL"), run, _SCORED)


def _selected(scored: DataFrame, top: int) -> DataFrame:
    """item, rank, doc_id and score of the ``top`` best rows of each item."""
    dealt = sliced(scored.withColumn("low", -F.col("score")), ["item"], ["low", "doc_id"], "scored")

    def run(batches):
        best = Best(top)
        for b in batches:
            for item, doc, score in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                best.add(item, [score], [doc])
        yield _rows(best)

    few = in_batches(dealt.select("item", "doc_id", "score"), run, _SCORED)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(items: DataFrame, most_words: int):
    """(item ids, Block) of all items, a bounded number of words at a time."""
    rows, words, first = [], 0, 0
    # An item has fewer terms than bytes; half of them are separators.
    for r in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").toLocalIterator():
        more = (len((r["text"] or "").encode("utf-8", "surrogatepass")) + 1) // 2
        if rows and (len(rows) == BLOCK_ITEMS or words + more > most_words):
            yield [x["item_id"] for x in rows], Block([x["text"] for x in rows], first)
            rows, words, first = [], 0, first + len(rows)
        rows.append(r)
        words += more
    if rows:
        yield [x["item_id"] for x in rows], Block([x["text"] for x in rows], first)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best documents.

    Null and empty texts have no terms, as documents and as items. Every row of ``docs`` is a document of
    its own, so repeated rows rank one behind the other; rows without doc_id come after equal scores with
    one. Every row of ``items`` is an item of its own: a repeated item_id has a list for each of its rows,
    and a null one has a list too. Without documents or items the result is empty. Texts of any length are
    read whole; columns besides doc_id, item_id and text are not read.
    """
    out = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for ids, block in _blocks(items, most_words):
        found = Cut(postings(docs, block), "postings")
        totals = found.df.filter("docs IS NOT NULL").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        many, words = totals["docs"] or 0, totals["words"] or 0
        df = np.zeros(max(block.size, 1), np.int64)
        # As many rows as the block has terms, at most.
        for r in found.df.select(F.explode("in_docs").alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect():
            df[r["term"]] = r["df"]
        if not many or not block.size:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        ranked = _selected(_scored(found.df, block, weights, many, words, top), top)
        names = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "nr bigint, item_id bigint")
        out = out.unionByName(ranked.join(F.broadcast(names), F.col("item") == F.col("nr")).select("item_id", "rank", "doc_id", "score"))
    return out
