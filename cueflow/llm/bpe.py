"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens by the vocabulary's pattern. Each block of documents keeps its
pre-tokens as positions in the block's own list of distinct words; only those lists are shuffled, by
word, so that every distinct word of the corpus meets in one place and is encoded once. The ids go back
to the blocks, where positions turn into ids in the order of the text. Decoding maps ids through the
token-byte table, which has the size of the vocabulary.

A block holds a bounded amount of text, and its list is cut by hash classes of words, one compressed
row for each class, so a frequent word costs one entry a block wherever it occurs. Blocks are written
once, so that lists and positions are of one reading of the texts whatever is run again.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm.runtime import cut_by, in_batches, row_and

#: Characters of text after which a block ends.
BLOCK_CHARS = 16_000_000
#: Bytes of decoded text in a batch, unless one text has more.
DECODED_BYTES = 8_000_000
#: Rows whose ids are looked up at once.
DECODED_ROWS = 32
#: A text of more characters than this is still one row, but starts a block of its own.

#: One match of any text: what a word is to an encoder of single words.
ALL = r"[\s\S]+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _blocks(batches, pattern: str, classes: int):
    """Yields (row ids, lengths in words, distinct words, their classes, positions among the words).

    Words stand by falling frequency, so positions are small numbers.
    """
    import regex
    from xxhash import xxh32_intdigest

    find = regex.compile(pattern).findall
    ids, lengths, codes, place, chars = [], [], [], {}, 0

    def block():
        flat = np.concatenate([*codes, np.zeros(0, np.int32)])
        order = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        first = list(place)
        words = [first[i].encode() for i in order.tolist()]
        return ids, lengths, words, np.fromiter((xxh32_intdigest(w) % classes for w in words), np.int64, len(words)), rank[flat]

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if chars and chars + len(text or "") > BLOCK_CHARS:
                yield block()
                ids, lengths, codes, place, chars = [], [], [], {}, 0
            words = find(text) if text else []
            codes.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words)))
            ids.append(key)
            lengths.append(len(words))
            chars += len(text or "")
    if ids:
        yield block()


def _pack(words: list[bytes]) -> bytes:
    import zstandard

    size = np.array([len(w) for w in words], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(words).to_bytes(4, "little") + size + b"".join(words))


def _unpack(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    data = raw[4 + 4 * n :]
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _squeeze(values: np.ndarray) -> bytes:
    import zstandard

    # Bytes of equal rank stand together, which compresses small numbers well.
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _stretch(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", classes: int | None = None) -> DataFrame:
    """The key column (bigint) and ``ids`` (array<int>) of every row of ``docs``.

    Ids are those of tiktoken with the given ranks and pattern and no special tokens. A null or empty
    text has no ids; repeated rows come out repeated; null keys pass; texts of any length are read
    whole; an empty table gives none. Columns besides the key and text are not read. ``classes`` is the
    number of hash classes of words and defaults to four for each shuffle partition.
    """
    spark = docs.sparkSession
    classes = classes or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def split(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for n, (ids, lengths, words, of, flat) in enumerate(_blocks(batches, pattern, classes)):
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=classes)).tolist()
            lists = [{"class": c, "words": _pack([words[i] for i in order[a:z].tolist()])} for c, (a, z) in enumerate(zip([0, *ends], ends, strict=False)) if z > a]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(task << 24) | n], pa.int64()),
                    "keys": pa.array([ids], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int32())),
                    "classes": pa.array([_squeeze(of)], pa.binary()),
                    "at": pa.array([_squeeze(flat)], pa.binary()),
                    "lists": pa.array([lists], pa.list_(pa.struct([("class", pa.int32()), ("words", pa.binary())]))),
                }
            )

    def encode_words(batches):
        import pyarrow as pa
        import tiktoken

        whole = tiktoken.Encoding("words", pat_str=ALL, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        now = None
        for b in batches:
            for c, block, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if c != now:  # words of one class stand together, and each is encoded once
                    now, known = c, {}
                ids = []
                for w in _unpack(blob):
                    found = known.get(w)
                    if found is None:
                        found = known[w] = whole.encode_ordinary(w.decode())
                    ids.append(found)
                size = np.array([len(x) for x in ids], np.int64)
                flat = np.array([i for x in ids for i in x], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([c], pa.int32()), pa.array([_squeeze(size)], pa.binary()), pa.array([_squeeze(flat)], pa.binary())], ["block", "class", "sizes", "ids"])

    def join(left, right):
        import pyarrow as pa

        out = [pa.array([], pa.int64())], [pa.array([], pa.list_(pa.int32()))]
        if left.num_rows:
            right = right.sort_by("class")
            size = np.concatenate([*map(_stretch, right["sizes"].to_pylist()), np.zeros(0, np.int32)]).astype(np.int64)
            flat = np.concatenate([*map(_stretch, right["ids"].to_pylist()), np.zeros(0, np.int32)])
            start = np.cumsum(size) - size
            # Lists are ordered by class, positions by frequency.
            order = np.argsort(_stretch(left["classes"][0].as_py()), kind="stable")
            if len(order) != len(size):
                raise RuntimeError("a block met other words than its own")
            for x in (size, start):
                x[order] = x.copy()
            at = _stretch(left["at"][0].as_py())
            lengths, keys = np.array(left["lengths"][0].as_py(), np.int64), left["keys"][0].as_py()
            ends = np.cumsum(lengths)
            step = max(1, len(lengths) // max(1, len(at) // 200_000 + 1))
            for lo in range(0, len(lengths), step):
                hi = min(len(lengths), lo + step)
                some = at[ends[lo] - lengths[lo] : ends[hi - 1]]
                n = size[some]
                stop = np.cumsum(n)
                pick = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start[some] - (stop - n), n)
                word_ends = np.cumsum(lengths[lo:hi])
                offsets = np.concatenate([[0], stop])[np.concatenate([[0], word_ends])]
                out[0].append(pa.array(keys[lo:hi], pa.int64()))
                out[1].append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[pick], pa.int32())))
        return pa.table({key: pa.chunked_array(out[0]), "ids": pa.chunked_array(out[1])})

    slim = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), "text")
    # Bucketed, so that positions stay where they are and the words' ids come to them.
    written = in_batches(slim, split, "block bigint, keys array<bigint>, lengths array<int>, classes binary, at binary, lists array<struct<class:int,words:binary>>")
    blocks = cut_by(written, "blocks", "block", int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = blocks.select("block", F.inline("lists")).select("class", "block", "words").repartition(F.col("class")).sortWithinPartitions("class")
    encoded = in_batches(words, encode_words, "block bigint, class int, sizes binary, ids binary")
    texts = blocks.select("block", "keys", "lengths", "classes", "at")
    return texts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(join, f"`{key}` bigint, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """The key column and ``decoded`` (binary) of every row of ``encoded``, and ``ids`` if they are to be kept.

    Ids go through the token-byte table, which each task has whole (its size is the vocabulary's). Null and
    empty ids decode to no bytes, repeated rows and null keys pass, an empty table gives none; an id
    outside the vocabulary is an error. Columns besides the key and ids are not read, so none clash.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = [b""] * (max(ranks.value.values()) + 1)
        for token, i in ranks.value.items():
            table[i] = token
        length = np.array([len(t) for t in table], np.int64)
        flat = np.frombuffer(b"".join(table), np.uint8)
        start = np.cumsum(length) - length
        for b in (b.slice(i, DECODED_ROWS) for b in batches for i in range(0, b.num_rows, DECODED_ROWS)):
            ids = b.column(1)
            of = np.concatenate([[0], np.cumsum(np.array(pc.fill_null(ids.value_lengths(), 0), np.int64))])
            tokens = ids.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(length[tokens])])[of]
            lo = 0
            while lo < b.num_rows:
                # As many rows as make a few megabytes of text, or one.
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + DECODED_BYTES, side="right")) - 1)
                some = tokens[of[lo] : of[hi]]
                n = length[some]
                pick = np.arange(int(n.sum())) + np.repeat(start[some] - (np.cumsum(n) - n), n)
                data = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((ends[lo : hi + 1] - ends[lo]).astype(np.int32).tobytes()), pa.py_buffer(flat[pick].tobytes())])
                kept = [ids.slice(lo, hi - lo)] if keep_ids else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *kept, data], [key, *["ids"] * keep_ids, "decoded"])
                lo = hi

    return in_batches(encoded.select(key, "ids"), run, row_and(encoded, key, "ids array<int>, decoded binary" if keep_ids else "decoded binary"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``.

    Digests of the ids are carried through decoding, so that one narrow pass follows the encoding.
    """
    encoded = encode(docs, ranks_path, pattern)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    carried = encoded.select(F.struct("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256")).alias("row"), "ids")
    decoded = decode(carried, ranks_path, "row")
    return decoded.select("row.*", F.sha2("decoded", 256).alias("decoded_sha256"))
