"""What the operators of this subpackage share: tables cut from their lineage, and word hashes.

Tables that cut a lineage go to the folder that the cluster names in ``spark.checkpoint.dir`` (see
``sources.staging``), so executors and the driver both see them and a lost executor loses nothing.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cueflow.sources.staging import Staged as Cut
from cueflow.sources.staging import bound_batches, shared_folder

#: White space that separates words: the space and U+0009 to U+000D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back; it goes when the application ends."""
    return Cut(df, name).df


def cut_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The same with its rows dealt into buckets by ``key``, which a grouping or join by that key can use without a shuffle."""
    spark, table = df.sparkSession, f"cueflow_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch. Texts may be long, and the JVM and Python hold a batch at once.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def give_back() -> None:
    """Returns what this process has freed to the machine: a worker lives on beside later tasks' workers and the JVM."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def in_batches(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, with batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes; a task's worker gives back what they took."""
    bound_batches(df.sparkSession, BATCH_ROWS, BATCH_BYTES)

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def row_and(packed: DataFrame, name: str, more: str) -> StructType:
    """The schema of column ``name`` of ``packed``, whatever its fields are called, and of the columns of the DDL ``more``."""
    return StructType([packed.schema[name], *StructType.fromDDL(more).fields])


def held_out(doc_id: str = "doc_id"):
    """True for the third of ids that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


# --- words of many texts at once ------------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null text has no bytes."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if n else whole[:0], offsets - offsets[0] if n else np.zeros(1, np.int64)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK, _GROUP = 1 << 16, 1 << 17
#: Bytes of the longest span that is hashed by a polynomial.
SHORT_SPAN = 64
_up = _down = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if _up is None or len(_up) < n:
        size = max(n, _BLOCK)
        _up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _ODD)]), dtype=np.uint64)
        _down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    return _up, _down


def word_spans(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``is_space`` (256 booleans) is false for.

    A run ends at the end of its text even where the next text follows without a gap.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~is_space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands.

    Short spans have a polynomial, mixed. Long ones, for which texts can be made up whose polynomials are equal, have XXH64.
    """
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    while at < n:
        # Spans are taken in groups of bounded size so that the running sums stay in the cache.
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + _GROUP)))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        up, down = _powers(hi - lo + 1)
        run = np.empty(hi - lo + 1, np.uint64)
        run[0] = 0
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=run[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    far = np.flatnonzero(ends - starts > SHORT_SPAN)
    if len(far):
        from xxhash import xxh64_intdigest

        out[far] = [xxh64_intdigest(data[a:b].tobytes(), 1) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return out


def space_table(extra: bytes = b"") -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(SPACE_BYTES) + list(extra)] = True
    return out
