"""Reading folders of subtitle files and writing converted ones.

Folders are listed and files read and written by executors, slices of the paths each. A table of many files that
is not a user's list is read by Spark's binary file source, whose patterns prune files before a byte of them is read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cueflow.functions.names import FORMATS, admitted, base_name, directory, extensions
from cueflow.operators.detect import detect
from cueflow.operators.ordered import running, sliced
from cueflow.sources.encoding import decode
from cueflow.sources.paths import PathList, file_bytes, names_in, remove, settle_part, sweep, write_part
from cueflow.sources.progress import watched
from cueflow.sources.staging import spread, staged


def glob() -> str:
    """Names with a registered extension, in any mixture of cases."""
    any_case = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*.{" + ",".join(map(any_case, extensions())) + "}"


def type_filters() -> dict[str, list[str]]:
    """What a user may pick from, as patterns of names: each format's own extension, and all files."""
    return {"Subtitles and lyrics": [f"*.{f.extension}" for f in FORMATS.values()], "All files": ["*"]}


def _status(spark: SparkSession, path: str):
    """What the file system says of a path; None if it is missing or can't be looked at."""
    from py4j.protocol import Py4JJavaError

    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return at.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(at)
    except Py4JJavaError:
        return None


def is_folder(spark: SparkSession, path: str) -> bool:
    """False also for a path that is missing or can't be looked at."""
    found = _status(spark, path)
    return bool(found and found.isDirectory())


def expand_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """pos and path of the files that ``paths`` name, in their order; the given paths are a user's list.

    Blank paths are dropped, others trimmed. A folder stands for its own files with a registered
    extension (not those of its subfolders), sorted by lower-case name, then path; other paths stand for
    themselves, there or not. Nothing is deduplicated (see ``paths.dedupe``). Executors list the folders, a slice
    of the paths each.
    """
    spark.dataSource.register(PathList)
    given = [p.strip() for p in paths if p.strip()]
    names = spark.read.format(PathList.name()).option("paths", json.dumps(given)).option("extensions", json.dumps(sorted(extensions()))).load()
    order = ["nth", "name", "path"]
    placed = running(sliced(names.withColumn("all", F.lit(1)), ["all"], order, "paths"), ["all"], order, {"pos": F.lit(1)})
    return placed.select("pos", "path")


def _binary(spark: SparkSession):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")


def read_folder(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, length and content of a folder's own files (not of its subfolders) with a registered extension, or whose names fit ``pattern``."""
    return _binary(spark).option("pathGlobFilter", pattern or glob()).load(folder).select("path", "length", "content")


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """pos, path, length and content of all that ``paths`` name (see ``expand_paths``), whose name admits them.

    A file that is missing or can't be read is a row with null content, never an exception.
    """
    return contents(expand_paths(spark, paths).filter(admitted(F.col("path"))))


#: Bytes of files that a task holds before it hands them on; a larger file is held by itself.
_HELD = 8 << 20


def contents(files: DataFrame) -> DataFrame:
    """``files`` (pos, path) with length and content, read by executors; both null where a file is missing or can't be read."""
    schema = "pos bigint, path string, length bigint, content binary"

    def run(batches):
        import pyarrow as pa

        def out(rows):
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["pos", "path", "length", "content"])

        rows, held = [], 0
        for b in batches:
            for pos, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = file_bytes(path)
                rows.append((pos, path, None if data is None else len(data), data))
                held += len(data or b"")
                if held >= _HELD:
                    yield out(rows)
                    rows, held = [], 0
        yield out(rows)

    return spread(files.select(F.col("pos").cast("bigint").alias("pos"), "path"), "path").mapInArrow(run, schema)


def listing_order(df: DataFrame, path: str = "path") -> DataFrame:
    return df.orderBy(F.lower(base_name(F.col(path))), path)


def documents(files: DataFrame) -> DataFrame:
    """Decoded and detected files: path, length, text, encoding, had_bom, error, format, score, evidence, ...

    Null content is a file that could not be read.
    """
    gone = F.struct(F.lit("readFailed").alias("failure"), F.lit("The file is missing or could not be read.").alias("detail"))
    found = detect(decode(files))
    return found.withColumn("error", F.when(F.col("content").isNull(), gone.cast(found.schema["error"].dataType)).otherwise(F.col("error")))


def inspect(files: DataFrame) -> DataFrame:
    """What a file is, without parsing it; an unknown format is no error here."""
    found = documents(files)
    return found.select("path", "format", "score", "evidence", "ext_matched", "runner_up", "runner_up_score", "ambiguous", "encoding", "had_bom", F.col("length").alias("bytes"), "error")


def from_column(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """Files out of a table that holds their texts."""
    content = F.encode(text, "UTF-8")
    return df.select(path.alias("path"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))


def _packed(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)


def _mapped(packed: DataFrame, run, more: str) -> DataFrame:
    schema = StructType([packed.schema["row"], *StructType.fromDDL(more).fields])
    return packed.mapInArrow(run, schema).select("row.*", *[f.name for f in StructType.fromDDL(more).fields])


def write_parts(df: DataFrame, folder: Column, content: Column, mark: str, done=None, failed=None) -> DataFrame:
    """``df`` with ``part``, the name below ``folder`` that the row's bytes stand under, ``write_failure`` and ``write_ns``.

    Rows with null content have neither. ``mark`` starts the names of all parts of a job. The two accumulators count.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for to, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                began = time.perf_counter_ns()
                part, failure = (None, None) if data is None else write_part(to, data, mark)
                out.append((part, failure, time.perf_counter_ns() - began))
                if done is not None:
                    (done if failure is None and data is not None else failed).add(1)
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["row", "part", "write_failure", "write_ns"])

    return _mapped(_packed(df, folder.alias("folder"), content.alias("content")), run, "part string, write_failure string, write_ns bigint")


def settle_parts(df: DataFrame, to: Column) -> DataFrame:
    """``df`` (with ``part``) with ``settle_failure``: parts get the name ``to``, or are removed where it is null."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            failures = []
            for part, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                failures.append(settle_part(part, path) if part and path else remove(part))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(failures, pa.string())], ["row", "settle_failure"])

    return _mapped(_packed(df, F.col("part").alias("of"), to.alias("to")), run, "settle_failure string")


def sweep_parts(folders: DataFrame, mark: str) -> None:
    """Removes what is left of a job's parts: those of attempts that were lost, or all if the job failed."""
    folders.select(F.col("folder").cast("string")).distinct().mapInArrow(lambda batches: sweep(batches, mark), "folder string").write.format("noop").mode("overwrite").save()


def folder_contents(folders: DataFrame) -> DataFrame:
    """path of everything that the folders (column ``folder``) hold themselves, listed by executors."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p for f in b.column(0).to_pylist() for p in names_in(f)], pa.string())], ["path"])

    return spread(folders.select(F.col("folder").cast("string")).distinct(), "folder").mapInArrow(run, "path string")


def new_mark() -> str:
    return f".{uuid.uuid4().hex}"


def write_files(df: DataFrame, path: str = "output_path", content: str = "output", order: str | None = None, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Writes each row's bytes; returns path and failure (null if written) of every row. Parent folders must exist.

    Tasks write under names of their own first. When all have, the rows' files are renamed, and where rows share a path the last
    one by ``order`` stays. If the job fails, none is renamed and all are removed; so are those of attempts that
    were lost on the way. ``progress`` is called with the numbers of files written and failed so far while the job runs.
    """
    mark, count = new_mark(), df.sparkSession.sparkContext.accumulator
    rows = df.select(F.col(path).alias("path"), F.col(content).alias("content"), (F.col(order) if order else F.lit(0)).cast("bigint").alias("o"))
    done, failed = count(0), count(0)
    folder = directory(F.col("path"))
    try:
        with watched(done, failed, progress):
            parts = write_parts(rows.select("path", "o", folder.alias("folder"), "content"), F.col("folder"), F.coalesce("content", F.lit(b"")), mark, done, failed)
            written = staged(parts.drop("content"), "written")
        last = F.row_number().over(Window.partitionBy("path", F.col("part").isNull()).orderBy(F.desc("o"), "part")) == 1
        settled = staged(settle_parts(written.withColumn("last", last), F.when(F.col("last"), F.col("path"))), "settled")
    finally:
        sweep_parts(rows.select(folder.alias("folder")), mark)
    return settled.select("path", F.coalesce("write_failure", "settle_failure").alias("failure"))
