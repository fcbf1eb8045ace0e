"""Conversion of a batch of files: one row in, one result row out, failures as values."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions.names import FORMATS, directory
from cueflow.functions.recorded import recorded
from cueflow.functions.text import is_blank
from cueflow.operators import paths
from cueflow.operators.loss import WARNING, loss_of
from cueflow.operators.model import shift_array
from cueflow.plans.parse import CUE, ERROR, PARSERS, by_format, parse
from cueflow.plans.write import write
from cueflow.sources.encoding import encode
from cueflow.sources.files import documents, folder_contents, new_mark, settle_parts, sweep_parts, write_parts
from cueflow.sources.progress import watched
from cueflow.sources.staging import staged


@dataclass(frozen=True)
class Options:
    target: str = "srt"
    offset_ms: int = 0
    policy: str = "autoRename"
    directory: str | None = None
    bom: bool = False
    strip_media: bool = False

    def __post_init__(self):
        if self.target not in FORMATS:
            raise ValueError(f"unknown format {self.target}")
        if self.policy not in ("autoRename", "overwrite", "skip"):
            raise ValueError(f"unknown policy {self.policy}")
        if self.directory is not None and not self.directory.strip():
            raise ValueError("a custom folder must have a name")

    @classmethod
    def from_settings(cls, settings: dict) -> Options:
        """From stored settings; what can't be read keeps its default."""
        found = cls()
        for name, value in settings.items():
            kind = {"target": str, "policy": str, "directory": str, "offset_ms": int, "bom": bool, "strip_media": bool}.get(name)
            if kind and isinstance(value, kind) and not (kind is int and isinstance(value, bool)):
                try:
                    found = replace(found, **{name: value})
                except ValueError:
                    continue
        return found

    def save(self, path: str) -> None:
        """As JSON; options at their default are left out."""
        plain = Options()
        with open(path, "w", encoding="utf-8") as f:
            json.dump({k: v for k, v in asdict(self).items() if v != getattr(plain, k)}, f)

    @classmethod
    def load(cls, path: str) -> Options:
        """Stored options; a file that is missing or can't be read gives the defaults."""
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            return cls()
        return cls.from_settings(found if isinstance(found, dict) else {})


def without(files: DataFrame, removed: DataFrame, order: str = "pos") -> DataFrame:
    """``files`` without the rows whose ``order`` is in ``removed``."""
    return files.join(removed.select(order).distinct(), order, "left_anti")


def _error(failure: str, detail: str) -> Column:
    return F.struct(F.lit(failure).alias("failure"), F.lit(detail).alias("detail")).cast(ERROR)


def convert_texts(df: DataFrame, source: str, target: str, offset_ms: int = 0) -> DataFrame:
    """``df`` (with ``text``) with ``content``, ``warnings``, ``cue_count`` and ``error``; narrow.

    Cues that the writer leaves out for want of text are counted too.
    """
    return converted_documents(parse(df, source), source, target, offset_ms)


def converted_documents(docs: DataFrame, source: str | Column, target: str, offset_ms: int = 0) -> DataFrame:
    """The same from parsed documents; ``source`` is their format or the column that names it."""
    if isinstance(source, str):
        return _converted(docs, source, target, offset_ms, tuple(FORMATS.values()))
    return _convert(docs, source, target, offset_ms)


@recorded
def _converted(docs: DataFrame, source: str, target: str, offset_ms: int, formats: tuple) -> DataFrame:
    return _convert(docs, F.lit(source), target, offset_ms)


def _convert(docs: DataFrame, source: Column, target: str, offset_ms: int) -> DataFrame:
    none = F.when(F.size("cues") == 0, _error("emptyDocument", "The file contains no subtitle entries."))
    docs = docs.withColumns({"error": F.coalesce("error", none), "cues": shift_array(F.col("cues"), offset_ms)})
    docs = docs.withColumns({"warnings": loss_of(source, F.lit(target)), "cue_count": F.size("cues")})
    out = write(docs, target)
    blank = F.when(is_blank(F.col("content")), _error("emptyDocument", "The file contains no subtitle entries to write."))
    out = out.withColumn("error", F.coalesce("error", blank))
    good = F.col("error").isNull()
    empty = F.expr(f"cast(array() as array<{WARNING}>)")
    return out.withColumns({"content": F.when(good, F.col("content")), "warnings": F.when(good, F.col("warnings")).otherwise(empty), "cue_count": F.when(good, F.col("cue_count")).otherwise(0)}).drop("cues", "styles", "fields", "title", "language")


#: The clock of the machine that a row is worked on, in nanoseconds; one more look at each row.
_NOW = "CAST(reflect('java.lang.System', 'nanoTime') AS BIGINT)"


def _since(began: Column, result: Column) -> Column:
    """Nanoseconds since ``began``, looked at when ``result`` is there."""
    return F.when(result.isNull(), F.expr(_NOW)).otherwise(F.expr(_NOW)) - began


def convert_documents(docs: DataFrame, options: Options) -> DataFrame:
    """Detected documents (text, format, error) with ``content``, ``warnings``, ``cue_count``, ``source_format`` and ``convert_ns``.

    Every format is a branch of its own, narrow within; files of no known format are one too. ``docs`` is
    read once a branch, so hand in a table. ``convert_ns`` is the time from a row's reading to its text's being made;
    rows that go through Python wait for those of their batch.
    """
    outputs = ("content", "warnings", "cue_count", "source_format", "convert_ns")
    keep = [c for c in docs.columns if c not in ("text", "error", "format", *outputs)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("error").cast(ERROR).alias("before"), F.col("format").alias("source_format"), F.coalesce("text", F.lit("")).alias("text"))
    columns = [*[F.col(f"row.`{c}`") for c in keep], "source_format", "content", "warnings", "cue_count", "error", "convert_ns"]

    def branch(fmt: str, mine: DataFrame) -> DataFrame:
        mine = mine.withColumn("began", F.expr(_NOW))
        done = converted_documents(parse(mine, fmt), fmt, options.target, options.offset_ms)
        return done.withColumn("convert_ns", _since(F.col("began"), F.col("content"))).select(*columns)

    unknown = _error("unsupportedFormat", "No registered format fits this file.")
    known = F.col("before").isNull() & F.coalesce(F.col("source_format").isin(*PARSERS), F.lit(False))
    failed = rows.filter(~known).withColumns({"content": F.lit(None).cast("string"), "warnings": F.expr(f"cast(array() as array<{WARNING}>)"), "cue_count": F.lit(0), "error": F.coalesce("before", unknown), "convert_ns": F.lit(0).cast("bigint")})
    # The format's filter reaches the scan, so a branch reads its own files' texts.
    return by_format(rows.filter(F.col("before").isNull()), "source_format", branch).unionByName(failed.select(*columns))


def _read(files: DataFrame) -> DataFrame:
    """Decoded and detected files as a table, without their bytes, with ``read_ns``."""
    found = documents(files.withColumn("__began", F.expr(_NOW)))
    return staged(found.withColumn("read_ns", _since(F.col("__began"), F.concat_ws("", "text", "format"))).drop("content", "__began"), "documents")


def _asked(done: DataFrame, options: Options, folders: DataFrame | None) -> DataFrame:
    """Converted rows with ``out_dir``, ``requested`` and, where the folder is missing, their error."""
    folder = F.lit(options.directory.strip()) if options.directory else directory(F.col("path"))
    asked = paths.requested(done, F.lit(options.target), folder=folder, media=options.strip_media)
    if folders is None:
        return asked
    known = folders.select(F.col("path").alias("out_dir")).distinct()
    gone = _error("targetPathUnavailable", "There is no such output folder.")
    # The few folders are looked up once each, not once a file.
    missing = asked.select("out_dir").distinct().join(known, "out_dir", "left_anti").withColumn("gone", F.lit(True))
    return asked.join(missing, "out_dir", "left").withColumn("error", F.coalesce("error", F.when(F.col("gone"), gone))).drop("gone")


def _results(out: DataFrame, options: Options, *more: Column | str) -> DataFrame:
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("action") == "skip", "skipped").otherwise("succeeded")
    failed = status == "failed"
    spent = F.col("read_ns") + F.col("convert_ns") + F.coalesce("write_ns", F.lit(0)) if "write_ns" in out.columns else F.col("read_ns") + F.col("convert_ns")
    return out.withColumn("status", status).select(
        "pos",
        F.col("path").alias("source_path"),
        "status",
        F.when(~failed, F.col("source_format")).alias("source_format"),
        F.lit(options.target).alias("target_format"),
        F.when(~failed, F.col("output_path")).alias("output_path"),
        F.col("error.failure").alias("failure"),
        F.coalesce("error.detail", "reason").alias("detail"),
        F.when(~failed, F.col("encoding")).alias("encoding"),
        F.when(failed, F.expr(f"cast(array() as array<{WARNING}>)")).otherwise(F.col("warnings")).alias("warnings"),
        F.when(failed, F.lit(False)).otherwise(F.coalesce("renamed", F.lit(False))).alias("output_renamed"),
        F.when(failed, 0).otherwise(F.col("cue_count")).alias("cue_count"),
        F.floor(spent / 1_000_000).cast("bigint").alias("elapsed_ms"),
        *more,
    )


def convert(files: DataFrame, options: Options, existing: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Results of a batch: files have path, content, pos; ``existing`` lists the paths that exist.

    A file whose content is null could not be read. ``folders`` (path), if given, lists the folders that
    exist; another output folder is a failure. ``output`` holds the bytes to write where the status is succeeded.
    Decoded files and converted ones are tables in the shared folder: what follows starts from them. Names are settled on paths
    alone; then each row's text meets its name by ``pos``, the one time that texts are shuffled (``convert_to_files`` moves none).
    """
    done = staged(convert_documents(_read(files), options), "converted")
    asked = _asked(done.drop("content"), options, folders)
    good = asked.filter(F.col("error").isNull()).select("pos", "path", "requested")
    named = paths.assign(good, existing, options.policy).select("pos", "action", "output_path", "renamed", "reason")
    out = asked.join(named, "pos", "left").join(done.select("pos", "content"), "pos")
    return _results(out, options, F.when(F.col("status") == "succeeded", encode(F.col("content"), options.bom)).alias("output"))


def convert_to_files(files: DataFrame, options: Options, existing: DataFrame | None = None, progress: Callable[[int, int, int], None] | None = None) -> DataFrame:
    """Converts a batch and writes its files; returns a row of results for each file.

    Each task writes what it has converted into the output folder under a name of its own, so texts never leave their task.
    Names are settled on paths, then the files are renamed or, where a row is skipped, removed; where rows were told to overwrite one
    file the last one stays. If the job fails no file has been renamed and all are removed. ``existing`` (path) defaults to what the output folders hold.
    ``progress`` is called with the numbers of files done (written or failed), all files, and failed ones, while the job runs.
    """
    spark, mark = files.sparkSession, new_mark()
    total, done, failed = files.count() if progress else 0, spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    folder = F.lit(options.directory.strip()) if options.directory else directory(F.col("path"))
    tell = None if progress is None else lambda good, bad: progress(good + bad, total, bad)
    out_dirs = files.select(folder.alias("folder")).distinct()
    try:
        with watched(done, failed, tell):
            converted = convert_documents(_read(files), options)
            parts = write_parts(converted.withColumn("out_folder", folder), F.col("out_folder"), F.when(F.col("error").isNull(), encode(F.col("content"), options.bom)), mark, done, failed)
            written = staged(parts.drop("content", "out_folder"), "written")
        there = existing if existing is not None else folder_contents(out_dirs).filter(~F.contains("path", F.lit(f"/{mark}.")))
        unwritten = F.when(F.col("write_failure") == "readFailed", _error("targetPathUnavailable", "There is no such output folder.")).when(F.col("write_failure").isNotNull(), F.struct(F.col("write_failure").alias("failure"), F.lit("The output could not be written.").alias("detail")).cast(ERROR))
        asked = _asked(written.withColumn("error", F.coalesce("error", unwritten)), options, None)
        named = paths.assign(asked.filter(F.col("error").isNull()).select("pos", "path", "requested"), there, options.policy)
        named = named.select("pos", "action", "output_path", "renamed", "reason", (F.row_number().over(Window.partitionBy("output_path").orderBy(F.desc("pos"))) == 1).alias("last"))
        out = staged(asked.join(named, "pos", "left"), "named")
        settled = settle_parts(out, F.when((F.col("action") == "write") & F.col("last"), F.col("output_path")))
        broken = F.when(F.col("settle_failure").isNotNull(), F.struct(F.col("settle_failure").alias("failure"), F.lit("The output could not be written.").alias("detail")).cast(ERROR))
        return staged(_results(settled.withColumn("error", F.coalesce("error", broken)), options), "results")
    finally:
        sweep_parts(out_dirs, mark)


def batch_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, lossy ones among the successes, and the summary sentence."""
    lossy = (F.col("status") == "succeeded") & (F.size("warnings") > 0)
    n = lambda test: F.count_if(test).cast("bigint")
    agg = results.groupBy(*keys).agg(
        n(F.col("status") == "succeeded").alias("succeeded"),
        n(F.col("status") == "failed").alias("failed"),
        n(F.col("status") == "skipped").alias("skipped"),
        n(lossy).alias("lossy"),
        n(F.col("status").isin("succeeded", "failed", "skipped")).alias("completed"),
        F.count(F.lit(1)).alias("total"),
    )
    return agg.withColumn("summary", summary(*[F.col(c) for c in ("succeeded", "failed", "skipped", "lossy")]))


def summary(succeeded: Column, failed: Column, skipped: Column, lossy: Column) -> Column:
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    parts = F.concat_ws(", ", part(succeeded, "succeeded"), part(failed, "failed"), part(skipped, "skipped"))
    styled = F.when(lossy > 0, F.concat(F.lit(" "), lossy.cast("string"), F.lit(" lost some styling."))).otherwise("")
    return F.when(parts == "", F.lit("")).otherwise(F.concat(parts, F.lit("."), styled))


__all__ = ["CUE", "Options", "batch_counts", "convert", "convert_documents", "convert_texts", "convert_to_files", "summary"]
