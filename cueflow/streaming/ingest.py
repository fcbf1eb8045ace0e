"""Files as they arrive: each micro-batch is converted as any batch is, and its names follow those given before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cueflow.plans.convert import Options, convert, convert_documents
from cueflow.sources.files import documents, glob
from cueflow.sources.staging import dropped_after, staged

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def incoming(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob()).option("maxFilesPerTrigger", per_trigger)
    return stream.load(folder).select("path", "length", "content")


def converted(files: DataFrame, options: Options) -> DataFrame:
    """path, source_format, content, warnings, cue_count, error, ... of a batch, without names."""
    return convert_documents(staged(documents(files).drop("content"), "documents"), options)


def names_given(spark: SparkSession, out: str, before: int) -> DataFrame:
    """path of every name that the batches before this one gave: one column of what they wrote, which outlives a restart."""
    earlier = [f"{out.rstrip('/')}/batch={i}" for i in range(before)]
    context = spark.sparkContext
    exists = lambda p: (at := context._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(context._jsc.hadoopConfiguration()).exists(at)
    there = [p for p in earlier if exists(f"{p}/_SUCCESS")]
    if not there:
        return spark.createDataFrame([], "path string")
    return spark.read.schema("output_path string").parquet(*there).filter("output_path IS NOT NULL").select(F.col("output_path").alias("path"))


def convert_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options, once: bool = True, existing: DataFrame | None = None) -> StreamingQuery:
    """Converts what arrives in a folder into Parquet rows of results (see ``convert``, with ``content``, the text), each file once.

    A name that an earlier batch gave exists for later ones, also after a restart; ``existing`` (path) adds names that were there before.
    Within a batch files take names in the order of a hash of their path. A batch that runs again replaces what it wrote, with
    the same names. Nothing is left of a batch's tables when it is through.
    """

    def convert_batch(files: DataFrame, number: int) -> None:
        with dropped_after():
            taken = names_given(spark, out, number)
            taken = taken if existing is None else taken.unionByName(existing.select("path"))
            results = convert(files.withColumn("pos", F.xxhash64("path")), options, taken)
            text = F.decode(F.when(F.startswith("output", F.lit(b"\xef\xbb\xbf")), F.substr("output", F.lit(4))).otherwise(F.col("output")), "UTF-8")
            results.withColumn("content", text).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = incoming(spark, folder).writeStream.foreachBatch(convert_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
