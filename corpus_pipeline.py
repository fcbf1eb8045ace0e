"""From raw documents to token ids: five stages, each the work of one operator over all that came before.

Every stage is written as Parquet to the shared folder and read again, so a stage that fails is the
only one to run anew and no plan grows over stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm import bpe, decontaminate, line_dedup, quality, shingle_dedup
from cueflow.llm.runtime import Cut, table


# What holds for every stage: an empty table gives none, texts of any length are read whole, other columns
# pass as they are whatever they are called, and a row is judged by its own text, not by its doc_id.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts are scored as texts without words; repeated rows go or stay together; at a score
    of exactly 0.5 a document stays, as all do where labels don't tell two classes.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; n_chars follows. Documents stay, even if nothing is left.

    A null text stays null; lines on exactly the least number of sites are boilerplate; repeated rows are treated alike.
    """
    out = line_dedup.remove_boilerplate(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 5-word-shingle Jaccard of 0.8 or more.

    The smallest doc_id stays, null ids come last, ties go by a hash of the text; repeated rows are one group, as null and empty texts are.
    """
    return shingle_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark.

    Null and empty texts and rows without doc_id stay unless their text leaks; repeated rows go or stay together; without items all stay.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to, of every row; a null text has no ids and decodes to an empty one."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    rows = encoded.select(F.struct("doc_id", F.size("ids").cast("bigint").alias("n_tokens")).alias("row"), "ids")
    return bpe.decode(rows, ranks, "row", keep_ids=True).select("row.*", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the classifier, the latent search or BPE; see tests/llm for what the stages are held against.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        after = Cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
