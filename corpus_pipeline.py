"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents,
the last one the pieces of packed sequences. Every stage works on all that its
predecessor kept; run() writes each stage's rows as a table in the shared
folder and reads them again, so that a lost executor never costs more than the
stage at hand. A table without rows passes through every stage, and further
columns are kept, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm import op3_toxicity, op6_suffix_array, op7_packing, op8_line_dedup, op10_jaccard_join
from glossarium.llm.common import cut, uncut


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars as the text now has it."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return docs.select(*columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; null and empty texts do. The labels of sf_dir teach the classifier."""
    how = op3_toxicity.Toxicity()
    model = op3_toxicity.train(spark, sf_dir, docs, how)
    names = [f"c{k}" for k in range(len(docs.columns))]
    scored = op3_toxicity.scores(docs.toDF(*names), model, how.width, names[docs.columns.index("text")], "score")
    return scored.filter("score < 0.5").select(*names).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more of them have, but for the last document's; a text that loses nothing stays as it is, null too."""
    return counted(op8_line_dedup.texts_without_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group linked by five-word shingles at 0.8 or more.

    A null id comes last; where ids tie the text decides, and of rows that
    repeat id and text one stays. Rows without words are in no group and stay.
    """
    return op10_jaccard_join.one_of_each(docs, op10_jaccard_join.Join(words=5, percent=80))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that stand earlier in the corpus, cut at whole characters; a null text becomes empty."""
    return counted(op6_suffix_array.texts_without_repeats(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens; a null text is one closing id, repeated rows and null ids are packed one by one."""
    return op7_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: A fitted classifier decides the first stage, and tokens the last: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            uncut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
