"""From raw documents to a training mix, in five stages; each reads what the one before it wrote.

All but the last return rows of documents with all of their columns, whatever their names. Each says what it does with
nulls, empty and wordless texts and repeated rows; texts of any length are judged whole, ties go by doc_id and then by
the hash of the text, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import factorization
from tidemark.llm.common import durable
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.jaccard_join import keep_one_each
from tidemark.llm.line_dedup import dedup_documents
from tidemark.llm.mixing import mix_sources


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. It learns from the labels outside the held-out fold.

    Null texts are judged as empty ones; repeated rows are judged alike; rows without doc_id by their texts.
    """
    return factorization.keep_good(docs, factorization.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before, or nearly so, go; a document that loses all of its words to that goes too.

    Null, empty and wordless texts lose nothing and stay, repeated rows lose alike; columns are kept whatever their names.
    """
    return dedup_documents(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8 or more, the one with the smallest id stays.

    Null, empty and wordless texts link with nothing and stay. Rows without doc_id go where a row with one is linked, and
    else one of them stays; of rows alike in doc_id and text one stays.
    """
    return keep_one_each(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go, or all words of a shorter one.

    Null, empty and wordless texts stay; repeated rows and rows without doc_id go by their texts.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document left.

    Null, empty and wordless texts have the size 0; a null source is a source of its own; repeated rows count each.
    """
    return mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifier's training cannot be written in SQL; tests hold each stage against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
