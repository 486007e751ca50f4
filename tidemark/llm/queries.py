"""The registered query of each text operator: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, factorization, toxicity
from .bin_packing import place_pieces, token_pieces
from .clustering import cluster_vectors
from .decontaminate import decontaminate
from .html_text import extract_pages
from .jaccard_join import jaccard_classes
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .quality_rules import quality_rules
from .repeated_bytes import remove_repeats
from .vector_codes import compress_vectors
from .vectors import join_total


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return got.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, as records of several layouts."""
    told = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat_format.digests(chat_format.format_chats(chat_format.records_of(rows, mixed=True)))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.score(docs, toxicity.train(docs, labels, ["low_quality", "toxic"]))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return factorization.score(docs, factorization.train(docs, _table(spark, sf_dir, "labels")))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2, room=1024)
    # the ids stay in their table; their sums alone are shuffled
    return place_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "_part", "_place"), room=1024)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = compress_vectors(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024.0)
    told = hashlib.sha256(",".join(str(x) for book in coded.codebooks for x in book.ravel()).encode()).hexdigest()
    rows = join_total(coded.rows, "label", "error", "label_error")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(_table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, width=64, scale=256.0, seed="2")
    sums = {r[0]: r[1] for r in found.rows.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row per cluster
    told = [(c, sums.get(c, 0), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(found.centroids)]
    each = spark.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(each), "cluster").withColumn("inertia", F.lit(sum(sums.values())).cast("long"))


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}
