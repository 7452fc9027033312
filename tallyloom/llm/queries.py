"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, cover_tree, html_text, minhash, mixing, nearest, outliers, prefix_trie, quality, secret_scan, spelling, token_files, toxicity
from workload.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_mix_sources", mixing.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("copies")


@query("op3_nearest", nearest.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


@query("op10_top_products", cover_tree.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_products(table(spark, sf_dir, "embeddings"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    fold = toxicity.held_out(F.col("doc_id"))
    return toxicity.score(docs, model).select("doc_id", fold.alias("held_out"), "score", "predicted", "spans")


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op9_quality_resampling")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality IN (0, 1)")
    share = labels.agg(F.avg("quality")).first()[0]
    rule = quality.Resampling() if share is None else quality.Resampling(keep=float(share))
    return quality.resample(table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"), rule)


@query("op11_robust_outliers")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).drop("n_lines")


@query("op12_prefix_trie", prefix_trie.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("turn_conv_id", "turn_pos")


@query("op13_spelling_variants", spelling.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
