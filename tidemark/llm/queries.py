"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, decontam, dialogue, hardneg, kneser_ney, langid, linededup, minhash, mixing, quality, sql, tokenbin, urlfilter, warc

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
END_ID = 2
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """A document's fold: crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES, urlfilter.train(urlfilter.labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_digests(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(fold(7) == 2, F.lit(False)))
    model = kneser_ney.train(docs.where("not held_out"), order=3)
    return kneser_ney.score(docs, model).drop("text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "removed", F.md5("text").alias("text_digest"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False)))
    model = langid.train(docs.where("not held_out").select("text", "lang"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), public_tokenizers.PATTERN)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hardneg.usable(table(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(moved, F.col("vec_id") % 50 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.damage_and_repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_url_filters, op3_token_binary, op4_quality_rules, op5_decontamination, op6_mixing, op7_lm_scoring, op8_line_dedup, op9_language_id, op10_ngram_jaccard_join, op11_byte_bpe, op12_hard_negatives, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express as a whole; see the tests for the others' brute-force versions."""
    return {"op12_hard_negatives": sql.negatives(), "op13_conversation_repair": sql.dialogue()}
