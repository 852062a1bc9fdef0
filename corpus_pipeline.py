"""A training-data pipeline in five stages, each of which calls one operator.

Every stage works on what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontam, langid, minhash, mixing, tokenbin
from tidemark.llm.queries import END_ID, table, tokenizer_path
from tidemark.llm.scratch import new_folder
from tidemark.session import share_package

#: DuckDB has no tokenizer, and no seeds or permutations equal to Spark's hashes: tested against plain Python instead.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose language is identified and not in doubt; learns from their ``lang`` column. Rows with a null or letterless text go; repeated rows are judged alike."""
    model = langid.train(docs.select("text", "lang"))
    judged = langid.identify(docs, model)
    return judged.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of equal and near-equal texts: that with the smallest doc_id, a null one last.

    Rows are told apart by doc_id and text together; of rows equal in both one stays. A null text
    counts as empty.
    """
    return minhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose own text holds a passage of the benchmark; a null or empty text holds none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: again for words taken twice. Repeated rows are mixed each by itself; a null text has no words and is not taken."""
    return mixing.taken_texts(docs, mixing.mix(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, repeated ones too, read back: doc_id, start, n_tokens, ids_crc32, file and place."""
    return tokenbin.token_digests(docs, tokenizer_path(), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written into the shared folder."""
    share_package(spark)
    folder, docs = new_folder(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
