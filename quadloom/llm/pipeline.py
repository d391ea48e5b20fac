"""The stages of the corpus pipeline: a training corpus from raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import langid, near_copies, packing, pii, substrings
from quadloom.sources.staging import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can tell; those without letters or with a low best score go.

    Without a lang column or any label nothing can be told, and all go.
    """
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of repeated rows one."""
    return near_copies.drop_near_copies(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 100-byte strings that start earlier; null texts come out empty."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("row"))
    left = substrings.remove_repeats(whole, carry=["row"], as_text=True)
    now = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    return _with_n_chars(left.select(*(now.get(c, F.col("row")[c]).alias(c) for c in docs.columns)))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str, key: str = pii.QUERY_KEY) -> DataFrame:
    """All documents, with personal data and secrets replaced by surrogates made under the key."""
    return _with_n_chars(pii.replace_pii(docs, key))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its token ids, and where it goes in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, keep_cache=False, with_ids=True).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


def _with_n_chars(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("pii", private_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, key: str = pii.QUERY_KEY) -> DataFrame:
    """The stages over documents; each result but the last is written to the shared folder and read again.

    An empty table gives none, repeated rows are one from the second stage on, and further columns of documents are
    carried along up to the last stage, whatever their names. key: the secret of the surrogates; the default, which stands in the
    source for all to read, is for tests and checks alone.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir, key) if stage is private_data else stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
