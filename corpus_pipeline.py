"""The corpus pipeline: five stages over documents, each an operator of sylva.llm, written as Parquet and read again in between.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. The first four return the columns of documents:
  quality classifier   documents scoring below 0.3 go; the model is fitted on the docs it is given and the table labels;
  exact dedup          of equal texts the largest doc_id stays;
  near-dedup           of linked documents (five-word shingles, similarity 0.75 or more) the least doc_id stays;
  decontamination      words inside 10-word windows of the benchmark are cut out (n_chars follows); documents that consist of
                       such words by half or more go;
  best-fit packing     returns the pieces and their places in sequences of at most 2048 tokens.

Defined results: null and empty texts score the share of good labels and stay where that is 0.3 or more; in exact dedup they are equal
and the largest id stays, in near-dedup they are linked with nothing, and packing makes them one piece of the end token. A null doc_id is
an id like others, but is the one that goes where another row has its text. Rows, not ids, are dropped: of rows of one id with different
texts each is judged by itself, of repeated rows one stays. Very long texts are read whole. Other columns are carried as they are,
whatever their names. Empty tables give empty results; without labels of both classes every document stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sylva.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from sylva.session import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The stages' classifier, sketches and tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/sylva-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
