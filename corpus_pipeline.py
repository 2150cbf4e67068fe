"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next one.

An empty table gives no rows in any stage; extra columns go along to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import minhash, packing, quality, secrets, substrings
from sievemill.llm.common import Scratch, give_back, split_by
from sievemill.llm.tokenizing import public_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more; the classifier is fitted on a sample of all labelled rows. A null or empty text
    has the score of a text without features; repeated rows and null ids are each scored."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, name="__score").where("__score >= 0.3").drop("__score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are alike to 80 percent or more: that of the smallest id.

    A null id is in no group, and null or empty texts are alike to nothing: such documents stay. Of rows that repeat an
    id and its text one stays. No partner is left out: what the best ones don't join is compared in full.
    Texts move only where a join or the comparison of repeated ids concerns them.
    """
    give_back(spark)
    scratch = Scratch(spark, "near")
    near = minhash.near_documents(docs, shingle=5, percent=80, complete=True)
    gone = scratch.keep(near.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    again = scratch.keep(near.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    names = [f"`{c}`" for c in docs.columns]
    id_ = F.col("doc_id").cast("long")
    plain, perhaps = split_by(docs, gone, "doc_id", id_)
    left = plain.select(*names).union(perhaps.join(gone, "doc_id", "left_anti").select(*names))
    if again.isEmpty():
        return left
    # null ids are compared among themselves
    once, perhaps = split_by(left, again.where("doc_id is not null"), "doc_id", F.coalesce(id_, F.lit(0)))
    null = F.col("doc_id").isNull()
    return once.where(~null).select(*names).union(perhaps.where(~null).unionByName(left.where(null)).select(*names).dropDuplicates(["doc_id", "text"]))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document of which no word is left goes. Null, empty and short
    texts, null ids and ids that are repeated stay as they are."""
    give_back(spark)
    return substrings.cut(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars is counted again; null texts stay null, each repeated row is scanned."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; a null text counts as empty, each row as a document."""
    give_back(spark)
    # a smaller memory of words than by default: earlier stages have left their heap behind
    return packing.pack(docs, public_path("byte_bpe_50k.json"), words=100_000)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substrings", substring_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: SQL can't express the stages' models and tokenizer; tests/llm/test_queries.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; between them the rows go through Parquet in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
