"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that the quality rules reject go.
2. toxicity: documents that the string-kernel machine scores at 0.7 or more go. It learns from the labels beside the
   documents table, and scores every document that the stage before kept.
3. near_duplicates: of each component of documents whose five-word shingles are similar by 0.8 or more, one stays, the
   one with the smallest doc_id. (op10's SimHash contract, three words and two bits, is that query's alone.)
4. mix: documents are repeated or left out so that sources come to their target weights.
5. encode: token ids and the decoded text of every document of the mix.

All but the last return the columns of documents. Rows of a null text fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.llm import bpe, mixing, near_copies, quality_rules, toxicity
from emberfold.llm.common import documents, scratch, ship, written

TOXIC_FROM = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The features are written beside their documents: texts are read once, and the verdict's plan stays small.
    measured = written(quality_rules.features(docs), "quality")
    known = quality_rules.references(measured)
    return quality_rules.judge(measured, known).where(F.col(quality_rules.BASE)["kept"]).select(*docs.columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    machine = toxicity.fit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).where(F.col("__ef_toxic.score") < TOXIC_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_copies.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    done = bpe.encode_and_decode(docs, keep=["doc_id", "source"])
    ids, decoded = F.col("__ef_bpe.ids"), F.col("__ef_bpe.decoded")
    return done.select("doc_id", "source", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"), F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("toxicity", remove_toxic), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: SQL has no means for the string kernel, MinHash or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), scratch(spark, "pipeline")
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
