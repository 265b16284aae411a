"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

1. toxicity: documents whose score reaches 0.7 go. Learnt from the labelled rows among the stage's input, outside the held-out third.
2. near duplicates: of every class the document with the smallest id stays.
3. secrets: every secret becomes [SECRET]; n_chars follows the text. No document goes.
4. mixing: temperature weights with at most two repeats of a source; every document is kept at least once.
5. packing: all documents as pieces in sequences of 2048 tokens.

Texts that are NULL count as empty where they are read and stay NULL in the rows. Stages 1 to 4 return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from arealytics.llm import mixing, ngram_join, packing, secret_scan, toxicity
from arealytics.llm.common import remainder, table, written
from arealytics.llm.queries import TOXIC_FROM


def without_toxic(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.learn(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.score(docs, model, into="__toxicity").where(F.col("__toxicity") < TOXIC_FROM).select(docs.columns)


def one_of_each(spark, docs, sf_dir):
    return ngram_join.one_of_each(docs)


def without_secrets(spark, docs, sf_dir):
    found = secret_scan.scan(docs, into="__spans")
    text = secret_scan.redacted(F.col("text"), F.col("__spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixed_sources(spark, docs, sf_dir):
    return mixing.mixed(docs, entropy=0.98, max_repeats=2.0)


def packed(spark, docs, sf_dir):
    return packing.pack(docs.select("doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", without_toxic), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("mixing", mixed_sources), ("packing", packed)]

ORACLE_SQL = None  # a trained classifier and a tokenizer are not SQL; tests/llm/test_pipeline.py holds the stages against brute force


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
