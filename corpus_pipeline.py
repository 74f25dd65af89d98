"""The corpus pipeline: toxic documents go, near copies go, sources are mixed, texts are encoded.

Every stage takes (spark, docs, sf_dir) and returns the next stage's docs, with the columns of documents; the last
returns a row of ids per document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, queries, similarity, toxicity
from tessera.llm.common import free_name, remove, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; labels of held-out ids aren't learned from."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~queries.held_out()))
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, model, out_col=score).filter(F.col(score) < queries.TOXIC).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles."""
    return similarity.near_duplicates_removed(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decodes): the ids of each text, and whether they decode to it."""
    path, pattern = queries.multilingual_vocabulary()
    found = bpe.encode_checked(docs.select("doc_id", "source", "text"), path=path, pattern=pattern)
    return found.select("doc_id", "source", F.size("bpe.ids").cast("long").alias("n_tokens"), "bpe.ids", "bpe.decodes")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A language model's scores can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again in the shared folder, and go when the next are written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
