"""A training corpus from raw documents: toxic documents out, one document of each near-duplicate
group kept, personal data replaced, sources mixed to target weights, text encoded.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of
``documents``.  Stages are narrow but for joins on skinny columns, so each can be written and read
again between them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import minhash, mixing, pieces, pii, toxicity
from moraine.llm.common import checkpoint_folder, fresh, table

MODEL = f"{os.environ.get('MORAINE_TOKENIZERS', '/opt/tokenizers')}/piece_bpe_32k.model"


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but the ``used`` ones under names that no operator gives, and the
    columns that bring the documents back."""
    names = [c if c in used else f"column {k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(f"`{other}`").alias(c) for other, c in zip(names, docs.columns)]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the lexicon is learned from the labels of ``docs``."""
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    held, back = apart(docs, "text")
    return toxicity.score(held, model).where("score < 0.5").select(*back)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group (five-word shingles, similarity 0.8 or more).
    Documents without an id, and without words, have no group and stay."""
    found = minhash.near_duplicates(docs, words=5, percent=80).where("not kept").select(F.col("doc_id").alias(fresh(docs, "copy")))
    return docs.join(found, docs["doc_id"] == found[found.columns[0]], "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it replaced by labels; ``n_chars`` follows."""
    held, back = apart(docs, "text")
    found = pii.detect(held)
    text = F.when(F.col("text").isNotNull(), pii.sanitised(F.col("text"), F.col("pii_base"), F.col("pii_terms")))
    found = found.withColumn("text", text).select(*back)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares of tokens."""
    held, back = apart(docs, "doc_id", "text", "lang", "source")
    return mixing.corpus_mix(held).where("mix_kept").select(*back)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sampled pieces; rows whose text would not decode stay visible."""
    return pieces.encode(docs, MODEL)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash", without_copies),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL can express neither the learned lexicon nor the sampled segmentations; tests/llm/test_pipeline.py
#: compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
