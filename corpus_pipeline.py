"""Corpus pipeline: language ID, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared checkpoint folder and reads it back as the
next stage's documents. The first three return the columns of ``documents``;
the last returns one row per packed piece.

* ``language_id``: documents whose language is rejected go (null or letterless
  texts, and scores under the calibrated threshold).
* ``toxicity``: documents predicted toxic go.
* ``near_duplicates``: of each group of documents that link by the Jaccard
  similarity of their 5-word shingles, 0.8 or more, the smallest doc_id stays;
  a null one is behind all others, and of a group without ids one row stays.
* ``packing``: what is left is cut and packed into sequences of 2048 tokens.

Each stage handles nulls in any column, empty tables, repeated rows and extra
columns as its operator says; extra columns pass through the first three stages.
"""

from __future__ import annotations

import uuid

from inkmill.llm import jaccard, langid, packing, toxicity
from inkmill.llm.common import ensure_checkpoint_dir, load


def language_id(spark, docs, sf_dir):
    return langid.keep_identified(docs)


def toxicity_filter(spark, docs, sf_dir):
    return toxicity.keep_civil(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    return jaccard.keep_one(docs, nameless=True)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("packing", pack_sequences),
]

#: Trained models and a tokenizer decide: SQL can't express them.
ORACLE_SQL = None


def run(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
