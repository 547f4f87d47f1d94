"""From raw documents to token ids: quality, toxicity, near duplicates, mixture, encoding.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, mixing, near_duplicates, quality, toxicity
from quire.llm.queries import WEIGHTS
from quire.llm.shared import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the base rules or the learned list reject go."""
    rules = quality.learn(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return quality.keep(docs, rules)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a score of 0.5 or more go."""
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each class of near duplicates, the document of the least id stays."""
    return near_duplicates.deduplicate(docs)


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: four fifths of all tokens, dealt out by the target weights, in at most two epochs."""
    return mixing.mix_documents(docs, WEIGHTS, (4, 5), max_epochs=2, seed=29)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: doc_id, the ids of the whole text, and their number."""
    out = bpe.encode(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicate_documents),
    ("mixing", target_mixture),
    ("bpe", token_ids),
]

#: Learned rules, scores and near duplicates have no SQL. The tests hold the near-duplicate stage against brute force, and the
#: statistics, the mixture and the ids of the others in the tests of their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
