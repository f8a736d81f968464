"""From raw documents to packed training sequences: five stages, each written and read again between."""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import jaccard_join, mixing, packing, pii, toxicity
from meterlake.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more.

    Null and empty texts score 0 and stay; repeated rows, rows without an id and extra columns stay as they are; an empty
    table stays empty; without labels of both kinds nothing is learned (see ``toxicity``).
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by shingles of five words at a similarity of 0.8 or more: the one with the smallest id.

    Documents without words and rows without an id link with nothing and stay; an id that repeats is one document, all
    of whose rows stay or go; columns of any name stay; an empty table stays empty.
    """
    return jaccard_join.keep_one(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and n_chars brought in line; no document is dropped.

    Null and empty texts stay as they are; of overlapping spans the union is replaced, named after the first; equal texts
    become equal texts; an empty table stays empty.
    """
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whole copies so that each source has its share of words.

    Documents without words are not taken; a null source is a source; repeated rows and rows without an id are documents
    of their own; ties in size are dealt by a hash of the id; an empty table stays empty.
    """
    return mixing.take_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Null and empty texts give the closing id alone; repeated rows are packed as often as they occur; an empty table
    gives no pieces.
    """
    return packing.concat_and_cut(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact_private),
    ("mixing", mix_sources), ("packing", pack),
]

#: Scores, spans and tokens are beyond SQL; ``tests/llm/test_pipeline.py`` compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
