"""The corpus pipeline: each stage takes the documents its predecessor kept, and its decisions take effect.

1. quality rules: documents that the base rule or the learned list rejects go;
2. near-dedup: of every component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more one row stays, that
   of the smallest doc_id (`llm/near.py`; the query ``op8_simhash`` keeps its own contract of three words and three bits);
3. suffix-array dedup: every byte that a repeated 200-byte string covers is cut out of the texts; rows stay;
4. PII: base and added spans become their kind in square brackets;
5. packing: the placed pieces of the remaining texts.

Stages 1 to 4 return the columns of ``documents``; n_chars follows a changed text. NULL and empty texts fail the base rule in
stage 1; an empty table passes through all stages. SQL cannot express stages 2 to 5, so there is no ORACLE_SQL; the tests
compare the stages with plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitclock.llm.bpe import public_vocabulary
from splitclock.llm.common import table, written
from splitclock.llm.near import one_of_each
from splitclock.llm.packing import pack
from splitclock.llm.pii import masked
from splitclock.llm.quality import keep_good
from splitclock.llm.suffix import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mask_pii", mask_pii),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
