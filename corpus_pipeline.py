"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, mixing, packing, privacy, quality
from quillon.llm.common import stored
from quillon.llm.entry import TOKENIZERS, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What a batch of rows on its way to or from a Python worker may hold, unless the session says so itself. Executors and
#: workers each hold several; Spark's own bound of 10,000 rows lets whole texts make some 25 MB, at times far more.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(stage: Stage) -> Stage:
    """The stage, in a session with that bound. It stays set, since the stage's result runs later; it changes no results."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_CONF, None) is None:
            spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@bounded
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


@bounded
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8 or more."""
    return jaccard.representatives(docs, n=5, tenths=80)


@bounded
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it give way to their kinds; n_chars follows the text."""
    return privacy.sanitise(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


@bounded
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the tempered marginals of source, language and topic where there are enough tokens for them."""
    return mixing.mix(docs).select(*docs.columns)


@bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return packing.pack(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good),
    ("ngram_jaccard_join", distinct),
    ("pii", private),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Learned rules and tokenizers have no SQL form; the stages' operators are each tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
