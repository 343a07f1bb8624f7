"""From raw documents to packed sequences: language, quality, near duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affiche.llm import language, near_duplicates, packing, passages, rules
from affiche.llm.queries import table
from affiche.llm.shared import settled

#: Documents whose language is less certain than this go; a fair guess among four languages is 0.25.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is known with some certainty."""
    model = language.fit(docs.where(~language.held_out()))
    told = language.predict(docs, model)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that neither the base rules nor the learned rules reject."""
    learned = rules.learn(docs, table(spark, sf_dir, "labels"))
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))
    return rules.judged(whole, learned).where("kept").select("document.*")


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id."""
    return near_duplicates.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents that are nothing else go."""
    return passages.deduplicated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicate_join),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
