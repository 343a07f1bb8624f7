"""The operators over the given tables, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affiche.llm import (
    bpe,
    language,
    licences,
    lines,
    long_repeats,
    near_duplicates,
    neighbours,
    packing,
    passages,
    resampling,
    rules,
    sharding,
    spellings,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every hundredth vector."""
    rows = neighbours.usable(table(spark, sf_dir, "embeddings"))
    return neighbours.search(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of near duplicates it is in."""
    return near_duplicates.joined(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, by the law ``rows``."""
    return sharding.document_shards(table(spark, sf_dir, "documents"), 16)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of rules learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    learned = rules.learn(docs, table(spark, sf_dir, "labels"))
    return rules.judged(docs.select("doc_id", "text"), learned).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.col("rule").cast("int").alias("rule"),
    )


def op7_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that start elsewhere too."""
    return long_repeats.digests(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score"
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of 13 words that an earlier document has."""
    return passages.digests(table(spark, sf_dir, "documents"))


def _places(docs: DataFrame) -> DataFrame:
    """The documents as files: path and is_licence next to their own columns.

    Documents lie in directories by source, language and thousand of ids, under id and hash of the text, so that rows
    that repeat an id with another text are files of their own. Ids divisible by 10 are licence files; of
    those, ids divisible by 1,000 lie in the directory of the source and other ids divisible by 100 in that of the language.
    Null source, language and id are called ``none``; a row without an id is no licence file.
    """
    doc_id = F.col("doc_id")
    source, lang = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("none")) for c in ("source", "lang")]
    thousand = F.coalesce(F.floor(doc_id / 1000).cast("string"), F.lit("none"))
    name = F.concat_ws("-", F.coalesce(doc_id.cast("string"), F.lit("none")), F.hex(F.xxhash64("text")))
    place = F.when(doc_id % 1000 == 0, source).when(doc_id % 100 == 0, F.concat_ws("/", source, lang))
    place = F.coalesce(place, F.concat_ws("/", source, lang, thousand))
    return docs.select(
        "doc_id", "text", F.concat_ws("/", place, name).alias("path"), F.coalesce(doc_id % 10 == 0, F.lit(False)).alias("is_licence")
    )


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every row of the documents, its own or that of the nearest directory above it.

    Where they lie is said in ``_places``; of several licence files in one directory the first by path counts. Rows that
    repeat id and text are one file, and each of them is returned.
    """
    files = _places(table(spark, sf_dir, "documents"))
    found = licences.scan(files.select("path", "text", "is_licence"))
    return files.select("path", "doc_id").join(found, "path").select("doc_id", "path", "licence", "score", "origin", "source")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of 20 characters and more that 3 documents hold, but in the last of them."""
    return lines.digests(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, its form and its root."""
    return spellings.grouped(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark texts, and a tenth of them drawn."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_one_bit_neighbours": op1_one_bit_neighbours,
    "op2_shingle_join": op2_shingle_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_sharding": op4_sharding,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_long_repeats": op7_long_repeats,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_licence_scan": op10_licence_scan,
    "op11_line_dedup": op11_line_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES: dict[str, str] = {
    "op11_line_dedup": """
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (
            SELECT doc_id, i AS place, parts[i] AS line,
                translate(
                    trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
                ) AS line_key
            FROM split, unnest(range(1, len(parts) + 1)) AS t(i)
        ),
        repeated AS (
            SELECT line_key, max(doc_id) AS last_doc FROM lines WHERE length(line_key) >= 20
            GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
        ),
        judged AS (
            SELECT doc_id, place, line, coalesce(doc_id < last_doc, false) AS gone
            FROM lines LEFT JOIN repeated USING (line_key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
}
