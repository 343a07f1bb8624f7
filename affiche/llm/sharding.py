"""Shards from a keyed permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affiche.llm.shared import partitions, settled, text_or_empty, unused

ROUNDS = 6


def _round(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    h = (half.astype(np.uint64) + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(half), np.int64)


def permuted(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The places that row numbers 0 to n - 1 take in a permutation of 0 to n - 1.

    A Feistel network permutes the numbers of 2k bits, 4**k being the first power not under n;
    a number that lands at n or beyond walks on along its cycle until it lands below n.
    """
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    rng = np.random.default_rng(seed)
    keys = [int(k) for k in rng.integers(0, 1 << 63, ROUNDS)]
    out = np.asarray(rows, np.int64).copy()
    left = np.ones(len(out), bool)
    while left.any():
        value = out[left]
        a, b = value >> bits, value & mask
        for key in keys:
            a, b = b, a ^ _round(b, key, bits)
        out[left] = (a << bits) | b
        left = out >= n
    return out


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Rows with global numbers from 0 in the given order.

    Range partitions are numbered on their own and start where the rows before them end; a mark of
    each row's place keeps rows that are alike in every ``order`` column from meeting in one partition.
    """
    spark = df.sparkSession
    _tie, _part, _place, _n = (unused(c, [*df.columns, name]) for c in ("tie", "part", "place", "n"))
    keyed = df.withColumn(_tie, F.monotonically_increasing_id())
    columns = [*order, _tie]
    dealt = keyed.repartitionByRange(max(partitions(spark), 1), *columns).sortWithinPartitions(*columns)
    dealt = settled(
        dealt.withColumn(_part, F.spark_partition_id())
        .withColumn(_place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .drop(_tie),
        "numbered",
    )
    sizes = dealt.groupBy(_part).agg(F.count("*").alias(_n)).collect()  # one row a partition
    starts, total = {}, 0
    for part, n in sorted((r[_part], r[_n]) for r in sizes):
        starts[part] = total
        total += n
    before = F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)]) if starts else None
    number = F.col(_place) + (before[F.col(_part)] if starts else F.lit(0))
    return dealt.withColumn(name, number.cast("long")).drop(_part, _place)


def shard(df: DataFrame, shards: int = 16, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """Adds ``shard`` and ``slot``: row number r goes to place p of a keyed permutation, p modulo the
    shards is its shard, the rest its slot.

    So shards differ by one row at most, slots have no gap, and where a row went can be computed from its
    number and the number of rows alone. ``order`` (all columns by default, nulls first) numbers the rows;
    rows alike in all of them are interchangeable. An empty table gives no rows. Columns named ``shard`` or
    ``slot`` are replaced, all others come through.
    """
    order = order or df.columns
    _row = unused("row", df.columns)
    _to = unused("to", [*df.columns, _row])
    rows = numbered(df.drop("shard", "slot"), [c for c in order if c not in ("shard", "slot")], _row)
    total = rows.agg(F.count("*")).first()[0]

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permuted(numbers.to_numpy(), total, seed))

    place_of = F.pandas_udf(place, T.LongType())
    placed = rows.withColumn(_to, place_of(_row))
    return (
        placed.withColumn("shard", (F.col(_to) % shards).cast("int"))
        .withColumn("slot", F.floor(F.col(_to) / shards).cast("long"))
        .drop(_row, _to)
    )


def document_shards(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """The law ``rows``: doc_id, size in bytes plus 1, CRC-32 of the text, shard and slot of every document.

    Rows are numbered by doc_id, then size and checksums, so any layout of the input gives the same
    shards. Null text counts as empty; null ids come first; repeated rows are told apart by number only.
    """
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    out = shard(rows, shards, seed, ["doc_id", "size", "text_crc32", "_text"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
