"""Packing token sequences: minimum bin slack over the counts of each length."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affiche.llm.shared import partitions, settled, unused
from affiche.llm.text import Words, chunks, ranges, utf8

#: Bytes of text tokenized at once; a longer document is worked on alone.
TEXT = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], room: int, lengths: list[int]) -> list[int]:
    """The combination of available lengths that fills ``room`` best.

    ``reach`` is a bit set of reachable sums; one layer is added for each length (longest first) and power of
    two of copies, until the room can be filled exactly. Going back over the layers gives the combination.
    """
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            layers.append((length, copies, reach))
            reach = (reach | (reach << (length * copies))) & mask
            left -= copies
            copies *= 2
            if reach >> room & 1:
                left = 0
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, copies, before in reversed(layers):
        if not before >> total & 1:
            out += [length] * copies
            total -= length * copies
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in a bin, how many such bins), by minimum bin slack.

    Each bin takes the longest length left and then the fullest combination of the rest; what it holds is
    removed. A combination is used as often as the counts allow, so the work depends on the number of
    different lengths (at most the capacity), not on the number of pieces.
    """
    counts = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        chosen = [seed, *fullest(counts, capacity - seed, [x for x in lengths if counts[x]])]
        counts[seed] += 1
        need: dict[int, int] = {}
        for x in chosen:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
        lengths = [x for x in lengths if counts[x]]
        out.append((chosen, times))
    return out


def placement(bins: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its runs (first number, first bin, bins, offset), by number of the piece of that length."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((used.get(x, 0), first_bin, times, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        first_bin += times
    return out


def pack(pieces: DataFrame, capacity: int = 2048, order: list[str] | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Only the counts per length come to the driver, at most ``capacity`` of them. Pieces of one length are
    numbered in salted groups of ``order`` columns (a length may be that of a third of all rows): the groups
    of a length start where the earlier ones end. Numbers then go to bins by ``placement``, which is sent
    along with the tasks; its size is bounded by the capacity. Rows alike in all columns are
    interchangeable. No row gives no row; other lengths raise an error.
    """
    spark = pieces.sparkSession
    order = order or [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.drop("sequence_id", "offset")
    _salt, _n, _before, _number, _to = (unused(c, rows.columns) for c in ("salt", "n", "before", "number", "to"))
    salts = 4 * partitions(spark)
    salted = settled(rows.withColumn(_salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")), "pieces")
    cells = settled(salted.groupBy("length", _salt).agg(F.count("*").alias(_n)), "cells")
    histogram = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum(_n)).collect()}
    if any(x is None or not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs = placement(patterns(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy(_salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn(_before, F.coalesce(F.sum(_n).over(earlier), F.lit(0))).drop(_n)
    own = Window.partitionBy("length", _salt).orderBy(*order)
    numbered = salted.join(starts, ["length", _salt]).withColumn(_number, F.row_number().over(own) - 1 + F.col(_before))
    sent = spark.sparkContext.broadcast({x: (np.array([r[0] for r in rs]), np.array(rs)) for x, rs in runs.items()})

    @F.pandas_udf("struct<sequence_id:long, offset:long>")
    def place(length, number):
        import pandas as pd

        out = np.zeros((len(length), 2), np.int64)
        lengths, numbers = length.to_numpy(), number.to_numpy()
        by_length = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[by_length])) + 1
        for at in np.split(by_length, cuts):
            if len(at):
                firsts, table = sent.value[int(lengths[at[0]])]
                run = table[np.searchsorted(firsts, numbers[at], "right") - 1]
                out[at, 0] = run[:, 1] + numbers[at] - run[:, 0]
                out[at, 1] = run[:, 3]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    placed = numbered.withColumn(_to, place(F.col("length").cast("long"), F.col(_number).cast("long")))
    return placed.select(*rows.columns, F.col(f"{_to}.sequence_id").alias("sequence_id"), F.col(f"{_to}.offset").alias("offset"))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass(frozen=True)
class Known:
    """Words by their hashes, in order, and the ids of each."""

    hashes: np.ndarray
    starts: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Known:
        """From words in any order and their ids end to end."""
        starts, order = np.cumsum(counts) - counts, np.argsort(hashes)
        own = counts[order]
        return Known(hashes[order], np.concatenate([[0], np.cumsum(own)]).astype(np.int64), ids[ranges(starts[order], own)])

    def with_(self, other: Known) -> Known:
        counts = np.concatenate([np.diff(self.starts), np.diff(other.starts)])
        return Known.of(np.concatenate([self.hashes, other.hashes]), counts, np.concatenate([self.ids, other.ids]))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the hashes would be, and whether it is there."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)


NONE_KNOWN = Known(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32))


class WordTokens:
    """Token ids of whole texts, each different word of a task tokenized once.

    The tokenizer drops white space and never joins across it, and lower-cases, so a text's ids are
    those of its words one after the other. Words are told apart by 64-bit hashes of their lower-cased bytes.
    Special tokens are found before that, in their exact spelling and also inside a word: a text with one
    is tokenized whole. New words join a short list first, which joins the long one when it is half as long.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        self.path, self.most = path, most
        self.special = [t.content.encode() for t in _tokenizer(path).get_added_tokens_decoder().values()]
        self.long = self.short = NONE_KNOWN

    def learn(self, raw: bytes, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Tokenize the different words of a text that are not yet known; a full memory is given up and begins anew."""
        new = ~(self.long.places(hashes)[1] | self.short.places(hashes)[1])
        if new.sum() + len(self.long.hashes) + len(self.short.hashes) > self.most:
            self.long = self.short = NONE_KNOWN
            new[:] = True
        if not new.any():
            return
        spelled = [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
        ids, counts = [], []
        for low in range(0, len(spelled), 5_000):
            part = spelled[low : low + 5_000]
            got = _tokenizer(self.path).encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        self.short = self.short.with_(Known.of(hashes[new], np.concatenate(counts), np.concatenate(ids)))
        if 2 * len(self.short.hashes) > len(self.long.hashes):
            self.long, self.short = self.long.with_(self.short), NONE_KNOWN

    def with_special(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """The documents in which a special token stands."""
        found = set()
        for spelling in self.special:
            at = raw.find(spelling)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(spelling) <= offsets[doc + 1]
                if inside:
                    found.add(doc)
                at = raw.find(spelling, int(offsets[doc + 1]) if inside else at + 1)
        return sorted(found)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, end to end, and the offsets between them."""
        raw = data.tobytes()
        whole = self.with_special(raw, offsets)
        if not whole:
            return self.by_words(data, offsets)
        data = data.copy()
        own = []
        for k in whole:
            text = raw[offsets[k] : offsets[k + 1]].decode()
            own.append(np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, np.uint32))
            data[offsets[k] : offsets[k + 1]] = ord(" ")
        ids, at = self.by_words(data, offsets)
        sizes = np.zeros(len(offsets), np.int64)
        sizes[np.array(whole) + 1] = [len(x) for x in own]
        ids = np.insert(ids, np.repeat(at[whole], sizes[np.array(whole) + 1]), np.concatenate(own))
        return ids, at + np.cumsum(sizes)

    def by_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for documents without special tokens."""
        words = Words(data, offsets, lower=True)
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        different, first, word = np.unique(words.hash, return_index=True, return_inverse=True)
        self.learn(data.tobytes(), different, words.start[first], words.end[first])
        at, here = self.long.places(different)
        starts = np.zeros(len(different), np.int64)
        counts = np.zeros(len(different), np.int64)
        starts[here], counts[here] = self.long.starts[at[here]], np.diff(self.long.starts)[at[here]]
        at, there = self.short.places(different)
        starts[there] = len(self.long.ids) + self.short.starts[at[there]]
        counts[there] = np.diff(self.short.starts)[at[there]]
        own = counts[word]
        per_doc = np.bincount(words.doc, weights=own, minlength=len(offsets) - 1).astype(np.int64)
        ids = np.concatenate([self.long.ids, self.short.ids])[ranges(starts[word], own)]
        return ids, np.concatenate([[0], np.cumsum(per_doc)])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """The token pieces of every document: its ids and then ``end``, cut only where longer than ``capacity``.

    Null or empty text is the one id ``end``. Null ids are kept as they are. The tokenizer file is read by
    each task from ``tokenizer_path``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordTokens(tokenizer_path)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for low, high in chunks(offsets, TEXT):
                base = offsets[low]
                ids, at = memory.encode(data[base : offsets[high]], offsets[low : high + 1] - base)
                out: list[tuple] = []
                for k, doc in enumerate(batch["doc_id"].slice(low, high - low).to_pylist()):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        out.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with the sequence that it is in and its offset there.

    Sequences hold at most ``capacity`` tokens, their pieces lie gapless from 0. Repeated documents give
    repeated pieces, each with a place of its own.
    """
    return pack(pieces(docs, tokenizer_path, capacity), capacity, ["doc_id", "piece", "ids_crc32"])


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing needs fewer bins: the tokens over the capacity, and the pieces that no two of share a bin."""
    total = -(-sum(k * n for k, n in histogram.items()) // capacity)
    lengths = sorted(histogram)
    big = sum(histogram[x] for x in lengths[bisect_right(lengths, capacity // 2) :])
    return max(total, big)
