"""Importance resampling towards a target text: gains of hashed n-grams, Gumbel noise, the highest scores.

N-grams are interned batch by batch in an open-addressed NumPy table: xxhash64 keys find the slot, the bytes
verify it. A slot holds the n-gram's bucket and count; the slot ids of the occurrences gather the gains.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affiche.llm.shared import settled
from affiche.llm.text import chunks, ranges, utf8

#: Bytes of text interned at once; a longer document is worked on alone.
BATCH = 2 << 20
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The five primes of xxHash64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of many pieces of ``data``: pieces of one length under 32 bytes at once, longer ones singly."""
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(length, kind="stable")
    lengths, first = np.unique(length[order], return_index=True)
    for size, low, high in zip(lengths.tolist(), first, np.append(first, len(order))[1:], strict=True):
        at = order[low:high]
        if size >= 32:
            out[at] = [xxhash.xxh64_intdigest(data[a : a + size].tobytes()) for a in start[at].tolist()]
            continue
        piece = np.ascontiguousarray(data[start[at][:, None] + np.arange(size)])
        h = np.full(len(at), _P5 + np.uint64(size), np.uint64)
        done = 0
        while done + 8 <= size:
            lane = np.ascontiguousarray(piece[:, done : done + 8]).view("<u8").ravel()
            h ^= _turned(lane * _P2, 31) * _P1
            h = _turned(h, 27) * _P1 + _P4
            done += 8
        if done + 4 <= size:
            lane = np.ascontiguousarray(piece[:, done : done + 4]).view("<u4").ravel().astype(np.uint64)
            h ^= lane * _P1
            h = _turned(h, 23) * _P2 + _P3
            done += 4
        for k in range(done, size):
            h ^= piece[:, k].astype(np.uint64) * _P5
            h = _turned(h, 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[at] = h ^ (h >> np.uint64(32))
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the pieces of ``data`` (none empty) that begin at a and at b are equal."""
    if not len(a):
        return np.zeros(0, bool)
    differ = data[ranges(a, length)] != data[ranges(b, length)]
    ends = np.cumsum(length)
    return ~np.logical_or.reduceat(differ, ends - length)


class Grams:
    """The n-grams of some texts: where each occurrence lies in the texts' words, which one blank parts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, longest: int):
        lower = _LOWER[data]
        inside = _WORD[lower]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        size = end - start
        place = np.cumsum(size + 1) - (size + 1)  # where each word begins once one blank follows each
        self.data = np.full(int((size + 1).sum()), ord(" "), np.uint8)
        self.data[ranges(place, size)] = lower[inside]
        doc = np.searchsorted(offsets, start, "right") - 1
        self.n_docs = len(offsets) - 1
        self.words = np.bincount(doc, minlength=self.n_docs)
        starts, lengths, docs = [], [], []
        for n in range(1, longest + 1):
            m = max(0, len(start) - n + 1)
            at = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
            starts.append(place[at])
            lengths.append(place[at + n - 1] + size[at + n - 1] - place[at])
            docs.append(doc[at])
        self.start, self.length, self.doc = (np.concatenate(x).astype(np.int64) for x in (starts, lengths, docs))


class Interned:
    """An open-addressed table of the different n-grams: a slot for each, and the slot of each occurrence.

    All occurrences probe together: those whose slot is empty write themselves in (one of them stays), then
    those that equal the n-gram in their slot, by key and by bytes, are done and the others try the next slot.
    """

    def __init__(self, grams: Grams, buckets: int):
        m = len(grams.start)
        size = 1 << max(4, int(2 * m).bit_length())  # at most half full, so every probe ends
        mask = np.uint64(size - 1)
        keys = xxhash64(grams.data, grams.start, grams.length)
        holder = np.full(size, -1, np.int64)  # the occurrence that stands for the slot's n-gram
        self.slot = np.zeros(m, np.int64)
        left, probe = np.arange(m), (keys & mask).astype(np.int64)
        while len(left):
            empty = holder[probe] < 0
            holder[probe[empty]] = left[empty]
            owner = holder[probe]
            same = (keys[owner] == keys[left]) & (grams.length[owner] == grams.length[left])
            same[same] = same_bytes(grams.data, grams.start[owner[same]], grams.start[left[same]], grams.length[left[same]])
            self.slot[left[same]] = probe[same]
            left, probe = left[~same], (probe[~same] + 1) & (size - 1)
        used = np.flatnonzero(holder >= 0)
        self.bucket = np.zeros(size, np.int64)
        raw = grams.data.tobytes()
        at = grams.start[holder[used]]
        ends = at + grams.length[holder[used]]
        self.bucket[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        self.count = np.bincount(self.slot, minlength=size)


def interned(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, int, Grams, Interned]]:
    """Rows low to high of the texts, their n-grams and their table, a few megabytes of text at a time."""
    data, offsets = utf8(texts)
    for low, high in chunks(offsets, BATCH):
        grams = Grams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], longest)
        yield low, high, grams, Interned(grams, buckets)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many n-grams of all texts (column ``text``) each bucket holds; as many numbers as buckets reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, table in interned(batch["text"], longest, buckets):
                np.add.at(total, table.bucket, table.count)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the thousandfold logarithm, rounded down, of its smoothed share of the target over the source's."""
    buckets, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000.0 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets))))
            for a, b in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)
        ],
        np.int64,
    )


def noise(doc_id: int | None, seed: str) -> int:
    """Gumbel noise of a document, in thousandths rounded down: SHA-256 of seed and id decides. No id: empty."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight (mean gain, rounded down) and score (weight plus noise) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for low, high, grams, table in interned(batch["text"], longest, len(known)):
                own = known[table.bucket][table.slot]
                total = np.zeros(grams.n_docs, np.int64)
                np.add.at(total, grams.doc, own)
                n = np.bincount(grams.doc, minlength=grams.n_docs)
                weight = total // np.maximum(n, 1)
                ids = batch["doc_id"].slice(low, high - low)
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.record_batch(
                    [ids, *(pa.array(c.astype(np.int64)) for c in (grams.words, n, weight, score))],
                    names=["doc_id", "n_words", "n_features", "weight", "score"],
                )

    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    seed: str = "2024",
    least_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rows that are not drawn have no rank.

    Words are runs of 0-9, a-z and anything beyond ASCII after A-Z are lower-cased; features are all runs of 1 to
    ``longest`` words with one blank between, in ``buckets`` by CRC-32. Of the rows with at least ``least_words`` words,
    ``percent`` in a hundred (rounded down) with the highest scores are drawn; ties go to the smaller doc_id, rows
    without an id come last, rows that repeat an id by their other values. Null and empty texts have weight 0.
    An empty target leaves the source's own frequencies to decide. Other columns are left out.

    The driver sees one count for each bucket and one for each different score. A gain lies between -44,000
    and 44,000 for any 64-bit counts and the noise between -3,200 and 23,000, so that is never over 115,000 numbers.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = settled(scored(docs, gain, longest, seed), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    counts = sorted(((r[0], r[1]) for r in able.groupBy("score").agg(F.count("*")).collect()), reverse=True)
    left = percent * sum(n for _, n in counts) // 100
    cut, before, above = None, 0, []
    for score, n in counts:
        if before >= left:
            break
        above.append((score, before))
        cut, before = score, before + n
    columns = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    starts = rows.sparkSession.createDataFrame(above, "score long, before long")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "n_words")
    number = F.row_number().over(order) + F.col("before")
    ranked = rows.where(drawn).join(F.broadcast(starts), "score").withColumn("rank", number.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= left, F.col("rank")))
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns, "rank").unionAll(rest.select(*columns, "rank"))
