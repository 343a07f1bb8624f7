"""Language ID by string kernels: n-gram presence, landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affiche.llm.shared import settled, unused
from affiche.llm.text import chunks, utf8

#: Lengths of the n-grams, in bytes of the lower-cased UTF-8 text.
SPECTRUM = (1, 2, 3)
UNKNOWN = "und"
#: Where the numbers of the n-grams of each length begin, and where they end.
_FIRST = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}


def gram_codes(text: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one text, each as a number: its bytes, after the numbers of shorter ones."""
    seen = []
    code = np.zeros(len(text), np.int32)
    for n in SPECTRUM:
        if len(text) < n:
            break
        code = (code[: len(text) - n + 1] << 8) | text[n - 1 :]
        if n < 3:
            mark = np.zeros(1 << (8 * n), bool)
            mark[code] = True
            seen.append(np.flatnonzero(mark) + _FIRST[n])
        else:
            seen.append(np.unique(code).astype(np.int64) + _FIRST[n])
    return np.concatenate(seen) if seen else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Landmarks:
    """Texts that stand for all others, as a presence matrix over the n-grams they hold."""

    codes: np.ndarray  # sorted n-grams
    presence: np.ndarray  # n-grams x landmarks
    sizes: np.ndarray  # distinct n-grams of each landmark

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Normalised blended-spectrum presence kernel of texts (given by their n-grams) to the landmarks."""
        out = np.zeros((len(grams), self.presence.shape[1]), np.float32)
        for low in range(0, len(grams), 64):
            batch = grams[low : low + 64]
            flags = np.zeros((len(batch), len(self.codes)), np.float32)
            for row, codes in enumerate(batch):
                at = np.searchsorted(self.codes, codes)
                at[at == len(self.codes)] = 0
                flags[row, at[self.codes[at] == codes]] = 1.0
            out[low : low + len(batch)] = flags @ self.presence
        sizes = np.array([max(1, len(g)) for g in grams], np.float64)
        return out / np.sqrt(sizes[:, None] * np.maximum(self.sizes, 1)[None, :])


@dataclass(frozen=True)
class LanguageModel:
    """Landmarks, the languages, and the weight of each landmark for each language."""

    landmarks: Landmarks
    languages: list[str]
    weights: np.ndarray  # landmarks + 1 (bias) x languages

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """For each text a share from 0 to 1 for each language."""
        if not self.languages:
            return np.zeros((len(grams), 0))
        kernel = self.landmarks.kernel(grams)
        raw = kernel @ self.weights[:-1] + self.weights[-1]
        e = np.exp(4.0 * (raw - raw.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def texts_grams(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(texts)
    lower = data.copy()
    lower[(lower >= 65) & (lower <= 90)] += 32
    return [gram_codes(lower[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def chosen(docs: DataFrame, rows: int) -> DataFrame:
    """lang, text and rank of at most ``rows`` rows of each language, the first by a hash of the id.

    Hashes are spread evenly, so of n documents the share (2 * rows + 200) / n with the smallest hashes holds
    ``rows`` documents but for a chance far below that of a hardware fault. The sizes of the languages are written first, so
    the join with them needs no shuffle and only that share is shuffled and ranked: a language that holds a
    third of all rows brings no more rows together than a rare one. Rows that repeat an id are told apart by
    their texts, and of each task no more than ``rows`` rows a language are sent.
    """
    order = Window.partitionBy("lang").orderBy("hash", "doc_id", "text_hash")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = settled(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    known = labelled.select(
        "doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("hash"), F.xxhash64("text").alias("text_hash")
    )
    return (
        known.join(sizes, "lang")
        .where(F.col("hash").cast("double") * F.col("n") < F.lit(float(1 << 40) * (2 * rows + 200)))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rows)
        .select("lang", "text", "rank", "hash", "text_hash")
    )


def fit(docs: DataFrame, landmarks: int = 32, rows: int = 500, ridge: float = 1e-3) -> LanguageModel:
    """Learns from ``text`` and ``lang`` of the given documents.

    At most ``rows`` documents of each language are learned from, the first by a hash of their id, and the
    first ``landmarks`` of those are its landmarks; the bound is per language, so rare languages keep theirs.
    Nystroem features are the kernel to the landmarks times the inverse root of the landmarks' own kernel;
    one-versus-rest ridge regression on them is solved on the driver, whose size is that of the landmarks.
    Executors work out the n-grams and the kernel rows. Without labelled text the model knows no language; rows
    without a label, a text or an id are not learned from, and of rows that repeat an id each counts.
    """
    picked = settled(chosen(docs, rows), "language-sample")

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = texts_grams(batch["text"])
            yield pa.record_batch({"lang": batch["lang"], "grams": pa.array([g.astype(np.int32).tobytes() for g in grams], pa.binary())})

    own = picked.where(F.col("rank") <= landmarks).orderBy("lang", "rank").select("lang", "text")
    held = [np.frombuffer(r["grams"], np.int32).astype(np.int64) for r in own.mapInArrow(grams_of, "lang string, grams binary").collect()]
    if not held:
        return LanguageModel(Landmarks(np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0)), [], np.zeros((1, 0)))
    codes = np.unique(np.concatenate(held))
    presence = np.zeros((len(codes), len(held)), np.float32)
    for k, grams in enumerate(held):
        presence[np.searchsorted(codes, grams), k] = 1.0
    marks = Landmarks(codes, presence, np.array([len(g) for g in held], np.float64))
    values, vectors = np.linalg.eigh(marks.kernel(held).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    sent = docs.sparkSession.sparkContext.broadcast(marks)  # landmarks x languages in number

    def kernel_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sent.value.kernel(texts_grams(batch["text"])).astype(np.float32)
            yield pa.record_batch({"lang": batch["lang"], "row": pa.array([r.tobytes() for r in rows], pa.binary())})

    known = picked.select("lang", "text").mapInArrow(kernel_of, "lang string, row binary").collect()
    languages = sorted({r["lang"] for r in known})
    x = np.stack([np.frombuffer(r["row"], np.float32) for r in known]).astype(np.float64) @ root
    y = np.where(np.array([r["lang"] for r in known])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = np.array([1.0 / sum(r["lang"] == name for r in known) for name in languages])
    weight = np.sqrt(np.array([weight[languages.index(r["lang"])] for r in known]))[:, None]
    x = np.hstack([x, np.ones((len(x), 1))])
    a = (x * weight).T @ (x * weight) + ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-9])
    beta = np.linalg.solve(a, (x * weight).T @ (y * weight))
    return LanguageModel(marks, languages, np.vstack([root @ beta[:-1], beta[-1:]]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` from the whole ``text`` alone; columns of these names are replaced.

    Null text, text without a letter, and every text if no language was learned, get ``und`` and 0. Every row is
    judged for itself, rows that repeat an id too, and keeps its other columns. Of equal scores the first language by name wins.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letter = unused("letter", rest)
    marked = docs.select(*rest, F.coalesce(has_letter("text"), F.lit(False)).alias(letter))
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        names = [*known.languages, UNKNOWN]
        for batch in batches:
            _, offsets = utf8(batch["text"])
            for low, high in chunks(offsets, 4 << 20):
                part = batch.slice(low, high - low)
                scores = known.scores(texts_grams(part["text"]))
                lettered = part[letter].to_numpy(zero_copy_only=False) & (len(known.languages) > 0)
                if len(known.languages):
                    best, score = scores.argmax(axis=1), scores.max(axis=1)
                else:
                    best, score = np.zeros(len(lettered), int), np.zeros(len(lettered))
                best = np.where(lettered, best, len(names) - 1)
                yield pa.record_batch(
                    [
                        *[part[c] for c in rest],
                        pa.array([names[k] for k in best], pa.string()),
                        pa.array(np.where(lettered, score, 0.0), pa.float64()),
                    ],
                    names=[*rest, "lang_pred", "score"],
                )

    return marked.mapInArrow(run, schema)


def has_letter(column: str) -> Column:
    return F.col(column).rlike(r"\p{L}")


def held_out() -> Column:
    """Documents that are never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
