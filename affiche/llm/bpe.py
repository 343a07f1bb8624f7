"""Byte-level BPE: the words of a task are merged together, in rank order, and documents are put back from them."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affiche.llm.text import ranges

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Ranks:
    """A rank file: the bytes of each token, and which pairs of tokens merge into which token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.n = max(self.of.values()) + 1
        token = [b""] * self.n
        for spelled, rank in self.of.items():
            token[rank] = spelled
        self.lengths = np.array([len(t) for t in token], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.single = np.array([self.of[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (self.of[t[:k]] * self.n + self.of[t[k:]], rank)
            for t, rank in self.of.items()
            for k in range(1, len(t))
            if t[:k] in self.of and t[k:] in self.of
        ]
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.merged = np.array([m for _, m in pairs] + [-1], np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, or -1."""
        pair = left * self.n + right
        at = np.searchsorted(self.pair, pair)
        return np.where(self.pair[at] == pair, self.merged[at], -1)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, end to end."""
        return self.bytes[ranges(self.starts[ids], self.lengths[ids])]


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=2)
def _split(pattern: str):
    import regex

    return regex.compile(pattern).findall


def merge_one(spelled: bytes, known: Ranks) -> list[int]:
    """The ids of one word, one merge at a time: always the lowest rank, of equals the first."""
    parts = [spelled[k : k + 1] for k in range(len(spelled))]
    while len(parts) > 1:
        rank, at = min((known.of.get(parts[k] + parts[k + 1], known.n), k) for k in range(len(parts) - 1))
        if rank == known.n:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [known.of[p] for p in parts]


def merge_all(words: list[bytes], known: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, end to end, and the offsets between them.

    The words lie in one array of symbols. An index from each pair that can merge (by the rank of the merged
    token) to the places where it stands is kept; ranks are taken in order, each merge is applied at all
    its places, and only pairs with the neighbours it touched are looked up again. A pair that appears with a
    rank already passed would have to be merged at once; words where that happens are merged one by one instead.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    token = known.single[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(lengths[lengths > 0])
    after[ends - 1] = -1
    before[np.concatenate([[0], ends[:-1]])] = -1
    rank_at = np.full(n, -1, np.int64)
    paired = np.flatnonzero(after >= 0)
    rank_at[paired] = known.merge_of(token[paired], token[paired + 1])
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []
    odd = np.zeros(len(words), bool)

    def add(places: np.ndarray) -> None:
        found = rank_at[places]
        places, found = places[found >= 0], found[found >= 0]
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(found)], strict=True):
            if high > low:
                rank = int(found[low])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append(places[low:high])

    add(paired)
    while queue:
        rank = heapq.heappop(queue)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank_at[at] == rank]
        if not len(at):
            continue
        at.sort()
        chained = after[at[:-1]] == at[1:]
        if chained.any():  # the same merge again at its right half: the left one goes first
            free, last = [], -1
            for place, right in zip(at.tolist(), after[at].tolist(), strict=True):
                if place != last:
                    free.append(place)
                    last = right
            at = np.array(free)
        right = after[at]
        token[at] = rank
        token[right] = -1
        rank_at[right] = -1
        after[at] = after[right]
        follows = after[at] >= 0
        before[after[at][follows]] = at[follows]
        touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        rank_at[touched] = -1
        touched = touched[after[touched] >= 0]
        rank_at[touched] = known.merge_of(token[touched], token[after[touched]])
        early = touched[(rank_at[touched] >= 0) & (rank_at[touched] <= rank)]
        if len(early):
            odd[word[early]] = True
            rank_at[early] = -1
            touched = np.setdiff1d(touched, early, assume_unique=True)
        add(touched)
    kept = token >= 0
    ids, counts = token[kept], np.bincount(word[kept], minlength=len(words))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if odd.any():
        each = [ids[offsets[k] : offsets[k + 1]] for k in range(len(words))]
        for k in np.flatnonzero(odd):
            each[k] = np.array(merge_one(words[k], known), np.int64)
        ids = np.concatenate(each)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])])
    return ids, offsets


class Encoder:
    """Ids of whole texts; every different word of a task is merged once, as long as the memory holds it."""

    def __init__(self, path: str, pattern: str, most: int = 600_000):
        self.known, self.split, self.most = ranks(path), _split(pattern), most
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the offsets between them."""
        if len(self.number) > self.most:
            self.forget()
        words = [self.split(t) for t in texts]
        number, first_new = self.number, len(self.number)
        places = [[number.setdefault(w, len(number)) for w in ws] for ws in words]
        new = list(number)[first_new:] if first_new < len(number) else []
        if new:
            ids, offsets = merge_all([w.encode() for w in new], self.known)
            self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
            self.ids = np.concatenate([self.ids, ids])
        counts = np.diff(self.offsets)
        flat = np.array([p for ps in places for p in ps], np.int64)
        sizes = np.array([len(p) for p in places], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        per_text = np.bincount(owner, weights=counts[flat], minlength=len(texts)).astype(np.int64)
        return self.ids[ranges(self.offsets[flat], counts[flat])], np.concatenate([[0], np.cumsum(per_text)])


def encoded(docs: DataFrame, rank_path: str, pattern: str, chars: int = 8 << 20) -> DataFrame:
    """Every document with its ids (an array) and the bytes they decode to.

    Null text is empty and has no ids. Texts are worked on whole, about ``chars`` characters at a time, so a
    task's memory does not grow with its rows; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(rank_path, pattern)
        for doc_ids, ids, offsets in _encoded_parts(batches, encoder, chars):
            parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())),
                    pa.array([encoder.known.spelled(p).tobytes() for p in parts], pa.binary()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, rank_path: str, pattern: str, chars: int = 8 << 20) -> DataFrame:
    """The number of ids of every document, and SHA-256 of its ids (little-endian, 32 bits) and of its decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(rank_path, pattern)
        for doc_ids, ids, offsets in _encoded_parts(batches, encoder, chars):
            raw, spelled = ids.astype("<u4"), encoder.known.spelled(ids)
            ends = np.concatenate([[0], np.cumsum(encoder.known.lengths[ids])])[offsets]
            yield pa.record_batch(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]),
                    pa.array([hashlib.sha256(spelled[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _keyed(docs).mapInArrow(run, ENCODED)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _encoded_parts(batches: Iterator[pa.RecordBatch], encoder: Encoder, chars: int):
    for batch in batches:
        doc_ids = batch["doc_id"].to_pylist()
        low = 0
        while low < len(doc_ids):
            texts, held, high = [], 0, low
            while high < len(doc_ids) and (high == low or held < chars):
                texts.append(batch["text"][high].as_py() or "")
                held += len(texts[-1])
                high += 1
            ids, offsets = encoder.encode(texts)
            yield doc_ids[low:high], ids, offsets
            low = high
