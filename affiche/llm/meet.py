"""Which entries meet others with the same key: packed messages between tasks instead of a row for each entry.

A document gives many (key, place) entries, most of which meet nothing. Each task sorts its entries by key
and sends one binary row for each range of keys; the task that holds a range sees which keys met, and sends the
owners only those places. Entries that already met inside a task are not sent on, but for one of each
key, so a key that a third of all documents hold costs one entry a task and not one a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affiche.llm.shared import partitions

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # owners (int64), keys (uint64), places (int64)
#: Entries that a task holds before it sends messages.
FLUSH = 1_500_000
OTHER, ANY, SMALLER = "another owner", "another entry", "a smaller owner"
_MESSAGE = "part int, kind int, payload binary"


def pack(owners: np.ndarray, columns: list[np.ndarray], flags: np.ndarray) -> bytes:
    """Owners, 64-bit columns and flags as compressed bytes.

    Owners are numbered, columns become differences, and both are laid out byte by byte of all
    numbers, so that high bytes, which hardly vary, cost next to nothing.
    """
    n = len(flags)
    different, number = np.unique(owners, return_inverse=True)
    numbered = [different.astype(np.int64).view(np.uint64), number.astype(np.uint64)]
    numbered[0] = np.diff(numbered[0], prepend=np.uint64(0))
    numbered += [np.diff(c.view(np.uint64), prepend=np.uint64(0)) for c in columns]
    planes = [c.view(np.uint8).reshape(len(c), 8).T.tobytes() for c in numbered]
    raw = b"".join([np.array([n, len(different)], np.int64).tobytes(), flags.astype(np.uint8).tobytes(), *planes])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(payload: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The owners and the columns after them, ``width`` in all, and the flags."""
    size = int(np.frombuffer(payload, np.int64, 1)[0])
    raw = pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n, n_owners = np.frombuffer(raw, np.int64, 2).tolist()
    flags = np.frombuffer(raw, np.uint8, n, 16).astype(bool)
    at, out = 16 + n, []
    for length in (n_owners, *[n] * width):
        planes = np.frombuffer(raw, np.uint8, 8 * length, at).reshape(8, length)
        out.append(np.ascontiguousarray(planes.T).view(np.uint64).reshape(length))
        at += 8 * length
    owners = np.cumsum(out[0], dtype=np.uint64)[out[1].astype(np.int64)]
    return [owners, *[np.cumsum(c, dtype=np.uint64) for c in out[2:]]], flags


def unpack_all(payloads: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [unpack(p, width) for p in payloads]
    if not parts:
        return [np.zeros(0, np.uint64)] * width, np.zeros(0, bool)
    return [np.concatenate([p[0][k] for p in parts]) for k in range(width)], np.concatenate([p[1] for p in parts])


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the first place of each run, and the run of each place."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


def met(owners: np.ndarray, keys: np.ndarray, known: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Which of the entries, sorted by key and owner, meet another; and which stand for their run elsewhere.

    ``known`` entries have met another before. Those that stand for their run are all that others need to see.
    """
    start, run = runs(keys)
    if not len(start):
        return np.zeros(0, bool), np.zeros(0, bool)
    least = owners[start]
    if rule == SMALLER:
        return owners > least[run], owners == least[run]
    if rule == ANY:
        many = np.diff(np.append(start, len(keys))) > 1
    else:
        last = owners[np.append(start[1:], len(keys)) - 1]
        many = last != least
    many |= np.logical_or.reduceat(known, start)
    head = np.zeros(len(keys), bool)
    head[start] = True
    return many[run], head | ~many[run]


def ordered(owners: np.ndarray, keys: np.ndarray, places: np.ndarray, rule: str, known: np.ndarray | None = None):
    known = np.zeros(len(keys), bool) if known is None else known
    order = np.lexsort((places, owners, keys))
    owners, keys, places, known = owners[order], keys[order], places[order], known[order]
    if rule == OTHER and len(keys):  # the same place of the same owner again says nothing new
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1]) | (places[1:] != places[:-1]) | known[1:]
        owners, keys, places, known = owners[new], keys[new], places[new], known[new]
    return owners, keys, places, known


def meet(df: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[Entries]], rule: str) -> DataFrame:
    """owner, places (sorted 64-bit numbers, packed) and keys (of those places) of the entries that meet another.

    ``rule`` says whom an entry has to meet: ``OTHER`` an entry of the same key and another owner, ``ANY`` any
    entry of the same key, ``SMALLER`` one of a smaller owner. Keys are told apart by their 64 bits. Owners
    without such entries have no row.
    """
    parts = partitions(df.sparkSession)

    def send(owners: np.ndarray, keys: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        owners, keys, places, known = ordered(owners, keys, places, rule)
        here, stands = met(owners, keys, known, rule)
        rows: list[tuple[int, int, bytes]] = []
        if here.any():  # they are told at once, by way of any part
            rows.append((int(keys[here][0] % np.uint64(parts)), 1, pack(owners[here], [places[here], keys[here]], here[here])))
        at = np.flatnonzero(stands)
        part = ((keys[at] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            own = at[cuts[p] : cuts[p + 1]]
            if len(own):
                rows.append((p, 0, pack(owners[own], [keys[own], places[own]], here[own])))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "payload"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        count = 0
        for batch in batches:
            for found in entries(batch):
                held.append(found)
                count += len(found[1])
                if count >= FLUSH:
                    yield from send(*[np.concatenate([h[k] for h in held]) for k in range(3)])
                    held, count = [], 0
        if count:
            yield from send(*[np.concatenate([h[k] for h in held]) for k in range(3)])

    def tell(table: pa.Table) -> pa.Table:
        kinds, payloads = table["kind"].to_pylist(), table["payload"].to_pylist()
        (owners, keys, places), known = unpack_all([p for p, k in zip(payloads, kinds, strict=True) if k == 0], 3)
        owners, keys, places, known = ordered(owners.view(np.int64), keys, places.view(np.int64), rule, known)
        here, _ = met(owners, keys, known, rule)
        here &= ~known if rule != SMALLER else True
        (o, p, ks), _ = unpack_all([p for p, k in zip(payloads, kinds, strict=True) if k == 1], 3)
        owners = np.concatenate([owners[here], o.view(np.int64)])
        places, keys = np.concatenate([places[here], p.view(np.int64)]), np.concatenate([keys[here], ks])
        to = (owners.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
        order = np.lexsort((places, owners, to))
        cuts = np.searchsorted(to[order], np.arange(parts + 1))
        rows = []
        for q in range(parts):
            own = order[cuts[q] : cuts[q + 1]]
            if len(own):
                rows.append((q, pack(owners[own], [places[own], keys[own]], np.zeros(len(own)))))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        (owners, places, keys), _ = unpack_all(table["payload"].to_pylist(), 3)
        owners, places = owners.view(np.int64), places.view(np.int64)
        order = np.lexsort((keys, places, owners))
        owners, places, keys = owners[order], places[order], keys[order]
        new = np.ones(len(owners), bool)  # rows that repeat an owner may tell of one place twice
        new[1:] = (owners[1:] != owners[:-1]) | (places[1:] != places[:-1]) | (keys[1:] != keys[:-1])
        owners, places, keys = owners[new], places[new], keys[new]
        start, _ = runs(owners)
        ends = np.append(start[1:], len(owners))
        return pa.table(
            {
                "owner": pa.array(owners[start], pa.int64()),
                "places": pa.array([places[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()),
                "keys": pa.array([keys[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()),
            }
        )

    asked = df.mapInArrow(ask, _MESSAGE)
    told = asked.groupBy("part").applyInArrow(tell, "part int, payload binary")
    return told.groupBy("part").applyInArrow(gather, "owner long, places binary, keys binary")


def numbers(column: bytes | None) -> np.ndarray:
    """Packed places as an array."""
    return np.frombuffer(column or b"", np.int64)


def with_owner(docs: DataFrame, *columns: str) -> DataFrame:
    """The owner of entries (doc_id as long) and the text; documents without an id own none."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *columns)
