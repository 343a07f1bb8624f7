"""Long repeated byte strings: winnowed fingerprints bring passages together, run-length indexes mark them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affiche.llm.meet import ANY, Entries, meet, numbers
from affiche.llm.shared import partitions, settled
from affiche.llm.text import VALUES, chunks, covered, mix, powers, utf8

#: Bytes of a string that must not start twice, and of a fingerprint inside it.
LENGTH = 400
GRAM = 64
#: UTF-8 has no such byte, so it can stand between texts.
BETWEEN = 0xFF
#: Bytes that one run-length index is built over, about.
INDEXED = 1 << 20


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all strings of n bytes."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[data] * up, dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * down[: len(data) - n + 1])


def slid(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of the given width."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def winnowed(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of fingerprints: the least in some window of the fingerprints of ``LENGTH`` bytes.

    Which places of a window are chosen depends on its bytes alone, so equal strings of ``LENGTH`` bytes have
    an equal fingerprint at the same place.
    """
    width = LENGTH - GRAM + 1
    hashes = rolling(text, GRAM)
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = slid(hashes, width)
    # A place is chosen if its hash is the least of a window over it: the greatest least around it tells.
    around = ~slid(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
    at = np.flatnonzero(hashes == around)
    return at, hashes[at]


def fingerprints(batch: pa.RecordBatch) -> Iterator[Entries]:
    data, offsets = utf8(batch["text"])
    for owner, a, b in zip(batch["doc_id"].to_pylist(), offsets[:-1], offsets[1:], strict=True):
        at, hashes = winnowed(data[a:b])
        if len(at):
            yield np.full(len(at), owner, np.int64), hashes, at


def contexts(rows: DataFrame, left_out: np.ndarray) -> DataFrame:
    """key, doc_id, start and bytes of what surrounds each fingerprint that met another.

    Of one fingerprint and document, surroundings that overlap are one, so no byte of a document is twice
    under one fingerprint.
    """
    sent = rows.sparkSession.sparkContext.broadcast(left_out)
    side = LENGTH - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(text_of(batch))
            out: list[tuple[int, int, int, bytes]] = []
            held = 0
            for row, owner in enumerate(batch["owner"].to_pylist()):
                text = data[offsets[row] : offsets[row + 1]]
                keys, at = numbers(batch["keys"][row].as_py()), numbers(batch["places"][row].as_py())
                kept = ~np.isin(keys, sent.value) & (at + GRAM <= len(text))
                keys, at = keys[kept], at[kept]
                if not len(at):
                    continue
                order = np.lexsort((at, keys))
                keys, at = keys[order], at[order]
                low, high = np.maximum(at - side, 0), np.minimum(at + LENGTH, len(text))
                first = np.ones(len(at), bool)
                first[1:] = (keys[1:] != keys[:-1]) | (low[1:] > high[:-1])
                starts = np.flatnonzero(first)
                ends = np.append(starts[1:], len(at)) - 1
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    if high[b] - low[a] >= LENGTH:
                        out.append((int(keys[a]), owner, int(low[a]), text[low[a] : high[b]].tobytes()))
                        held += len(out[-1][3])
                if held > 8 << 20:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
            names=["key", "doc_id", "start", "bytes"],
        )

    return rows.mapInArrow(run, "key long, doc_id long, start long, bytes binary")


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of some texts, sampled at the ends of its runs.

    ``heads`` and ``tails`` are the first and last suffix of each run of equal letters before suffixes;
    with each is kept how far it agrees with the suffix sorted before (after) it. Suffixes inside a run need
    no sample: stepping one letter on in a text shortens the agreement by one.
    """

    def __init__(self, texts: np.ndarray, group: np.ndarray):
        n = len(texts)
        order = suffix_order(texts, group)
        letter = texts[order - 1]  # at 0 that is the last separator
        edge = np.ones(n + 1, bool)
        edge[1:-1] = (letter[1:] != letter[:-1]) | (letter[1:] == BETWEEN) | (group[order[1:]] != group[order[:-1]])
        self.n_runs = int(edge[:-1].sum())
        ends = np.flatnonzero(texts == BETWEEN)
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate([texts, np.full(8, BETWEEN, np.uint8)]), 8)[:n]
        words = np.ascontiguousarray(words).view(np.uint64).reshape(n)
        head = np.flatnonzero(edge[:-1] & (np.arange(n) > 0))
        tail = np.flatnonzero(edge[1:] & (np.arange(n) < n - 1))
        same_head = group[order[head]] == group[order[head - 1]]
        same_tail = group[order[tail]] == group[order[tail + 1]]
        self.heads, self.tails = order[head], order[tail]
        self.first = np.array([order[0]]), np.array([order[-1]])
        self.head_agrees = np.where(same_head, self._agree(words, self.heads, order[head - 1]), 0)
        self.tail_agrees = np.where(same_tail, self._agree(words, self.tails, order[tail + 1]), 0)

    def _agree(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters two suffixes share, up to the end of either text."""
        most = np.minimum(self.left[a], self.left[b])
        out, open_, done = most.copy(), np.arange(len(a)), 0
        while True:
            open_ = open_[most[open_] > done]
            if not len(open_):
                return out
            differs = words[a[open_] + done] ^ words[b[open_] + done]
            ended = differs != 0
            low = differs[ended] & (~differs[ended] + np.uint64(1))
            letters = np.log2(low.astype(np.float64)).astype(np.int64) // 8
            out[open_[ended]] = np.minimum(most[open_[ended]], done + letters)
            open_ = open_[~ended]
            done += 8

    def statistics(self, n: int) -> np.ndarray:
        """For each place of the texts, how long the longest string from there is that starts elsewhere too."""
        best = np.zeros(n, np.int64)
        for samples, agrees, first in ((self.heads, self.head_agrees, self.first[0]), (self.tails, self.tail_agrees, self.first[1])):
            end = np.zeros(n, np.int64)
            sampled = np.zeros(n, np.int64)
            end[first], end[samples] = first, samples + agrees
            sampled[first], sampled[samples] = first, samples
            last = np.maximum.accumulate(sampled)
            best = np.maximum(best, end[last] - np.arange(n))
        return best


def suffix_order(texts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Suffixes in order, those of one group together: sorted by five letters, then by twice as many each round.

    A suffix ends with its text; of suffixes that are equal up to there, the one of the earlier text comes first.
    """
    n, span = len(texts), 5
    ends = np.flatnonzero(texts == BETWEEN)
    number = np.searchsorted(ends, np.arange(n))
    left = ends[number] - np.arange(n)
    padded = np.concatenate([texts, np.zeros(span, np.uint8)]).astype(np.int64)
    key = group.astype(np.int64)
    for k in range(span):
        key = key << 8 | np.where(left >= k, padded[k : k + n], 0)
    whole = np.where(left < span, number, -1)
    active = np.lexsort((whole, key))
    order, slots, rank = active.copy(), np.arange(n), np.zeros(n, np.int64)
    key, whole = key[active], whole[active]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
    while True:
        start = np.flatnonzero(new)
        rank[active] = slots[start][np.cumsum(new) - 1]
        size = np.diff(np.append(start, len(active)))
        open_ = np.repeat(size > 1, size)
        active, slots = active[open_], slots[open_]
        if not len(active):
            return order
        key = rank[active] << 32 | rank[active + span]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        order[slots] = active
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        span *= 2


def marked(table: pa.Table) -> pa.Table:
    """doc_id, first, last: runs of places where a string of ``LENGTH`` bytes starts that starts elsewhere too."""
    keys, owners, starts = (table[c].to_numpy() for c in ("key", "doc_id", "start"))
    found = table["bytes"].to_pylist()
    order = np.argsort(keys, kind="stable")
    out: list[tuple[int, int, int]] = []
    texts: dict[tuple[int, bytes], list[int]] = {}
    held, last = 0, None

    def finish() -> None:
        alone = [(key, text, rows[0]) for (key, text), rows in texts.items()]
        lengths = np.array([len(t) + 1 for _, t, _ in alone])
        joined = np.frombuffer(b"".join(t + b"\xff" for _, t, _ in alone), np.uint8)
        _, numbers_ = np.unique(np.array([k for k, _, _ in alone], np.int64), return_inverse=True)
        longest = RunIndex(joined, np.repeat(numbers_, lengths)).statistics(len(joined))
        hits, at = longest >= LENGTH, 0
        for (key, text, _), length in zip(alone, lengths.tolist(), strict=True):
            rows = texts[key, text]
            if len(rows) > 1:  # the whole text is there again
                spans = [(0, len(text) - LENGTH)]
            else:
                own = np.concatenate([[False], hits[at : at + length], [False]])
                edges = np.flatnonzero(own[1:] != own[:-1])
                spans = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))
            for row in rows:
                out.extend((int(owners[row]), int(starts[row]) + a, int(starts[row]) + b) for a, b in spans)
            at += length

    for row in order.tolist():
        if held > INDEXED and keys[row] != last:
            finish()
            texts, held = {}, 0
        last = keys[row]
        same = texts.setdefault((int(keys[row]), found[row]), [])
        held += 0 if same else len(found[row])
        same.append(row)
    if texts:
        finish()
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table(dict(zip(("doc_id", "first", "last"), (pa.array(c, pa.int64()) for c in columns), strict=True)))


def frequent(shared: DataFrame, share: float = 1e-5, least: int = 4096) -> np.ndarray:
    """Fingerprints that stand at more than ``least`` places and the given share of all places that met: at most 1 / share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [numbers(k) for k in batch["keys"].to_pylist()]
            different, seen = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            yield pa.record_batch([pa.array(different), pa.array(seen.astype(np.int64))], names=["key", "seen"])

    counts = shared.mapInArrow(count, "key long, seen long").groupBy("key").agg(F.sum("seen").alias("seen"))
    places = shared.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
    return np.sort(np.array([r[0] for r in counts.where(F.col("seen") > max(least, share * places)).collect()], np.int64))


def window_entries(often: np.ndarray):
    """Hashes of all strings of ``LENGTH`` bytes over the given fingerprints."""

    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        data, offsets = utf8(text_of(batch))
        for row, owner in enumerate(batch["owner"].to_pylist()):
            text = data[offsets[row] : offsets[row + 1]]
            at = numbers(batch["places"][row].as_py())[np.isin(numbers(batch["keys"][row].as_py()), often)]
            hashes = rolling(text, LENGTH)
            if not len(at) or not len(hashes):
                continue
            near = covered(np.maximum(at - (LENGTH - GRAM), 0), LENGTH - GRAM + 1, len(hashes))
            starts = np.flatnonzero(near)
            yield np.full(len(starts), owner, np.int64), hashes[starts], starts

    return entries


def owner_of() -> Column:
    """What a row's places go under: the hash of id and text, so rows that repeat an id are told apart by their texts
    and rows without an id count like any other."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    row = batch["row"]
    return row.flatten()[row.type.get_field_index("text")]


def repeats(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """doc_id (the owner), first, last: where strings of ``LENGTH`` bytes start that start elsewhere too, in runs of places.

    ``dealt`` are the documents once more (``row``), shuffled by ``owner``.
    """
    rows = docs.select(owner_of().alias("doc_id"), "text")
    shared = settled(meet(rows, fingerprints, ANY), "fingerprints")
    often = frequent(shared)
    # The whole row goes along, so that this shuffle of the texts and the one of the cut are one and the same.
    near = dealt.join(shared, "owner").select("owner", "row", "places", "keys")
    groups = contexts(near, often).withColumn("part", F.pmod("key", F.lit(4 * partitions(docs.sparkSession))).cast("int"))
    out = groups.groupBy("part").applyInArrow(marked, "doc_id long, first long, last long")
    if not len(often):
        return out
    starts = meet(near, window_entries(often), ANY)
    return out.union(starts.mapInArrow(_spans, "doc_id long, first long, last long"))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owners, first, last = [], [], []
        for owner, packed in zip(batch["owner"].to_pylist(), batch["places"].to_pylist(), strict=True):
            at = numbers(packed)
            new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            first.append(at[new])
            last.append(at[np.append(new[1:], len(at)) - 1])
            owners.append(np.full(len(new), owner, np.int64))
        if owners:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in (owners, first, last)], names=["doc_id", "first", "last"])


def removed(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in a string that starts at one of the places."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.minimum(first, n), 1)
    np.add.at(steps, np.minimum(last + LENGTH, n), -1)
    return np.cumsum(steps[:n]) > 0


def _cut(docs: DataFrame, columns: list[str], schema, finish) -> DataFrame:
    """The columns of the documents are in a struct on the way, where no name can clash."""
    dealt = docs.select(F.struct(*columns).alias("row"), owner_of().alias("owner")).repartition("owner")
    spans = repeats(docs, dealt).groupBy(F.col("doc_id").alias("owner")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = pa.record_batch(whole["row"].flatten(), names=columns)
            data, offsets = utf8(batch["text"])
            for low, high in chunks(offsets, 4 << 20):
                found = []
                for row in range(low, high):
                    text = data[offsets[row] : offsets[row + 1]]
                    own = whole["spans"][row].as_py() or []
                    a, b = (np.array([x[c] for x in own], np.int64) for c in ("first", "last"))
                    found.append((text, removed(a, b, len(text))))
                yield finish(batch.slice(low, high - low), found)

    return dealt.join(spans, "owner", "left").select("row", "spans").mapInArrow(run, schema)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, first and end: the maximal runs of bytes to remove of every row of the documents, one row each."""

    def finish(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        edges = [np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))) for _, gone in found]
        ids = batch["doc_id"].cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(edges)), [len(e) // 2 for e in edges])))
        places = np.concatenate([*edges, np.zeros(0, np.int64)]).astype(np.int64)
        return pa.record_batch([ids, pa.array(places[::2]), pa.array(places[1::2])], names=["doc_id", "first", "end"])

    return _cut(docs, ["doc_id", "text"], "doc_id long, first long, end long", finish)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and SHA-256 of the bytes kept of every document.

    Removed is each byte of the UTF-8 text that lies in a string of ``LENGTH`` bytes that also starts anywhere
    else, in the same document too; strings may overlap and never cross documents. Null text is empty. Of rows
    that repeat an id with the same text, each is found in the other; rows that repeat an id with another text
    lose what they share with any row and no more. Rows without an id lose and count like any other. Rows are told
    apart by 64-bit hashes of id and text.

    Two such strings have a winnowed fingerprint at the same place, so the surroundings of fingerprints that met
    another hold them all. Those of one fingerprint meet in one task, equal ones once; a run-length index
    over some groups of them gives the matching statistics of each. Fingerprints that are too frequent for
    one task have the strings over them compared by 64-bit hashes instead, which any number of tasks can do.
    """

    def finish(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch(
            [
                batch["doc_id"].cast(pa.int64()),
                pa.array([len(text) for text, _ in found], pa.int64()),
                pa.array([int(gone.sum()) for _, gone in found], pa.int64()),
                pa.array([int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()) for _, gone in found], pa.int64()),
                pa.array([hashlib.sha256(text[~gone].tobytes()).hexdigest() for text, gone in found], pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _cut(docs, ["doc_id", "text"], schema, finish)
