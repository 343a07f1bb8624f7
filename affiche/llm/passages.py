"""Repeated passages of words: windows anchored at a difference cover, extended where anchors meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affiche.llm.meet import OTHER, SMALLER, Entries, meet, numbers, with_owner
from affiche.llm.text import Words, chunks, covered, utf8

#: Words in a passage, the period of the cover, and the residues in it: every difference modulo the period
#: is the difference of two of them, so two equal passages share an anchor at the same word.
LENGTH = 13
PERIOD = 7
COVER = (1, 2, 4)
ANCHOR = LENGTH - (PERIOD - 1)


def anchors(batch: pa.RecordBatch) -> Iterator[Entries]:
    """Hashes of the windows of ``ANCHOR`` words that begin at places of the cover."""
    data, offsets = utf8(batch["text"])
    ids = batch["doc_id"].to_numpy()
    for low, high in chunks(offsets):
        words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        at, hashes = words.grams(ANCHOR)
        doc = words.doc[at]
        place = at - words.first[doc]
        kept = np.isin(place % PERIOD, COVER)
        yield ids[low + doc[kept]], hashes[kept], place[kept]


def windows(batch: pa.RecordBatch) -> Iterator[Entries]:
    """Hashes of the whole windows that contain an anchor which met another."""
    data, offsets = utf8(batch["text"])
    ids, places = batch["doc_id"].to_numpy(), batch["places"]
    for low, high in chunks(offsets):
        words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        at, hashes = words.grams(LENGTH)
        wanted = np.zeros(len(words.start) + 1, bool)
        for k in range(high - low):
            found = numbers(places[low + k].as_py())
            found = found[found < words.count[k]]
            for shift in range(PERIOD):
                wanted[words.first[k] + found[found >= shift] - shift] = True
        kept = wanted[at]
        doc = words.doc[at[kept]]
        yield ids[low + doc], hashes[kept], at[kept] - words.first[doc]


def repeats(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """owner (doc_id), places and keys of the windows that also start in a document with a smaller doc_id.

    ``dealt`` are the documents once more (``row``), shuffled by the ``owner`` they go under.
    """
    shared = meet(with_owner(docs), anchors, OTHER).select("owner", "places")

    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        row = dict(zip(batch["row"].type.names, batch["row"].flatten(), strict=True))
        ids = row["doc_id"].cast(pa.int64())
        mine = pa.record_batch([ids, row["text"], batch["places"]], names=["doc_id", "text", "places"])
        # A row without an id goes under its text, which may be named like a document: it still owns nothing.
        yield from windows(mine.filter(ids.is_valid()))

    return meet(dealt.join(shared, "owner").select("row", "places"), entries, SMALLER)


def _deduplicated(docs: DataFrame, columns: list[str], schema, finish) -> DataFrame:
    """Texts are shuffled once, by owner: for the windows around anchors that met another, and for the cut.

    What is cut is checked against the row's own windows, so rows that repeat an id with another text lose nothing
    that only the other has. The columns of the documents are in a struct, where no name can clash.
    """
    owner = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    dealt = docs.select(F.struct(*columns).alias("row"), owner.alias("owner")).repartition("owner")
    marked = dealt.join(repeats(docs, dealt), "owner", "left").select("row", "places", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = pa.record_batch(whole["row"].flatten(), names=columns)
            ids = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch["text"])
            for low, high in chunks(offsets):
                base = offsets[low]
                part = data[base : offsets[high]]
                words = Words(part, offsets[low : high + 1] - base)
                at, hashes = words.grams(LENGTH)
                own = np.zeros(len(words.start), np.uint64)
                own[at] = hashes
                begins = np.zeros(len(words.start), bool)
                begins[at] = True
                raw = part.tobytes()
                rows = []
                for k in range(high - low):
                    first, n = int(words.first[k]), int(words.count[k])
                    places, keys = numbers(whole["places"][low + k].as_py()), numbers(whole["keys"][low + k].as_py()).view(np.uint64)
                    here = np.flatnonzero((places < n) & ids[low + k])
                    here = here[begins[first + places[here]] & (own[first + places[here]] == keys[here])]
                    gone = covered(places[here], LENGTH, n)
                    mine = slice(first, first + n)
                    kept = [raw[a:b] for a, b in zip(words.start[mine][~gone], words.end[mine][~gone], strict=True)]
                    rows.append((n, int(gone.sum()), b" ".join(kept), raw[offsets[low + k] - base : offsets[low + k + 1] - base]))
                yield finish(batch.slice(low, high - low), rows)

    return marked.mapInArrow(run, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Documents without the words of passages that stand in a document with a smaller doc_id.

    A passage is ``LENGTH`` consecutive words (runs of anything but ASCII white space, unchanged). Texts that lose
    words are put together again from the words kept, with one blank between them; all others, null ones
    too, stay as they are, and so do all other columns. A document that loses all of its words goes.
    Rows of one id lose nothing to each other, and each loses what a smaller id has of its own text; documents
    without an id neither lose nor take. Equal passages are told by 64-bit hashes of their words.
    """
    columns = docs.columns

    def finish(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        texts = [old if not gone else kept.decode() for (_, gone, kept, _), old in zip(rows, batch["text"].to_pylist(), strict=True)]
        out = pa.record_batch([pa.array(texts, pa.string()) if c == "text" else batch[c] for c in columns], names=columns)
        return out.filter(pa.array([not n or gone < n for n, gone, _, _ in rows], pa.bool_()))

    return _deduplicated(docs, columns, docs.schema, finish)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and SHA-256 of the kept words (one blank between them) of every document."""

    def finish(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch(
            [
                batch["doc_id"].cast(pa.int64()),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return _deduplicated(docs, ["doc_id", "text"], "doc_id long, n_words long, n_removed long, kept_sha256 string", finish)
