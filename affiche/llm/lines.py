"""Line dedup: hashes of lines dealt by range, streamed by document, told back as bitmaps of the lines to keep.

No text is sent to find repeated lines. A task hashes its lines and settles what it can see alone: of a key that
enough of its documents hold, only the largest document's entry goes on and stands for all of them, so the most
frequent line of a corpus costs a few entries a task. Entries are dealt by ranges of the hash and sorted by
document and place within a range, largest document first; one pass over that order tells which lines go.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affiche.llm.shared import SPACES, partitions, settled

#: A key shorter than this is never dropped; a key goes where this many documents hold it.
LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
#: Lines a task holds before it settles and sends them.
FLUSH = 400_000
_SPACE = SPACES.encode()
#: An entry: the key's hash in two halves, the document, its text, the places of the key in it, how many documents
#: (at most ``least_documents``) it stands for, and whether it is known to go.
_ENTRY = "high long, low long, doc_id long, text_hash long, places binary, weight int, gone boolean"
_GONE = "doc_id long, text_hash long, places binary"
_BITMAP = "doc_id long, text_hash long, keep binary"


def key_of(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where in sorted rows any of the columns changes: the first place of each run."""
    first = np.ones(len(columns[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(first)


def verdict(rows: pa.RecordBatch, least_documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by key, then document (largest first, no id last): is the key's number of documents known to
    be reached, and is the entry one of the key's largest document."""
    n = rows.num_rows
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    high, low, absent, doc = sort_columns(rows)
    group = starts(high, low, absent, doc)
    key = np.flatnonzero(np.isin(group, starts(high, low), assume_unique=True))  # the first group of each key
    weight = np.maximum.reduceat(rows["weight"].to_numpy().astype(np.int64), group)
    enough = np.add.reduceat(weight, key) >= least_documents
    groups_of_key = np.diff(np.append(key, len(group)))
    rows_of_group = np.diff(np.append(group, n))
    largest = np.zeros(len(group), bool)
    largest[key] = True
    return np.repeat(np.repeat(enough, groups_of_key), rows_of_group), np.repeat(largest, rows_of_group)


def sort_columns(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The key's halves, whether the id is null, and the id upside down."""
    absent = rows["doc_id"].is_null().to_numpy(zero_copy_only=False)
    return rows["high"].to_numpy(), rows["low"].to_numpy(), absent, ~rows["doc_id"].fill_null(0).to_numpy()


def entries(lines: list[tuple], least_documents: int) -> pa.RecordBatch:
    """What a task says about its lines: (digest, document, its text, place), one entry for each key and text."""
    digests = np.frombuffer(b"".join(x[0] for x in lines), "<i8").reshape(-1, 2)
    docs = pa.array([x[1] for x in lines], pa.int64())
    texts = np.array([x[2] for x in lines], np.int64)
    places = np.array([x[3] for x in lines], np.int32)
    absent, doc = docs.is_null().to_numpy(zero_copy_only=False), ~docs.fill_null(0).to_numpy()
    order = np.lexsort((places, texts, doc, absent, digests[:, 1], digests[:, 0]))
    high, low, absent, doc, texts, places = (c[order] for c in (digests[:, 0], digests[:, 1], absent, doc, texts, places))
    different = starts(high, low, absent, doc, texts, places)  # rows that repeat an id and its text say nothing new
    high, low, absent, doc, texts, places = (c[different] for c in (high, low, absent, doc, texts, places))
    at = starts(high, low, absent, doc, texts)
    offsets = pa.py_buffer((4 * np.append(at, len(places))).astype(np.int32))
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(places.astype("<i4"))])
    columns = [
        pa.array(high[at]),
        pa.array(low[at]),
        pa.array(~doc[at], pa.int64(), mask=absent[at]),
        pa.array(texts[at]),
        packed,
        pa.array(np.ones(len(at), np.int32)),
    ]
    rows = pa.record_batch(columns, names=["high", "low", "doc_id", "text_hash", "places", "weight"])
    enough, largest = verdict(rows, least_documents)
    weight = np.where(enough, least_documents, 1).astype(np.int32)
    return rows.set_column(5, "weight", pa.array(weight)).append_column("gone", pa.array(enough & ~largest))


def hashed(docs: DataFrame, least_chars: int, least_documents: int) -> DataFrame:
    """The entries of all lines, settled as far as one task can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for doc, text_hash, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                for place, line in enumerate((text or "").encode().split(b"\n")):
                    key = key_of(line)
                    if long_enough(key, least_chars):
                        held.append((xxhash.xxh3_128_digest(key), doc, text_hash, place))
                        if len(held) >= FLUSH:
                            yield entries(held, least_documents)
                            held = []
        if held:
            yield entries(held, least_documents)

    return docs.select(*_identity(), "text").mapInArrow(run, _ENTRY)


def streamed(asked: DataFrame, least_documents: int) -> DataFrame:
    """The lines that go, of entries in ranges of the hash: one pass over each range in order.

    Only the rows of the last key are carried from batch to batch: those of fewer than ``least_documents`` documents,
    or the first row, which stands for all once the number is reached.
    """
    order = ["high", "low", F.col("doc_id").desc_nulls_last(), "text_hash"]
    dealt = asked.repartitionByRange(partitions(asked.sparkSession), "high", "low").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            enough, largest = verdict(batch, least_documents)
            gone = batch.filter(pa.array(enough & ~largest))
            if gone.num_rows:
                yield gone.select(["doc_id", "text_hash", "places"])
            high, low, *_ = sort_columns(batch)
            last = int(starts(high, low)[-1])
            held = batch.slice(last, 1 if enough[-1] else None)
            if enough[-1]:
                held = held.set_column(5, batch.schema.field(5), pa.array([least_documents], pa.int32()))

    return dealt.drop("gone").mapInArrow(run, _GONE)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, text_hash and keep (compressed bits, one a line, 0: goes) of every text that loses a line.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least ``least_chars``
    code points that at least ``least_documents`` documents hold stays only in the largest doc_id that holds it.
    Lines after the last bit stay. ``text_hash`` (Spark's xxhash64) tells texts of one id apart. Rows with one
    id are one document; so are all rows without an id, which comes before every other. Keys are told apart
    by 128-bit hashes.
    """
    asked = settled(hashed(docs, least_chars, least_documents), "line-entries")
    gone = asked.where("gone").select("doc_id", "text_hash", "places").unionAll(streamed(asked.where("not gone"), least_documents))
    of_text = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("places").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keeps = [bitmap(np.frombuffer(b"".join(p), "<i4")) for p in batch["places"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], batch["text_hash"], pa.array(keeps, pa.binary())], names=["doc_id", "text_hash", "keep"])

    return settled(of_text.mapInArrow(run, _BITMAP), "line-bitmaps")


def bitmap(places: np.ndarray) -> bytes:
    """Compressed bits of the lines up to the last one that goes."""
    keep = np.ones(-(-(int(places.max()) + 1) // 8) * 8, bool)
    keep[places] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    """Lines, lines dropped, and the text of the others."""
    lines = (text or "").split("\n")
    if keep is None:
        return len(lines), 0, text or ""
    gone = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)) == 0)
    dropped = set(gone.tolist())
    return len(lines), len(dropped), "\n".join(x for k, x in enumerate(lines) if k not in dropped)


def _identity() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text")).alias("text_hash")]


def _marked(docs: DataFrame, columns: list[str], least_chars: int, least_documents: int) -> DataFrame:
    """``row`` (the given columns) and ``keep`` of every row. The user's columns are in a struct, so no name can clash."""
    bitmaps = keep_bitmaps(docs, least_chars, least_documents)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), *_identity()).alias("l")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash"))
    return rows.join(bitmaps.alias("r"), same, "left").select("row", "keep")


def _applied(marked: DataFrame, schema: T.StructType | str, finish: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch["row"]
            columns = dict(zip(row.type.names, row.flatten(), strict=True))
            yield finish(columns, [kept_lines(t, k) for t, k in zip(columns["text"].to_pylist(), batch["keep"].to_pylist(), strict=True)])

    return marked.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The documents, all columns, with the lines that ``keep_bitmaps`` keeps in ``text``.

    Every row stays, null texts too; a text that loses all of its lines is empty. Texts that lose nothing are unchanged.
    """
    names, types = docs.columns, [f.type for f in _arrow(docs)]

    def finish(columns: dict, lines: list[tuple]) -> pa.RecordBatch:
        texts = [t if not gone else kept for t, (_, gone, kept) in zip(columns["text"].to_pylist(), lines, strict=True)]
        out = [pa.array(texts, t) if c == "text" else columns[c] for c, t in zip(names, types, strict=True)]
        return pa.record_batch(out, names=names)

    return _applied(_marked(docs, names, least_chars, least_documents), docs.schema, finish)


def _arrow(docs: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(docs.schema)


def digests(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and SHA-256 of the kept lines of every row of the documents.

    Null and empty texts are one empty line, which stays. No rows give no rows; other columns are left out.
    """

    def finish(columns: dict, lines: list[tuple]) -> pa.RecordBatch:
        out = [
            columns["doc_id"].cast(pa.int64()),
            pa.array([x[0] for x in lines], pa.int64()),
            pa.array([x[1] for x in lines], pa.int64()),
            pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in lines], pa.string()),
        ]
        return pa.record_batch(out, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    return _applied(_marked(docs, ["doc_id", "text"], least_chars, least_documents), schema, finish)
