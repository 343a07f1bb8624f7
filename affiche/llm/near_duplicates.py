"""Near duplicates: documents whose word shingles overlap enough, by T-occurrence search over inverted lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affiche.llm.components import components
from affiche.llm.meet import OTHER, Entries, meet
from affiche.llm.shared import settled, unused
from affiche.llm.text import Words, chunks, utf8

#: Words in a shingle; two sets link when SHARE_TOP * union <= SHARE_OF * intersection.
SHINGLE = 5
SHARE_TOP, SHARE_OF = 75, 100
#: The bits of a shingle's hash that are sent and compared: enough to tell apart the shingles of two documents.
KEY = np.uint64(0xFFFFFFFFFFFF0000)
#: Members of a group that one task searches at once; larger groups are split into blocks.
BLOCK = 1024
#: Lists and sets probed for at once.
PROBES = 1_000_000


def least_overlap(n: np.ndarray | int):
    """The fewest shingles that a set of n has in common with any set it links to."""
    return -(-SHARE_TOP * n // SHARE_OF)


def links(n: np.ndarray | int, m: np.ndarray | int, common: np.ndarray | int):
    """Whether sets of n and m shingles with so many in common link."""
    return SHARE_OF * common >= SHARE_TOP * (n + m - common)


def by_document(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order by document and hash. Few documents are numbered by 16 bits, which numpy deals out without comparing."""
    order = np.argsort(hashes)
    numbers = docs[order]
    if len(docs) and docs.max() < 1 << 16:
        numbers = numbers.astype(np.uint16)
    return order[np.argsort(numbers, kind="stable")]


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of documents: the first one, and the document and hash of each distinct shingle, in order.

    A text of fewer words than a shingle has is one shingle; one without words has none. A-Z are lower-cased.
    """
    data, offsets = utf8(texts)
    for low, high in chunks(offsets):
        words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], lower=True)
        at, hashes = words.grams(SHINGLE)
        docs = words.doc[at]
        for n in range(1, SHINGLE):
            short = np.flatnonzero(words.count == n)
            if len(short):
                at, own = words.grams(n)
                whole = np.isin(at, words.first[short]) & (words.count[words.doc[at]] == n)
                docs, hashes = np.concatenate([docs, words.doc[at[whole]]]), np.concatenate([hashes, own[whole] + np.uint64(n)])
        order = by_document(docs, hashes)
        docs, hashes = docs[order], hashes[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
        yield low, docs[new], hashes[new]


def shingles(packed: bytes) -> np.ndarray:
    """Packed shingles as sorted numbers."""
    planes = np.zeros((8, len(packed) // 6), np.uint8)
    planes[:6] = np.frombuffer(packed, np.uint8).reshape(6, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).reshape(-1))


def packed_shingles(keys: bytes) -> bytes:
    """Keys of shingles (64 bits, of which 48 count) as differences, byte by byte of all of them: 6 bytes each at most."""
    numbers = (np.frombuffer(keys, np.uint64) >> np.uint64(16)).astype(np.int64)
    return np.ascontiguousarray(np.diff(numbers, prepend=0).view(np.uint8).reshape(-1, 8).T[:6]).tobytes()


def class_of(sorted_hashes: np.ndarray) -> int:
    """A number for a whole set, the same for equal sets."""
    return int.from_bytes(hashlib.blake2b(sorted_hashes.tobytes(), digest_size=8).digest(), "little") >> 1


def _classes(docs: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(docs, minlength=n)
    ends = np.cumsum(counts)
    return counts, np.array([class_of(hashes[e - c : e]) for c, e in zip(counts, ends, strict=True)], np.int64)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and class (null without shingles) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, owners, hashes in shingle_sets(batch["text"]):
                n = _run_length(batch, low)
                counts, classes = _classes(owners, hashes, n)
                yield pa.record_batch(
                    [batch["doc_id"].slice(low, n), pa.array(counts, pa.int64()), pa.array(classes, mask=counts == 0)],
                    names=["doc_id", "n_shingles", "class"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, class long")


def _run_length(batch: pa.RecordBatch, low: int) -> int:
    """How many documents the run of ``shingle_sets`` that begins at ``low`` holds."""
    _, offsets = utf8(batch["text"])
    return next(high for a, high in chunks(offsets) if a == low) - low


def class_shingles(batch: pa.RecordBatch) -> Iterator[Entries]:
    """Every shingle of every set, as an entry of the set's class."""
    for low, owners, hashes in shingle_sets(batch["text"]):
        _, classes = _classes(owners, hashes, _run_length(batch, low))
        yield classes[owners], hashes & KEY, np.zeros(len(hashes), np.int64)


def candidates(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """id, n and shared: sets that may link at all, with those of their shingles that other sets have too.

    A shingle that only one set has is in no intersection, so the shared ones are all that ever need
    comparing, and a set needs ``least_overlap`` of them. Sets are named by their smallest document.
    """
    shared = meet(docs.select("text"), class_shingles, OTHER).select(F.col("owner").alias("class"), F.col("keys").alias("shared"))
    named = sets.groupBy("class").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"))
    enough = F.octet_length("shared") / 8 * SHARE_OF >= F.col("n") * SHARE_TOP
    found = named.where(F.col("id").isNotNull()).join(shared, "class").where(enough).select("id", "n", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([packed_shingles(k) for k in batch["shared"].to_pylist()], pa.binary())
            yield pa.record_batch([batch["id"], batch["n"], packed], names=["id", "n", "shared"])

    return found.mapInArrow(run, "id long, n long, shared binary")


def frequent(sets: DataFrame, share: float = 0.01, least: int = 16) -> np.ndarray:
    """Shingles that at least ``share`` of the candidate sets have (and ``least`` of them), sorted.

    One that so many have is that frequent in some task, so tasks only report those. There can be no more than
    the mean number of shingles of a set divided by the share.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, tokens = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merged(tokens, seen, held):
            if held:
                tokens, back = np.unique(np.concatenate([tokens, *held]), return_inverse=True)
                weights = np.concatenate([seen, np.ones(sum(map(len, held)), np.int64)])
                seen = np.bincount(back, weights=weights, minlength=len(tokens)).astype(np.int64)
            return tokens, seen

        for batch in batches:
            for packed in batch["shared"].to_pylist():
                held.append(shingles(packed))
                total += 1
            if sum(map(len, held)) > 1_000_000:
                tokens, seen = merged(tokens, seen, held)
                held = []
        tokens, seen = merged(tokens, seen, held)
        many = seen >= max(share * total, 1)
        if share * total < 1:
            many = seen >= 2
        yield pa.record_batch([pa.array(tokens[many]), pa.array(seen[many])], names=["token", "seen"])

    most = sets.count() * share
    rows = sets.select("shared").mapInArrow(count, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen"))
    return np.sort(np.array([r[0] for r in rows.where(F.col("seen") >= max(most, least)).collect()], np.int64))


def prefixes(sets: DataFrame, rare_last: np.ndarray) -> DataFrame:
    """id and token: of each candidate set so many shingles that two sets that link have one of them in common.

    All sets put their shingles in one order: those no other set has, then by hash, then the frequent
    ones. Two sets that link cannot differ in the whole first part of both, n - least_overlap(n) + 1 long.
    """
    sent = sets.sparkSession.sparkContext.broadcast(rare_last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = [], []
            for key, n, packed in zip(batch["id"].to_pylist(), batch["n"].to_pylist(), batch["shared"].to_pylist(), strict=True):
                own = shingles(packed)
                late = np.isin(own, sent.value)
                first = n - least_overlap(n) + 1 - (n - len(own))
                own = np.concatenate([own[~late], own[late]])[:first]
                ids.append(np.full(len(own), key, np.int64))
                tokens.append(own)
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(tokens))], names=["id", "token"])

    return sets.mapInArrow(run, "id long, token long")


def routes(prefix: DataFrame) -> DataFrame:
    """id and leader: the smallest set of each prefix shingle, once. Any two sets that may link share a leader."""
    leaders = prefix.groupBy("token").agg(F.min("id").alias("leader"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    return prefix.join(leaders.drop("_n"), "token").select("id", "leader").distinct()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays share."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def against_leaders(routed: DataFrame, sets: DataFrame) -> DataFrame:
    """id, leader and linked: each set compared with its leaders; sizes too far apart need no comparing."""
    own = sets.select("id", F.col("n").alias("n_own"), F.col("shared").alias("own"))
    lead = sets.select(F.col("id").alias("leader"), F.col("n").alias("n_lead"), F.col("shared").alias("lead"))
    sizes = sets.select("id", "n")
    sized = (
        routed.where(F.col("id") != F.col("leader"))
        .join(sizes, "id")
        .join(sizes.select(F.col("id").alias("leader"), F.col("n").alias("_n")), "leader")
        .withColumn("near", SHARE_OF * F.least("n", "_n") >= SHARE_TOP * F.greatest("n", "_n"))
        .select("id", "leader", "near")
    )
    pairs = sized.where("near").select("id", "leader").join(own, "id").join(lead, "leader")
    far = sized.where(~F.col("near")).select("id", "leader", F.lit(False).alias("linked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch["n_own"].to_numpy(), batch["n_lead"].to_numpy()
            both = [
                common(shingles(a), shingles(b))
                for a, b in zip(batch["own"].to_pylist(), batch["lead"].to_pylist(), strict=True)
            ]
            yield pa.record_batch([batch["id"], batch["leader"], pa.array(links(n, m, np.array(both, np.int64)), pa.bool_())], names=["id", "leader", "linked"])

    return pairs.mapInArrow(run, "id long, leader long, linked boolean").union(far)


class Lists:
    """Inverted lists from shingle to sets, and a T-occurrence search over them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray]):
        self.ids, self.sizes = ids, sizes
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        order = np.argsort(flat, kind="stable")  # owners ascend in it already
        flat, self.sets = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        self.start = np.flatnonzero(new)
        self.tokens = flat[self.start]
        self.end = np.append(self.start[1:], len(flat))
        #: List and set as one number, ascending: a binary probe for any set in any list.
        self.probe = np.repeat(np.arange(len(self.tokens)), self.end - self.start) * len(tokens) + self.sets

    def search(self, n: int, tokens: np.ndarray) -> np.ndarray:
        """The places of the sets that link to a set of n shingles, by DivideSkip.

        Any such set is in at least T lists. The longest lists are left aside, fewer than T of them, the short
        ones are merged, and what occurs in T less the long ones is probed for in those.
        """
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == tokens]
        needed = int(least_overlap(n))
        if len(at) < needed:
            return np.zeros(0, np.int64)
        lengths = self.end[at] - self.start[at]
        longest = max(2, int(lengths.max()))
        n_long = min(needed - 1, int(needed / (0.01 * np.log2(longest) + 1)))
        order = np.argsort(lengths, kind="stable")
        short, long = at[order[: len(at) - n_long]], at[order[len(at) - n_long :]]
        merged = np.concatenate([self.sets[self.start[t] : self.end[t]] for t in short]) if len(short) else np.zeros(0, np.int64)
        count = np.bincount(merged, minlength=len(self.ids))
        found = np.flatnonzero(count >= max(1, needed - n_long))
        if not len(found):
            return found
        total = count[found]
        step = max(1, PROBES // len(found))
        for k in range(0, len(long), step):
            wanted = long[k : k + step, None] * len(self.ids) + found
            place = np.minimum(np.searchsorted(self.probe, wanted), len(self.probe) - 1)
            total = total + (self.probe[place] == wanted).sum(axis=0)
        return found[links(n, self.sizes[found], total)]


def searched(asking: pa.Table, held: pa.Table) -> pa.Table:
    """Links enough to join up all sets of one group that link: never all pairs, one for each set newly joined."""
    a, b = [], []
    if asking.num_rows and held.num_rows:
        ids = held["id"].to_numpy()
        lists = Lists(ids, held["n"].to_numpy(), [shingles(s) for s in held["shared"].to_pylist()])
        joined = np.arange(len(ids))
        for key, n, packed in zip(asking["id"].to_pylist(), asking["n"].to_pylist(), asking["shared"].to_pylist(), strict=True):
            found = lists.search(n, shingles(packed))
            found = found[ids[found] != key]
            if len(found):
                groups, first = np.unique(joined[found], return_index=True)
                for other in ids[found[first]].tolist():
                    a.append(key)
                    b.append(other)
                if len(groups) > 1:
                    joined[np.isin(joined, groups)] = groups[0]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def remaining(compared: DataFrame, routed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the sets that do not link to their leader with all others of the leader's group.

    Sets that link to the leader are joined up by it already. The others are searched for in the whole group,
    which is dealt in blocks of about ``BLOCK`` sets, so each task has two blocks at most.
    """
    members = routed.groupBy("leader").agg(F.count("*").alias("_n"))
    open_ = compared.where(~F.col("linked")).select("id", "leader").join(members.where(F.col("_n") > 2), "leader")
    open_ = open_.withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))

    def block(name: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias(name)

    asks = settled(open_.select("id", "leader", "_blocks", block("i")), "unlinked")
    tokens = sets.select("id", "n", "shared")
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    asking = asks.join(tokens, "id").select("leader", "i", every.alias("j"), "id", "n", "shared")
    needed = asks.select("leader", "_blocks", "i").distinct()
    held = routed.join(needed.select("leader", "_blocks").distinct(), "leader").select("leader", "id", block("j"))
    held = held.join(tokens, "id").join(needed.select("leader", "i"), "leader").select("leader", "i", "j", "id", "n", "shared")
    key = ["leader", "i", "j"]
    held = held.toDF(*held.columns)  # both sides come from ``sets``: give one its own columns
    return asking.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(searched, "a long, b long")


def joined(docs: DataFrame) -> DataFrame:
    """Every document with ``n_shingles`` and ``component_id``, the smallest doc_id that links lead to.

    Sets are of distinct five-word shingles; two documents link when 100 * intersection >= 75 * union; a
    document without words has an empty set and links to nothing. Documents with equal sets are one class and
    searched for once. Documents without an id (null) keep a null component. No link between different sets is
    lost: prefixes bring any two that may link to a common leader, and every comparison there is exact but
    for the 64-bit hashes that stand for shingles and sets. Repeated ids count as one document.
    """
    sets = settled(measured(docs), "shingles")
    known = sets.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    wanted = settled(candidates(docs, known), "candidates")
    routed = settled(routes(prefixes(wanted, frequent(wanted))), "routes")
    compared = settled(against_leaders(routed, wanted), "compared")
    found = compared.where("linked").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    reached = components(found.union(remaining(compared, routed, wanted)))
    named = known.groupBy("class").agg(F.min("doc_id").alias("id"))
    named = named.join(reached, "id", "left").select("class", F.coalesce("component", "id").alias("component_id"))
    return sets.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents without near duplicates: of each component the one with the smallest doc_id stays.

    Documents without an id stay. Of rows that repeat an id, the first by text stays if the id does.
    """
    _kept, _rank = unused("kept", docs.columns), unused("rank", docs.columns)
    kept = joined(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(_kept)).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long") == F.col(_kept), "left")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    unnamed = rows.where(F.col("doc_id").isNull()).select(*docs.columns)
    named = rows.where(F.col(_kept).isNotNull()).withColumn(_rank, F.row_number().over(first))
    return named.where(F.col(_rank) == 1).select(*docs.columns).union(unnamed)
