import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from affiche.llm import resampling
from tests.llm.tables import CLASHING, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=1):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    def counted(texts):
        c = Counter()
        for t in texts:
            c.update(zlib.crc32(f.encode()) % buckets for f in features(t, longest)[1])
        return c

    source, wanted = counted(t for _, t in rows), counted(target)
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        w, f = features(text, longest)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[5]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "été", "ÉTÉ", "7", "x" * 31, "x" * 32, "y" * 40, "日本語", "o'clock", "a_b", "C3PO", " ", "end\n"]
    vocabulary += [f"w{k}" for k in range(200)]
    out = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 70)))) for i in range(300)]
    out += [(400, None), (401, ""), (402, "-- \x00 []"), (403, "one " * 30_000), (None, "alpha " * 25), (None, None)]
    out += [(404, "beta " * 20), (404, "beta " * 20), (404, "w1 " * 20), (-7, "beta alpha " * 10)]
    return out


TARGET = ["alpha beta w1 w2 w3", "w1 w1 日本語", None, "", "x" * 32]


@pytest.mark.parametrize("longest, batch", [(1, 2 << 20), (1, 64), (3, 1000)])
def test_equals_brute_force(spark, rows, monkeypatch, longest, batch):
    monkeypatch.setattr(resampling, "BATCH", batch)
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id int, text string")
    out = resampling.resampled(documents(spark, rows, CLASHING).repartition(5), target, longest)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == brute(rows, TARGET, longest)


def test_every_share_and_ties(spark, rows):
    """Few buckets and a large share; every row of one id has the same noise, so ties are many."""
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    more = rows + [(900, "beta alpha " * 10)] * 40
    for percent in (0, 50, 100):
        out = resampling.resampled(documents(spark, more), target, buckets=7, percent=percent)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(more, TARGET, buckets=7, percent=percent)


def test_empty_tables(spark):
    none = documents(spark, [])
    some = documents(spark, [(1, "a b c " * 10), (2, None)])
    assert resampling.resampled(none, some).count() == 0
    assert resampling.resampled(some, none).where("rank is null").count() == 2
    assert resampling.resampled(none, none).count() == 0


@pytest.mark.parametrize("length", [*range(1, 40), 100])
def test_keys_are_xxhash64(length):
    data = np.random.default_rng(length).integers(0, 256, 500, dtype=np.uint8)
    start = np.arange(0, 500 - length, 3)
    got = resampling.xxhash64(data, start, np.full(len(start), length))
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + length].tobytes()) for a in start.tolist()]


def test_equal_keys_are_told_apart_by_their_bytes(monkeypatch):
    """With one key for all n-grams each still gets a slot of its own."""
    monkeypatch.setattr(resampling, "xxhash64", lambda data, start, length: np.full(len(start), 5, np.uint64))
    text = np.frombuffer(b"one two six one ten two one", np.uint8)
    grams = resampling.Grams(text, np.array([0, len(text)]), 1)
    table = resampling.Interned(grams, 100)
    words = text.tobytes().split()
    assert len({int(s) for s in table.slot}) == 4
    assert [int(table.count[s]) for s in table.slot] == [words.count(w) for w in words]
    assert [int(table.bucket[s]) for s in table.slot] == [zlib.crc32(w) % 100 for w in words]


def test_long_text(spark):
    """Megabytes in one row are worked on alone."""
    rows = [(1, "ab cd " * 600_000), (2, "ab " * 30)]
    target = documents(spark, [(1, "cd")])
    got = {r["doc_id"]: r["n_features"] for r in resampling.resampled(documents(spark, rows), target).collect()}
    assert got == {1: 1_200_000, 2: 30}
    assert resampling.bucket_counts(documents(spark, rows).select(F.col("text")), 2).sum() == 2_400_058
