import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from affiche.llm import (
    bpe,
    language,
    licences,
    long_repeats,
    near_duplicates,
    neighbours,
    packing,
    passages,
    rules,
    sharding,
)
from affiche.llm.components import components
from affiche.llm.meet import ANY, OTHER, SMALLER, meet, numbers
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents with an extra column whose name clashes with those that operators add."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    """Unlike texts, copies, near copies, shared passages, nulls, empties, blanks and one long periodic text."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("Ra", "to", "mi", "él", "x") for b in ("ka", "no", "ß", "vu", "")]

    def fresh(n):
        return " ".join(rng.choice(vocabulary) + str(rng.randrange(60)) for _ in range(n))

    base, passage = fresh(260), fresh(90)
    out = [base, base, base.upper(), None, "", " \n\t ", "one", "one two", "ONE two", "a b c d e"]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = fresh(1)
        out.append(" ".join(w))
    for _ in range(15):
        out.append(fresh(rng.randrange(1, 60)) + "\n" + passage + "  " + fresh(rng.randrange(1, 60)))
    out += [fresh(rng.randrange(1, 200)) for _ in range(15)]
    out += ["he said it " * 700, "é" * 900, "é" * 900, "\n".join([fresh(6)] * 9)]
    return list(enumerate(out))


@pytest.fixture
def many_parts(spark, monkeypatch):
    """Small messages, blocks and indexes, so that small tables take the ways of large ones."""
    from affiche.llm import meet as meeting

    monkeypatch.setattr(meeting, "FLUSH", 500)
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    monkeypatch.setattr(long_repeats, "INDEXED", 4096)


def as_dict(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(400)]
    vectors[7] = (7, None)
    vectors[8] = (8, [0.0] * 8)
    vectors[9] = (9, [float("nan")] + [1.0] * 7)
    vectors[10] = (10, [None] + [1.0] * 7)
    vectors[11] = (11, [float("inf")] + [1.0] * 7)
    for i in range(200, 260):
        vectors[i] = (i, vectors[100][1])
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    rows = neighbours.usable(df)
    found = neighbours.search(rows, rows.where("vec_id % 100 = 0"), block=50).collect()
    want = brute.nearest(vectors)
    got = brute.groups(found, lambda r: r["query_id"])
    assert set(got) == set(want)
    hits = 0
    for q, rs in got.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in rs] == sorted((r["score"], r["vec_id"]) for r in rs)
        hits += len({r["vec_id"] for r in rs} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [r["vec_id"] for r in got[100]] == list(range(200, 210))  # ties: the smallest ids


def test_nearest_of_few_and_of_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = neighbours.usable(df)
    found = [tuple(r)[:3] for r in neighbours.search(rows, rows.where("vec_id = 0")).orderBy("rank").collect()]
    assert found == [(0, 1, 2), (0, 2, 1)]
    none = neighbours.usable(df.where("false"))
    assert neighbours.search(none, none).count() == 0


def test_near_duplicates_match_brute_force(spark, texts, many_parts):
    got = as_dict(near_duplicates.joined(documents(spark, texts).repartition(5)))
    assert got == brute.components(texts)


def test_one_of_each_keeps_the_smallest(spark, texts):
    docs = documents(spark, texts)
    want = {i for i, (_, c) in brute.components(texts).items() if c == i}
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == want


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(60)]
    sets += [np.unique(np.append(s[2:], rng.integers(0, 60, 2))) for s in sets[:30]]
    sizes = np.array([len(s) for s in sets])
    lists = near_duplicates.Lists(np.arange(len(sets)), sizes, sets)
    for s in sets:
        common = np.array([len(np.intersect1d(s, t)) for t in sets])
        want = np.flatnonzero(near_duplicates.links(len(s), sizes, common))
        assert lists.search(len(s), s).tolist() == want.tolist()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 501)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rule", [OTHER, ANY, SMALLER])
def test_meeting_entries(spark, rule, many_parts):
    rng = np.random.default_rng(1)
    rows = [(int(i), [int(k) for k in rng.integers(0, 300, 20)]) for i in range(60)]

    def entries(batch):
        for owner, keys in zip(batch["id"].to_pylist(), batch["keys"].to_pylist(), strict=True):
            yield np.full(len(keys), owner), np.array(keys, np.uint64) << np.uint64(55), np.arange(len(keys))

    df = spark.createDataFrame(rows, "id long, keys array<long>").repartition(4)
    got = {(r["owner"], p) for r in meet(df, entries, rule).collect() for p in numbers(r["places"]).tolist()}
    flat = [(i, p, k % 512) for i, ks in rows for p, k in enumerate(ks)]
    want = set()
    for i, p, k in flat:
        others = [(j, q) for j, q, m in flat if m == k and (j, q) != (i, p)]
        if (
            (rule == ANY and others)
            or (rule == OTHER and any(j != i for j, _ in others))
            or (rule == SMALLER and any(j < i for j, _ in others))
        ):
            want.add((i, p))
    assert got == want


def test_packing_fills_sequences(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(documents(spark, texts), path, 64).collect()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for i, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["length"] for r in own] == [len(ids[k : k + 64]) for k in range(0, len(ids), 64)]
        assert [r["start"] for r in own] == list(range(0, len(ids), 64))
        assert [r["ids_crc32"] for r in own] == [
            zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()) for k in range(0, len(ids), 64)
        ]
    histogram = {}
    for bin_ in brute.groups(rows, lambda r: r["sequence_id"]).values():
        at = 0
        for r in sorted(bin_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            histogram[r["length"]] = histogram.get(r["length"], 0) + 1
        assert at <= 64
    used = len({r["sequence_id"] for r in rows})
    assert used <= packing.lower_bound(histogram, 64) * 1.05 + 1


def test_packing_special_tokens_as_the_library_does(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [
        "a <|endoftext|> b",
        "Word<|endoftext|>word's <|startoftext|><|endoftext|>",
        "<|ENDOFTEXT|> <|EndOfText|> <|endoftext |>",
        "<|endoftext|>",
        "one <|endof",
        "text|> two",
        None,
        "<|startoftext|>É a <|STARTOFTEXT|>\n<|endoftext|",
        "<|endoftext|> A b " * 40,
        "a b",
    ]
    rows = list(enumerate(texts))
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want[i, k // 64] = (k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()))
    out = packing.pack_documents(documents(spark, rows).coalesce(1), path, 64).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(40):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 70)
        chosen = packing.fullest(counts, room, sorted(counts, reverse=True))
        sums = {0}
        for x, n in counts.items():
            for _ in range(n):
                sums |= {s + x for s in sums}
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert all(chosen.count(x) <= counts[x] for x in chosen)


def test_packing_nothing_and_bad_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, length long")
    assert packing.pack(empty, 8).count() == 0
    with pytest.raises(ValueError, match="from 1 to 8"):
        packing.pack(spark.createDataFrame([(1, 9)], "doc_id long, length long"), 8).count()


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    assert sorted(sharding.permuted(np.arange(n), n, 1).tolist()) == list(range(n))


def test_shards_are_even_and_repeatable(spark, texts):
    twice = [*texts, *texts[:5], (None, "no id"), (None, None)]
    docs = documents(spark, twice)
    rows = sharding.document_shards(docs, 16).collect()
    assert len(rows) == len(twice)
    counts = {s: len(rs) for s, rs in brute.groups(rows, lambda r: r["shard"]).items()}
    assert max(counts.values()) - min(counts.values()) <= 1
    for rs in brute.groups(rows, lambda r: r["shard"]).values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {
        (i, len((t or "").encode()) + 1, brute.text_crc(t)) for i, t in twice
    }
    again = sharding.document_shards(docs.repartition(7), 16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.document_shards(docs.where("false"), 16).count() == 0


@pytest.fixture(scope="module")
def tiktokens():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, texts, tiktokens):
    path, library = tiktokens
    more = ["aaaaaaaaaaaaaaaaa", " " * 40 + "x", "ab" * 3000, "你好" * 50, "🙂🙂", "'s't I'll 12345", "<|endoftext|>"]
    rows = [*texts, *enumerate(more, 1000)]
    docs = documents(spark, rows)
    ids = {r["doc_id"]: r for r in bpe.encoded(docs, path, public_tokenizers.PATTERN, chars=500).collect()}
    got = as_dict(bpe.digests(docs, path, public_tokenizers.PATTERN))
    for i, text in rows:
        want = library.encode_ordinary(text or "")
        assert list(ids[i]["ids"]) == want
        assert bytes(ids[i]["decoded"]) == (text or "").encode()
        assert got[i] == (
            len(want),
            hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )


def test_words_merged_one_by_one_are_the_same(tiktokens):
    path, library = tiktokens
    known = bpe.ranks(path)
    for word in (b"international", b"zzzzzzzz", "éèà".encode(), b"a"):
        assert bpe.merge_one(word, known) == library.encode_ordinary(word.decode())


def test_statistics_match_brute_force(spark, texts):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = [*texts, (900, "# a|b <c> $5\n# a|b <c> $5\n\n \n"), (901, "x y z x y z x y")]
    got = as_dict(rules.with_statistics(documents(spark, rows)).select(columns))
    assert got == {i: brute.statistics(t) for i, t in rows}


def test_rules_find_planted_junk_and_keep_the_rest(spark):
    rng = random.Random(4)

    def text(junk):
        w = ["word" + str(rng.randrange(5000)) for _ in range(80)]
        return " ".join(x + "###" for x in w) if junk else " ".join(w)

    rows = [(i, text(i % 5 == 0)) for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame(
        [(i, None if i == 3 else int(i % 5 != 0)) for i in range(300)] + [(None, 0)], "doc_id long, quality int"
    )
    learned = rules.learn(docs, labels)
    assert learned.rules
    out = rules.judged(docs, learned)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] for i in kept if i % 5)
    unseen = [i for i in range(300, 400) if i % 5 == 0]
    assert sum(not kept[i] for i in unseen) >= 0.9 * len(unseen)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_labels_no_rules(spark):
    docs = documents(spark, [(1, None), (2, "")])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.learn(docs, labels).rules == ()
    assert [r["kept"] for r in rules.judged(docs, rules.DecisionList()).collect()] == [False, False]


def test_best_test_by_hand():
    counts = [("n_words", 0, 5, 0), ("n_words", 1, 0, 5)]
    assert rules.best_test(counts, {"n_words": [10.0]} | dict.fromkeys(rules.FEATURES[1:], ())) == (
        rules.Test("n_words", False, 10.0),
        0,
    )


def test_long_repeats_match_brute_force(spark, texts, many_parts):
    got = as_dict(long_repeats.digests(documents(spark, texts).repartition(3)))
    assert got == brute.long_repeats(texts)


def test_frequent_fingerprints_take_the_other_way(spark, texts, many_parts, monkeypatch):
    original = long_repeats.frequent
    monkeypatch.setattr(long_repeats, "frequent", lambda shared: original(shared, share=0.0, least=3))
    got = as_dict(long_repeats.digests(documents(spark, texts)))
    assert got == brute.long_repeats(texts)


def test_spans_are_what_is_removed(spark, texts):
    found = brute.groups(long_repeats.spans(documents(spark, texts)).collect(), lambda r: r["doc_id"])
    want = brute.long_repeats(texts)
    for i, (_, gone, n, _) in want.items():
        rows = found.get(i, [])
        assert (sum(r["end"] - r["first"] for r in rows), len(rows)) == (gone, n)


def test_passages_match_brute_force(spark, texts, many_parts):
    docs = documents(spark, texts).repartition(3)
    want = brute.passages(texts)
    assert as_dict(passages.digests(docs)) == want
    kept = passages.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (n, gone, _) in want.items() if not n or gone < n}


def test_cover_meets_every_shift():
    residues = set(passages.COVER)
    for shift in range(passages.PERIOD):
        assert any((r + shift) % passages.PERIOD in residues for r in residues)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    out = language.predict(docs, model).where(language.held_out()).select("lang", "lang_pred", "score").collect()
    assert len(out) > 100 and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_kernel_is_shared_n_grams():
    a, b = (np.frombuffer(x, np.uint8) for x in (b"banana", b"bandana"))
    grams = [{x[k : k + n] for n in (1, 2, 3) for k in range(len(x) - n + 1)} for x in (b"banana", b"bandana")]
    codes = [language.gram_codes(x) for x in (a, b)]
    assert [len(c) for c in codes] == [len(g) for g in grams]
    presence = np.zeros((len(codes[1]), 1), np.float32)
    presence[:] = 1
    marks = language.Landmarks(np.sort(codes[1]), presence, np.array([len(codes[1])], np.float64))
    want = len(grams[0] & grams[1]) / (len(grams[0]) * len(grams[1])) ** 0.5
    assert marks.kernel([codes[0]])[0, 0] == pytest.approx(want)


def test_language_of_nothing(spark):
    docs = documents(spark, [(1, None), (2, "123 !"), (3, "abc")])
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    out = language.predict(docs, language.fit(unlabelled)).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}
    known = language.predict(docs, language.fit(docs.where("doc_id = 3"))).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in known] == ["und", "und", "en"]


def test_licences_own_and_inherited(spark):
    rows = [
        ("a/LICENSE", "The MIT stuff\nReleased under the MIT License.\n", True),
        ("a/b/x.txt", "nothing here", False),
        ("a/b/y.txt", "text\n// licensed under the Apache License, Version 2.0\nmore text", False),
        ("a/c/LICENSE", "Licensed under CC BY-NC 4.0.", True),
        ("a/c/d/z.txt", None, False),
        ("top.txt", "", None),
        ("top.txt", "This work is licensed under the GNU General Public License, version 3.", False),
        (None, "Released under the MIT License.", True),
        ("e/f.txt", "the work is in the public house of the general " * 40, False),
    ]
    files = spark.createDataFrame(rows, "path string, text string, is_licence boolean")
    out = licences.scan(files)
    got = {r["path"]: (r["licence"], r["origin"], r["source"]) for r in out.collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own", "a/LICENSE"),
        "a/b/x.txt": ("MIT", "inherited", "a/LICENSE"),
        "a/b/y.txt": ("Apache-2.0", "own", "a/b/y.txt"),
        "a/c/LICENSE": ("CC-BY-NC-4.0", "own", "a/c/LICENSE"),
        "a/c/d/z.txt": ("CC-BY-NC-4.0", "inherited", "a/c/LICENSE"),
        "top.txt": ("GPL-3.0", "own", "top.txt"),
        "e/f.txt": (None, None, None),
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_in_longer_lines_over_lines_and_as_whole_texts(spark):
    full, headers = dict(licences.longer()), {n: t for n, t in reversed(licences.HEADERS)}
    prose = "the house stands at the end of a long road and nobody has seen who lives in it since the winter"
    wrapped = "\n".join(f" * {part}" for part in headers["GPL-3.0"].replace("; ", ";\n").replace(", ", ",\n").split("\n"))
    rows = [
        ("a/x", "Copyright 2020 Foo Inc. All rights reserved. Licensed under the Apache License, Version 2.0.", "Apache-2.0", 0),
        ("b/x", f"{prose}\n{prose} Released under the MIT License. {prose}", "MIT", 1),
        ("c/x", "# Licensed under the\n# Mozilla Public\n# License, version 2.0.\n", "MPL-2.0", 0),
        ("d/x", full["MIT"], "MIT", 0),
        ("e/x", prose + " " + full["MIT"].replace("\n", " ") + " " + prose, "MIT", 0),
        ("f/x", full["BSD-3-Clause"], "BSD-3-Clause", 0),
        ("g/x", full["GPL-3.0"], "GPL-3.0", 0),
        ("h/x", full["MPL-2.0"], "MPL-2.0", 0),
        ("i/x", full["Apache-2.0"], "Apache-2.0", 0),
        ("j/x", f"/*\n{wrapped}\n */\n{prose}", "GPL-3.0", 1),
        ("k/x", headers["CC-BY-NC-4.0"] + " " + prose, "CC-BY-NC-4.0", 0),
        ("l/x", f"{prose}\n" * 50, None, None),
        ("m/x", "this software is free and the public may use the general terms of a license in this work", None, None),
    ]
    files = spark.createDataFrame([(p, t, False) for p, t, *_ in rows], "path string, text string, is_licence boolean")
    # A corpus of other lines, so that frequencies are not those of licence texts alone.
    files = files.union(files.sparkSession.range(400).selectExpr("concat('z/', id)", f"concat('{prose} ', id)", "false"))
    out = licences.stated(files)
    got = {r["path"]: (r["licence"], r["line"]) for r in out.collect()}
    assert {p: (n, got[p][1] if n and p in "d/x g/x h/x i/x f/x" else k) for p, _, n, k in rows if n} == got
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(
    "run",
    [
        near_duplicates.joined,
        near_duplicates.one_of_each,
        passages.digests,
        passages.deduplicated,
        long_repeats.digests,
        rules.with_statistics,
        lambda d: packing.pieces(d, public_tokenizers.path("word_bpe_49k.json")),
        lambda d: language.predict(d, language.fit(d)),
        lambda d: bpe.digests(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    ],
)
def test_empty_tables_and_null_ids(spark, run):
    empty = documents(spark, [(1, "x")]).where("false")
    assert run(empty).count() == 0
    odd = documents(spark, [(None, "some words that stand here twice " * 20), (None, None), (4, None)])
    assert run(odd).count() == 3
