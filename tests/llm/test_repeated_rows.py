"""Rows that repeat an id with another text, rows without an id or a label, and columns whose names clash."""

import random

import pytest
from pyspark.sql import functions as F

from affiche.llm import language, long_repeats, near_duplicates, packing, passages, rules, sharding
from tests.llm import brute
from tests.llm.tables import CLASHING, documents


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


A, B = prose(1, 120), prose(2, 120)


def test_passages_of_rows_that_share_an_id(spark):
    """The second row of id 6 shares nothing with a smaller id and keeps every word."""
    rows = [(5, A), (6, A), (6, B), (7, B + " " + A), (None, A), (None, B), (8, "x " + B)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in passages.digests(documents(spark, rows)).collect()), key=repr)
    want = [(5, 120, 0), (6, 120, 120), (6, 120, 0), (7, 240, 240), (None, 120, 0), (None, 120, 0), (8, 121, 120)]
    assert got == sorted(want, key=repr)
    kept = passages.deduplicated(documents(spark, rows, CLASHING))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(5, A), (6, B), (None, A), (None, B), (8, "x")], key=repr
    )


def test_texts_of_passages_are_shuffled_once(spark, plan_of):
    out = passages.digests(documents(spark, [(k, A) for k in range(50)]))
    out.collect()
    plan = plan_of(out)
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert "ReusedExchange" in final


@pytest.mark.parametrize(
    "run",
    [
        passages.deduplicated,
        near_duplicates.one_of_each,
        sharding.shard,
        lambda d: sharding.numbered(d, ["doc_id"]),
        lambda d: rules.with_statistics(d.drop("n_words")),
        lambda d: language.predict(d, language.fit(d)),
        lambda d: packing.pack(d.withColumn("length", F.lit(3)), 8),
    ],
)
def test_clashing_columns_come_through(spark, run):
    # ``score`` is what the language prediction adds, in place of a column of that name.
    names = [*(c for c in CLASHING if c != "score"), "deal", "places_", "keys_", "letter", "_letter", "salt", "n", "before", "number", "to", "_to", "owner", "lang_hash"]
    names += ["tie", "_tie", "part", "_part", "place", "_place", "_row", "words", "_words", "lines", "_lines", "windows", "_windows", "_kept", "_rank"]
    docs = documents(spark, [(1, A), (2, B), (3, None), (None, A), (4, "")], names)
    out = run(docs)
    same = [c for c in names if c != "n_words"]
    assert set(docs.columns) <= set(out.columns)
    assert docs.select("doc_id", *same).exceptAll(out.select("doc_id", *same)).count() == 0


def test_labels_of_rows_that_share_an_id(spark):
    rows = [(1, "the house of the", "en"), (1, "la maison de la", None), (1, "das haus von dem", "de"), (2, None, "en"), (None, "x y", "fr")]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["de", "en"]
    got = {(r["text"], r["lang_pred"]) for r in language.predict(docs, model).collect()}
    assert {("the house of the", "en"), ("das haus von dem", "de"), (None, "und")} <= got


def test_no_more_rows_than_asked_for(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") % 50 > 0, "a").otherwise("b").alias("lang"))
    counts = {r["lang"]: r["count"] for r in language.chosen(docs, 60).groupBy("lang").count().collect()}
    assert counts == {"a": 60, "b": 60}


def test_brute_force_passages_with_null_and_repeated_rows(spark):
    rng = random.Random(3)
    pool = [prose(10 + k, 30) for k in range(6)]
    rows = [(rng.randrange(12), " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 4)))) for _ in range(40)]
    unique = [(100 + k, t) for k, (_, t) in enumerate(rows)]
    assert {r["doc_id"]: tuple(r)[1:] for r in passages.digests(documents(spark, unique)).collect()} == brute.passages(unique)
    got = sorted((tuple(r) for r in passages.digests(documents(spark, rows)).collect()))
    want = []
    for i, t in rows:
        others = [(k, x) for k, x in rows if k < i]
        want.append((i, *brute.passages([*((k - 1000, x) for k, x in others), (i, t)])[i]))
    assert got == sorted(want)


def test_long_repeats_of_rows_that_share_an_id(spark):
    """Unique texts stay whole whatever else their id holds; rows without an id count as another place."""
    c, d, e = (prose(20 + k, 200) for k in range(3))
    rows = [(5, c), (5, d), (6, c), (None, e), (7, "x" + e), (8, d[:300]), (9, A), (9, A), (None, None)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in long_repeats.digests(documents(spark, rows, CLASHING)).collect()), key=repr)
    n, m, k = len(c), len(d), len(e)
    want = [(5, n, n), (5, m, 0), (6, n, n), (None, k, k), (7, k + 1, k), (8, 300, 0), (9, len(A), len(A)), (9, len(A), len(A)), (None, 0, 0)]
    assert got == sorted(want, key=repr)


def test_texts_of_long_repeats_are_shuffled_once(spark, plan_of):
    out = long_repeats.digests(documents(spark, [(k, A + " " + prose(k, 50)) for k in range(30)]))
    out.collect()
    assert "ReusedExchange" in plan_of(out).split("== Initial Plan ==")[0]
