import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from affiche.llm import lines, queries
from tests.llm.tables import CLASHING, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, chars=20, documents=3):
    """(doc_id, lines, dropped, kept text) of every row; rows of one id are one document, rows without an id too."""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(float("-inf") if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [
            x
            for x in own
            if len(holders.get(key(x), ())) < documents or max(holders[key(x)]) == (float("-inf") if i is None else i)
        ]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = [f"line number {k} of the pool " + "é" * (k % 7) for k in range(40)] + ["short", "", "  \t", "é" * 19, "É" * 20]
    pool += ["x" * 19 + "é", "y" * 20, " \x0by" + "Y" * 19 + "\r", "a\x85" + "b" * 18, "\xa0" + "c" * 19]
    out = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, "\n"), (103, "\n\n" + pool[1]), (104, pool[1].upper() + "\n"), (105, "own line that nobody else has")]
    out += [(200, pool[3]), (200, pool[3]), (200, pool[4] + "\n" + pool[3]), (None, pool[3] + "\nx"), (None, pool[7]), (None, None)]
    out += [(-5, "\n".join([pool[9]] * 3000)), (-(1 << 63), pool[2]), ((1 << 63) - 1, pool[2] + "\nend")]
    return out


@pytest.mark.parametrize("flush", [7, 400_000])
def test_equals_brute_force(spark, rows, monkeypatch, flush):
    monkeypatch.setattr(lines, "FLUSH", flush)
    got = lines.digests(documents(spark, rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_other_limits(spark, rows):
    got = lines.digests(documents(spark, rows), 5, 2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 5, 2)


def test_one_line_everywhere_is_sent_once_a_task(spark):
    docs = documents(spark, [(i, "the same line in all of the documents") for i in range(5000)]).repartition(3)
    asked = lines.hashed(docs, 20, 3)
    assert asked.where("not gone").count() == 3
    assert {r["n_dropped"] for r in lines.digests(docs).where("doc_id < 4999").collect()} == {1}
    assert lines.digests(docs).where("doc_id = 4999").first()["n_dropped"] == 0


def test_keys_longer_than_a_batch_are_streamed(spark, monkeypatch):
    """One entry a document: the key's run goes on over many Arrow batches."""
    monkeypatch.setattr(lines, "FLUSH", 1)
    rows = [(i, "the same line in all of the documents\nand more") for i in range(1500)]
    got = lines.digests(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_texts_and_other_columns_come_through(spark, rows):
    docs = documents(spark, rows, CLASHING)
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == sorted(((i, h) for i, _, _, h in brute(rows)), key=repr)
    want = docs.drop("text").exceptAll(out.drop("text")).count() + out.drop("text").exceptAll(docs.drop("text")).count()
    assert want == 0
    assert out.where("text is null").count() == docs.where("text is null").count()


def test_bitmaps_hold_the_lines_that_stay(spark):
    rows = [(i, "own\nthe line that all of them hold\nlast") for i in range(4)]
    out = {r["doc_id"]: lines.kept_lines("own\nthe line that all of them hold\nlast", bytes(r["keep"])) for r in lines.keep_bitmaps(documents(spark, rows)).collect()}
    assert out == dict.fromkeys(range(3), (3, 1, "own\nlast"))


def test_long_text(spark):
    """Several megabytes in one row, half of its lines repeated elsewhere."""
    many = [f"a line of some length with the number {k}" for k in range(60_000)]
    rows = [(1, "\n".join(many)), (2, "\n".join(many[::2])), (3, "\n".join(many[::4]))]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.digests(documents(spark, rows)).collect()}
    assert got == {1: (60_000, 15_000), 2: (30_000, 15_000), 3: (15_000, 0)}


def test_empty_table(spark):
    empty = documents(spark, [], CLASHING)
    assert lines.digests(empty).count() == 0 and lines.deduplicated(empty).columns == empty.columns


def test_given_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(queries.ORACLES["op11_line_dedup"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.QUERIES["op11_line_dedup"](spark, sf).collect())
    assert sum(r[2] for r in want) > 100
