import pytest

import __spark_entry__ as entry
from affiche.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op1_", "op3_", "op12_"))])
def test_one_row_for_each_document(spark, name):
    ids = sorted(r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
