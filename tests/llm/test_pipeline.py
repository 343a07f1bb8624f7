import corpus_pipeline
from affiche.llm import language, queries, rules
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(after) <= set(before) and after
            seen.append((before, after))
            docs = spark.createDataFrame(out.collect(), docs.schema)
        else:
            assert {r["doc_id"] for r in out.collect()} == set(before)
    before, after = seen[1]
    assert all(brute.statistics(t)[0] >= 50 for t in after.values())
    before, after = seen[2]
    assert set(after) == {i for i, (_, c) in brute.components(list(before.items())).items() if c == i}
    before, after = seen[3]
    want = brute.passages(list(before.items()))
    assert set(after) == {i for i, (n, gone, _) in want.items() if not n or gone < n}
    for i, text in after.items():
        assert len(brute.words(text)) == want[i][0] - want[i][1]


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(0 < r["length"] <= 2048 for r in out)
    assert [s[0] for s in corpus_pipeline.STAGES] == [
        "language ID",
        "quality rules",
        "n-gram Jaccard join",
        "substring dedup",
        "best-fit packing",
    ]
    assert language.UNKNOWN == "und" and rules.FEATURES
