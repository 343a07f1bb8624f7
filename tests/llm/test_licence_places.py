"""op10 over documents that lie in three levels of directories."""

from affiche.llm.queries import op10_licence_scan

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
PROSE = "the house stands at the end of a long road and nobody has seen who lives in it"


def scanned(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, path string, licence string"
    docs = spark.createDataFrame([(*row, "p", "l") for row in rows], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    return op10_licence_scan(spark, str(folder)).collect()


def test_the_nearest_directory_above_gives_its_licence(spark, tmp_path):
    rows = [
        (1000, MIT, "en", "web"),  # in web
        (100, APACHE, "en", "web"),  # in web/en
        (7, PROSE, "en", "web"),  # in web/en/0
        (2007, PROSE, "fr", "web"),  # in web/fr/2
        (3010, f"{PROSE}\n{MIT}", "en", "web"),  # licence file of web/en/3
        (3011, PROSE, "en", "web"),
        (3012, f"{PROSE}\n{APACHE}", "en", "web"),  # states its own
        (3013, PROSE, "en", "books"),
        (4, MIT, None, "books"),  # no licence file
        (5, PROSE, None, "books"),
    ]
    got = {r["doc_id"]: (r["licence"], r["origin"], r["source"] and r["source"].split("-")[0]) for r in scanned(spark, tmp_path, rows)}
    assert got == {
        1000: ("MIT", "own", "web/1000"),
        100: ("Apache-2.0", "own", "web/en/100"),
        7: ("Apache-2.0", "inherited", "web/en/100"),
        2007: ("MIT", "inherited", "web/1000"),
        3010: ("MIT", "own", "web/en/3/3010"),
        3011: ("MIT", "inherited", "web/en/3/3010"),
        3012: ("Apache-2.0", "own", "web/en/3/3012"),
        3013: (None, None, None),
        4: ("MIT", "own", "books/none/0/4"),
        5: (None, None, None),
    }


def test_every_row_is_returned(spark, tmp_path):
    rows = [
        (None, MIT, "en", "web"),
        (None, None, None, None),
        (None, None, None, None),
        (20, PROSE, "en", ""),
        (20, MIT, "en", ""),
        (20, MIT, "en", ""),
        (21, "", "en", ""),
        (1000, None, "en", "web"),
    ]
    got = sorted(str((r["doc_id"], r["licence"], r["origin"])) for r in scanned(spark, tmp_path, rows))
    assert got == sorted(
        map(
            str,
            [
                (None, "MIT", "own"),
                (None, None, None),
                (None, None, None),
                (20, "MIT", "inherited"),
                (20, "MIT", "own"),
                (20, "MIT", "own"),
                (21, "MIT", "inherited"),
                (1000, None, None),
            ],
        )
    )


def test_no_documents(spark, tmp_path):
    assert scanned(spark, tmp_path, []) == []
