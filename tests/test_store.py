import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from affiche.operators import filters, paging, rollups
from affiche.plans.load import load_activities
from affiche.schema import ACTIVITY, NEW_ACTIVITY, READ_COLUMNS
from affiche.sources import registry, store
from affiche.sources.pages import read_pages
from affiche.streaming.incremental import load_snapshots

DEFAULTS = dict(
    summary=None, link=None, category="mjc", age_min=5, age_max=10, event_date="2026-05-01",
    event_time=None, price=None, city="Lyon", source_url="https://example.com/1",
)


def rows_of(spark, *rows):
    full = [{**DEFAULTS, **row} for row in rows]
    nullable = NEW_ACTIVITY.__class__([type(f)(f.name, f.dataType, True) for f in NEW_ACTIVITY])
    return spark.createDataFrame([[r[n] for n in NEW_ACTIVITY.names] for r in full], nullable)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def stored(spark, path):
    return store.read_store(spark, path)


def test_create_if_absent(spark, path):
    store.init_store(spark, path)
    assert rollups.is_empty(stored(spark, path))
    assert stored(spark, path).columns == ACTIVITY.names
    store.append(path, rows_of(spark, {"title": "A"}), "1")
    store.init_store(spark, path)
    assert stored(spark, path).count() == 1


def test_insert_and_read(spark, path):
    batch = rows_of(
        spark,
        {"title": "Atelier Lecture", "category": "library", "city": "Lyon", "event_date": "2026-04-15"},
        {"title": "Spectacle Marionnettes", "category": "theatre", "city": "Grenoble", "event_date": "2026-04-20"},
    )
    assert store.append(path, batch, "1") == 2
    page, total = paging.read_page(stored(spark, path))
    assert total.first()["total"] == 2
    assert [r["title"] for r in page.collect()] == ["Atelier Lecture", "Spectacle Marionnettes"]
    assert page.columns == READ_COLUMNS


def test_same_row_twice(spark, path):
    batch = rows_of(spark, {"title": "Atelier Peinture"})
    assert [store.append(path, batch, "1"), store.append(path, batch, "2")] == [1, 0]
    assert stored(spark, path).count() == 1


def test_undated_rows_are_stored_again(spark, path):
    batch = rows_of(spark, {"title": "A", "event_date": None}, {"title": "B"}, {"title": "A", "event_date": None})
    store.append(path, batch, "1")
    store.append(path, batch, "2")
    assert stored(spark, path).count() == 5
    assert store.append(path, batch, "3", null_safe=True) == 0


def test_null_safe_load(spark, path):
    batch = rows_of(spark, {"title": "A", "event_date": None}, {"title": "A", "event_date": None})
    assert store.append(path, batch, "1", null_safe=True) == 1


def test_repeated_load_overwrites_itself(spark, path):
    batch = rows_of(spark, {"title": "A", "event_date": None}, {"title": "B"})
    store.append(path, batch, "1")
    store.append(path, batch, "2")
    before = sorted(map(tuple, stored(spark, path).drop("created_at").collect()), key=repr)
    assert store.append(path, batch, "2") == 1
    assert sorted(map(tuple, stored(spark, path).drop("created_at").collect()), key=repr) == before


def test_required_columns(spark, path):
    batch = rows_of(spark, {"title": "A", "city": None}, {"title": None}, {"title": "B"}, {"title": "C", "source_url": None})
    assert store.append(path, batch, "1") == 1


def test_first_row_of_a_key_wins(spark, path):
    store.append(path, rows_of(spark, {"title": "A", "price": "5€"}), "1")
    store.append(path, rows_of(spark, {"title": "A", "price": "9€"}, {"title": "A", "price": "9€", "city": "Metz"}), "2")
    assert {(r["city"], r["price"]) for r in stored(spark, path).collect()} == {("Lyon", "5€"), ("Metz", "9€")}


def test_first_row_of_a_batch_wins(spark, path):
    batch = rows_of(spark, {"title": "A", "summary": "zz first"}, {"title": "A", "summary": "aa second"}).coalesce(1)
    assert store.append(path, batch, "1") == 1
    assert [r["summary"] for r in stored(spark, path).collect()] == ["zz first"]


def test_crawl_order_decides_within_a_batch(spark, path):
    rows = rows_of(spark, {"title": "A", "summary": "late"}, {"title": "A", "summary": "early"})
    ordered = rows.withColumns(
        {"category_ord": F.when(F.col("summary") == "late", 2).otherwise(1), "city_ord": F.lit(0), "item_ix": F.lit(0)}
    )
    assert store.append(path, ordered, "1") == 1
    assert [r["summary"] for r in stored(spark, path).collect()] == ["early"]


def test_ids_are_unique_and_grow(spark, path):
    def batch(word, n):
        return rows_of(spark, *[{"title": f"{word} {i}"} for i in range(n)]).repartition(3)

    store.append(path, batch("a", 40), "1")
    first = [r["id"] for r in stored(spark, path).collect()]
    store.append(path, batch("b", 30), "2")
    ids = {r["title"]: r["id"] for r in stored(spark, path).collect()}
    assert sorted(first) == list(range(1, 41))
    assert len(set(ids.values())) == 70
    assert min(i for t, i in ids.items() if t.startswith("b")) > max(first)


def test_hot_city_is_split_over_files(spark, path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.append(path, rows_of(spark, *[{"title": f"t{i}"} for i in range(400)]), "1")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = stored(spark, path).groupBy(F.input_file_name()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 400


# ---- reads


def table(spark):
    rng = random.Random(7)
    dates = [None, None, "2026-01-05", "2026-01-06", "2025-12-31", "2026-99-99"]
    rows = [
        (
            i, f"t{i}", None, None, rng.choice(["library", "mjc"]), rng.choice([None, 3, 6]), rng.choice([8, 12]),
            rng.choice(dates), rng.choice([None, "09:00", "14:30"]), None, rng.choice(["Lyon", "Évry", "lyon"]), "u", None,
        )
        for i in rng.sample(range(100_000), 500)
    ]
    return spark.createDataFrame(rows, ACTIVITY), [dict(zip(ACTIVITY.names, r)) for r in rows]


def in_order(rows):
    def key(value):
        return (value is not None, value or "")

    return sorted(rows, key=lambda r: (key(r["event_date"]), key(r["event_time"]), r["id"]))


@pytest.mark.parametrize(
    "chosen",
    [
        {}, {"category": "mjc"}, {"city": "Lyon"}, {"city": ""}, {"date_from": "2026-01-06"}, {"date_to": "2026-01-05"},
        {"age": 7}, {"age": 0}, {"category": "library", "city": "Évry", "date_from": "2026-01-01", "age": 9},
    ],
)
def test_filters(spark, chosen):
    frame, rows = table(spark)

    def keeps(r):
        c, day = chosen, r["event_date"]
        return (
            (not c.get("category") or r["category"] == c["category"])
            and (not c.get("city") or r["city"] == c["city"])
            and (not c.get("date_from") or day is None or day >= c["date_from"])
            and (not c.get("date_to") or day is None or day <= c["date_to"])
            and ("age" not in c or (r["age_min"] is not None and r["age_min"] <= c["age"] <= r["age_max"]))
        )

    want = [r["id"] for r in in_order(filter(keeps, rows))]
    page, total = paging.read_page(frame, page=2, per_page=30, **chosen)
    assert total.first()["total"] == len(want)
    assert [r["id"] for r in page.collect()] == want[30:60]


def test_pages_at_every_depth(spark):
    frame, rows = table(spark)
    want = in_order(rows)
    for number in (1, 29, 50, 51):
        page = [r["id"] for r in paging.page_rows(frame, number, 10).collect()]
        assert page == [r["id"] for r in want[(number - 1) * 10 : number * 10]], number
    for place in (0, 9, 180, 320, 499):  # null and known dates and times
        last = want[place]
        after = paging.rows_after(frame, last["event_date"], last["event_time"], last["id"], 10)
        assert [r["id"] for r in after.collect()] == [r["id"] for r in want[place + 1 : place + 11]], place


def test_response(spark):
    frame, rows = table(spark)
    answer = paging.response(frame, page=2, per_page=5, category="mjc").first()
    want = in_order(r for r in rows if r["category"] == "mjc")
    assert [a["id"] for a in answer["activities"]] == [r["id"] for r in want[5:10]]
    assert (answer["total"], answer["page"], answer["per_page"]) == (len(want), 2, 5)
    assert list(answer["activities"][0].asDict()) == READ_COLUMNS
    beyond = paging.response(frame, page=99, per_page=100).first()
    assert beyond["activities"] == [] and beyond["total"] == 500


@pytest.mark.parametrize("bad", [{"age": 0}, {"age": 19}, {"page": 0}, {"per_page": 0}, {"per_page": 101}])
def test_argument_limits(bad):
    with pytest.raises(ValueError):
        filters.check_arguments(**bad)
    filters.check_arguments(age=18, page=1, per_page=100)


def test_rollups(spark):
    frame, rows = table(spark)
    report = rollups.status_report(frame).first()
    assert report["total_activities"] == 500
    for name, counts in (("category", report["by_category"]), ("city", report["by_city"])):
        assert counts == {v: sum(r[name] == v for r in rows) for v in {r[name] for r in rows}}
    assert [r["city"] for r in rollups.distinct_values(frame, "city").collect()] == ["Lyon", "lyon", "Évry"]
    union = [r["city"] for r in rollups.with_configured(frame, registry.cities(spark), "city").collect()]
    assert union == sorted({*registry.CITIES, "Lyon", "lyon", "Évry"})


def test_rollups_of_an_empty_table(spark):
    frame = spark.createDataFrame([], ACTIVITY)
    report = rollups.status_report(frame).first()
    assert (report["total_activities"], report["by_category"], report["by_city"]) == (0, {}, {})
    assert rollups.total(frame).first()["total"] == 0


# ---- whole runs


def test_load_counts(spark, path, tmp_path):
    event = "<article class='event'><h2>{0}</h2><p>le 11/5/2026 pour tous, en famille</p></article>"
    home = '<nav><a href="/agenda">Agenda</a></nav>'
    body = "".join(map(event.format, ["Spectacle du soir", "Spectacle DU soir", "Conte du matin"]))
    rows = [(1, "https://a.fr/", home, 200), (2, "https://a.fr/agenda", body, 200), (3, "https://b.fr/", body, 404)]
    folder = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string, status int").write.json(folder)
    pages = read_pages(spark, folder, "json")
    assert pages.count() == 2
    sites = spark.createDataFrame([("mjc", "Ici", "https://a.fr/", 0, 0), ("mjc", "Là", "https://b.fr/", 0, 1)], registry.SITE_SCHEMA)
    day = dt.date(2026, 3, 1)
    assert load_activities(pages, sites, path, "1", day) == (3, 2, 2)
    assert load_activities(pages, sites, path, "2", day) == (3, 2, 0)


# ---- incremental load


def test_incremental_load(spark, tmp_path):
    event = "<article class='event'><h2>Spectacle numéro {0}</h2><p>le 1{0}/5/2026 pour tous, en famille</p></article>"
    home = '<nav><a href="/agenda">Agenda</a></nav>'
    sites = spark.createDataFrame([("mjc", "Ici", "https://a.fr/", 0, 0)], registry.SITE_SCHEMA)
    folder, target, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    ids = itertools.count()

    def crawl(*numbers, status=200):
        body = "".join(event.format(n) for n in numbers)
        rows = [(next(ids), "https://a.fr/", home, 200), (next(ids), "https://a.fr/agenda", body, status)]
        spark.createDataFrame(rows, "page_id long, url string, html string, status int").write.mode("append").parquet(folder)
        load_snapshots(spark, folder, sites, target, progress, as_of=dt.date(2026, 3, 1)).awaitTermination()
        return sorted(r["title"][-1] for r in stored(spark, target).collect())

    assert crawl(1, 2) == ["1", "2"]
    assert crawl(2, 3) == ["1", "2", "3"]
    assert crawl(4, 5, status=500) == ["1", "2", "3"]
    progress = str(tmp_path / "fresh progress")  # starts again at batch 0, which must not replace the stored one
    assert crawl(6, 7) == ["1", "2", "3", "6", "7"]


def test_agenda_pages_of_a_later_run(spark, tmp_path):
    event = "<article class='event'><h2>Spectacle numéro {0}</h2><p>le 1{0}/5/2026 pour tous, en famille</p></article>"
    pages = {
        "https://a.fr/": '<nav><a href="/agenda">Agenda</a></nav>' + event.format(8) + event.format(9),
        "https://a.fr/agenda": event.format(1) + event.format(2),
        "https://a.fr/agenda/ete": event.format(3) + event.format(4),
    }
    sites = spark.createDataFrame([("mjc", "Ici", "https://a.fr/", 0, 0)], registry.SITE_SCHEMA)
    folder, target, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))

    def crawl(*urls, home=None):
        rows = [(n, u, home or pages[u], 200) for n, u in enumerate(urls)]
        spark.createDataFrame(rows, "page_id long, url string, html string, status int").write.mode("append").parquet(folder)
        load_snapshots(spark, folder, sites, target, progress, as_of=dt.date(2026, 3, 1)).awaitTermination()
        return sorted(r["title"][-1] for r in stored(spark, target).collect())

    assert crawl("https://a.fr/") == []
    assert crawl("https://a.fr/agenda", "https://a.fr/agenda/ete") == ["1", "2"]
    # the site page now leads elsewhere: the earlier agenda page counts no more
    assert crawl("https://a.fr/", home='<nav><a href="/agenda/ete">Agenda</a></nav>') == ["1", "2"]
    pages["https://a.fr/agenda"] = event.format(5) + event.format(6)
    assert crawl("https://a.fr/agenda", "https://a.fr/agenda/ete") == ["1", "2", "3", "4"]


# ---- what a load costs


def test_a_load_into_an_empty_store_joins_nothing(spark, path, plan_of):
    store.init_store(spark, path)
    fresh = store.insert_if_absent(rows_of(spark, {"title": "A"}), stored(spark, path))
    assert [r["title"] for r in fresh.collect()] == ["A"]
    assert "Join" not in plan_of(fresh)


def test_keys_meet_by_their_hashes(spark, path, plan_of):
    store.append(path, rows_of(spark, {"title": "A"}, {"title": "A", "event_date": None}), "1")
    batch = rows_of(spark, {"title": "A"}, {"title": "B"}, {"title": "B"}, {"title": "A", "event_date": None})
    for null_safe, left in ((False, ["A", "B"]), (True, ["B"])):
        fresh = store.insert_if_absent(batch, stored(spark, path), null_safe)
        plan = plan_of(fresh)
        assert sorted(r["title"] for r in fresh.collect()) == left and "__key_hash" not in fresh.columns
        assert "LeftAnti" in plan and "__key_hash" in plan and "NestedLoop" not in plan


def test_ids_follow_the_batch_without_gaps_between_its_tasks(spark, path):
    batch = rows_of(spark, *[{"title": f"t{i}"} for i in range(25)]).repartition(7)
    in_order = [r["title"] for r in batch.collect()]
    assert store.append(path, batch, "1") == 25
    assert [r["title"] for r in stored(spark, path).orderBy("id").collect()] == in_order
    counts = spark.read.schema(store.CELLS).parquet(f"{path}/cells").agg(F.sum("n")).first()[0]
    assert counts == 25 and store.append(path, batch, "2") == 0
