"""The physical plans the jobs rely on at scale."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from affiche.operators import blocks, dedup, discovery, filters, paging, rollups
from affiche.plans.build import family_events, found_activities
from affiche.schema import NEW_ACTIVITY
from affiche.sources import registry, store
from affiche.sources.pages import read_pages
from affiche.sources.settle import written
from verification import views


@pytest.fixture(scope="module")
def activities(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "store")
    rows = [
        (f"t{i}", None, None, "mjc", 5, 10, f"2026-01-{i % 28 + 1:02d}", None, None, "Lyon", "u") for i in range(50)
    ]
    store.append(path, spark.createDataFrame(rows, NEW_ACTIVITY), "1")
    return store.read_store(spark, path)


def test_filters_reach_the_scan(activities, plan_of):
    found = filters.filter_activities(activities, "mjc", "Lyon", "2026-01-02", "2026-01-20", 7)
    plan = plan_of(found.select("title"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    for part in ("EqualTo(category,mjc)", "EqualTo(city,Lyon)", "Or(GreaterThanOrEqual(event_date", "LessThanOrEqual(age_min,7)"):
        assert part in pushed
    assert "summary" not in plan.split("ReadSchema")[1]


def test_page_is_a_top_k(activities, plan_of):
    plan = plan_of(paging.page_rows(activities, 2))
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_first_wins_cuts_before_the_shuffle(activities, plan_of):
    plan = plan_of(dedup.first_activities(activities, ["source_url", "id"]))
    assert re.search(r"row_number\(\), 1, Partial", plan) and re.search(r"row_number\(\), 1, Final", plan)
    cap = plan_of(discovery.cap_pages(activities.withColumnRenamed("title", "page_url"), "city"))
    assert re.search(r"row_number\(\), 50, Partial", cap)


def test_status_counts_the_table_once(activities, plan_of):
    plan = plan_of(rollups.status_counts(activities))
    assert plan.count("FileScan") == 1
    # the grouping sets expand the small result, above the first aggregation
    assert plan.index("Expand") < plan.index("HashAggregate", plan.index("Expand"))


def test_page_blocks_need_no_shuffle(spark, plan_of):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    plan = plan_of(blocks.event_items(pages))
    assert "Exchange" not in plan and "Sort" not in plan
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("many_sites", [False, True])
def test_html_is_not_shuffled(spark, plan_of, tmp_path, many_sites):
    rows = [(n, f"https://s{n}.fr/", "<nav><a href='/agenda'>Agenda</a></nav>") for n in range(50)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    pages = read_pages(spark, str(tmp_path / "pages"))
    sites = registry.sites(spark)
    if many_sites:
        urls = spark.range(10_000).select(F.concat(F.lit("https://s"), "id", F.lit(".fr/")).alias("url"))
        sites = written(urls.select(F.lit("mjc").alias("category"), F.lit("Ici").alias("city"), "url", F.lit(0).alias("category_ord"), F.lit(0).alias("city_ord")))
    for plan in (plan_of(discovery.discover(sites, pages)), plan_of(found_activities(pages, sites))):
        lines = plan.splitlines()
        scan = next(n for n, line in enumerate(lines) if "FileScan" in line and "html" in line)
        reader = max(n for n in range(scan) if "MapInArrow" in lines[n])
        indent = lines[scan].index("FileScan")
        above = [line for line in lines[reader:scan] if re.search(r"[A-Z]", line) and re.search(r"[A-Z]", line).start() < indent]
        assert not any("Exchange" in line for line in above), plan


def test_item_rules_stay_on_the_jvm(spark, plan_of):
    items = spark.createDataFrame([("t", "x")], "title string, full_text string")
    plan = plan_of(family_events(items))
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_undated_rows_stay_out_of_the_join(activities, plan_of):
    fresh = store.insert_if_absent(activities.select(*NEW_ACTIVITY.names), activities)
    plan = plan_of(fresh)
    assert "LeftAnti" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_the_rules_of_listings_are_no_whole_stage_method(spark, tmp_path, plan_of):
    orders = [(k, 1, dt.datetime(1995, 1, 1 + k)) for k in range(20)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    customer = spark.createDataFrame([(1, "C", 7, "S")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, "NATION_7")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    found = views.activities(spark, str(tmp_path))
    assert found.count() == len(found.collect()) == 20
    rules = [line for line in plan_of(found).splitlines() if "Project" in line and "lpad(" in line]
    assert rules and not any(re.search(r"\*\([0-9]+\) Project", line) for line in rules)


def test_orders_of_days_are_the_semi_join_of_their_listings(spark, tmp_path, plan_of):
    day = [dt.datetime(1995, 1, n) for n in range(1, 5)]
    orders = [(1, 1, day[0]), (1, 1, day[3]), (2, 1, day[3]), (3, 1, None), (None, 1, day[0]), (4, 1, day[1]), (4, 1, day[1])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    early = views.orders_of_days(spark, str(tmp_path), "1995-01-03")
    assert sorted(tuple(r) for r in early.collect()) == [(1, 1, day[0]), (1, 1, day[3]), (4, 1, day[1]), (4, 1, day[1])]
