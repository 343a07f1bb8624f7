"""Versions of pages (newest snapshot, buckets), of sitemaps (trees) and of the store (manifest, hashes, counts)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from affiche.operators import discovery, rollups
from affiche.plans.build import found_activities
from affiche.plans.load import load_activities
from affiche.sources import manifest, pages, registry, snapshots, store
from tests.test_store import rows_of

FETCHED = "page_id long, url string, html string, status int, fetched_at timestamp"


def day(n):
    return dt.datetime(2026, 1, n)


def ids(df, name="page_id"):
    return sorted(r[name] for r in df.collect())


# ---- newest snapshots


def test_newest_snapshot_of_each_url(spark):
    rows = [
        (1, "a", "old", 200, day(1)), (2, "a", "new", 200, day(2)), (3, "a", "failed", 500, day(3)),
        (4, "b", "unknown", 200, None), (5, "b", "known", None, day(1)),
        (6, "c", "x", 200, None), (7, "c", "y", 200, None),
        (8, "d", None, 200, day(1)), (9, "d", "", 200, day(1)),
        (10, None, "no url", 200, day(1)), (11, "e", "same", 200, day(1)), (11, "e", "same", 200, day(1)),
    ]
    found = pages.newest(pages.successful(spark.createDataFrame(rows, FETCHED)))
    assert ids(found) == [2, 5, 7, 9, 11, 11]
    assert found.columns == ["page_id", "url", "html", "status", "fetched_at"]
    assert pages.newest(spark.createDataFrame([], FETCHED)).count() == 0


def test_read_newest_of_older_files(spark, tmp_path):
    """Files from before fetch times were kept: the larger number is the newer page."""
    folder = str(tmp_path / "pages")
    spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "page_id long, url string, html string").write.parquet(folder)
    found = pages.read_newest(spark, folder)
    assert [tuple(r) for r in found.collect()] == [(2, "a", "y")]


def test_only_the_newest_page_is_loaded(spark, tmp_path):
    event = "<article class='event'><h2>Spectacle numéro {0}</h2><p>le 1{0}/5/2026 pour tous, en famille</p></article>"
    home = '<nav><a href="/agenda">Agenda</a></nav>'
    rows = [
        (1, "https://a.fr/", home, 200, day(1)),
        (2, "https://a.fr/agenda", event.format(3) + event.format(4), 200, day(5)),
        (3, "https://a.fr/agenda", event.format(1) + event.format(2), 200, day(4)),
        (4, "https://a.fr/agenda", event.format(5) + event.format(6), 404, day(6)),
    ]
    sites = spark.createDataFrame([("mjc", "Ici", "https://a.fr/", 0, 0)], registry.SITE_SCHEMA)
    path = str(tmp_path / "store")
    counts = load_activities(spark.createDataFrame(rows, FETCHED), sites, path, "1", dt.date(2026, 3, 1))
    assert counts == (2, 2, 2)
    assert sorted(r["title"][-1] for r in store.read_store(spark, path).collect()) == ["3", "4"]


# ---- buckets


def above_html(plan: str) -> list[str]:
    """The operators between the scan that reads HTML and the page reader (or the top)."""
    lines = plan.splitlines()
    scan = next(n for n, line in enumerate(lines) if "FileScan" in line and "html:string" in line)
    out, indent = [], lines[scan].index("FileScan")
    for line in reversed(lines[:scan]):
        at = next((k for k, c in enumerate(line) if c.isalpha()), 0)
        if at < indent:
            out.append(line.strip())
            indent = at
        if "MapInArrow" in line:
            break
    return out


def test_bucketed_html_is_not_shuffled_for_a_large_agenda(spark, plan_of, tmp_path):
    rows = [(n, f"https://s{n}.fr/", "<p>x</p>", 200, day(1 + n % 2)) for n in range(200)]
    folder = str(tmp_path / "snapshots")
    snapshots.add_snapshots(spark.createDataFrame(rows, FETCHED), folder, 8)
    now = snapshots.current(spark, folder, 8)
    # Ten million agenda rows: too many for a broadcast.
    wanted = spark.range(10_000_000).select(F.concat(F.lit("https://s"), "id", F.lit(".fr/")).alias("url"))
    read = pages.page_blocks(now.join(wanted, "url", "left_semi"))
    plan = plan_of(read)
    above = above_html(plan)
    assert any("SortMergeJoin" in line for line in above), plan
    assert not any("Exchange" in line for line in above), plan
    assert "Bucketed: true" in plan
    assert read.count() == 200


def test_newest_of_many_urls_needs_no_shuffle_of_html(spark, plan_of, tmp_path, monkeypatch):
    """Even when the winners are too many to be broadcast."""
    rows = [(n, f"u{n % 50}", "h", 200, day(1 + n // 50)) for n in range(150)]
    folder = str(tmp_path / "snapshots")
    for crawl in range(3):
        snapshots.add_snapshots(spark.createDataFrame(rows[50 * crawl : 50 * crawl + 50], FETCHED), folder, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = snapshots.current(spark, folder, 8)
        plan = plan_of(pages.page_blocks(now))
        assert not any("Exchange" in line for line in above_html(plan)), plan
        assert ids(now) == list(range(100, 150))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_snapshots_yet(spark, tmp_path):
    folder = str(tmp_path / "it's none")
    assert snapshots.current(spark, folder, 4).count() == 0
    snapshots.add_snapshots(spark.createDataFrame([(1, "a", "x")], "page_id long, url string, html string"), folder, 4)
    assert [tuple(r) for r in snapshots.current(spark, folder, 4).collect()] == [(1, "a", "x")]


def test_html_is_not_shuffled_for_a_derived_site_table(spark, plan_of, tmp_path):
    """Spark cannot tell the size of sites that come out of an aggregation; the agenda search settles their URLs."""
    rows = [(n, f"https://s{n}.fr/", "<nav><a href='/agenda'>Agenda</a></nav>") for n in range(50)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    stored = pages.read_pages(spark, str(tmp_path / "pages"))
    urls = spark.range(3_000_000).select((F.col("id") % 50).alias("k")).groupBy("k").count()
    sites = urls.select(
        F.lit("mjc").alias("category"), F.lit("Ici").alias("city"), F.concat(F.lit("https://s"), "k", F.lit(".fr/")).alias("url"),
        F.lit(0).alias("category_ord"), F.lit(0).alias("city_ord"),
    )
    for df in (discovery.discover(sites, stored), found_activities(stored, sites)):
        assert not any("Exchange" in line for line in above_html(plan_of(df))), plan_of(df)


# ---- sitemap trees


def tree(spark):
    def xml(*locs):
        return "".join(f"<loc>{x}</loc>" for x in locs)

    listed = {
        "r/sitemap.xml": ("r/a.xml", "r/b.xml", "r/agenda/0"),
        "r/a.xml": ("r/c.xml", "r/sitemap.xml", "r/agenda/a", "r/contact"),
        "r/b.xml": ("r/c.xml", "r/b.xml", "r/agenda/b"),
        "r/c.xml": ("r/a.xml", "r/d.xml", "r/agenda/c2", "r/agenda/c1"),
        "r/d.xml": ("r/agenda/d",),
        "s/sitemap.xml": ("r/c.xml",),
        "lost.xml": ("r/agenda/lost",),
    }
    return spark.createDataFrame([(u, xml(*ls)) for u, ls in listed.items()], pages.SITEMAPS)


@pytest.mark.parametrize(
    "levels, of_r, of_s",
    [(0, "0", ""), (1, "0 a b", "c1 c2"), (2, "0 a b c1 c2", "a c1 c2 d"), (3, "0 a b c1 c2 d", "0 a b c1 c2 d"), (9, "0 a b c1 c2 d", "0 a b c1 c2 d")],
)
def test_sitemap_levels(spark, levels, of_r, of_s):
    roots = spark.createDataFrame([("r/sitemap.xml",), ("s/sitemap.xml",), ("t/sitemap.xml",)], "root string")
    if levels == 3:
        of_s = "0 a c1 c2 d"  # s -> c -> a -> sitemap; b is a level further
    rows = discovery.sitemap_pages(tree(spark), roots, levels=levels).collect()
    got = {root: " ".join(sorted(r["page_url"].removeprefix("r/agenda/") for r in rows if r["root"] == root)) for root in ("r/sitemap.xml", "s/sitemap.xml")}
    assert got == {"r/sitemap.xml": of_r, "s/sitemap.xml": of_s}
    assert len(rows) == len({tuple(r) for r in rows})


def test_sitemaps_are_scanned_once(spark):
    """However many levels are followed: their text is not dealt to the level that asks for it."""
    scanned = spark.sparkContext.accumulator(0)

    def counted(row):
        scanned.add(1)
        return row

    rows = tree(spark)
    counting = spark.createDataFrame(rows.rdd.map(counted), rows.schema)
    roots = spark.createDataFrame([("r/sitemap.xml",)], "root string")
    assert discovery.sitemap_pages(counting, roots, levels=2).count() > 0
    assert scanned.value == rows.count()



def test_pages_of_each_sitemap_are_cut(spark):
    roots = spark.createDataFrame([("s/sitemap.xml",)], "root string")
    assert [r["page_url"] for r in discovery.sitemap_pages(tree(spark), roots, n=1).collect()] == ["r/agenda/c1"]


@pytest.mark.parametrize(
    "raw, text",
    [
        ("a&#38;b", "a&b"), ("a&#x26;lt;b", "a&lt;b"), ("&#233;&#xE9;&#Xe9;", "ééé"), ("&#128512;", "😀"), ("&amp;#38;", "&#38;"),
        ("&#0;&#xD800;&#x110000;&#;&#x;", "&#0;&#xD800;&#x110000;&#;&#x;"), ("&#00038;&lt;", "&<"), ("plain", "plain"),
    ],
)
def test_numbered_entities(spark, raw, text):
    rows = spark.createDataFrame([("u", f"<loc>{raw}</loc>")], pages.SITEMAPS)
    assert [r["loc"] for r in pages.sitemap_locations(rows).collect()] == [text]


# ---- the store's versions


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def titles(spark, path, version=None):
    return ids(store.read_store(spark, path, version), "title")


def load(spark, path, name, *words, **more):
    return store.append(path, rows_of(spark, *[{"title": w, **more} for w in words]), name)


def test_readers_stay_on_their_version(spark, path):
    load(spark, path, "1", "A")
    then = store.read_store(spark, path)
    load(spark, path, "2", "A", "B")
    assert titles(spark, path) == ["A", "B"] and titles(spark, path, 2) == ["A"] and titles(spark, path, 1) == []
    assert ids(then, "title") == ["A"]
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, path, 9)
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, path + "-none")


def test_a_load_killed_half_way_is_invisible(spark, path, monkeypatch):
    load(spark, path, "1", "A")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(manifest, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            load(spark, path, "2", "B", "C")
    assert titles(spark, path) == ["A"]
    assert load(spark, path, "2", "B", "C") == 2
    assert sorted(r["id"] for r in store.read_store(spark, path).collect()) == [1, 2, 3]
    gone = manifest.remove(spark, path, keep=1)
    assert len(gone) == 1 and gone[0].startswith("2-")
    assert titles(spark, path) == ["A", "B", "C"] and manifest.numbers(spark, path) == [3]


def test_last_id_and_emptiness_read_no_data(spark, path, monkeypatch):
    store.init_store(spark, path)
    assert store.is_empty(spark, path)
    load(spark, path, "1", "A", "B")

    def read(*_):
        raise AssertionError("stored rows were read")

    monkeypatch.setattr(store, "_rows", read)
    assert manifest.read(spark, path).last_id == 2 and not store.is_empty(spark, path)


def test_second_writer_is_refused(spark, path):
    load(spark, path, "1", "A")
    with pytest.raises(FileExistsError):
        manifest.publish(spark, path, 2, [])
    assert titles(spark, path) == ["A"]


def test_unseen_keys_read_no_stored_rows(spark, path, plan_of, monkeypatch):
    load(spark, path, "1", "A", "B")
    load(spark, path, "2", "C", event_date="2026-05-02")
    read, original = [], store._rows
    monkeypatch.setattr(store, "_rows", lambda s, p, loads: read.append([x.load_ids for x in loads]) or original(s, p, loads))
    assert load(spark, path, "3", "D", "E") == 2
    assert load(spark, path, "4", "A", "F") == 1
    assert load(spark, path, "5", "G", event_date="2027-01-01") == 1
    assert read == [[], [("1",)], []]
    new = rows_of(spark, {"title": "unseen"})
    assert "FileScan" not in plan_of(store.insert_if_absent(new, original(spark, path, [])))


def test_compaction_changes_no_row(spark, path):
    for k in range(5):
        load(spark, path, str(k), "A", f"B{k}", f"C{k}")
        load(spark, path, f"undated {k}", "U", event_date=None)
    before = sorted(map(tuple, store.read_store(spark, path).collect()))
    version = store.compact(spark, path, small=3, keep=2)
    assert sorted(map(tuple, store.read_store(spark, path).collect())) == before
    assert sorted(len(x.load_ids) for x in version.loads) == [1, 1, 1, 7]
    assert store.compact(spark, path, small=1, keep=0) == version
    assert load(spark, path, "new", "A", "B0", "C4", "Z") == 1
    assert store.read_store(spark, path).agg(F.max("id")).first()[0] > max(r[0] for r in before)
    with pytest.raises(ValueError, match="merged"):
        load(spark, path, "1", "A")
    counts = {(r["scope"], r["name"]): r["cnt"] for r in rollups.counts_of_cells(store.cells(spark, path)).collect()}
    whole = {(r["scope"], r["name"]): r["cnt"] for r in rollups.status_counts(store.read_store(spark, path)).collect()}
    assert counts == whole
    manifest.remove(spark, path, keep=1)
    assert store.read_store(spark, path).count() == len(before) + 1


def test_report_from_the_counts_of_loads(spark, path):
    for k in range(3):
        load(spark, path, str(k), "A", f"B{k}", city=f"City {k % 2}", category="mjc" if k else "library")
    kept = rollups.report_of_counts(rollups.counts_of_cells(store.cells(spark, path))).first()
    assert kept == rollups.status_report(store.read_store(spark, path)).first()
    assert rollups.report_of_counts(rollups.counts_of_cells(store.cells(spark, path, 1))).first()["total_activities"] == 0


def test_load_names_of_any_kind(spark, path):
    assert load(spark, path, "../a b/ç=1", "A") == 1
    assert load(spark, path, "../a b/ç=1", "A", "B") == 2
    assert titles(spark, path) == ["A", "B"]
