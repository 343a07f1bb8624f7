"""Event blocks of a page: candidate groups, the best group, the items of it.

A page may show its events in one of three ways: blocks hit by a known
selector, blocks that share their classes, or plain articles and cards. Each
way gives candidate groups, the first way with a group of some size wins.
A page arrives as one row with all its blocks, so the choice is made on that
row: no shuffle, and two snapshots that share an id stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affiche.functions import lexicon
from affiche.functions.text import blank_to_null, strip, summary_cut
from affiche.sources.pages import page_blocks

# The three ways in the order they are tried.
SELECTOR, SHARED_CLASSES, FALLBACK = 1, 2, 3


def class_key(classes: Column) -> Column:
    """Same classes, same key, whatever their order on the page."""
    return F.array_join(F.sort_array(classes), " ")


def is_kept(chars: Column, in_nav: Column) -> Column:
    return (chars > lexicon.MIN_BLOCK_CHARS) & ~in_nav


def group_score(n: Column, avg_chars: Column, has_heading: Column, has_link: Column) -> Column:
    """Many, long, titled and linked blocks score high."""
    return (
        n
        * F.sqrt(avg_chars)
        * F.when(has_heading, 2.0).otherwise(1.0)
        * F.when(has_link, 1.5).otherwise(1.0)
    )


def class_group_array(elements: Column) -> Column:
    """The groups of one page: an array of structs (below, first_ix, group), the best group being the smallest.

    ``elements``: the kept elements as an array of structs with class_key, ix, chars, has_heading, has_link.
    Groups of one are left out. ``below`` is the negated score; of equal scores the first on the page is
    the better one, then the smaller class key.
    """

    def measured(members: Column) -> Column:
        chars = F.aggregate(members, F.lit(0).cast("long"), lambda total, e: total + e["chars"])
        return F.struct(
            F.get(members, F.lit(0))["class_key"].alias("class_key"),
            F.size(members).cast("long").alias("n"),
            (chars / F.size(members)).alias("avg_chars"),
            F.exists(members, lambda e: e["has_heading"]).alias("has_heading"),
            F.exists(members, lambda e: e["has_link"]).alias("has_link"),
            F.array_min(F.transform(members, lambda e: e["ix"])).alias("first_ix"),
            members.alias("members"),
        )

    def scored(group: Column) -> Column:
        score = group_score(*[group[c] for c in ("n", "avg_chars", "has_heading", "has_link")])
        return F.struct((-score).alias("below"), group["first_ix"].alias("first_ix"), group.alias("group"))

    keys = F.array_distinct(F.transform(elements, lambda e: e["class_key"]))
    by_key = F.transform(keys, lambda key: F.filter(elements, lambda e: e["class_key"] == key))
    several = F.filter(by_key, lambda members: F.size(members) >= lexicon.MIN_BLOCKS)
    return F.transform(F.transform(several, measured), scored)


def _page_groups(elements: DataFrame, *page: str) -> DataFrame:
    """One row per page with its class groups; the elements of one page meet in one row, as in a page snapshot."""
    kept = F.struct("class_key", "ix", "chars", "has_heading", "has_link")
    return (
        elements.filter(is_kept(F.col("chars"), F.col("in_nav")))
        .groupBy(*page)
        .agg(F.collect_list(kept).alias("__elements"))
        .select(*page, class_group_array(F.col("__elements")).alias("__groups"))
    )


_GROUP_FIELDS = ("class_key", "n", "avg_chars", "has_heading", "has_link", "first_ix")


def class_groups(elements: DataFrame, *page: str) -> DataFrame:
    """Statistics of the kept elements per page and class key; groups of one are left out.

    ``elements``: page columns, class_key, ix, chars, in_nav, has_heading, has_link.
    """
    each = _page_groups(elements, *page).select(*page, F.explode("__groups").alias("g"))
    return each.select(*page, *[F.col(f"g.group.{c}").alias(c) for c in _GROUP_FIELDS], (-F.col("g.below")).alias("score"))


def best_class_group(elements: DataFrame, *page: str) -> DataFrame:
    """The top-scoring class group of each page, the first one on the page among equals."""
    best = _page_groups(elements, *page).select(*page, F.array_min("__groups").alias("g")).filter("g is not null")
    return best.select(*page, *[F.col(f"g.group.{c}").alias(c) for c in _GROUP_FIELDS], (-F.col("g.below")).alias("score"))


def _selector_hit(block: Column, selector: str) -> Column:
    tag, _, name = selector.partition(".")
    tests = []
    if tag:
        tests.append(block["tag"] == tag)
    if name:
        tests.append(F.coalesce(F.array_contains(block["classes"], name), F.lit(False)))
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def event_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, pieces, paras, way, block): the blocks of the winning group of each page."""
    page = ["page_id", "url", "pieces", "paras"]
    kept = page_blocks(pages).select(
        *page,
        F.filter(F.coalesce("blocks", F.array()), lambda b: is_kept(b["chars"], b["in_nav"])).alias("kept"),
    )
    classed = F.filter("kept", lambda b: b["tag"].isin(lexicon.GROUPED_TAGS) & b["classes"].isNotNull())
    element = F.transform(
        classed,
        lambda b: F.struct(
            class_key(b["classes"]).alias("class_key"),
            *[b[c].alias(c) for c in ("ix", "chars", "has_heading", "has_link")],
            b.alias("block"),
        ),
    )

    def by_selector(way: int, selector: str) -> Column:
        hits = F.filter("kept", lambda b: _selector_hit(b, selector))
        return F.when(F.size(hits) >= lexicon.MIN_BLOCKS, F.struct(F.lit(way).alias("way"), hits.alias("blocks")))

    # Null where no classes are shared; every listed group has members enough.
    shared = F.get(
        F.transform(
            F.array_compact(F.array(F.array_min(class_group_array(F.col("elements"))))),
            lambda best: F.struct(
                F.lit(SHARED_CLASSES).alias("way"), F.transform(best["group"]["members"], lambda e: e["block"]).alias("blocks")
            ),
        ),
        F.lit(0),
    )
    # Tried one after the other: a page whose blocks the first selector hits is not searched for the others.
    tries = [
        *[by_selector(SELECTOR, s) for s in lexicon.BLOCK_SELECTORS],
        shared,
        *[by_selector(FALLBACK, s) for s in lexicon.FALLBACK_SELECTORS],
    ]
    chosen = kept.withColumn("elements", element).select(*page, F.coalesce(*tries).alias("chosen"))
    return chosen.select(*page, F.col("chosen.way").alias("way"), F.explode("chosen.blocks").alias("block"))


def _text(pieces: Column, where: Column, joint: str) -> Column:
    return F.array_join(F.slice(pieces, where["start"] + 1, where["stop"] - where["start"]), joint)


def item_columns(blocks: DataFrame) -> DataFrame:
    """(page_id, url, way, item_ix, title, full_text, link, desc_text, para_text); untitled blocks left out.

    ``para_text`` is the first paragraph of some length that does not repeat the title. Lengths
    decide first, so hardly any paragraph but the chosen one is put together.
    """
    pieces, block, title = F.col("pieces"), F.col("block"), F.col("title")
    own_paras = F.slice(
        "paras", block["paras"]["start"] + 1, block["paras"]["stop"] - block["paras"]["start"]
    )
    real = F.filter(
        own_paras,
        lambda p: (p["chars"] > lexicon.MIN_PARAGRAPH_CHARS)
        & ((p["chars"] != F.length(title)) | (_text(pieces, p, "") != title)),
    )
    titled = blocks.withColumn("title", blank_to_null(_text(pieces, block["title"], ""))).filter(
        title.isNotNull()
    )
    return titled.withColumn("para", F.get(real, F.lit(0))).select(
        "page_id",
        "url",
        "way",
        block["ix"].alias("item_ix"),
        "title",
        _text(pieces, block["text"], " ").alias("full_text"),
        block["link"].alias("link"),
        _text(pieces, block["summary"], "").alias("desc_text"),
        _text(pieces, F.col("para"), "").alias("para_text"),
    )


def event_items(pages: DataFrame) -> DataFrame:
    return item_columns(event_blocks(pages))


def summary(title: Column, desc_text: Column, para_text: Column) -> Column:
    """The described summary unless it repeats the title, else the first real paragraph; 300 characters."""
    described = F.when((desc_text != "") & (desc_text != title), desc_text)
    return strip(summary_cut(F.coalesce(described, para_text)))
