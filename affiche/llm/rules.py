"""Quality rules learned from labels: text statistics, sequential covering, an ordered Spark expression.

DataFrame operations only: no Python runs on an executor.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affiche.llm.shared import SPACES, settled, text_or_empty, unused

SYMBOLS = "[#*$%&|<>]"
#: What the rules may look at, each worked out from the statistics of ``with_statistics``.
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "dup_line_share", "repeat_share")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds word, symbol, line and repetition counts of the whole text (null text: none of anything).

    Words are runs of anything but ASCII white space. ``n_repeat_words`` counts the words inside three-word
    windows that the text holds twice or more: windows, as 64-bit hashes of their words, are sorted, and neighbours that agree give their
    word places, each counted once. Columns of these names are replaced.
    """
    text = text_or_empty()
    trimmed = F.btrim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    left = [c for c in docs.columns if c not in STATISTICS]
    _words, _lines, _windows = (unused(c, left) for c in ("words", "lines", "windows"))
    words = docs.select(
        *left,
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
        .alias(_words),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        lines.alias(_lines),
    )
    n = F.greatest(F.size(_words) - 2, F.lit(0))
    windows = F.zip_with(
        F.zip_with(F.slice(_words, 1, n), F.slice(_words, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(_words, 3, n),
        lambda ab, c: F.xxhash64(ab["a"], ab["b"], c),
    )
    sorted_windows = words.select(
        *left,
        F.size(_words).cast("long").alias("n_words"),
        F.length(F.array_join(_words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        F.size(_lines).cast("long").alias("n_lines"),
        (F.size(_lines) - F.size(F.array_distinct(_lines))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias(_windows),
    )
    m = F.greatest(F.size(_windows) - 1, F.lit(0))
    places = F.zip_with(
        F.slice(_windows, 1, m),
        F.slice(_windows, 2, m),
        lambda a, b: F.when(a["w"] == b["w"], F.array(*[x["i"] + k for x in (a, b) for k in range(3)])).otherwise(
            F.array().cast("array<int>")
        ),
    )
    repeated = F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n_repeat_words")
    row = F.struct(*[repeated if c == "n_repeat_words" else F.col(c) for c in STATISTICS])
    # A generator of one row: filters on the statistics stay above it, instead of working them out again.
    return sorted_windows.select(*left, F.inline(F.array(row)))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "n_words": lambda: F.col("n_words").cast("double"),
        "mean_word": lambda: share("word_chars", "n_words"),
        "symbol_share": lambda: share("n_symbols", "word_chars"),
        "upper_share": lambda: share("n_upper", "word_chars"),
        "dup_line_share": lambda: share("n_dup_lines", "n_lines"),
        "repeat_share": lambda: share("n_repeat_words", "n_words"),
    }[name]()


@dataclass(frozen=True)
class Test:
    """One threshold test: the feature is at least the threshold, or below it."""

    name: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = feature(self.name)
        return value >= self.threshold if self.at_least else value < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, otherwise the document is kept."""

    rules: tuple[tuple[Test, ...], ...] = field(default=())

    def rule(self) -> Column:
        """The number of the first rule that holds, from 1, or null."""
        out = None
        for number, tests in enumerate(self.rules, 1):
            holds = conjunction(tests)
            out = F.when(holds, number) if out is None else out.when(holds, number)
        return F.lit(None).cast("int") if out is None else out

    def keeps(self) -> Column:
        return self.rule().isNull()


def conjunction(tests: tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test.column()
    return out


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    cuts: int = 31,
    max_rules: int = 8,
    max_tests: int = 3,
    precision: float = 0.95,
    least: int = 5,
) -> DecisionList:
    """A decision list for low quality (label 0), by sequential covering.

    Learns from at most ``max_rows`` labelled documents, the first by a hash of their id; two thirds grow
    rules, a third prunes them. A rule grows by the threshold test with the best information gain, among
    ``cuts`` quantiles of each feature, until it covers no good row or has ``max_tests``; tests are then
    dropped from its end as long as that does not lower (bad - good) / (bad + good) on the pruning rows.
    It is taken if bad rows make up ``precision`` of at least ``least`` pruning rows it covers; what it
    covers leaves both sets, and the next rule grows. Labels that are null or not 0 or 1 are ignored, of a
    repeated id the lowest label counts; without labels the list is empty.

    Only the chosen ids are broadcast (``max_rows`` longs), and only counts per feature and bin come back.
    """
    ids = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("_label"))
        .withColumn("_order", F.xxhash64("doc_id"))
        .orderBy("_order", "doc_id")
        .limit(max_rows)
    )
    known = with_statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    known = settled(
        known.where(~base_failed()).select(
            (F.col("_label") == 0).alias("bad"),
            (F.pmod("_order", F.lit(3)) != 0).alias("grows"),
            *STATISTICS,
        ),
        "labelled",
    )
    shares = [k / (cuts + 1) for k in range(1, cuts + 1)]
    found = known.where("grows").agg(*[F.percentile_approx(feature(f), shares, 10_000).alias(f) for f in FEATURES]).first()
    if found[0] is None:
        return DecisionList()
    cut_points = {f: sorted(set(found[f])) for f in FEATURES}

    def binned(f: str) -> Column:
        """How many cut points the value reaches."""
        value = feature(f)
        return sum([(value >= c).cast("int") for c in cut_points[f]], F.lit(0))

    known = settled(
        known.withColumn("_bins", F.array(*[F.struct(F.lit(f).alias("f"), binned(f).alias("b")) for f in FEATURES])),
        "binned",
    )
    rules: list[tuple[Test, ...]] = []
    while len(rules) < max_rules:
        free = known.where(DecisionList(tuple(rules)).keeps())
        tests: tuple[Test, ...] = ()
        while len(tests) < max_tests:
            grown = free.where(F.col("grows") & conjunction(tests))
            counts = grown.select("bad", F.explode("_bins").alias("x")).groupBy("x.f", "x.b").agg(
                F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((~F.col("bad")).cast("long")).alias("good")
            )
            best = best_test([tuple(r) for r in counts.collect()], cut_points)
            if best is None:
                break
            tests = (*tests, best[0])
            if best[1] == 0:
                break
        tests = pruned(free.where(~F.col("grows")), tests, precision, least)
        if not tests:
            break
        rules.append(tests)
    return DecisionList(tuple(rules))


def best_test(counts: list[tuple[str, int, int, int]], cut_points: dict[str, list[float]]) -> tuple[Test, int] | None:
    """The test with the best gain of information about bad rows, and the good rows it still covers."""
    best, found = 0.0, None
    for name in FEATURES:
        by_bin = {b: (bad, good) for f, b, bad, good in counts if f == name}
        all_bad, all_good = (sum(x[k] for x in by_bin.values()) for k in (0, 1))
        if not all_bad or not all_good:
            continue
        before = math.log2(all_bad / (all_bad + all_good))
        for k, cut in enumerate(cut_points[name]):
            low_bad, low_good = (sum(x[i] for b, x in by_bin.items() if b <= k) for i in (0, 1))
            for at_least, bad, good in ((True, all_bad - low_bad, all_good - low_good), (False, low_bad, low_good)):
                if bad:
                    gain = bad * (math.log2(bad / (bad + good)) - before)
                    if gain > best + 1e-9:
                        best, found = gain, (Test(name, at_least, cut), good)
    return found


def pruned(rows: DataFrame, tests: tuple[Test, ...], precision: float, least: int) -> tuple[Test, ...]:
    """The shortest beginning of a rule that is worth the most on rows it was not grown on, if that is enough."""
    if not tests:
        return ()
    sums = []
    for k in range(1, len(tests) + 1):
        holds = conjunction(tests[:k])
        sums += [F.sum((holds & F.col("bad")).cast("long")), F.sum((holds & ~F.col("bad")).cast("long"))]
    got = [x or 0 for x in rows.agg(*sums).first()]
    worth = [((b - g) / (b + g) if b + g else -1.0, b, g) for b, g in zip(got[::2], got[1::2], strict=True)]
    k = max(range(len(worth)), key=lambda i: (worth[i][0], -i))
    _, bad, good = worth[k]
    return tests[: k + 1] if bad + good >= least and bad >= precision * (bad + good) else ()


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Every document with its statistics, ``base_failed``, the ``rule`` that rejects it and ``kept``.

    Columns of these names are replaced, all others come through. Rows that repeat an id are judged each for itself.
    """
    out = with_statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("rule", rules.rule()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
