"""Licence scans: sparse TF-IDF cosine of lines, windows and whole files to templates, and inheritance from
the nearest directory.

DataFrame operations only: no Python runs on an executor.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affiche.llm.shared import settled, text_or_empty

#: The statements by which a file says its licence, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
}
#: The notices that stand at the head of a file.
HEADERS = [
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "BSD-3-Clause",
        "All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the "
        "LICENSE file.",
    ),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To "
        "view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to "
        "Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
]
#: A line, window or file states a licence if its cosine to the template is at least this.
THRESHOLD = 0.75
#: Windows of a template begin at every so-manieth part of its length.
STEPS = 16


@lru_cache(maxsize=1)
def longer() -> tuple[tuple[str, str], ...]:
    """(licence, text) of the headers and of the whole texts that are kept beside this module."""
    kept = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return (*HEADERS, *[(p.name.removesuffix(".txt"), p.read_text()) for p in kept])


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies of the template terms, and the templates as vectors of length 1."""

    idf: dict[str, float]
    unseen: float
    templates: dict[str, dict[str, float]]

    def common(self, threshold: float) -> set[str]:
        """The most frequent terms, as long as no template made up of them alone comes near the threshold.

        A line without any other template term cannot reach it: its cosine is at most the length of a template
        within these terms.
        """
        out: set[str] = set()
        for term in sorted(self.idf, key=lambda t: (self.idf[t], t)):
            tried = out | {term}
            longest = max(math.sqrt(sum(w * w for t, w in v.items() if t in tried)) for v in self.templates.values())
            if longest > threshold - 1e-6:
                break
            out = tried
        return out


def counted(lines: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """How many lines (a column ``tokens``) there are, and how many have each of the terms.

    Only the given terms come back, one number each.
    """
    known = F.array_distinct(F.filter("tokens", lambda t: t.isin(terms)))
    each = lines.select(F.explode(F.array_append(known, F.lit(""))).alias("term"))
    counts = {r[0]: r[1] for r in each.groupBy("term").agg(F.count("*")).collect()}
    return counts.pop("", 0), counts


def weights(n: int, counts: dict[str, int], templates: dict) -> Weights:
    """What follows from document frequencies over n lines. A term that no template has weighs as much as one
    that no line has."""
    terms = sorted({w for t in templates.values() for w in _words(t)})
    idf = {t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 1 for t in terms}
    vectors = {}
    for name, text in templates.items():
        words = _words(text)
        raw = {w: words.count(w) * idf[w] for w in dict.fromkeys(words)}
        length = math.sqrt(sum(x * x for x in raw.values()))
        vectors[name] = {w: x / length for w, x in raw.items()}
    return Weights(idf, math.log(n + 1) + 1, vectors)


def times(line_tokens: Column, term: Column | str) -> Column:
    """How often a term stands in a line."""
    return F.size(F.filter(line_tokens, lambda w: w == term)).cast("double")


def dots(line_tokens: Column, known: Weights) -> Column:
    """Inner products of a line (not yet of length 1) and each template, as an array of (dot, licence)."""
    return F.array(
        *[
            F.struct(
                sum([times(line_tokens, t) * F.lit(w * known.idf[t]) for t, w in vector.items()], F.lit(0.0)).alias("dot"),
                F.lit(name).alias("licence"),
            )
            for name, vector in sorted(known.templates.items())
        ]
    )


def length(line_tokens: Column, known: Weights) -> Column:
    """The length of a line as a vector."""
    idf = F.create_map(*[F.lit(x) for t, w in known.idf.items() for x in (t, w)])

    def weight(term: Column) -> Column:
        return F.coalesce(idf[term], F.lit(known.unseen)) * times(line_tokens, term)

    terms = F.array_distinct(line_tokens)
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda total, term: total + weight(term) * weight(term)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row, so that later filters do not work them out again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def lines_of(files: DataFrame, *columns: str) -> DataFrame:
    """The lines of every whole text with their tokens; lines without any are left out."""
    parts = F.transform(
        F.split(text_or_empty(), "\n", -1), lambda text, k: F.struct(k.alias("line"), tokens(text).alias("tokens"))
    )
    return files.select(*columns, F.inline(parts)).where(F.size("tokens") > 0)


def by_line(lines: DataFrame, known: Weights, threshold: float) -> DataFrame:
    """path, line, score and licence of the lines that are near a template.

    Whole lines are compared, but most are ruled out before that: they hold common terms only, or so many terms
    that no template has that they are too long for the threshold.
    """
    telling = sorted(set(known.idf) - known.common(threshold))
    near = lines.where(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in telling])))
    vocabulary = F.array(*[F.lit(t) for t in sorted(known.idf)])
    near = once(
        near,
        best=F.array_max(dots(F.col("tokens"), known)),
        strange=F.size(F.array_except("tokens", vocabulary)).cast("double"),
    )
    near = near.where(F.col("best.dot") >= (threshold - 1e-6) * known.unseen * F.sqrt("strange"))
    near = once(near, score=F.round(F.col("best.dot") / length(F.col("tokens"), known), 9))
    return near.where(F.col("score") >= threshold).select("path", "line", "score", F.col("best.licence").alias("licence"))


def cosine(weighed: Column) -> Column:
    """The cosine to a template of an array of (term, sq, gain): each place's squared weight, and what it adds to
    the inner product. Equal terms lie together after sorting, the k-th of them adds 2k - 1 squares."""
    start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("dot"))

    def add(total: Column, x: Column) -> Column:
        k = F.when(total["term"] == x["term"], total["k"] + 1.0).otherwise(F.lit(1.0))
        return F.struct(
            x["term"].alias("term"),
            k.alias("k"),
            (total["sq"] + (2.0 * k - 1.0) * x["sq"]).alias("sq"),
            (total["dot"] + x["gain"]).alias("dot"),
        )

    return F.aggregate(F.array_sort(weighed), start, add, lambda t: F.round(t["dot"] / F.sqrt(t["sq"]), 9))


def reachable(held: Column, vector: dict[str, float]) -> Column:
    """No less than the squared length of a template's vector within the terms held: terms of like weight are counted
    together at the largest of their weights, which is at most a tenth above the others' squares."""
    levels: list[tuple[float, list[str]]] = []
    for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if not levels or w * w * 1.1 < levels[-1][0]:
            levels.append((w * w, []))
        levels[-1][1].append(term)
    counted = [F.lit(most) * F.size(F.array_intersect(held, F.array(*[F.lit(t) for t in terms]))) for most, terms in levels]
    return sum(counted, F.lit(0.0))


def by_window(files: DataFrame, known: Weights, threshold: float) -> DataFrame:
    """path, line, score and licence of the best window of every file for each template that it is near to.

    Windows have as many tokens as the template, over line ends, and begin at every ``STEPS``-th part of that
    (at every token for statements) and at the end of the file; the whole file is one more. The templates that
    a file is scored for are found on its row by its terms: no part of a file has a cosine above the
    length of the template within the terms of the file. Windows without any telling term of the template are
    left out, they cannot reach the threshold.
    """
    spark = files.sparkSession
    names = sorted(known.templates)
    alone = [Weights({t: known.idf[t] for t in known.templates[n]}, known.unseen, {n: known.templates[n]}) for n in names]
    tells = [sorted(set(w.idf) - w.common(threshold)) for w in alone]
    telling = sorted({t for ts in tells for t in ts})
    parts = F.transform(F.split(text_or_empty(), "\n", -1), tokens)
    whole = once(files.select("path", "text"), parts=parts)
    whole = once(whole.drop("text"), tokens=F.flatten("parts"), sizes=F.transform("parts", F.size)).drop("parts")
    near = whole.where(F.exists("tokens", lambda t: t.isin(telling)))
    near = once(near, held=F.array_distinct(F.filter("tokens", lambda t: t.isin(sorted(known.idf)))))
    reach = [F.struct(F.lit(k).alias("template"), reachable(F.col("held"), known.templates[n]).alias("mass")) for k, n in enumerate(names)]
    near = near.withColumn("wanted", F.filter(F.array(*reach), lambda x: x["mass"] >= threshold * threshold - 1e-6))
    near = near.select("path", "tokens", "sizes", F.explode("wanted.template").alias("template"))
    one = pa.map_(pa.string(), pa.float64())
    vectors = spark.createDataFrame(
        pa.table(
            {
                "template": pa.array(range(len(names)), pa.int32()),
                "licence": pa.array([n[0] for n in names]),
                "n": pa.array([n[1] for n in names], pa.int32()),
                "tells": pa.array(tells, pa.list_(pa.string())),
                "idf": pa.array([list(known.idf.items())] * len(names), one),
                "gain": pa.array([[(t, w * known.idf[t]) for t, w in known.templates[n].items()] for n in names], one),
            }
        )
    )
    rows = near.join(F.broadcast(vectors), "template")  # one row a template

    def weigh(t: Column) -> Column:
        idf = F.when(t.isin(vocabulary), F.coalesce(F.col("idf")[t], F.lit(known.unseen))).otherwise(F.lit(known.unseen))
        gain = F.when(t.isin(vocabulary), F.coalesce(F.col("gain")[t], F.lit(0.0))).otherwise(F.lit(0.0))
        return F.struct(t.alias("term"), (idf * idf).alias("sq"), gain.alias("gain"))

    def around(p: Column) -> Column:
        low = F.ceil(F.greatest(p - F.col("n") + 1, F.lit(0)) / F.col("step")).cast("int") * F.col("step")
        high = F.least(p, F.col("last"))
        return F.when(low <= high, F.sequence(low, high, F.col("step"))).otherwise(F.array().cast("array<int>"))

    vocabulary = sorted(known.idf)
    rows = once(
        rows,
        weighed=F.transform("tokens", weigh),
        last=F.greatest(F.size("tokens") - F.col("n"), F.lit(0)),
        step=F.greatest(F.floor(F.col("n") / STEPS).cast("int"), F.lit(1)),
        told=F.filter(
            F.sequence(F.lit(0), F.size("tokens") - 1),
            lambda p: F.get("tokens", p).isin(telling) & F.array_contains("tells", F.get("tokens", p)),
        ),
    )
    starts = F.array_distinct(F.array_append(F.flatten(F.transform("told", around)), F.col("last")))
    scores = F.transform(
        starts, lambda s: F.struct(cosine(F.slice("weighed", s + 1, F.col("n"))).alias("score"), (-s).alias("at"))
    )
    everything = F.struct(cosine(F.col("weighed")).alias("score"), F.lit(0).alias("at"))
    rows = once(rows, best=F.array_max(F.array_append(scores, everything)))
    rows = rows.where(F.col("best.score") >= threshold)
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("line"))

    def passed(total: Column, n: Column) -> Column:
        seen = total["seen"] + n
        over = F.when(seen <= -F.col("best.at"), 1).otherwise(0)
        return F.struct(seen.alias("seen"), (total["line"] + over).alias("line"))

    line = F.aggregate("sizes", start, passed, lambda t: t["line"])
    return rows.select("path", line.alias("line"), F.col("best.score").alias("score"), "licence")


def stated(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, licence, score and line: the licence that each file states itself, where it does.

    The line, window or whole file with the highest cosine counts; of equals the one that begins on the first
    line, then the licence first by name. Lines are compared with the statements, windows and whole files with
    statements, headers and whole licence texts.
    """
    lines = lines_of(files, "path")
    every = {(name, len(_words(text)), k): text for k, (name, text) in enumerate([*templates.items(), *longer()])}
    n, counts = counted(lines, sorted({w for t in every.values() for w in _words(t)}))
    scored = by_line(lines, weights(n, counts, templates), threshold)
    scored = scored.unionByName(by_window(files, weights(n, counts, every), threshold))
    top = Window.partitionBy("path").orderBy(F.desc("score"), "line", "licence")
    found = scored.withColumn("_rank", F.row_number().over(top)).where(F.col("_rank") == 1)
    return found.select("path", "licence", "score", "line")


def directory(path: Column) -> Column:
    """The directory of a path; the root is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(files: DataFrame, own: DataFrame) -> DataFrame:
    """path, licence, score, origin and source: of each file its own licence, or that of the nearest directory above.

    A licence file (``is_licence`` of ``files``) that states a licence gives it to its directory and what lies
    below; of several in one directory the first by path counts. Every different directory is joined with each
    of its ancestors, the deepest one with a licence file wins; files then join their directory. A file
    without either has nulls.
    """
    given = own.join(files.where("is_licence").select("path"), "path")
    first = F.min(F.struct("path", "licence")).alias("g")
    given = given.groupBy(directory(F.col("path")).alias("ancestor")).agg(first).select("ancestor", "g.*")
    folders = files.select(directory(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    chains = folders.select("folder", F.explode(F.array_distinct(above)).alias("ancestor"))
    deepest = F.max(F.struct(F.length("ancestor").alias("depth"), "path", "licence")).alias("d")
    nearest = chains.join(given, "ancestor").groupBy("folder").agg(deepest)
    nearest = nearest.select("folder", F.col("d.path").alias("_source"), F.col("d.licence").alias("_given"))
    rows = files.select("path", directory(F.col("path")).alias("folder"))
    rows = rows.join(own, "path", "left").join(nearest, "folder", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("_given").isNotNull(), "inherited")
    return rows.select(
        "path",
        F.coalesce("licence", "_given").alias("licence"),
        "score",
        origin.alias("origin"),
        F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("_source")).alias("source"),
    )


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The licence of every file (path, text, is_licence), its own or an inherited one.

    Null text states nothing; files without a path are left out; of files that repeat a path the best
    line or window of either counts, and the path has one row.
    """
    named = files.where(F.col("path").isNotNull()).select("path", "text", "is_licence")
    own = settled(stated(named, templates, threshold), "licences")
    places = named.groupBy("path").agg(F.max(F.coalesce("is_licence", F.lit(False))).alias("is_licence"))
    return inherited(places, own)
