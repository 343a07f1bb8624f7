"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word's vector says how many of its letters are in each group. One edit adds a letter to one group, takes
one from a group, or both, so a search down the trie may meet a surplus of one and a deficit of one and no more. The
top levels of the trie (length, then the first groups) are the cells that tasks work on; a word is sent to its
own cell and to those within the budget, and the rest of the search goes on inside the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affiche.llm.shared import settled

#: Letters are in this many groups, by code point.
GROUPS = 13
#: Words in a cell; cells are made deeper until none is larger, and a cell at full depth is cut into blocks.
CELL = 10_000
#: A trie node of so few words is not split further.
LEAF = 100
#: Searches that go down a cell's trie together.
ASKED = 100_000
#: Pairs of words that are compared at once.
PAIRS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased and no other letter."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def occurrences(docs: DataFrame, least_chars: int = 7, one_in: int = 31) -> DataFrame:
    """word: every occurrence of a run of A-Z, a-z and U+00C0 to U+00FF, misspelled as the id and the run decide.

    Let h be the CRC-32 of "<doc_id>:<run>" (no id: empty). Where ``one_in`` divides h the run loses its code point
    h % length. Runs too short to give a word of ``least_chars`` are not even listed.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_chars},}}"), F.lit(0))
    listed = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lowered = listed.select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= least_chars)


def vocabulary(docs: DataFrame, least_chars: int = 7, least: int = 2, one_in: int = 31) -> DataFrame:
    """word and n of the words that occur at least ``least`` times; counted in each task before the shuffle."""
    counted = occurrences(docs, least_chars, one_in).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def vectors(words: list[str]) -> np.ndarray:
    """For each word how many of its letters are in each group."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64) % GROUPS
    cell = np.repeat(np.arange(len(words)) * GROUPS, sizes) + letters
    return np.bincount(cell, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the words b (rows) are which of the words a with one code point replaced, or inserted if b are longer."""
    size = a.shape[1]
    if size == b.shape[1]:
        differ = np.zeros((len(a), len(b)), np.uint8)
        for k in range(size):
            other = a[:, k, None] != b[None, :, k]
            differ += other & (differ < 2)
        return differ == 1
    # As many letters from the front and from the back agree as a has, or more.
    agree = np.zeros((len(a), len(b)), np.int32)
    for order, shift in ((range(size), 0), (range(size - 1, -1, -1), 1)):
        still = np.ones((len(a), len(b)), bool)
        for k in order:
            still &= a[:, k, None] == b[None, :, k + shift]
            if not still.any():
                break
            agree += still
    return agree >= size


#: Where a search stands: as long as the word and nothing spent, the surplus spent, both spent (or the one a longer
#: word has), and a longer word with nothing spent.
EVEN, OWING, DONE, LONGER = range(4)
#: What a step of -1, 0 or 1 in a group makes of each of these; -1 ends the search. Of two words as long the surplus comes
#: at the earlier level, so each pair is found from one side only.
_AFTER = np.array([[-1, EVEN, OWING], [DONE, OWING, -1], [-1, DONE, -1], [-1, LONGER, DONE]], np.int8)


class Trie:
    """Words of one length, arranged by the counts of their letter groups: sorted, a node is a run of rows.

    ``levels`` says which group is looked at first, second and so on; the words agree before ``level``.
    """

    def __init__(self, words: list[str], levels: list[int], level: int):
        self.level, self.levels = level, levels
        counts = vectors(words)[:, levels]
        self.place = np.lexsort(counts.T[::-1])
        self.counts = counts[self.place].astype(np.int32)
        self.letters = letters(words)[self.place]

    def search(self, words: list[str], state: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (number of a searched word, number of a trie word) one edit apart; searched words are of one length too."""
        wanted, own_letters = vectors(words)[:, self.levels].astype(np.int32), letters(words)
        stack = [(0, len(self.place), self.level, np.arange(len(words)), state.astype(np.int8))]
        while stack:
            low, high, level, who, at = stack.pop()
            if high - low <= LEAF or level == GROUPS:
                rows = max(1, PAIRS // (high - low))
                for first in range(0, len(who), rows):
                    part = slice(first, first + rows)
                    yield from self.leaf(low, high, level, own_letters[who[part]], wanted, who[part], at[part])
                continue
            column, own = self.counts[low:high, level], wanted[who, level]
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                step = column[a] - own
                near = np.flatnonzero(np.abs(step) <= 1)
                after = _AFTER[at[near], step[near] + 1]
                on = near[after >= 0]
                if len(on):
                    stack.append((low + a, low + b, level + 1, who[on], after[after >= 0]))

    def leaf(self, low: int, high: int, level: int, mine: np.ndarray, wanted: np.ndarray, who: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """Compares the words themselves. Of words as long as the search that have spent nothing, one of the two has
        the surplus first among the levels left, or comes first by its letters: that one reports the pair."""
        for q, w in zip(*(x.tolist() for x in np.nonzero(one_edit(mine, self.letters[low:high]))), strict=True):
            if at[q] == EVEN:
                own, other = (*wanted[who[q], level:], *mine[q]), (*self.counts[low + w, level:], *self.letters[low + w])
                if own > other:
                    continue
            yield int(who[q]), int(self.place[low + w])


def cell_keys(sizes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The cell of each row: the length and the counts of the first levels."""
    keys = np.hstack([sizes[:, None], counts]).astype(">i4")
    width, raw = 4 * keys.shape[1], keys.tobytes()
    return [raw[k : k + width] for k in range(0, len(raw), width)]


def cells_within_budget(sizes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], int]]:
    """For each way to spend the budget on the first levels: the rows that can, their cells and where they then stand."""
    rows = np.arange(len(sizes))
    yield rows, cell_keys(sizes, counts), EVEN
    yield rows, cell_keys(sizes + 1, counts), LONGER
    depth = counts.shape[1]
    for i in range(depth):
        more = counts.copy()
        more[:, i] += 1
        yield rows, cell_keys(sizes, more), OWING
        yield rows, cell_keys(sizes + 1, more), DONE
        for j in range(i + 1, depth):
            able = np.flatnonzero(counts[:, j] > 0)
            swapped = more[able]
            swapped[:, j] -= 1
            yield able, cell_keys(sizes[able], swapped), DONE


def with_vectors(words: DataFrame) -> DataFrame:
    """word, n and their counts in all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(vectors(batch["word"].to_pylist()).tolist(), pa.list_(pa.int32()))
            yield pa.record_batch([batch["word"], batch["n"], counts], names=["word", "n", "counts"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, counts array<int>")


def levels_and_depth(words: DataFrame) -> tuple[list[int], int]:
    """The groups, those with most letters first, and the least depth at which no cell holds more than ``CELL`` words.

    The driver sees one number a group and one a depth. Should a cell at full depth be larger, the depth is the full one.
    """
    sums = words.agg(*[F.coalesce(F.sum(F.col("counts")[k]), F.lit(0)) for k in range(GROUPS)]).first()
    levels = sorted(range(GROUPS), key=lambda k: (-sums[k], k))
    for depth in range(GROUPS):
        cell = [F.char_length("word"), *[F.col("counts")[k] for k in levels[:depth]]]
        if (words.groupBy(*cell).agg(F.count("*").alias("size")).agg(F.max("size")).first()[0] or 0) <= CELL:
            return levels, depth
    return levels, GROUPS


def _held(words: DataFrame, levels: list[int], depth: int) -> DataFrame:
    """cell, word and n: every word in the cell it lies in."""
    return _in_cells(words, levels, depth, lambda sizes, counts: [(np.arange(len(sizes)), cell_keys(sizes, counts), EVEN)]).drop("state")


def _searches(words: DataFrame, levels: list[int], depth: int) -> DataFrame:
    """cell, word, n and state, for every cell a word's search goes down into."""
    return _in_cells(words, levels, depth, cells_within_budget)


def _in_cells(words: DataFrame, levels: list[int], depth: int, ways) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch["word"].to_pylist()
            counts, sizes = vectors(spelled)[:, levels[:depth]], np.array([len(w) for w in spelled], np.int64)
            for rows, keys, state in ways(sizes, counts):
                part = pa.array(rows)
                out = [pa.array(keys, pa.binary()), batch["word"].take(part), batch["n"].take(part), pa.array(np.full(len(rows), state, np.int32))]
                yield pa.record_batch(out, names=["cell", "word", "n", "state"])

    return words.select("word", "n").mapInArrow(run, "cell binary, word string, n long, state int")


def near_words(words: DataFrame) -> DataFrame:
    """word, near and near_n: all pairs of the words (``word`` unique, with ``n``) one edit apart, both ways round."""
    counted = settled(with_vectors(words), "vectors")
    levels, depth = levels_and_depth(counted)
    held, sent, keys = _held(counted, levels, depth), _searches(counted, levels, depth), ["cell"]
    if depth == GROUPS:  # Words alike in all groups may be too many for one task: blocks, each searched for all.
        blocks = held.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
        held = held.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        sent = sent.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held, sent, keys = held.drop("blocks"), sent.drop("blocks"), ["cell", "block"]

    def run(here: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if here.num_rows and asked.num_rows:
            spelled, n = here["word"].to_pylist(), here["n"].to_pylist()
            trie = Trie(spelled, levels, depth)
            as_long = pc.equal(pc.utf8_length(asked["word"]), len(spelled[0]))
            for group in (asked.filter(as_long), asked.filter(pc.invert(as_long))):
                for first in range(0, group.num_rows, ASKED):
                    part = group.slice(first, ASKED)
                    other, m = part["word"].to_pylist(), part["n"].to_pylist()
                    for a, b in trie.search(other, part["state"].to_numpy()):
                        out.append((other[a], spelled[b], n[b]))
                        out.append((spelled[b], other[a], m[a]))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])

    return held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """word and root: where following ``form`` from each word ends. Each round doubles how far one step goes."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = settled(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def grouped(docs: DataFrame, least_chars: int = 7, least: int = 2, times: int = 10, one_in: int = 31) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents.

    Words come from ``occurrences`` and have at least ``least_chars`` code points and ``least`` occurrences. A word's
    form is the near word with most occurrences (ties: the first in code-point order) if those are at least
    ``times`` its own; its root is where the forms lead. Null and empty texts have no words, repeated rows
    count each time, other columns are left out, no rows give no words.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, so that forms never lead back")
    words = settled(vocabulary(docs, least_chars, least, one_in), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.less") >= times * F.col("n")
    formed = settled(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best.near")).alias("form"),
            F.when(chosen, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    # Each step multiplies the occurrences by ``times``, so the chain cannot be longer than their logarithm.
    most, steps = words.agg(F.max("n")).first()[0] or 0, 0
    while least * times ** (steps + 1) <= most:
        steps += 1
    linked = roots(formed.where(F.col("form").isNotNull()), max(0, steps - 1).bit_length())
    return formed.join(linked, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
