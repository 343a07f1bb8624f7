import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from affiche.llm import spellings
from tests.llm.tables import CLASHING, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def variants(word, alphabet):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in alphabet}
    out |= {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in alphabet}
    return out - {word}


def brute(rows):
    counts = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    alphabet = {c for w in n for c in w}
    # Only one word is that long: no other is near it.
    near = {w: variants(w, alphabet) & n.keys() if len(w) < 100 else set() for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = ["horloge", "étendard", "magasin", "voyageur", "bâtiment", "STATION", "Ærøskøbing", "multiplier", "ananassa", "aaaaaaa", "straße×÷ÿ"]
    words = []
    for w in base:
        for k, times in ((0, 400), (1, 30), (2, 3)):
            for _ in range(times if k else 1):
                v = list(w)
                for _ in range(k):
                    at, c = rng.randrange(len(v)), rng.choice("aeét")
                    rng.choice([lambda: v.insert(at, c), lambda: v.pop(at), lambda: v.__setitem__(at, c)])()  # noqa: B023
                words += ["".join(v)] * (times if not k else rng.randrange(1, 40 // k**3 + 2))
    rng.shuffle(words)
    out = [(i, " ".join(words[i::150])) for i in range(150)]
    out += [(500, None), (501, ""), (502, "123 -- ab"), (None, "horloge Horloge"), (None, "horloge"), (503, "x" * 70_000), (503, "x" * 70_000)]
    out += [(504, "chain" * 2 + "s"), (504, "chain" * 2 + "s")] + [(600 + k, "abcdefghij") for k in range(2)]
    out += [(700 + k, "abcdefghiX") for k in range(22)] + [(800 + k, "abcdefghXX") for k in range(230)] + [(1100 + k, "abcdefgXXX") for k in range(2400)]
    return out


def as_rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("cell, leaf", [(20_000, 24), (5, 2), (1, 1)])
def test_equals_brute_force(spark, rows, monkeypatch, cell, leaf):
    monkeypatch.setattr(spellings, "CELL", cell)
    monkeypatch.setattr(spellings, "LEAF", leaf)
    got = as_rows(spellings.grouped(documents(spark, rows, CLASHING).repartition(4)))
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # some chains have several steps


def test_forms_are_followed_to_the_end(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(12)], "word string, form string")
    got = dict(spellings.roots(links, 4).collect())
    assert got == {f"w{k}": "w12" for k in range(12)}


def test_forms_may_not_lead_back(spark, rows):
    with pytest.raises(ValueError, match="times"):
        spellings.grouped(documents(spark, rows), times=1)


def test_no_words(spark):
    for table in ([], [(1, None), (2, ""), (3, "one two three")]):
        out = spellings.grouped(documents(spark, table))
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


WORDS = st.text("abné", min_size=3, max_size=7)


@settings(max_examples=60, deadline=None)
@given(st.sets(WORDS, min_size=1, max_size=40), st.integers(1, 6), st.integers(0, spellings.GROUPS))
def test_trie_finds_all_near_words(words, leaf, depth):
    """Cells and tries together, without Spark: every pair, and each from one side only."""
    words = sorted(words)
    counts = spellings.vectors(words)
    levels = list(np.argsort(-counts.sum(axis=0), kind="stable"))
    sizes, counts = np.array([len(w) for w in words]), counts[:, levels[:depth]]
    cells, found = {}, set()
    for w, key in zip(words, spellings.cell_keys(sizes, counts), strict=True):
        cells.setdefault(key, []).append(w)
    original, spellings.LEAF = spellings.LEAF, leaf
    for rows, keys, state in spellings.cells_within_budget(sizes, counts):
        for row, key in zip(rows, keys, strict=True):
            if key in cells:
                trie = spellings.Trie(cells[key], levels, depth)
                for _, b in trie.search([words[row]], np.array([state])):
                    pair = frozenset((words[row], cells[key][b]))
                    assert pair not in found
                    found.add(pair)
    spellings.LEAF = original
    assert found == {frozenset((a, b)) for a in words for b in words if b in variants(a, "abné")}


@given(st.lists(st.text("abéĀ", min_size=4, max_size=4), min_size=1, max_size=9), st.lists(st.text("abéĀ", min_size=5, max_size=5), min_size=1, max_size=9))
def test_one_edit(short, long):
    for a, b in ((short, short), (short, long), (long, long)):
        got = spellings.one_edit(spellings.letters(a), spellings.letters(b))
        assert got.tolist() == [[y in variants(x, "abéĀ") for y in b] for x in a]
