import numpy as np
import pytest

from affiche.llm import near_duplicates


def near_sets(n_sets, size, seed=5):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**40, size))
    sets = []
    for _ in range(n_sets):
        keep = rng.random(len(base)) < rng.choice([0.6, 0.85, 0.95])
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**40, (~keep).sum() // 2)])))
    return sets


@pytest.mark.parametrize("probes", [1, 50, 1_000_000])
def test_long_lists_are_probed_together(monkeypatch, probes):
    sets = near_sets(40, 300)
    sizes = np.array([len(s) for s in sets])
    lists = near_duplicates.Lists(np.arange(len(sets)), sizes, sets)
    monkeypatch.setattr(near_duplicates, "PROBES", probes)
    calls, plain = [], np.searchsorted

    def counted(*args, **kwargs):
        calls.append(1)
        return plain(*args, **kwargs)

    monkeypatch.setattr(np, "searchsorted", counted)
    for s in sets:
        common = np.array([len(np.intersect1d(s, t)) for t in sets])
        want = np.flatnonzero(near_duplicates.links(len(s), sizes, common))
        calls.clear()
        assert lists.search(len(s), s).tolist() == want.tolist()
        # One search for the lists of the set, one for all probes: not one for each of over a hundred long lists.
        assert probes < 1_000_000 or len(calls) <= 2


def test_nothing_is_probed_for_without_candidates(monkeypatch):
    sets = near_sets(3, 300)
    alone = np.sort(np.concatenate([s[k::3] for k, s in enumerate(sets)]))
    alone = np.unique(np.concatenate([alone, np.arange(2**41, 2**41 + 2)]))
    lists = near_duplicates.Lists(np.arange(4), np.array([len(s) for s in [*sets, alone[:0]]]), [*sets, alone[:0]])
    assert lists.search(10_000, alone).tolist() == []
    assert near_duplicates.Lists(np.arange(0), np.arange(0), []).tokens.tolist() == []


@pytest.mark.parametrize("n_docs", [3, 70_000])
def test_order_by_document_and_hash(n_docs):
    rng = np.random.default_rng(1)
    docs = rng.integers(0, n_docs, 5_000)
    hashes = rng.integers(0, 2**63, 5_000).astype(np.uint64) * np.uint64(2) // np.uint64(1 + (n_docs < 10) * 2**60)
    order = near_duplicates.by_document(docs, hashes)
    want = np.lexsort((hashes, docs))
    assert docs[order].tolist() == docs[want].tolist()
    assert hashes[order].tolist() == hashes[want].tolist()
