import random
from itertools import combinations

import numpy as np
import pytest

from feedloom.llm import minhash
from feedloom.llm.common import MULTIPLIER, U64, mix, words_of
from tests.llm.samples import ODD_TEXTS, documents, prose


def plain_signature(elements, size):
    """The definition: every element offers j + u to the place its permutation has in round j."""
    out = [float("inf")] * size
    for e in elements:
        places = list(range(size))
        for j in range(size):
            r = int(mix(np.array([e], U64) + U64((j + 1) * int(MULTIPLIER) & 0xFFFFFFFFFFFFFFFF))[0])
            k = j + (r & 0xFFFFFFFF) % (size - j)
            places[j], places[k] = places[k], places[j]
            out[places[j]] = min(out[places[j]], j + (r >> 32) * 2.0 ** -32)
    return out


def test_signatures_follow_the_definition():
    random.seed(3)
    sets = [np.array(random.sample(range(10 ** 9), n), U64) for n in (1, 2, 7, 40, 300)] + [np.empty(0, U64)]
    got = minhash.signatures(sets, 24)
    for row, elements in zip(got, sets):
        assert row.tolist() == plain_signature(elements.tolist(), 24)


def test_signatures_estimate_similarity():
    base = np.arange(1, 901, dtype=U64)
    other = np.concatenate([base[:850], np.arange(5001, 5051, dtype=U64)])
    a, b = minhash.signatures([mix(base), mix(other)], 2048)
    assert abs((a == b).mean() - 850 / 950) < 0.03


def sets_of(texts, size):
    out = {}
    for i, text in texts:
        w = words_of((text or "").encode())
        out[i] = frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    return out


def plain_components(texts, size, percent):
    sets = sets_of(texts, size)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_copies():
    texts, n = [], 0
    for seed in range(8):
        words = prose(seed, 150).split()
        for copy in range(8):
            changed = list(words)
            for k in random.Random(100 * seed + copy).sample(range(150), copy if seed % 2 else 2 * copy):
                changed[k] = f"new{copy}_{k}"
            texts.append((n * 7 % 64, " ".join(changed)))
            n += 1
    return texts + [(100, texts[0][1]), (101, texts[9][1]), (102, None), (103, "short text"), (104, "Short  TEXT")]


@pytest.mark.parametrize("block", [20_000, 3])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 100 * block)
    texts = near_copies()
    found = minhash.near_duplicates(documents(spark, texts), words_per_shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_components(texts, 3, 85)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(s) for i, s in sets_of(texts, 3).items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS, ("component_id", "kept", "bands", "bucket"))
    rows = minhash.near_duplicates(docs, words_per_shingle=3, percent=85).collect()
    assert len(rows) == len(ODD_TEXTS)
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [found[i].n_shingles for i in (1, 2, 3, 4, 5, 7, 8, 10)] == [0, 0, 0, 1, 1, 1, 1, 2]
    assert found[6].component_id == 5 and not found[6].kept and found[4].component_id == 4
    assert all(found[i].kept for i in (1, 2, 3, 5, 7, 8, 9, 10))
    nameless = [r for r in rows if r.doc_id is None]
    assert [(r.n_shingles, r.component_id, r.kept) for r in nameless] == [(1, None, None)]
    kept = minhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        ["1", "2", "3", "4", "4", "5", "7", "8", "9", "10", "None"])


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []
