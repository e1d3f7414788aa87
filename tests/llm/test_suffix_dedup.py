import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import queries, suffix_dedup
from tests.llm.samples import ODD_TEXTS, documents, prose


def plain(texts, length):
    """(bytes, removed, spans, what is left) of each text, by counting all its strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[k:k + length] for x in data for k in range(len(x) - length + 1))
    out = []
    for x in data:
        runs = []
        for k in range(len(x) - length + 1):
            if seen[x[k:k + length]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + length
                else:
                    runs.append([k, k + length])
        edges = [0, *[e for r in runs for e in r], len(x)]
        out.append((len(x), sum(b - a for a, b in runs), len(runs), b"".join(
            x[a:b] for a, b in zip(edges[::2], edges[1::2]))))
    return out


def mingled(count, seed):
    pick = random.Random(seed)
    shared = [prose(k, pick.randrange(4, 30)) for k in range(8)]
    texts = []
    for k in range(count):
        parts = [prose(100 + k * 9 + j, pick.randrange(2, 20)) for j in range(4)]
        for _ in range(3):
            parts.insert(pick.randrange(len(parts) + 1), pick.choice(shared))
        texts.append(" ".join(parts))
    return texts + [texts[0], texts[1][:150], "ab" * 300, "abc" * 100, "é" * 200, None, "", texts[2]]


@pytest.mark.parametrize("hot", [20_000, 1])
@pytest.mark.parametrize("piece_bits", [19, 9])
def test_removal_equals_counting_all_strings(spark, monkeypatch, hot, piece_bits):
    if piece_bits == 9 and hot == 1:
        pytest.skip("covered by the two alone")
    monkeypatch.setattr(suffix_dedup, "PIECE_BITS", piece_bits)
    suffix_dedup._powers.forget()
    texts = mingled(30, 1)
    docs = documents(spark, enumerate(texts), ("anchor", "row_key", "ranges"))
    rows = {r.doc_id: r for r in suffix_dedup.without_repeats(docs, length=60, anchor=20, hot=hot).collect()}
    want = plain(texts, 60)
    got = [(r.n_bytes, sum(x.end - x.begin for x in r.removed), len(r.removed), bytes(r.kept)) for _, r in sorted(
        rows.items())]
    suffix_dedup._powers.forget()
    assert got == want and any(w[1] for w in want)


def test_segments_hold_every_string_once():
    pieces = [prose(k, 80).encode() for k in range(4)] + [b"ab" * 100, b"short"]
    piece, start, strings, lead, _ = suffix_dedup.segments(pieces, 50, 16)
    places = Counter((p, s + k) for p, s, n in zip(piece, start, strings) for k in range(n))
    assert places == Counter((p, k) for p, x in enumerate(pieces) for k in range(len(x) - 49))
    assert ((lead >= strings - 1) & (lead <= 50 - 16)).all()


def test_transform_equals_comparing_pairs():
    pick = np.random.default_rng(3)
    length, anchor, reach = 12, 4, 8
    texts, lead, strings, collection = [], [], [], []
    for k in range(60):
        n = int(pick.integers(1, reach + 2))
        lead.append(int(pick.integers(n - 1, reach + 1)))
        strings.append(n)
        collection.append(int(pick.integers(0, 3)))
        core = np.full(40, 97)
        core[pick.integers(0, 40, 2)] = 98  # nearly the same everywhere
        texts.append(core[reach - lead[-1]:][:n + length - 1].astype(np.uint8).tobytes())
    order = np.argsort(collection, kind="stable")
    texts = [texts[k] for k in order]
    lead, strings, collection = (np.array(x)[order] for x in (lead, strings, collection))
    got = suffix_dedup.repeated_strings(collection, lead, strings, texts, length, reach)
    seen = Counter((collection[k], reach - lead[k] + j, t[j:j + length])
                   for k, t in enumerate(texts) for j in range(strings[k]))
    for k, t in enumerate(texts):
        for j in range(strings[k]):
            column = reach - lead[k] + j
            assert got[k, column] == (seen[collection[k], column, t[j:j + length]] > 1)


def test_odd_rows_and_query(spark):
    rows = suffix_dedup.without_repeats(documents(spark, ODD_TEXTS, ("kept", "begin"))).collect()
    assert len(rows) == len(ODD_TEXTS)
    found = {r.doc_id: r for r in rows}
    assert [(found[i].n_bytes, len(found[i].removed)) for i in (1, 2, 4)] == [(0, 0), (0, 0), (3, 0)]
    assert [(found[i].removed[0].end, bytes(found[i].kept)) for i in (7, 8)] == [(60_000, b""), (40_000, b"")]
    assert suffix_dedup.without_repeats(documents(spark, [])).collect() == []
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = plain([r.text for r in docs], 400)
    got = {r.doc_id: r for r in queries.op7_suffix_dedup(spark, sf).collect()}
    for r, (size, removed, spans, kept) in zip(docs, want):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (size, removed, spans,
                                                                      hashlib.sha256(kept).hexdigest())
