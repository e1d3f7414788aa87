"""Phrases beside a plain count over strings."""

import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import phrases
from feedloom.llm.common import BITMAP_BITS
from feedloom.llm.phrases import Chunk, Runs, collocations, normal, stretches
from tests.llm.samples import ODD_TEXTS, documents, prose


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, least, longest, first):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i:i + n])] += 1
    often = {k: f for k, f in counts.items() if f >= least}
    out = []
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        holders = [f for (other, w), f in often.items() if other == lang and len(w) > len(words)
                   and any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if any(f >= a for f in holders):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = often[lang, words[:k]], often[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right, totals[lang]))
    ranked = []
    for lang in {o[0] for o in out}:
        for rank, o in enumerate(sorted(x for x in out if x[0] == lang)[:first], 1):
            ranked.append((lang, rank, o[3].decode(), -o[2], o[4], o[5], o[6], -o[1]))
    return sorted(ranked)


def table(spark, rows):
    return spark.createDataFrame([(lang, text, "row", 1) for lang, text in rows], "lang string, text string, row string, key int")


MIXED = [(("en", "de", None)[k % 3], prose(k % 17, 60, 12) + (" To be OR not to be" if k % 2 else "\tto  be,or not!")) for k in range(60)]


@pytest.mark.parametrize("rows,least,longest,first", [
    (MIXED, 5, 5, 2000), (MIXED, 5, 3, 4), ([(None, t) for _, t in ODD_TEXTS], 2, 5, 2000),
    ([("en", "a a a a a b a a")] * 7 + [("en", None), ("en", "")], 3, 4, 2000), ([("en", "nothing twice here")], 2, 5, 10)])
def test_beside_plain_counts(spark, rows, least, longest, first):
    found = collocations(table(spark, rows), least=least, longest=longest, first=first).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, least, longest, first)


def test_empty_table(spark):
    assert collocations(documents(spark, [])).count() == 0


def test_large_counts_stay_exact(spark):
    big = 10 ** 13
    rows = [("en", 1, "x", big), ("en", 1, "y", big - 7), ("en", 2, "x y", big - 11)]
    found = phrases.scored(spark.createDataFrame(rows, "lang string, n_words int, phrase string, f long"),
                           spark.createDataFrame([("en", 3 * 10 ** 15 + 1)], "lang string, n long")).first()
    assert found.score == 1000 * (big - 11) * (3 * 10 ** 15 + 1) // (big * (big - 7))


def counts_of(chunk, n):
    """Counts by the bytes each group's first place points at."""
    runs, text = Runs(chunk), b"\n".join(chunk.parts)
    keys = runs.keys(n)
    out = Counter()
    for place, count in zip(*runs.groups(n, keys, np.ones(len(keys), bool))):
        out[text[runs.ends[place] - runs.lengths[place]:runs.ends[place + n - 1]]] += int(count)
    return out


def test_stretches_of_a_long_text_count_every_run_once():
    text = normal(prose(3, 4000, 50).encode())
    whole = Chunk()
    whole.add(7, "en", 0, text)
    for n in (1, 2, 5):
        cut = Counter()
        for start, end, skip in stretches(text, n - 1, 300):
            part = Chunk(skip=skip)
            part.add(7, "en", start, text[start:end])
            cut += counts_of(part, n)
        assert cut == counts_of(whole, n)


def test_long_texts_beside_plain_counts(spark):
    rows = [("en", prose(5, 900, 9)), ("en", "x y z " * 100), (None, prose(6, 10, 9))]
    found = collocations(table(spark, rows), least=4, longest=5, first=2000, chunk_bytes=200).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, 4, 5, 2000)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With all phrases of a length under one fingerprint, their texts still part them."""
    def same(hashes, n, salt):
        return np.full(max(0, len(hashes) - n + 1), n, np.uint64)

    monkeypatch.setattr(phrases.Runs, "keys", lambda self, n: same(self.hashes, n, self.salt))
    chunk = Chunk()
    chunk.add(1, "en", 0, b"a b a b\nc a b")
    assert counts_of(chunk, 2) == {b"a b": 3, b"b a": 1, b"c a": 1}
    found = phrases.together(list(phrases.places(chunk, [(range(1, 3), np.full(BITMAP_BITS // 32, 2 ** 32 - 1, np.uint32))])))
    assert sorted(found[0].tolist()) == [1, 1, 1, 2, 2, 2] and len(set(found[1].tolist())) == 6
    assert sorted(found[2].tolist()) == [1, 1, 1, 3, 3, 3]


def test_normal_form():
    assert normal("  Ab\tcD. É;;\n x \x0b!y".encode()) == "ab cd\nÉ\nx\ny".encode()


def test_only_runs_of_frequent_parts_are_handed_out():
    chunk = Chunk()
    chunk.add(0, "en", 0, b"a b c d")
    runs, everything = Runs(chunk), np.full(BITMAP_BITS // 32, 0xFFFFFFFF, np.uint32)
    words = np.zeros_like(everything)
    for key in runs.keys(1)[[0, 1, 3]]:  # all but c; the other bitmaps are full, as they may become
        slot = int(key) % BITMAP_BITS
        words[slot >> 5] |= np.uint32(1 << (slot & 31))
    found = phrases.places(chunk, [(range(1, 2), words), (range(2, 3), everything), (range(3, 6), everything)])
    assert [sorted(zip(f[4].tolist(), f[5].tolist())) for f in found] == [[(0, 1), (2, 1), (6, 1)], [(0, 3)], [], [], []]


def test_the_last_pass_has_few_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([("a b a b",)] * 20, "text string").selectExpr("text", "'en' AS lang").repartition(20)
    tasks, mapped = [], phrases.map_batches
    monkeypatch.setattr(phrases, "map_batches", lambda df, *rest: tasks.append(df.rdd.getNumPartitions()) or mapped(df, *rest))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a task per file
    try:
        got = {(r.phrase, r.a) for r in collocations(docs, least=2, longest=3, first=9).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks[1] > tasks[-1] == spark.sparkContext.defaultParallelism
    assert got == {("a b", 40), ("a b a", 20), ("b a b", 20)}
