"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import (MULTIPLIER, U64, WordHashes, as_long, bitmap_of, byte_texts, in_blocks, map_batches,
                                 membership, mix, shingle_hashes, stored, whole_groups, words_of)
from feedloom.llm.components import components

#: 26 bands of 5 values: a pair at similarity 0.85 shares no band with probability 2.4e-7, at 0.8 with 3.3e-5.
BANDS, ROWS = 26, 5
BLOCK_CLASSES = 20_000  # of a bucket, compared by signatures in one task
BLOCK_SHINGLES = 2_000_000  # of a group, compared on full sets in one task
ELEMENTS_AT_ONCE = 60_000  # bounds the permutation state of a worker


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures, one row per set of distinct 64-bit elements; an empty set has infinite values.

    Element e has its own random permutation p of the `size` places and, in round j, offers the value
    j + u(e, j) with u uniform in [0, 1) to place p[j]: the ranks of one element are correlated, which
    spreads its values evenly over the places. All elements of all sets take a round together; a set stops
    as soon as its largest value is below the next round, when no later offer can win.
    """
    out = np.full((len(sets), size), np.inf)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, U64)
    if not len(elements):
        return out
    places = None
    for j in range(size):
        random = mix(elements + U64((j + 1) * int(MULTIPLIER) & 0xFFFFFFFFFFFFFFFF))
        value = j + (random >> U64(32)).astype(np.float64) * 2.0 ** -32
        pick = j + ((random & U64(0xFFFFFFFF)) % U64(size - j)).astype(np.int64)
        if places is None:
            place = pick
        else:
            row = np.arange(len(elements))
            place = places[row, pick]
            places[row, pick] = places[:, j]
        np.minimum.at(flat, owner * size + place, value)
        live = (out.max(axis=1) >= j + 1)[owner]
        if not live.any():
            break
        if places is None:
            places = np.tile(np.arange(size, dtype=np.uint16), (int(live.sum()), 1))
            places[np.arange(len(places)), pick[live]] = 0
        elif not live.all():
            places = places[live]
        if not live.all():
            owner, elements = owner[live], elements[live]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band: equal keys mean equal values in that band (and the same band)."""
    values = signature.view(U64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), values.shape[:2])
    for k in range(rows):
        key = mix((key ^ values[:, :, k]) * MULTIPLIER)
    return key


def _described(words_per_shingle: int, bands: int, rows: int):
    schema = "doc_id long, n_shingles long, class_hi long, class_lo long, text_key long, bands array<long>, marks binary"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, texts, text_keys = batch.column(0), byte_texts(batch.column(1)), batch.column(2)
            start = 0
            while start < len(texts):  # so many documents at a time as keep the permutations small
                sets, total, end = [], 0, start
                while end < len(texts) and total < ELEMENTS_AT_ONCE:
                    found = np.unique(shingle_hashes(hashes.of(words_of(texts[end] or b"")), words_per_shingle))
                    sets.append(found)
                    total += len(found)
                    end += 1
                sizes = np.array([len(s) for s in sets], np.int64)
                class_hi = np.array([np.bitwise_xor.reduce(mix(s * MULTIPLIER)) if len(s) else 0 for s in sets], U64)
                class_lo = np.array([np.add.reduce(mix(s + MULTIPLIER)) if len(s) else 0 for s in sets], U64)
                signed = signatures(sets, bands * rows)
                keys = band_keys(signed, bands, rows).reshape(-1).view(np.int64)
                marks = (mix(signed.view(U64)) & U64(255)).astype(np.uint8)
                offsets = np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.array(sizes), as_long(class_hi), as_long(class_lo),
                     text_keys.slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)),
                     pa.array([m.tobytes() for m in marks], pa.binary())],
                    ["doc_id", "n_shingles", "class_hi", "class_lo", "text_key", "bands",
                     "marks"])
                start = end

    return over, schema


def _forest(size: int, linked_to) -> Iterator[tuple[int, int]]:
    """(root, member) of the components of `size` items, where linked_to(item, others) says which others it links to.

    Every item is compared with the items that no one has reached yet: a group in which most are linked takes
    few comparisons, and no pair is stored.
    """
    open_items = np.arange(size)
    while len(open_items) > 1:
        root, open_items = open_items[0], open_items[1:]
        frontier = [root]
        while frontier and len(open_items):
            hit = linked_to(frontier.pop(), open_items)
            for item in open_items[hit]:
                yield int(root), int(item)
                frontier.append(item)
            open_items = open_items[~hit]


def _likely(values: int, percent: int):
    """Of the classes in one bucket: a forest of those whose signatures and sizes allow the wanted similarity."""
    share = percent / 100
    least = values * share - 5 * (values * share * (1 - share)) ** 0.5  # missed with probability 3e-7

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["bucket", "block_a", "block_b"]):
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(ids), values)
            sizes = np.diff(np.append(starts, len(ids)))

            def fit(a, b):
                near = (marks[a] == marks[b]).sum(axis=1) >= least
                return near & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))

            first = starts[sizes == 2]
            good = first[fit(first, first + 1)]
            left, right = [good], [good + 1]
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
                found = list(_forest(size, lambda item, others: fit(start + item, start + others)))
                left.append(start + np.array([a for a, _ in found], np.int64))
                right.append(start + np.array([b for _, b in found], np.int64))
            a, b = ids[np.concatenate(left)], ids[np.concatenate(right)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return over


def _linked(words_per_shingle: int, percent: int):
    """Of the classes in one likely group: a forest of the links on their full sets."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for table, starts in whole_groups(batches, ["likely", "block_a", "block_b"]):
            ids, texts = table.column("id").to_numpy(), byte_texts(table.column("text").combine_chunks())
            left, right = [], []
            for start, end in zip(starts, np.append(starts[1:], len(ids))):
                sets = [np.unique(shingle_hashes(hashes.of(words_of(t)), words_per_shingle)) for t in texts[start:end]]
                n = np.array([len(s) for s in sets])
                owner = np.repeat(np.arange(len(sets)), n)
                _, number = np.unique(np.concatenate(sets), return_inverse=True)
                order = np.argsort(number, kind="stable")
                holders, first = owner[order], np.searchsorted(number[order], np.arange(number.max() + 2))
                bounds = np.concatenate([[0], np.cumsum(n)])

                def linked_to(item: int, others: np.ndarray) -> np.ndarray:
                    mine = number[bounds[item]:bounds[item + 1]]
                    lengths = first[mine + 1] - first[mine]
                    at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
                    both = np.bincount(holders[at + np.arange(len(at))], minlength=len(sets))[others]
                    return 100 * both >= percent * (n[item] + n[others] - both)

                for a, b in _forest(len(sets), linked_to):
                    left.append(ids[start + a])
                    right.append(ids[start + b])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return over


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, class_id.

    A document's set holds its distinct shingles of lower-cased words; a shorter text is one shingle, a null,
    empty or blank text has no set and is linked with nothing. Documents of equal sets form a class, named by
    its smallest doc_id (`class_id`); only one text per class is compared. Two classes are linked if
    100 * intersection >= percent * union on the full sets.

    Classes that share a bucket are compared by their signatures, with five standard deviations to spare; the
    groups that remain connected are compared on full sets. Inside a group every class is compared with those not
    yet reached, so near-copies need few comparisons and no pairs are stored; large groups are cut into blocks.

    Rows that repeat a doc_id are one document, whose set is the smallest of theirs; each row is returned with
    its own n_shingles. Rows without doc_id are returned with null component_id, kept and class_id, and are
    linked with nothing. Other columns of `docs` are ignored. An empty table gives an empty result.
    """
    over, schema = _described(words_per_shingle, bands, rows)
    described = stored(map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), over, schema),
                       "signatures")
    whole = ["n_shingles", "class_hi", "class_lo"]
    sets = (described.filter("doc_id is not null").groupBy("doc_id")
            .agg(F.min(F.struct(*whole, "text_key", "bands", "marks")).alias("least")).select("doc_id", "least.*"))
    filled = stored(sets.filter("n_shingles > 0"), "sets")
    classes = stored(filled.groupBy(*whole).agg(F.min(F.struct("doc_id", "text_key", "bands", "marks")).alias("least"))
                     .select(*whole, F.col("least.doc_id").alias("id"), "least.text_key", "least.bands",
                             "least.marks"), "classes")
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    shared = (buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
              .select("bucket", F.ceil(F.col("size") / F.lit(BLOCK_CLASSES)).cast("int").alias("blocks")))
    members = (buckets.join(shared, "bucket")
               .join(classes.select("id", F.col("n_shingles").alias("n"), "marks"), "id"))

    likely = components(map_batches(in_blocks(members.select("bucket", "id", "n", "marks", "blocks"), ["bucket"], "id",
                                              "blocks"), _likely(bands * rows, percent), "a long, b long"))
    named = stored(classes.select("id", "text_key", "n_shingles").join(likely, "id")
                   .withColumnRenamed("component", "likely"), "likely")
    sizes = named.groupBy("likely").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    maybe = membership(bitmap_of(named, "id"))
    texts = (docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("text_key"))
             .filter(maybe("id")).join(named.join(sizes, "likely"), ["id", "text_key"])
             .groupBy("likely", "id", "blocks").agg(F.min("text").alias("text")))
    final = components(map_batches(in_blocks(texts, ["likely"], "id", "blocks"), _linked(words_per_shingle, percent),
                                   "a long, b long"))

    roots = (classes.select(*whole, "id").join(final, "id", "left")
             .select(*whole, F.col("id").alias("class_id"), F.coalesce("component", "id").alias("root")))
    of_doc = filled.select("doc_id", *whole).join(roots, whole).select("doc_id", "class_id", "root")
    alone = F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))
    return (described.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", alone).alias("component_id"),
                    F.coalesce("class_id", alone).alias("class_id"))
            .select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"),
                    "class_id"))


def one_of_each_group(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs`, all columns, that lead their group (`kept`); rows without doc_id stay.

    Of rows that repeat a doc_id all stay or none does: they are one document.
    """
    lost = near_duplicates(docs, **parameters).filter("not kept").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
