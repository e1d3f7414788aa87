"""Removal of byte strings that stand elsewhere too, by a column-wise transform of the collection.

The text is cut into segments so that equal strings meet: every string of LENGTH bytes has one anchor, the run of
ANCHOR bytes in it whose hash is smallest, and the strings that follow each other and share an anchor are a segment.
Segments of equal anchors are one collection. Equal strings lie at equal distance from their anchor, so the
collection is aligned at the anchor and its transform is built column by column, from the last to the first: each
round puts one byte before every segment, re-sorts the segments by it, stably, and updates the common prefixes of
neighbours. Only one column is ever held, and a string stands elsewhere if a neighbour shares LENGTH bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import (U64, as_long, bitmap_of, byte_texts, covered, map_batches, membership, mix, once, stored,
                                 whole_groups)

LENGTH, ANCHOR = 400, 128
HOT_SEGMENTS = 20_000  # a collection of more is cut by what its strings hold in common besides the anchor
HOT_STRINGS = 8  # strings of a piece of a segment of such a collection
PIECE_BITS = 19  # long texts are looked at in pieces of 2^19 bytes, overlapping so that no string is cut
BASE = 0x5851F42D4C957F2D


@once
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = (1 << PIECE_BITS) + 1
    inverse = pow(BASE, -1, 1 << 64)
    up, down = (np.concatenate([[U64(1)], np.cumprod(np.full(n - 1, U64(b)))]) for b in (BASE, inverse))
    return up, down, mix(np.arange(1, 257, dtype=U64))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def segments(pieces: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(piece, start, strings, lead, anchor hash): the segments of texts that together fit a piece.

    A segment holds `strings` strings, the first from `start`; its anchor begins `lead` bytes later.
    """
    data = b"".join(pieces)
    up, down, table = _powers()
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(table[np.frombuffer(data, np.uint8)] * up[:n], out=sums[1:])
    runs = mix((sums[anchor:] - sums[:-anchor]) * down[:n - anchor + 1])
    at = np.arange(len(runs), dtype=U64)
    ranked = (runs & ~U64((1 << PIECE_BITS) - 1)) | at  # equal hashes: the first
    best = (_sliding_least(ranked, length - anchor + 1) & U64((1 << PIECE_BITS) - 1)).astype(np.int64)
    ends = np.cumsum([len(p) for p in pieces])
    starts = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(n + 1, np.int32)  # strings that lie in one text
    lengths = ends - starts
    has = lengths >= length
    whole[starts[has]] += 1
    whole[ends[has] - length + 1] -= 1
    inside = np.cumsum(whole)[:len(best)] > 0
    place = np.flatnonzero(inside)
    if not len(place):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),)
    piece = np.searchsorted(ends, place, "right")
    new = np.concatenate([[True], (np.diff(best[place]) != 0) | (np.diff(piece) != 0)])
    first = np.flatnonzero(new)
    begin = place[first]
    count = np.diff(np.append(first, len(place)))
    return piece[first], begin - starts[piece[first]], count, best[begin] - begin, runs[best[begin]]


def _runs(length: int, anchor: int):
    size = 1 << PIECE_BITS

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(1))
            waiting: list[tuple[int, int, bytes]] = []  # row, offset, bytes
            total = 0

            def emit():
                piece, start, count, lead, hashes = segments([p for _, _, p in waiting], length, anchor)
                content = np.fromiter(
                    (xxhash.xxh3_64_intdigest(waiting[k][2][s:e]) for k, s, e in zip(
                        piece.tolist(), start.tolist(), (start + count + length - 1).tolist())), U64, len(piece))
                rows = np.array([r for r, _, _ in waiting])[piece]
                offset = np.array([o for _, o, _ in waiting])[piece]
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), as_long(hashes), as_long(content), pa.array(start + offset),
                     pa.array(count, pa.int32()), pa.array(lead, pa.int32())],
                    ["row_key", "anchor", "content", "start", "strings", "lead"])

            for row, text in enumerate(texts):
                for offset in range(0, max(0, len(text or b"") - length + 1), size - length + 1):
                    part = text[offset:offset + size]
                    if total + len(part) > size:
                        yield emit()
                        waiting, total = [], 0
                    waiting.append((row, offset, part))
                    total += len(part)
            if waiting:
                yield emit()

    return over, "row_key long, anchor long, content long, start long, strings int, lead int"


def _cut_out(length: int):
    """The bytes of the listed segments; those of hot collections in pieces, named by what their strings share."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist()):
                for w in wanted:
                    start, strings, step = w["start"], w["strings"], HOT_STRINGS if w["hot"] else w["strings"]
                    # pieces begin at fixed distances from the anchor, so that those of equal strings are alike
                    first = -w["lead"] // step * step + w["lead"] if w["hot"] else 0
                    for at in range(first, strings, step):
                        low, high = max(0, at), min(strings, at + step)
                        key, lead = w["anchor"], w["lead"] - low
                        if w["hot"]:
                            shared = text[start + at + step - 1:start + at + length]
                            key = xxhash.xxh3_64_intdigest(shared) - (1 << 63)
                        rows.append((key, w["anchor"], w["content"], low, high - low, lead, w["many"],
                                     text[start + low:start + high + length - 1]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            names = ["collection", "anchor", "content", "low", "strings", "lead", "many", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return over, ("collection long, anchor long, content long, low int, strings int, lead int, many boolean, "
                  "bytes binary")


def repeated_strings(collection: np.ndarray, lead: np.ndarray, strings: np.ndarray, texts: list[bytes],
                     length: int = LENGTH, reach: int = LENGTH - ANCHOR) -> np.ndarray:
    """Which strings of segments stand in another segment of their collection too: segments x (reach + 1) columns.

    Column reach - d is the string that begins d bytes before the anchor. `order` holds the segments by what they
    hold from the current column on, `common` the common prefix of each with its predecessor, up to `length`.
    A segment enters where it ends and leaves where it begins.
    """
    left = reach - lead
    right = left + np.array([len(t) for t in texts])
    columns = int(right.max())
    aligned = np.zeros((len(texts), columns), np.uint8)
    for row, text in enumerate(texts):
        aligned[row, left[row]:right[row]] = np.frombuffer(text, np.uint8)
    matrix = np.ascontiguousarray(aligned.T)
    _, group = np.unique(collection, return_inverse=True)
    group = group.astype(np.int64) << 8
    by_end = np.argsort(-right, kind="stable")
    enters = np.searchsorted(-right[by_end], -np.arange(columns + 1), "left")  # enters[c] segments reach beyond c
    result = np.zeros((len(texts), reach + 1), bool)
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for column in range(columns - 1, -1, -1):
        new = by_end[enters[column + 1]:enters[column]]
        if len(new):
            order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int32), common])
            if len(common) > len(new):
                common[len(new)] = 0
        key = group[order] | matrix[column][order]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        alike = np.flatnonzero(key[1:] == key[:-1])
        ranges = np.empty(2 * len(alike), np.int64)
        ranges[0::2], ranges[1::2] = moved[alike] + 1, moved[alike + 1] + 1
        updated = np.zeros(len(order) + 1, np.int32)
        if len(alike):
            shortest = np.minimum.reduceat(np.append(common, np.int32(0)), ranges)[::2]
            updated[alike + 1] = np.minimum(shortest + 1, length)
        order, common = order[moved], updated[:-1]
        if column <= reach:
            begins = (column - left[order] < strings[order])
            result[order, column] = begins & ((common >= length) | (updated[1:] >= length))
            stay = np.flatnonzero(left[order] < column)
            if len(stay) < len(order):
                if len(stay):
                    common = np.minimum.reduceat(common[:stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1]))
                order, common = order[stay], common[:len(stay)]
    return result


def _judged(length: int, anchor: int):
    """The runs of strings (from, to) of each segment that stand elsewhere too."""
    reach = length - anchor

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, ["collection"]):
            columns = {c: table.column(c).to_numpy() for c in ("collection", "low", "strings", "lead", "many")}
            lead, strings = columns["lead"].astype(np.int64), columns["strings"].astype(np.int64)
            elsewhere = repeated_strings(columns["collection"], lead, strings, table.column("bytes").to_pylist(),
                                         length, reach)
            first = reach - lead
            offset = np.arange(reach + 1)[None, :] - first[:, None]
            inside = (offset >= 0) & (offset < strings[:, None])
            found = (elsewhere | columns["many"].astype(bool)[:, None]) & inside
            padded = np.pad(found, ((0, 0), (1, 1))).astype(np.int8)
            change = np.diff(padded, axis=1)
            row, begin = np.nonzero(change == 1)
            _, end = np.nonzero(change == -1)
            at = pa.array(row)
            low = columns["low"].astype(np.int64)[row]
            yield pa.RecordBatch.from_arrays(
                [table.column("anchor").combine_chunks().take(at), table.column("content").combine_chunks().take(at),
                 pa.array(begin - first[row] + low), pa.array(end - first[row] + low)],
                ["anchor", "content", "begin", "end"])

    return over, "anchor long, content long, begin long, end long"


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(row_key, begin, end): byte ranges of texts covered by `length`-byte strings that also start elsewhere.

    row_key is xxhash64(doc_id, text). Ranges may overlap. Repeated rows are places of their own, so all their strings
    stand elsewhere; texts shorter than `length` and null texts hold none.
    """
    over, schema = _runs(length, anchor)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("binary").alias("text"))
    runs = stored(map_batches(keyed, over, schema), "segments")
    anchors = stored(runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("low"),
                                                F.max("content").alias("high")).filter("n > 1")
                     .select("anchor", "n", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    listed = stored(runs.filter(membership(bitmap_of(anchors, "anchor"))("anchor")).join(anchors, "anchor"), "repeated")
    # segments alike to the last byte: all their strings stand elsewhere; where others share the anchor, one of them
    # represents the equal ones in the collection
    alike = listed.filter("not mixed").select("row_key", F.col("start").alias("begin"),
                                              (F.col("start") + F.col("strings") + length - 1).alias("end"))
    mixed = listed.filter("mixed")
    chosen = (mixed.groupBy("anchor", "content", "n").agg(
        F.count("*").alias("times"), F.min(F.struct("row_key", "start", "strings", "lead")).alias("at")))
    wanted = stored(chosen.select("at.row_key", F.struct(
        "anchor", "content", "at.start", "at.strings", "at.lead", (F.col("times") > 1).alias("many"),
        (F.col("n") > hot).alias("hot")).alias("segment")).groupBy("row_key")
        .agg(F.collect_list("segment").alias("segments")), "wanted")
    maybe = membership(bitmap_of(wanted, "row_key"))
    texts = (keyed.filter(maybe("row_key")).join(wanted, "row_key").groupBy("row_key")
             .agg(F.min("text").alias("text"), F.first("segments").alias("segments")).select("text", "segments"))
    cut, cut_schema = _cut_out(length)
    judged, judged_schema = _judged(length, anchor)
    found = map_batches(map_batches(texts, cut, cut_schema).repartition("collection")
                        .sortWithinPartitions("collection"), judged, judged_schema)
    shared = (mixed.join(found, ["anchor", "content"])
              .select("row_key", (F.col("start") + F.col("begin")).alias("begin"),
                      (F.col("start") + F.col("end") + length - 1).alias("end")))
    return alike.unionAll(shared)


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): per row of `docs` its length, the removed ranges (maximal, in order) and the
    bytes left. A null text is empty. Further columns are ignored; an empty table gives an empty result."""
    found = stored(repeats(docs, **parameters).groupBy("row_key")
                   .agg(F.collect_set(F.struct("begin", "end")).alias("ranges")), "ranges")
    maybe = membership(bitmap_of(found, "row_key"))
    keyed = (docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
                         F.xxhash64("doc_id", "text").alias("row_key")).withColumn("hit", maybe("row_key")))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    joined = (keyed.filter("hit").join(found, "row_key", "left")
              .select("doc_id", "text", F.coalesce("ranges", none).alias("ranges"))
              .unionAll(keyed.filter("not hit").select("doc_id", "text", none.alias("ranges"))))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            removed, kept, lengths = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs = covered([(r["begin"], r["end"]) for r in ranges])
                edges = [0, *[x for run in runs for x in run], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append([{"begin": a, "end": b} for a, b in runs])
                lengths.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "removed", "kept"])

    return map_batches(joined, over, "doc_id long, n_bytes long, removed array<struct<begin:bigint,end:bigint>>, "
                                     "kept binary")


