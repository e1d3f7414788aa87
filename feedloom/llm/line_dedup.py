"""Removal of passages of several lines that stand elsewhere too: whole, or cut at content-defined boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import U64, as_long, bitmap_of, byte_texts, map_batches, membership, mix, stored

ROLLING_LINES = 2  # a boundary depends on so many lines before it, so an inserted line moves only near boundaries
MEAN_LINES = 3  # of a chunk
LEAST_LINES = 2
LEAST_BYTES = 40  # shorter chunks are left alone


def chunks_of(text: bytes) -> list[tuple[int, int, int]]:
    """(first byte, end, lines) of the chunks of a text; the line feeds between two chunks belong to neither.

    A line ends a chunk if the rolling hash over it and the line before is 0 modulo MEAN_LINES.
    """
    lines = text.split(b"\n")
    hashes = np.array([xxhash.xxh3_64_intdigest(line) for line in lines], U64)
    rolling = np.zeros(len(lines), U64)
    for back in range(ROLLING_LINES):
        rolling = mix(rolling)
        rolling[back:] += hashes[:len(lines) - back]
    cut = mix(rolling) % U64(MEAN_LINES) == 0
    cut[-1] = True
    ends_of_lines = np.cumsum([len(line) + 1 for line in lines])
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    starts = np.concatenate([[0], ends_of_lines])[first]
    return [(int(s), int(e) - 1, int(n)) for s, e, n in zip(starts, ends_of_lines[last], last - first + 1)]


def windows_of(text: bytes) -> list[tuple[int, int, int, int]]:
    """(first byte, end, lines, first line) of the shortest passages worth removing that start or end at each line.

    Every longer passage of LEAST_LINES and LEAST_BYTES is a union of such windows.
    """
    lines = text.split(b"\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    found, last = set(), 0
    for first in range(len(lines)):
        last = max(last, first + LEAST_LINES - 1)
        while last < len(lines) and starts[last + 1] - 1 - starts[first] < LEAST_BYTES:
            last += 1
        if last >= len(lines):
            break
        found.add((first, last))
    first = len(lines)
    for last in reversed(range(len(lines))):
        first = min(first, last - LEAST_LINES + 1)
        while first >= 0 and starts[last + 1] - 1 - starts[first] < LEAST_BYTES:
            first -= 1
        if first < 0:
            break
        found.add((first, last))
    return [(starts[a], starts[b + 1] - 1, b - a + 1, a) for a, b in sorted(found)]


def _worth(chunk: tuple[int, ...]) -> bool:
    return chunk[2] >= LEAST_LINES and chunk[1] - chunk[0] >= LEAST_BYTES


def _hashed(parts: Callable[[bytes], list[tuple]]):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, hi, lo = [], [], [], []
            for row, text in enumerate(byte_texts(batch.column(2))):
                for k, chunk in enumerate(parts(text or b"")):
                    if _worth(chunk):
                        value = xxhash.xxh3_128_intdigest(text[chunk[0]:chunk[1]])
                        rows.append(row)
                        number.append(k)
                        hi.append(value >> 64)
                        lo.append(value & 0xFFFFFFFFFFFFFFFF)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()),
                 as_long(np.array(hi, U64)), as_long(np.array(lo, U64))], ["doc_id", "text_key", "chunk", "hi", "lo"])

    return over


def _cut_out(parts: Callable[[bytes], list[tuple]]):
    """The bytes of the listed chunks of a text."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, content = [], [], []
            for row, (text, wanted) in enumerate(zip(byte_texts(batch.column(2)), batch.column(3).to_pylist())):
                chunks = parts(text)
                for k in wanted:
                    rows.append(row)
                    number.append(k)
                    content.append(text[chunks[k][0]:chunks[k][1]])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()),
                 pa.array(content, pa.binary())], ["doc_id", "text_key", "chunk", "content"])

    return over


def repeated_chunks(docs: DataFrame, parts: Callable[[bytes], list[tuple]] = chunks_of) -> DataFrame:
    """(doc_id, text_key, chunk, first_doc_id, own_first): the chunks of several lines that an earlier place holds too.

    text_key is xxhash64(text), chunk counts the chunks of the text from 0. The earliest place, by doc_id, then
    text_key, then position, is not listed. Chunks are equal if all their bytes are. Rows that repeat both
    doc_id and text are one place. A null text has no chunks; a null doc_id comes before all others. Further
    columns are ignored. own_first is the earliest chunk where it stands in the same text, else null. `parts` cuts
    a text into chunks, or into windows that may overlap.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    chunks = stored(map_batches(keyed, _hashed(parts), "doc_id long, text_key long, chunk int, hi long, lo long"), "chunks")
    place = F.struct("doc_id", "text_key", "chunk")
    # merge joins at every size: the lists grow with the documents, and skewed keys are split at run time
    repeated = (chunks.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                .filter("first <> last").select("hi", "lo", "first"))
    listed = stored(chunks.join(repeated, ["hi", "lo"]).select("doc_id", "text_key", "chunk", "hi", "lo", "first"),
                    "repeated")
    wanted = listed.groupBy("doc_id", "text_key").agg(F.collect_set("chunk").alias("wanted"))
    maybe = membership(bitmap_of(listed.select("text_key").distinct(), "text_key"))
    texts = keyed.filter("text is not null").filter(maybe("text_key")).alias("t").join(
        wanted.hint("merge").alias("w"), F.expr("t.text_key = w.text_key and t.doc_id <=> w.doc_id")).select("t.*", "wanted")
    cut = map_batches(texts, _cut_out(parts), "doc_id long, text_key long, chunk int, content binary")
    content = stored(cut.alias("c").join(listed.hint("merge").alias("l"), F.expr(
        "c.text_key = l.text_key and c.chunk = l.chunk and c.doc_id <=> l.doc_id"))
        .select("l.*", "content"), "contents")
    mine = content.select("first", "hi", "lo", F.struct("doc_id", "text_key", "chunk").alias("place"), "content")
    firsts = (mine.filter("first = place").groupBy("hi", "lo").agg(F.min("content").alias("first_content")))
    own = F.expr("first.doc_id <=> place.doc_id and first.text_key = place.text_key")
    return (mine.filter("first <> place").join(firsts.hint("merge"), ["hi", "lo"]).filter("content = first_content")
            .select("place.doc_id", "place.text_key", "place.chunk", F.col("first.doc_id").alias("first_doc_id"),
                    F.when(own, F.col("first.chunk")).alias("own_first")).distinct())


def without_passages(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without the lines of repeated passages, wherever these begin and end.

    A passage is a run of LEAST_LINES lines and LEAST_BYTES bytes or more. It goes if all its bytes stand at an earlier
    place (by doc_id, then text_key, then position) that it does not overlap. The first place of every line stays.
    Otherwise as `without_repeats`.
    """
    def rest(data: bytes, gone: list[tuple[int, int]]) -> bytes:
        windows, lines = windows_of(data), data.split(b"\n")
        lost = {line for k, own in gone if own < 0 or windows[own][3] + windows[own][2] <= windows[k][3]
                for line in range(windows[k][3], windows[k][3] + windows[k][2])}
        return b"\n".join(line for k, line in enumerate(lines) if k not in lost)

    return _without(docs, windows_of, rest)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without the repeated chunks of their texts.

    What is left of a text is joined as it stood. A document of which nothing but white space is left, and which
    had more, goes. Rows with nothing to remove come back as they are, null and empty texts among them.
    `n_chars`, where there is one, is counted anew for changed texts.
    """
    def rest(data: bytes, gone: list[tuple[int, int]]) -> bytes:
        numbers = {k for k, _ in gone}
        return b"\n".join(data[a:b] for k, (a, b, _) in enumerate(chunks_of(data)) if k not in numbers)

    return _without(docs, chunks_of, rest)


def _without(docs: DataFrame, parts: Callable[[bytes], list[tuple]],
             rest: Callable[[bytes, list[tuple[int, int]]], bytes]) -> DataFrame:
    """`docs` with `rest` of the texts of which repeated_chunks lists something: (chunk, own_first or -1) each."""
    both = F.shiftleft(F.col("chunk").cast("long"), 32) + F.coalesce("own_first", F.lit(-1)) + 1
    found = stored(repeated_chunks(docs, parts).select("doc_id", "text_key", both.alias("gone")), "removals")
    lists = found.groupBy("doc_id", "text_key").agg(F.collect_set("gone").alias("__removed"))
    maybe = membership(bitmap_of(found.select("text_key").distinct(), "text_key"))
    keyed = docs.withColumn("__key", F.xxhash64("text")).withColumn("__maybe", maybe("__key"))
    joined = keyed.filter("__maybe and text is not null").alias("t").join(
        lists.hint("merge").alias("l"), F.expr("t.__key = l.text_key and t.doc_id <=> l.doc_id"), "left").select("t.*", "__removed")

    @F.pandas_udf("string")
    def rebuilt(texts: pd.Series, removed: pd.Series) -> pd.Series:
        def one(text: str, gone: np.ndarray) -> str:
            return rest(text.encode(), [(int(x) >> 32, (int(x) & 0xFFFFFFFF) - 1) for x in gone]).decode()

        return texts.combine(removed, one)

    changed = (joined.filter("__removed is not null").withColumn("text", rebuilt("text", "__removed"))
               .filter("text rlike '\\\\S'"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    same = keyed.filter("not __maybe or text is null").unionByName(joined.filter("__removed is null")
                                                                   .drop("__removed"))
    return same.select(*docs.columns).unionAll(changed.select(*docs.columns))
