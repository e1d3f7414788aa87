"""Benchmark contamination by templates: numbers, names and units become slots, windows are hash-joined, and the
values in the slots must agree throughout a match."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import (CACHED_WORD_BYTES, CACHED_WORDS, U64, as_long, bitmap_of, byte_texts, in_bitmap,
                                 map_batches, shingle_hashes, stored)

WINDOW = 8  # template tokens
MATCH = 13  # consistent tokens that make a match, or 80 % of a shorter item
SHIFT = 3  # tokens inserted or left out at one place that do not end a match

#: Words taken for a unit after a number.
UNITS = frozenset(b"""
    % km m cm mm kg g mg lb lbs oz l ml s sec secs second seconds min mins minute minutes h hour hours day days week
    weeks month months year years mile miles meter meters metre metres foot feet inch inches dollar dollars euro euros
    cent cents percent degree degrees
""".split())

NUMBER = re.compile(rb"[+-]?[$\xa3]?\d[\d.,:/]*")
NUMBER_UNIT = re.compile(rb"([+-]?\d[\d.,]*)([a-z%]+)")
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOPS = b".!?:;"

LITERAL, NUM, CAPITAL, UNIT, NUM_UNIT, NOTHING = range(6)
STOP_BIT = 8
SLOT_HASH = np.array([0, 0x6E756D626572, 0x6E616D65, 0x756E6974, 0x6E756D756E6974, 0], U64)  # of number, name, ...


class Tokens(dict):
    """What a word is: 60 bits of the hash of its lower-case core, whether it ends a sentence, and its kind."""

    def __missing__(self, word: bytes) -> int:
        core, stop = word.strip(EDGE), word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":", b";")
        lower = core.lower()
        if NUMBER.fullmatch(core):
            kind = NUM_UNIT if word.endswith(b"%") else NUM
        elif NUMBER_UNIT.fullmatch(lower):
            kind = NUM_UNIT
        elif not core:
            kind = UNIT if word == b"%" else NOTHING
        elif lower in UNITS:
            kind = UNIT
        else:
            try:
                kind = CAPITAL if core.decode()[0].isupper() else LITERAL
            except UnicodeDecodeError:  # an edge byte stripped inside a letter
                kind = LITERAL
        value = (xxhash.xxh3_64_intdigest(lower) >> 4) << 4 | (STOP_BIT if stop else 0) | kind
        if len(word) <= CACHED_WORD_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def template(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(template hashes, slot values) of the tokens; a slot value is 0 for a literal.

        A number, a unit after a number and a capitalised word inside a sentence are slots; punctuation is dropped.
        """
        words = text.split()
        coded = np.fromiter(map(self.__getitem__, words), U64, len(words))
        kind = (coded & U64(7)).astype(np.int64)
        number = (kind == NUM) | (kind == NUM_UNIT)
        begins = np.concatenate([[True], (coded[:-1] & U64(STOP_BIT)) > 0])[:len(coded)]
        after_number = np.concatenate([[False], number[:-1]])[:len(coded)]
        slot = number | ((kind == CAPITAL) & ~begins) | ((kind == UNIT) & after_number)
        value = coded & ~U64(15)
        some = kind != NOTHING
        return (np.where(slot, SLOT_HASH[kind], value)[some], np.where(slot, value | U64(1), U64(0))[some])


def _windows(texts: DataFrame, window: int, bits: np.ndarray | None, short: list[int]) -> DataFrame:
    """(key, position, hash, slots, tokens): windows of the template. One of fewer literals than slots is hashed with
    the values of its slots, so that it meets only the same values.

    Without `bits`, a text shorter than the window is one window of its own length; with them, windows of the lengths
    in `short` are made too.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            names, found = batch.column(0).to_numpy(zero_copy_only=False), []
            for name, text in zip(names, byte_texts(batch.column(1))):
                template, slots = tokens.template(text or b"")
                filled = np.concatenate([[0], np.cumsum(slots != 0)])
                for size in [min(window, len(template))] if bits is None else [*short, window]:
                    if not 0 < size <= len(template):
                        continue
                    hashes = shingle_hashes(template, size)
                    many = 2 * (filled[size:] - filled[:-size]) > size
                    if many.any():
                        hashes = np.where(many, ~shingle_hashes(template ^ slots, size), hashes)
                    at = np.arange(len(hashes)) if bits is None else np.flatnonzero(in_bitmap(bits, hashes))
                    if len(at):
                        found.append((np.full(len(at), name, np.int64), at, hashes[at],
                                      [slots[k:k + size] for k in at], np.full(len(at), len(template))))
            if found:
                key, at, hashes, count = (np.concatenate([x[k] for x in found]) for k in (0, 1, 2, 4))
                values = [v for x in found for v in x[3]]
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(at), as_long(hashes),
                     pa.ListArray.from_arrays(pa.array(offsets), as_long(np.concatenate(values))),
                     pa.array(count)], ["key", "position", "hash", "slots", "tokens"])

    return map_batches(texts, over, "key long, position long, hash long, slots array<long>, tokens long")


#: An aligned token: position in the document and in the item, slot value of the item (0: a literal) and the document.
Cell = tuple[int, int, int, int]


def _diagonals(windows: list[dict]) -> list[list[Cell]]:
    cells: dict[int, dict[int, Cell]] = {}
    for w in windows:
        p, q = w["position"], w["item_position"]
        mine = cells.setdefault(p - q, {})
        for k, (a, b) in enumerate(zip(w["item_slots"], w["doc_slots"])):
            mine[q + k] = (p + k, q + k, a, b)
    return [[mine[q] for q in sorted(mine)] for _, mine in sorted(cells.items())]


def _chains(diagonals: list[list[Cell]]) -> Iterator[list[Cell]]:
    """Runs of neighbouring cells, each followed by the best run on a diagonal at most SHIFT away that ends before it
    or, cut short, does; the longest chains."""
    runs = []
    for cells in diagonals:
        first = 0
        for k in range(1, len(cells) + 1):
            if k == len(cells) or cells[k][1] != cells[k - 1][1] + 1:
                runs.append(cells[first:k])
                first = k
    runs.sort(key=lambda r: (r[0][1], r[0][0]))
    latest: dict[int, tuple[int, int]] = {}  # of a diagonal: cells of the chain that ends with its last run, and the run
    before, skipped, followed = [-1] * len(runs), [0] * len(runs), set()
    for k, run in enumerate(runs):
        d, best = run[0][0] - run[0][1], len(run)
        for other in range(d - SHIFT, d + SHIFT + 1):
            if other in latest:
                size, j = latest[other]
                skip = max(0, runs[j][-1][1] + 1 - run[0][1], runs[j][-1][0] + 1 - run[0][0])
                if skip < len(run) and size + len(run) - skip > best:
                    best, before[k], skipped[k] = size + len(run) - skip, j, skip
        latest[d] = best, k
        followed.add(before[k])
    for k in range(len(runs)):
        if k not in followed and before[k] >= 0:
            parts = []
            while k >= 0:
                parts.append(runs[k][skipped[k]:])
                k = before[k]
            yield [cell for part in reversed(parts) for cell in part]


def _judge(cells: list[Cell]) -> tuple[int, int]:
    """Tokens matched and slots changed: all cells if their values map one to one, else the longest stretch of cells
    without another value."""
    slots = {(a, b) for _, _, a, b in cells if a}
    if len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots}):
        return len(cells), sum(a != b for a, b in slots)
    longest = length = 0
    for _, _, a, b in cells:
        length = length + 1 if a == b else 0
        longest = max(longest, length)
    return longest, 0


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the windows that one document and item share: the most tokens matched, and how many slots are changed."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            diagonals = _diagonals(row["windows"])
            matched, less = max((m, -c) for m, c in map(_judge, [*diagonals, *_chains(diagonals)]))
            rows.append((row["doc_id"], row["item_id"], row["item_tokens"], matched, -less))
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         ["doc_id", "item_id", "item_tokens", "matched", "changed_slots"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, match: int = MATCH) -> DataFrame:
    """(doc_id, item_id, item_tokens, matched, changed_slots): the items a document repeats, also with other values.

    Texts become templates: numbers, units after numbers and names (capitalised words inside a sentence) are typed
    slots, other words are lower-cased, punctuation is dropped. Windows of `window` tokens are joined on their hash.
    The windows that one document and item share at one distance, or at distances that differ by a few inserted or
    missing tokens, are a match if they cover `match` tokens, or 80 % of an item of fewer, and if equal slot values of
    the item always meet equal values of the document and the other way round; where they do not, a stretch of so
    many tokens without any changed value is. An item shorter than a window is one window. `changed_slots` counts the
    values that differ: more than 0 is a re-parameterised question.

    Only windows that pass a fixed-size bitmap of the benchmark's windows are shuffled. Rows without id or text
    match nothing. Rows that repeat an id count as one text each, their matches
    are merged. Either table may be empty, and may have further columns.
    """
    items = stored(_windows(benchmark.filter("item_id is not null").select("item_id", "text").distinct(), window, None,
                            []), "benchmark-windows")
    bits = bitmap_of(items, "hash")
    short = sorted(r["tokens"] for r in items.filter(F.col("tokens") < window).select("tokens").distinct().collect())
    found = _windows(docs.filter("doc_id is not null").select("doc_id", "text"), window, bits, short)
    pairs = (found.select(F.col("key").alias("doc_id"), "position", "hash", F.col("slots").alias("doc_slots"))
             .join(items.select(F.col("key").alias("item_id"), F.col("position").alias("item_position"), "hash",
                                F.col("slots").alias("item_slots"), F.col("tokens").alias("item_tokens")), "hash"))
    aligned = (pairs.filter(F.size("item_slots") == F.size("doc_slots")).groupBy("doc_id", "item_id", "item_tokens")
               .agg(F.collect_list(F.struct("position", "item_position", "item_slots", "doc_slots")).alias("windows")))
    judged = map_batches(aligned, _judged, "doc_id long, item_id long, item_tokens long, matched long, changed_slots long")
    needed = F.least(F.lit(match), F.ceil(F.col("item_tokens") * 0.8))
    return (judged.filter(F.col("matched") >= needed)
            .groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "item_tokens", (-F.col("changed_slots"))
                                                             .alias("less"))).alias("best"))
            .select("doc_id", "item_id", "best.item_tokens", "best.matched", (-F.col("best.less")).alias("changed_slots")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs`, all columns, that repeat no benchmark item. Rows without doc_id stay."""
    lost = contaminated(docs, benchmark, **parameters).select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
