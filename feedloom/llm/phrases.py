"""Phrases that occur more often than their parts explain, by Rabin-Karp fingerprints.

Texts are cut into pieces and words once and stored. Then passes over them count: numpy prefix polynomials over the hashes
of the words give the fingerprint of every n-gram by one subtraction, a task counts the n-grams of the words it holds, and
Spark adds the counts per fingerprint. Words come first, then pairs whose words are frequent, then longer runs whose pairs
are; a bitmap of fixed size over the frequent fingerprints says so, which may let others pass but misses none. A last pass
hands out, for frequent fingerprints only, counts with a pointer to the first place of each run in the words a task holds.
There equal runs are compared word by word; between tasks a fingerprint goes with a control of other hashes, 128 bits in
all, so that different phrases of one fingerprint part. One pointer of each is followed into the stored text, and counts
are added by what is written there: only frequent phrases are ever written out.

Defined results: a null text has no words, a null language is `und`; repeated rows count each; a table without frequent
phrases gives no rows; other columns are ignored, whatever their names. Texts of any length are worked on in pieces of
about CHUNK bytes that share their last words, so that memory is bounded but for a single word longer than that.
Frequent parts meet the phrases that hold them in slices (SLICES copies of each part), and ranks are taken in slices
first: neither a common word nor a language is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import U64, bitmap_of, in_bitmap, map_batches, mix, stored

CHUNK = 6 << 20
HELD = 1_000_000  # rows of a task; results do not depend on it
TASK_WORDS = 20_000_000  # words of a task of the last pass, unless that would be fewer tasks than there are cores
POINTER = ["key", "control", "count", "row", "start", "size"]
SLICES = 16
RANK_SLICES = 64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
UNKNOWN = "und"
NEWLINE = 10
#: A-Z to a-z, the marks that end a piece to a line feed, the tab to a space
NORMAL = bytes(c + 32 if 65 <= c <= 90 else NEWLINE if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c
               for c in range(256))


def normal(text: bytes) -> bytes:
    """The words of a text, one space between words and one line feed between pieces."""
    pieces = (b" ".join(p.split(b" ")) if b"  " not in p else b" ".join(w for w in p.split(b" ") if w)
              for p in text.translate(NORMAL).split(b"\n"))
    return b"\n".join(p for p in (q.strip(b" ") for q in pieces) if p)


def worded(docs: DataFrame) -> DataFrame:
    """(row, lang, words, n): every text in its normal form under a number of its own, and its words. Runs a job."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n = [len(t) and t.count(b" ") + t.count(b"\n") + 1 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("lang"), pa.array(texts, pa.binary()), pa.array(n, pa.int64())],
                ["row", "lang", "words", "n"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    return stored(map_batches(rows, over, "row long, lang string, words binary, n long"), "phrases-words")


@dataclass
class Chunk:
    """Texts, or a stretch of one, that a task counts together."""

    rows: list[int] = field(default_factory=list)
    langs: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)  # of each stretch in its text
    parts: list[bytes] = field(default_factory=list)
    skip: int = 0  # words at the start that the chunk before has counted

    def add(self, row: int, lang: str, start: int, part: bytes) -> None:
        self.rows.append(row)
        self.langs.append(lang)
        self.starts.append(start)
        self.parts.append(part)


def separator_before(text: bytes, end: int, start: int = 0) -> int:
    return max(text.rfind(b" ", start, end), text.rfind(b"\n", start, end))


def stretches(text: bytes, shared: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, words shared with the stretch before), so that every run of shared + 1 words is in one stretch and
    ends in exactly one beyond its shared words."""
    start = skip = 0
    while True:
        end = len(text)
        if end - start > size:
            cut = separator_before(text, start + size, start)
            if cut < 0 or cut <= start or text.count(b" ", start, cut) + text.count(b"\n", start, cut) < 2 * shared:
                found = [p for p in (text.find(b" ", start + size), text.find(b"\n", start + size)) if p >= 0]
                cut = min(found, default=end)
            end = cut
        yield start, end, skip
        if end == len(text):
            return
        at, skip = end, 0
        while skip < shared and at > start:
            at = max(separator_before(text, at, start), start - 1)
            skip += 1
            if at < start:
                at = start - 1
                break
        start = at + 1


def chunks(batches: Iterator[pa.RecordBatch], shared: int, size: int) -> Iterator[Chunk]:
    held, held_bytes = Chunk(), 0
    for batch in batches:
        for row, lang, text in zip(*(batch.column(c).to_pylist() for c in ("row", "lang", "words"))):
            if not text:
                continue
            if len(text) > size:
                for start, end, skip in stretches(text, shared, size):
                    long = Chunk(skip=skip)
                    long.add(row, lang, start, text[start:end])
                    yield long
                continue
            held.add(row, lang, 0, text)
            held_bytes += len(text)
            if held_bytes >= size:
                yield held
                held, held_bytes = Chunk(), 0
    if held.rows:
        yield held


class Codes(dict):
    """A number per different word of a chunk, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def fingerprints(hashes: np.ndarray, n: int, salt: np.ndarray) -> np.ndarray:
    """Of every run of n words: h0 + h1/B + h2/B^2 ... modulo 2^64, mixed with `salt` of its first word."""
    m = len(hashes)
    if m < n:
        return np.zeros(0, U64)
    powers = np.multiply.accumulate(np.r_[U64(1), np.full(m - 1, BASE, U64)])
    inverse = np.multiply.accumulate(np.r_[U64(1), np.full(m - 1, INVERSE, U64)])
    prefix = np.r_[U64(0), np.cumsum(hashes * inverse, dtype=U64)]
    return mix((prefix[n:] - prefix[:-n]) * powers[:m - n + 1] ^ salt[:m - n + 1] ^ U64(n * INVERSE & (1 << 64) - 1))


class Runs:
    """The words of a chunk as numbers, and its runs of n words."""

    def __init__(self, chunk: Chunk):
        whole = b"\n".join(chunk.parts) + b"\n"
        words, codes_of = whole.split(), Codes()
        self.chunk = chunk
        self.codes = np.fromiter(map(codes_of.__getitem__, words), np.int64, len(words))
        distinct = list(codes_of)
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), ">u8").astype(U64).reshape(-1, 2)
        self.hashes, self.others = both[self.codes, 0], both[self.codes, 1]
        self.lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))[self.codes]
        self.ends = np.cumsum(self.lengths + 1) - 1
        self.breaks = np.r_[0, np.cumsum(np.frombuffer(whole, np.uint8)[self.ends] == NEWLINE)]
        sizes = np.array([len(p) for p in chunk.parts])
        part_ends = np.cumsum(sizes + 1) - 1
        self.part, self.part_starts = np.searchsorted(part_ends, self.ends), part_ends - sizes
        self.langs = sorted(set(chunk.langs))
        self.lang = np.array([self.langs.index(x) for x in chunk.langs])[self.part]
        self.salt = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], U64)[self.lang]

    def keys(self, n: int) -> np.ndarray:
        return fingerprints(self.hashes, n, self.salt)

    def groups(self, n: int, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, count) of every different run among the wanted ones that lie in one piece and end in words
        that no chunk before has counted."""
        wanted = wanted & (self.breaks[n - 1:][:len(keys)] == self.breaks[:len(keys)])
        wanted[:max(0, self.chunk.skip - n + 1)] = False
        at = np.flatnonzero(wanted)
        at = at[np.argsort(keys[at], kind="stable")]
        other = (keys[at][1:] != keys[at][:-1]) | (self.lang[at][1:] != self.lang[at][:-1])
        for k in range(n):  # equal fingerprints of different words are different groups
            other |= self.codes[at + k][1:] != self.codes[at + k][:-1]
        first = np.flatnonzero(np.r_[len(at) > 0, other])
        return at[first], np.diff(np.r_[first, len(at)])


def in_slices(columns: dict[str, pa.Array], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def tally(chunk: Chunk, sizes: range, shorter: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(key, count) of the different n-grams of a chunk, for each n of `sizes`, all of whose runs of one word less than
    the first of the sizes may be frequent. The key is half a fingerprint: what shares it is counted together, which can
    only let more pass."""
    runs = Runs(chunk)
    part = sizes[0] - 1
    may = None if shorter is None else in_bitmap(shorter, runs.keys(part))
    for n in sizes:
        keys = runs.keys(n)
        wanted = np.ones(len(keys), bool)
        for k in range(n - part + 1 if may is not None else 0):
            wanted &= may[k:k + len(keys)]
        place, counts = runs.groups(n, keys, wanted)
        yield from in_slices({"key": pa.array(keys[place].astype(np.uint32).view(np.int32)), "count": pa.array(counts)})


Found = list[np.ndarray]  # key, control, count, row, start, size


def places(chunk: Chunk, frequent: list[tuple[range, np.ndarray]]) -> Iterator[Found]:
    """The n-grams of a chunk that may be frequent themselves: where each stands first, in bytes of its text. The
    control is a second fingerprint, of other hashes of the words. A run may be frequent if its bitmap says so and both
    runs of one word less in it may be: what a bitmap lets pass by chance grows with the words and with the frequent
    runs, and nearly all of that goes here."""
    runs = Runs(chunk)
    rows, starts = np.array(chunk.rows, np.int64), np.array(chunk.starts, np.int64)
    may = np.ones(len(runs.hashes) + 1, bool)
    for sizes, bits in frequent:
        for n in sizes:
            keys = runs.keys(n)
            may = in_bitmap(bits, keys) & may[:len(keys)] & may[1:len(keys) + 1]
            place, counts = runs.groups(n, keys, may)
            part, begin = runs.part[place], runs.ends[place] - runs.lengths[place]
            yield [keys[place].view(np.int64), fingerprints(runs.others, n, runs.salt)[place].view(np.int64), counts,
                   rows[part], begin - runs.part_starts[part] + starts[part], runs.ends[place + n - 1] - begin]


def together(parts: list[Found]) -> Found:
    """Equal runs once, with their counts added and the place of the first."""
    found = [np.concatenate(column) for column in zip(*parts)]
    order = np.lexsort((found[1], found[0]))
    found = [column[order] for column in found]
    first = np.flatnonzero(np.r_[len(order) > 0, (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])])
    return [np.add.reduceat(column, first) if k == 2 and len(first) else column[first] for k, column in enumerate(found)]


def pointed(batches: Iterator[pa.RecordBatch], shared: int, size: int, frequent: list[tuple[range, np.ndarray]]) \
        -> Iterator[pa.RecordBatch]:
    """The places of all chunks of a task, equal runs together as far as HELD rows go."""
    held: list[Found] = []
    for chunk in chunks(batches, shared, size):
        held += places(chunk, frequent)
        if sum(len(f[0]) for f in held) > HELD:
            held = [together(held)]
            if len(held[0][0]) > HELD // 2:
                yield from in_slices(dict(zip(POINTER, map(pa.array, held[0]))))
                held = []
    if held:
        yield from in_slices(dict(zip(POINTER, map(pa.array, together(held)))))


def over_chunks(words: DataFrame, shared: int, size: int, fn, schema: str) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, shared, size):
            yield from fn(chunk)

    return map_batches(words, over, schema)


def frequent_phrases(words: DataFrame, least: int, longest: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, f) of all phrases up to `longest` words that occur at least so often, and (lang, n) with
    all words of a language. Runs jobs."""
    bits: list[tuple[range, np.ndarray]] = []
    for sizes in (range(1, 2), range(2, 3), range(3, longest + 1)):
        if sizes and sizes[-1] <= longest:
            shorter = bits[-1][1] if bits else None
            counted = over_chunks(words, sizes[-1] - 1, chunk_bytes, lambda c, n=sizes, b=shorter: tally(c, n, b),
                                  "key int, count long")
            often = counted.groupBy("key").agg(F.sum("count").alias("f")).where(F.col("f") >= least).select("key")
            bits.append((sizes, bitmap_of(often.select(F.col("key").cast("long").alias("key")), "key")))
    # nearly every task meets nearly every frequent run: tasks that grew in number with the input would hand out as many
    # rows as there are frequent runs and tasks, so these are fewer and each combines more
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -int(-all_words // TASK_WORDS))
    pointers = map_batches(words.coalesce(tasks), lambda batches: pointed(batches, longest - 1, chunk_bytes, bits),
                           ", ".join(f"{c} long" for c in POINTER))
    # of equal runs any place will do; the least row has one, and the size is that of all of them
    found = pointers.groupBy("key", "control").agg(
        F.sum("count").alias("f"), F.min("row").alias("row"), F.min_by("start", "row").alias("start"),
        F.max("size").alias("size")).where(F.col("f") >= least)
    said = found.join(words.select("row", "lang", "words"), "row").select(
        "lang", F.expr("substring(words, cast(start as int) + 1, cast(size as int))").cast("string").alias("phrase"), "f")
    exact = said.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).withColumn("n_words", F.size(F.split("phrase", " ")))
    return stored(exact, "phrases-exact"), totals


def words_between(begin, length):
    return F.array_join(F.slice("__words", begin, length), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Every phrase of two words and more with its lowest-scoring cut."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), "f",
                           F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    cuts = phrases.where("n_words > 1").withColumn("__words", F.split("phrase", " ")).select(
        "lang", "phrase", F.col("f").alias("a"), F.pmod(F.xxhash64("phrase"), F.lit(SLICES)).cast("int").alias("slice"),
        "__words", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "slice", "k", words_between(F.lit(1), F.col("k")).alias("first"),
        words_between(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))

    def look(column: str, name: str) -> DataFrame:
        return parts.select("lang", "slice", F.col("part").alias(column), F.col("f").alias(name))

    wide = {c: F.col(c).cast("decimal(20,0)") for c in ("a", "n", "l", "r")}
    looked = cuts.join(look("first", "l"), ["lang", "slice", "first"]).join(look("rest", "r"), ["lang", "slice", "rest"]) \
        .join(totals, "lang").select("lang", "phrase", "n", "k", *[wide[c].alias(c) for c in ("a", "l", "r")])
    score = looked.withColumn("score", F.expr("(a * cast(n as decimal(20,0)) * 1000bd) div (l * r)"))
    best = F.min(F.struct("score", "k", *[F.col(c).cast("long").alias(c) for c in ("l", "r", "a", "n")])).alias("cut")
    return score.groupBy("lang", "phrase").agg(best).select(
        "lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def not_held(phrases: DataFrame) -> DataFrame:
    """(lang, phrase) that lie in a longer phrase which occurs as often."""
    longer = phrases.where("n_words > 2").withColumn("__words", F.split("phrase", " ")).select(
        "lang", "f", "__words", "n_words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("length")).select(
        "lang", "f", "__words", "length",
        F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("length") + 1)).alias("begin"))
    inner = longer.select("lang", words_between(F.col("begin"), F.col("length")).alias("phrase"), "f") \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return phrases.where("n_words > 1").join(inner, ["lang", "phrase"]).where(F.col("longer") >= F.col("f")) \
        .select("lang", "phrase")


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, first: int = 2000,
                 chunk_bytes: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of each language whose worst cut scores best."""
    phrases, totals = frequent_phrases(worded(docs), least, longest, chunk_bytes)
    kept = scored(phrases, totals).join(not_held(phrases), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    slices = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES))).orderBy(*order)
    near = kept.withColumn("rank", F.row_number().over(slices)).where(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= first).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
