"""Vector compression by product codes whose codebooks come from ball k-means, in whole numbers.

Each component becomes floor(1024 x); a vector is cut into equal consecutive parts and every part position has a codebook
of its own. A round assigns each part to its nearest entry and moves every entry to the floored mean of its parts.

A round does not compare a part with all entries. The parts that an entry held before it moved form its ball: their
distances to where it is now, and the largest of them, the radius. An entry can only take a part of the ball if it is
not farther from the ball's entry than twice the radius: those are the ball's neighbour entries, sorted by distance.
A part nearer than half the distance to the closest neighbour is in the stable core and keeps its code unseen. The
others lie in annular rings between half distances, and a part is compared with the neighbours up to its own ring only.
All comparisons are exact, ties go to the lower index, and the result is that of comparing everything.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of unequal length are padded with
zeros to the longest, rounded up to a multiple of the number of parts; repeated rows are kept, and the seeds are the
rows of the smallest vec_ids, ties by vector, null vec_ids last. With fewer rows than entries the codebooks are that
much smaller. Numbers too large for exact 64-bit arithmetic are computed as Python integers, and an error beyond a long
becomes the largest long. An empty table gives no rows and empty codebooks; further columns but the label are left out.

A round is one map over the vectors, stored with their codes, and a sum per entry, combined in each task before the
shuffle: the driver sees the codebooks only, parts x entries rows, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import map_batches, stored

SCALE = 1024
BLOCK = 2048  # parts compared at once
LARGEST = (1 << 63) - 1
LABEL_SLICES = 32  # that many copies of the label sums, so that a label of many rows is no single join key


def whole(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and the vector as an array of floor(1024 x)."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(x.isNotNull() & finite).select(
        "vec_id", "label", F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("whole"))


class Space:
    """How parts are held as numbers: float64 where its products are exact, then int64, then Python integers."""

    def __init__(self, width: int, largest: int):
        bound = 16 * max(1, width) * (largest + 1) ** 2  # four squared distances
        self.kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object

    def of(self, rows: np.ndarray) -> np.ndarray:
        return rows.astype(self.kind)

    def distances(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances, exact."""
        if self.kind is np.float64:
            return ((points * points).sum(1)[:, None] + (entries * entries).sum(1)[None, :]
                    - 2.0 * (points @ entries.T))
        apart = points[:, None, :] - entries[None, :, :]
        return (apart * apart).sum(2)

    def pairwise(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a - b) * (a - b)).sum(1)


class Balls:
    """One part position's codebook, with the entries around each entry by distance."""

    def __init__(self, entries: np.ndarray, space: Space):
        self.space, self.entries = space, space.of(entries)
        between = space.distances(self.entries, self.entries)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, 1)

    def nearest(self, points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, squared distance) of every point, from the codes of the round before."""
        codes = codes.copy()
        squared = self.space.pairwise(points, self.entries[codes])
        ball = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, codes[ball][1:] != codes[ball][:-1]]) if len(ball) else []
        before = codes.copy()
        for members in np.split(ball, starts[1:]) if len(ball) else []:
            entry = before[members[0]]
            reach = 4 * squared[members]  # an entry farther than this from the ball's entry cannot win
            others = self.between[entry]
            others = others[:np.searchsorted(others, reach.max(), "right")]  # neighbour entries, by the radius
            ring = np.searchsorted(others, reach, "right")  # how many of them each part must be compared with
            loose = np.flatnonzero(ring > 1)  # the rest is the stable core: only its own entry is near enough
            loose = loose[np.argsort(ring[loose], kind="stable")]
            for at in range(0, len(loose), BLOCK):
                some = loose[at:at + BLOCK]
                # ascending entry numbers, so that the first least distance is that of the lowest index
                near = np.sort(self.order[entry, :ring[some[-1]]])
                found = self.space.distances(points[members[some]], self.entries[near])
                best = found.argmin(1)
                codes[members[some]] = near[best]
                squared[members[some]] = found[np.arange(len(some)), best]
        return codes, squared


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    flat, lengths = column.flatten(), np.diff(column.offsets.to_numpy())
    values = flat.to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


class Coder:
    """What the tasks of a round share: the codebooks of all part positions."""

    def __init__(self, books: np.ndarray, largest: int):
        self.parts, _, self.width = books.shape
        self.space = Space(self.width, largest)
        self.balls = [Balls(book, self.space) for book in books]

    def assign(self, vectors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        found = [ball.nearest(self.space.of(vectors[:, k * self.width:(k + 1) * self.width]), codes[:, k])
                 for k, ball in enumerate(self.balls)]
        return np.stack([c for c, _ in found], 1), [d for _, d in found]


def _round(rows: DataFrame, coder: Coder, width: int) -> DataFrame:
    """`rows` with the codes of this round."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = matrix(batch.column("codes"), coder.parts).astype(np.int64)
            codes, squared = coder.assign(matrix(batch.column("whole"), width), before)
            error = [min(LARGEST, int(sum(int(d[i]) for d in squared))) for i in range(len(codes))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * coder.parts, pa.int32()),
                                             pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("whole"), lists, pa.array(error, pa.int64())],
                ["vec_id", "label", "whole", "codes", "error"])

    kinds = dict(rows.dtypes)
    return map_batches(rows, over, f"vec_id {kinds['vec_id']}, label {kinds['label']}, whole {kinds['whole']}, "
                                   "codes array<int>, error long")


def _sums(rows: DataFrame, parts: int, width: int, largest: int) -> DataFrame:
    """(part, entry, n, sums): added up in each batch, then by Spark."""
    step, kind = width // parts, np.int64 if largest < 1 << 40 else object

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, codes = matrix(batch.column("whole"), width), matrix(batch.column("codes"), parts)
            keys, counts, totals = [], [], []
            for k in range(parts):
                used, place, n = np.unique(codes[:, k], return_inverse=True, return_counts=True)
                total = np.zeros((len(used), step), kind)
                np.add.at(total, place, vectors[:, k * step:(k + 1) * step].astype(kind))
                keys += [(k, int(u)) for u in used]
                counts += n.tolist()
                totals += [[str(v) for v in row] for row in total.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()),
                 pa.array(counts, pa.int64()), pa.array(totals, pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    partial = map_batches(rows.select("whole", "codes"), over, "part int, entry int, n long, sums array<string>")
    added = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).cast("string").alias(str(i)) for i in range(step)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added)


def compress(df: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code as hex digits, error) of every kept row, and the codebooks (part, entry, position). Runs
    jobs. An entry's index takes two hex digits, so there are at most 256."""
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    rows = stored(whole(df), "codes-whole")
    sizes = rows.agg(F.max(F.size("whole")).alias("width"),
                     F.max(F.array_max("whole")).alias("high"), F.min(F.array_min("whole")).alias("low")).first()
    largest = max(abs(sizes.high or 0), abs(sizes.low or 0))
    width = -(-(sizes.width or 0) // parts) * parts
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "whole").limit(entries).select("whole").collect()
    books = np.array([list(map(int, s.whole)) + [0] * (width - len(s.whole)) for s in seeds], object) \
        .reshape(len(seeds), parts, width // parts).transpose(1, 0, 2)
    coded = rows.withColumn("codes", F.array(*[F.lit(0)] * parts))
    if len(seeds):
        for k in range(rounds):
            coded = stored(_round(coded, Coder(books, largest), width), f"codes-round-{k}").drop("error")
            books = books.copy()
            for r in _sums(coded, parts, width, largest).collect():  # parts x entries rows at most
                books[r.part, r.entry] = [int(r[str(i)]) // r.n for i in range(width // parts)]
        coded = stored(_round(coded, Coder(books, largest), width), "codes-last")
    else:
        coded = coded.withColumn("error", F.lit(0).cast("long"))
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return coded.select("vec_id", "label", F.array_join(digits, "").alias("code"), "error"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """The error summed over equal labels, nulls together, beside every row."""
    slice_of = F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_SLICES)).cast("int")
    sums = codes.groupBy("label").agg(F.coalesce(F.try_sum("error"), F.lit(LARGEST)).alias("label_error")) \
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SLICES - 1))))
    left = codes.withColumn("slice", slice_of).alias("c")
    return left.join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label"))
                     & (F.col("c.slice") == F.col("s.slice"))).select("c.*", "s.label_error").drop("slice")


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
