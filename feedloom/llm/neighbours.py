"""Nearest neighbours by inner product: multiprobe p-stable hashing, merged candidates, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import MULTIPLIER, U64, as_long, map_batches, mix, stored

TABLES = 2
PROBES = 200  # buckets of a table a query visits on average, at most: it decides how many hashes a table has
MOST_HASHES = 12
WIDTH = 1.2  # of a hash cell, in units of the largest norm
TARGET = 0.97  # estimated probability that a true neighbour shares a visited bucket of some table
PILOT_ROWS = 64  # rows whose exact neighbours give the distance the estimates are made for
BLOCK_ROWS = 8_192  # index rows compared at a time
BLOCK_QUERIES = 2_048


def _vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles, one per id; all of the commonest length."""
    usable = (table.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null")
              .filter("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
              .filter("exists(v, x -> x <> 0)"))
    length = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return usable.filter(F.size("v") == (length["n"] if length else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


@dataclass
class Hashes:
    """Random projections: tables x hashes x (dimension + 1), offsets, cell width, and the largest norm.

    Rows are scaled to norm at most 1 and lifted to norm 1 by one more component; queries are scaled to norm 1 and
    lifted by 0. Then the largest inner product is the smallest distance, for which the hashes are made.
    """

    projections: np.ndarray
    offsets: np.ndarray
    norm: float

    @classmethod
    def drawn(cls, dimension: int, hashes: int, norm: float, tables: int = TABLES) -> Hashes:
        random = np.random.default_rng(20_177)
        return cls(random.standard_normal((tables, hashes, dimension + 1)), random.uniform(0, WIDTH, (tables, hashes)),
                   norm)

    def places(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """rows x tables x hashes: where the vectors fall, in cells."""
        size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        scaled = vectors / (size if query else self.norm)
        lift = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1, keepdims=True)))
        lifted = np.hstack([scaled, np.zeros_like(lift) if query else lift])
        return (np.einsum("rd,thd->rth", lifted, self.projections) + self.offsets) / WIDTH


def _bucket(cells: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit key of integer cells (rows x hashes) of one table."""
    key = np.full(len(cells), U64(table + 1))
    for k in range(cells.shape[1]):
        key = mix((key ^ cells[:, k].astype(np.int64).view(U64)) * MULTIPLIER)
    return key


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.vectorize(erf)(x / sqrt(2.0)))


def probes(place: np.ndarray, distance: float, target: float, limit: int | None = None) -> np.ndarray | None:
    """Cells (probes x hashes) around one place, most promising first, until their estimated success reaches `target`.

    A neighbour at `distance` is normally distributed around the place along each projection. The probability of a
    set of cells is the product over the projections; sets are visited in its order, by a heap over per-projection
    ranks, and never twice. With a `limit`, None if more are needed.
    """
    home = np.floor(place)
    reach = int(np.ceil(4 * distance / WIDTH)) + 1
    shifts = np.arange(-reach, reach + 1)
    edges = (home[:, None] + np.append(shifts, reach + 1)[None, :] - place[:, None]) * WIDTH / distance
    chance = np.diff(_normal(edges), axis=1)
    order = np.argsort(-chance, axis=1, kind="stable")
    ranked = np.maximum(np.take_along_axis(chance, order, axis=1), 1e-300)
    logs = np.log(ranked)
    hashes, width = logs.shape
    heap = [(-float(logs[:, 0].sum()), 0, (0,) * hashes)]
    found, success = [], 0.0
    while heap and success < target:
        if limit is not None and len(found) >= limit:
            return None
        cost, last, ranks = heapq.heappop(heap)
        found.append(ranks)
        success += float(np.exp(-cost))
        for k in range(last, hashes):  # only from the last raised rank on: each combination has one predecessor
            if ranks[k] + 1 < width:
                raised = (*ranks[:k], ranks[k] + 1, *ranks[k + 1:])
                heapq.heappush(heap, (cost + float(logs[k, ranks[k]] - logs[k, ranks[k] + 1]), k, raised))
    ranks = np.array(found)
    return home + shifts[np.take_along_axis(order.T, ranks, axis=0)]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def _best(queries: pd.DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, visits=None) -> pd.DataFrame:
    """The k best rows (distinct `ids`) of a block for each query; visits(first, last) says which rows the queries of
    that range visit."""
    out = []
    for first in range(0, len(queries), BLOCK_QUERIES):
        part = queries.iloc[first:first + BLOCK_QUERIES]
        own = part["query_id"].to_numpy()
        scores = _matrix(part["q"]) @ matrix.T
        banned = own[:, None] == ids[None, :]
        if visits is not None:
            banned |= ~visits(first, first + len(part))
        scores[banned] = -np.inf
        if scores.shape[1] > k:  # ties at the cut are kept, so that the smaller ids win later
            cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
            q, r = np.nonzero((scores >= cut) & ~banned)
        else:
            q, r = np.nonzero(~banned)
        exactly = (_matrix(part["q"])[q] * matrix[r]).sum(axis=1)  # the same in whatever block a pair meets
        out.append(pd.DataFrame({"query_id": own[q], "vec_id": ids[r], "score": exactly}))
    found = pd.concat(out).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found[found.groupby("query_id").cumcount() < k]


FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of all partial results: (query_id, rank, vec_id, score). A query has at most k rows per block."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id")))
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.slice(best, 1, k).alias("best"))
            .select("query_id", F.posexplode("best").alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    (-F.col("x.less")).alias("score")))


def exact(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) by comparing all `queries` (query_id, q) with all `rows` (vec_id, v), in blocks."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    groups = max(1, -(-queries.count() // BLOCK_QUERIES))
    left = (rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "v")
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    right = (queries.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), "query_id", "q")
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))

    def compare(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(asked, block["vec_id"].to_numpy(), _matrix(block["v"]), k)

    return _ranked(right.groupBy("block", "group").cogroup(left.groupBy("block", "group")).applyInPandas(compare, FOUND),
                   k)


def hashes_for(pilot: np.ndarray, dimension: int, norm: float, distance: float, each: float, tables: int) -> Hashes:
    """The most selective tables whose buckets some pilot queries can visit with PROBES probes on average."""
    for count in range(MOST_HASHES, 1, -1):
        hashes = Hashes.drawn(dimension, count, norm, tables)
        needed = []
        for place in hashes.places(pilot, query=True):
            cells = probes(place[0], distance, each, 4 * PROBES)
            needed.append(4 * PROBES if cells is None else len(cells))
        if np.mean(needed) <= PROBES:
            break
    return hashes


def search(table: DataFrame, is_query, k: int = 20, target: float = TARGET, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score, probes): the k rows of largest inner product found for each query.

    `table` holds (vec_id, embedding); the rows for which the Column `is_query` holds are queries, and every row but
    the query's own is a candidate. All rows are indexed, in `tables` hash tables. A query visits buckets in the order
    of their estimated success until that reaches the share that makes `target` over all tables, for neighbours as
    far as the k-th of PILOT_ROWS rows compared exactly with all others. Candidates of all tables are merged and
    ranked by their exact scores in double precision, ties by smaller vec_id. A query for which fewer than k
    candidates were found, though there are more, is compared with all rows.

    Left out: null ids, vectors that are null, zero, hold null or non-finite components, or are not of the commonest
    length. Of rows that repeat an id the smallest vector counts. Further columns are ignored.
    """
    rows = stored(_vectors(table), "vectors")
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("norm"),
                     F.max(F.size("v")).alias("d")).first()
    pilot = stored(queries.orderBy(F.xxhash64("query_id")).limit(PILOT_ROWS), "pilot")
    vectors = pilot.orderBy("query_id").toPandas()["q"]  # PILOT_ROWS rows
    if not len(vectors):
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"),
                              F.lit(0.0).alias("score"), F.lit(0).alias("probes"))
    norm = sqrt(shape["norm"])
    known = exact(pilot, rows, k).groupBy("query_id").agg(F.min("score").alias("least")).join(pilot, "query_id").select(
        (F.col("least") / F.sqrt(F.expr("aggregate(q, 0D, (s, x) -> s + x * x)")) / norm).alias("cosine"))
    cosine = known.agg(F.percentile_approx("cosine", 0.25).alias("c")).first()["c"]
    distance = max(0.05, sqrt(max(0.0, 2.0 - 2.0 * (cosine if cosine is not None else 0.0))))
    each = 1.0 - (1.0 - target) ** (1.0 / tables)
    hashes = hashes_for(_matrix(vectors)[:16], shape["d"], norm, distance, each, tables)
    # buckets are spread over groups of about BLOCK_ROWS rows; a group larger than that is cut into blocks
    groups = max(1, -(-shape["n"] * tables // BLOCK_ROWS))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor(hashes.places(_matrix(batch.column(1).to_pandas()), query=False))
            for t in range(tables):
                keys = _bucket(cells[:, t], t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), as_long(keys), as_long(keys % U64(groups))],
                    ["vec_id", "v", "bucket", "group"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, group, buckets, count = [], [], [], []
            for number, place in enumerate(hashes.places(_matrix(batch.column(1).to_pandas()), query=True)):
                keys = np.concatenate([_bucket(probes(place[t], distance, each), t) for t in range(tables)])
                order = np.argsort(keys % U64(groups), kind="stable")
                names, starts = np.unique((keys % U64(groups))[order], return_index=True)
                row += [number] * len(names)
                group += names.astype(np.int64).tolist()
                buckets += np.split(keys[order].view(np.int64), starts[1:])
                count += [len(keys)] * len(names)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(group, pa.int64()),
                 pa.array(buckets, pa.list_(pa.int64())), pa.array(count, pa.int32())],
                ["query_id", "q", "group", "buckets", "probes"])

    placed = map_batches(rows.select("vec_id", "v"), indexed, "vec_id long, v array<double>, bucket long, group long")
    asked = stored(map_batches(queries, visited, "query_id long, q array<double>, group long, buckets array<long>, "
                                                 "probes int"), "probes")
    sizes = placed.groupBy("group").agg(F.ceil(F.count("*") / F.lit(2 * BLOCK_ROWS)).cast("int").alias("blocks"))
    crowds = asked.groupBy("group").agg(F.ceil(F.count("*") / F.lit(2 * BLOCK_QUERIES)).cast("int").alias("crowds"))
    cut = stored(sizes.join(crowds, "group"), "groups")
    left = (placed.join(cut, "group")
            .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
            .withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
            .select("group", "block", "crowd", "bucket", "vec_id", "v"))
    right = (asked.join(cut, "group")
             .withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.col("crowds")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("group", "block", "crowd", "query_id", "q", "buckets"))

    def compare(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        block = block.sort_values("vec_id", kind="stable")  # a row is here once for each of its buckets
        ids, starts = np.unique(block["vec_id"].to_numpy(), return_index=True)
        names, place = np.unique(block["bucket"].to_numpy(), return_inverse=True)
        table_of = np.zeros((len(some), len(names)), bool)
        for q, keys in enumerate(some["buckets"]):
            at = np.searchsorted(names, keys)
            hit = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == keys)
            table_of[q, at[hit]] = True
        return _best(some, ids, _matrix(block["v"].iloc[starts]), k, lambda first, last: np.logical_or.reduceat(
            table_of[first:last][:, place], starts, axis=1))

    key = ["group", "block", "crowd"]
    found = _ranked(right.groupBy(*key).cogroup(left.groupBy(*key)).applyInPandas(compare, FOUND), k).checkpoint()
    enough = min(k, shape["n"] - 1)
    full = found.groupBy("query_id").count().filter(F.col("count") >= enough).select("query_id")
    short = queries.join(full, "query_id", "left_anti").checkpoint()
    rest = exact(short, rows, k)
    counts = asked.groupBy("query_id").agg(F.max("probes").alias("probes"))
    return found.join(full, "query_id", "left_semi").unionAll(rest).join(counts, "query_id")
