"""Nearest neighbours by inner product (13): a block matrix join with int8 product tiles.

Vectors are packed into blocks where they are read: a block is one row that holds some hundred vectors. Blocks of queries are dealt into groups
of about `QUERY_BYTES`, blocks of candidates into groups of at most `CANDIDATE_BYTES` (fewer where that keeps all tasks at work), and each pair of
groups is one cell of a grid: its queries come first, its candidates' blocks stream past them. So a task holds one group of queries and one block.

In a cell both sides are quantised to int8, a scale for each vector: v = scale * code + e. Products of codes are whole numbers below 2^24, which a
float product gives exactly (over 1,024 components at a time). For an approximate product the error is at most |e_q| |c| + |scale_q code_q| |e_c|.
A pair whose upper bound is below the query's threshold goes; the threshold is the k-th best exact product so far, or, as long as there are
fewer, what k candidates reach by their lower bounds. The pairs that survive are recomputed from the original vectors in double precision,
component by component in order, and the best k of each query in each cell are merged by a heap over the cells. So the result is exact.

The work is that of the product, queries times candidates; each group of queries is sent once for each group of candidates and the other way round.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither as query nor as candidate; vectors
of another length than the query's aren't its candidates; a row with a null id is never a query by the default rule, and as a candidate comes
after equal ones with an id; rows that share an id are rows by themselves (only the query's own row is left out); ties go to the smaller id; a product that
overflows to NaN comes last; fewer than k candidates are returned all; an empty table, or one without queries, gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import claim, col, scratch, spread, written

K, EVERY = 20, 20
BLOCK_BYTES, QUERY_BYTES, CANDIDATE_BYTES = 512 << 10, 16 << 20, 256 << 20
#: Queries of a tile, and components whose int8 products a float sum holds exactly.
TILE, EXACT = 2048, 1024
BLOCK = "query boolean, dim int, block long, ids array<long>, rows array<long>, vectors binary"


def matrices(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Of a batch (id, vector, query): by length, the places of the vectors that take part and these as a matrix."""
    lists = batch.column(1)
    offsets = np.asarray(lists.offsets)
    values = lists.values.cast(pa.float32() if kind is np.float32 else pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        matrix = values[offsets[at][:, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
        if good.any():
            yield int(dim), at[good], matrix[good]


def packed(df: DataFrame, id_col: str, vector_col: str, is_query: Column, kind: type) -> DataFrame:
    """Blocks of candidates (all rows) and of queries; a row's number is the same in both."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n_rows, n_blocks = TaskContext.get().partitionId() << 40, 0, 0
        held: dict[tuple[bool, int], list] = {}

        def block(key: tuple[bool, int]) -> pa.RecordBatch:
            nonlocal n_blocks
            parts = held.pop(key)
            n_blocks += 1
            ids = pa.concat_arrays([p[0] for p in parts])
            columns = [[key[0]], [key[1]], [first + n_blocks], [ids.to_pylist()], [np.concatenate([p[1] for p in parts])], [np.concatenate([p[2] for p in parts]).tobytes()]]
            types = [pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query", "dim", "block", "ids", "rows", "vectors"])

        for batch in batches:
            asked = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            for dim, at, matrix in matrices(batch, kind):
                most = max(16, min(4096, BLOCK_BYTES // (8 * dim)))
                numbers = first + n_rows + np.arange(len(at))
                n_rows += len(at)
                ids = batch.column(0).take(pa.array(at))
                for start in range(0, len(at), most):
                    part = slice(start, start + most)
                    own = asked[at[part]]
                    for query, chosen in ((False, np.arange(len(own))), (True, np.flatnonzero(own))):
                        if len(chosen):
                            key = (query, dim)
                            if sum(len(p[1]) for p in held.get(key, ())) + len(chosen) > most:
                                yield block(key)
                            held.setdefault(key, []).append((ids[part].take(pa.array(chosen)), numbers[part][chosen], matrix[part][chosen]))
        for key in list(held):
            yield block(key)

    vector = col(vector_col).cast("array<float>" if kind is np.float32 else "array<double>")
    return written(df.select(col(id_col).cast("long").alias("id"), vector.alias("v"), is_query.alias("q")).mapInArrow(pack, BLOCK), "vector-blocks")


class Codes:
    """Vectors of one block or group: originals, int8 codes (as floats, for the product), scales and the norms of the error bound."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors.astype(np.float64)
        with np.errstate(all="ignore"):
            self.scale = np.maximum(np.abs(self.exact).max(axis=1) / 127, np.finfo(np.float64).tiny)
            codes = np.rint(self.exact / self.scale[:, None]).astype(np.int8)
            self.codes = codes.astype(np.float32)
            whole = self.exact - self.scale[:, None] * codes
            self.error, self.norm = np.sqrt((whole * whole).sum(axis=1)), np.sqrt((self.exact * self.exact).sum(axis=1))
            self.rough = self.scale * np.sqrt((self.codes * self.codes).sum(axis=1, dtype=np.float64))
        self.columns = np.ascontiguousarray(self.exact.T)


def bounds(q: Codes, of: slice, c: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Of a tile: approximate products, and how far off they can be."""
    dim = q.codes.shape[1]
    tile = np.zeros((len(q.scale[of]), len(c.scale)))
    for i in range(0, dim, EXACT):
        tile += q.codes[of, i : i + EXACT] @ c.codes[:, i : i + EXACT].T
    tile *= q.scale[of][:, None]
    tile *= c.scale[None, :]
    off = np.outer(q.error[of], c.norm)
    off += np.outer(q.rough[of], c.error)
    off *= 1 + 1e-9
    off += np.outer(q.norm[of] + q.rough[of], 1e-12 * (c.norm + c.rough))
    return tile, off


def products(q: Codes, c: Codes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact products of pairs, summed in the order of components, so that equal vectors have equal products everywhere."""
    out = np.zeros(len(i))
    for a, b in zip(q.columns, c.columns, strict=True):
        out += a[i] * b[j]
    return out


class Nearest:
    """The best k of each query of a group so far."""

    def __init__(self, queries: Codes, rows: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.rows, self.ids, self.k = queries, rows, ids, k
        self.score = np.full((len(rows), k), np.nan)
        self.vec = np.zeros((len(rows), k), dtype=np.int64)
        self.bare = np.zeros((len(rows), k), dtype=bool)
        self.n = np.zeros(len(rows), dtype=np.int64)

    def meet(self, c: Codes, rows: np.ndarray, ids: np.ndarray, bare: np.ndarray) -> None:
        """bare: candidates without an id."""
        for start in range(0, len(self.rows), TILE):
            of = slice(start, start + TILE)
            with np.errstate(all="ignore"):
                tile, off = bounds(self.q, of, c)
                least = np.where(self.n[of] == self.k, self.score[of, -1], -np.inf)  # a NaN among the best excludes nothing
                open_ = np.flatnonzero(self.n[of] < self.k)
                if len(open_) and len(rows) > self.k + 1:
                    low = tile[open_] - off[open_]
                    at = len(rows) - self.k - 1  # one more than k, as the query's own row may be among them
                    low[np.isnan(low)] = -np.inf
                    least[open_] = np.partition(low, at, axis=1)[:, at]
                tile += off
                i, j = np.nonzero(~(tile < least[:, None]))
                i += start
                other = self.rows[i] != rows[j]
                i, j = i[other], j[other]
                if len(i):
                    self.merge(i, products(self.q, c, i, j), ids[j], bare[j])

    def merge(self, i: np.ndarray, score: np.ndarray, vec: np.ndarray, bare: np.ndarray) -> None:
        """i: the queries' places, in ascending order."""
        touched = np.unique(i)
        old = np.arange(self.k)[None, :] < self.n[touched][:, None]
        i = np.concatenate([i, np.repeat(touched, self.n[touched])])
        score, vec, bare = (np.concatenate([new, own[touched][old]]) for new, own in ((score, self.score), (vec, self.vec), (bare, self.bare)))
        order = np.lexsort((vec, bare, -score, np.isnan(score), i))
        i, score, vec, bare = i[order], score[order], vec[order], bare[order]
        starts = np.searchsorted(i, touched)
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        good = place < self.k
        self.score[i[good], place[good]], self.vec[i[good], place[good]], self.bare[i[good], place[good]] = score[good], vec[good], bare[good]
        self.n[touched] = np.minimum(np.diff(np.append(starts, len(i))), self.k)

    def batches(self, most: int = 4096) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.rows), most):
            of = slice(start, start + most)
            held = np.arange(self.k)[None, :] < self.n[of][:, None]
            ends = pa.array(np.concatenate([[0], np.cumsum(self.n[of])]), pa.int32())
            vec = pa.array(self.vec[of][held], pa.int64(), mask=self.bare[of][held])
            columns = [pa.array(self.rows[of]), pa.array(self.ids[of]), pa.ListArray.from_arrays(ends, vec), pa.ListArray.from_arrays(ends, pa.array(self.score[of][held]))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "query_id", "vec_ids", "scores"])


def met(cells: DataFrame, k: int, kind: type) -> DataFrame:
    """row, query_id, vec_ids, scores of each query in each cell: rows come sorted by cell, the queries of a cell first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neighbours", int)
        cell, queries, nearest = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                key = tuple(batch.column(x)[r].as_py() for x in range(3))
                if key != cell:
                    if nearest is not None:
                        yield from nearest.batches()
                    cell, queries, nearest = key, [], None
                found = batch.column(4)[r].values
                ids, bare = found.fill_null(0).to_numpy(zero_copy_only=False), found.is_null().to_numpy(zero_copy_only=False)
                rows = batch.column(5)[r].values.to_numpy(zero_copy_only=False)
                vectors = np.frombuffer(batch.column(6)[r].as_buffer(), dtype=kind).reshape(len(rows), key[0])
                if batch.column(3)[r].as_py() == 0:
                    queries.append((vectors, rows, ids))
                elif queries:
                    if nearest is None:
                        nearest = Nearest(Codes(np.concatenate([x[0] for x in queries])), *(np.concatenate([x[n] for x in queries]) for n in (1, 2)), k)
                    nearest.meet(Codes(vectors), rows, ids, bare)
        if nearest is not None:
            yield from nearest.batches()

    return cells.mapInArrow(work, "row long, query_id long, vec_ids array<long>, scores array<double>")


def heaps(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best k of each query out of its cells' lists. Rows come sorted by query; a query's lists are held, nothing else."""

    def best(row: list) -> tuple:
        query_id, lists = row
        order = lambda x: (x[1] != x[1], -x[1] if x[1] == x[1] else 0.0, x[0] is None, x[0] or 0)
        merged = heapq.merge(*(zip(v, s, strict=True) for v, s in lists), key=order)
        return query_id, [x for x, _ in zip(merged, range(k), strict=False)]

    def batch_of(rows: list) -> pa.RecordBatch:
        flat = [(q, n, v, s) for q, found in rows for n, (v, s) in enumerate(found, 1)]
        columns = list(zip(*flat, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    at, own, done = None, None, []
    for batch in batches:
        for row, query_id, vecs, scores in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if row != at:
                if own:
                    done.append(best(own))
                at, own = row, (query_id, [])
            own[1].append((vecs, scores))
        if len(done) > 1000:
            yield batch_of(done)
            done = []
    if own:
        done.append(best(own))
    yield batch_of(done)


def nearest(df: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, query_bytes: int = QUERY_BYTES, candidate_bytes: int = CANDIDATE_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k rows of the largest inner product, exactly. Queries: ids divisible by EVERY, if not given."""
    spark = df.sparkSession
    kind = np.float32 if df.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    is_query = col(id_col) % EVERY == 0 if is_query is None else is_query
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark) as kept:
        blocks = packed(df, id_col, vector_col, is_query, kind)
        size = F.size("rows").cast("long") * F.col("dim") * 8
        sizes = blocks.groupBy(F.col("dim").alias("_dim")).agg(F.sum(F.when(F.col("query"), size)).alias("q"), F.sum(F.when(~F.col("query"), size)).alias("c"), F.count_if(~F.col("query")).alias("n"))
        n_q = F.ceil(F.col("q") / query_bytes)
        n_c = F.greatest(F.ceil(F.col("c") / candidate_bytes), F.least("n", F.ceil(2 * tasks / n_q)))
        grid = sizes.where("q IS NOT NULL").select("_dim", n_q.alias("n_q"), n_c.alias("n_c"))  # a row for each length of vectors
        placed = blocks.join(grid, F.col("dim") == F.col("_dim"))
        own = F.pmod(F.xxhash64("block"), F.when(F.col("query"), F.col("n_q")).otherwise(F.col("n_c")))
        others = F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("n_c")).otherwise(F.col("n_q")) - 1)
        placed = placed.select("dim", own.alias("own"), F.explode(others).alias("other"), F.when(F.col("query"), 0).otherwise(1).alias("side"), "ids", "rows", "vectors")
        at = lambda side: F.when(F.col("side") == side, F.col("own")).otherwise(F.col("other"))
        cells = spread(placed.select("dim", at(0).alias("qg"), at(1).alias("cg"), "side", "ids", "rows", "vectors"), "dim", "qg", "cg")
        lists = written(met(cells.sortWithinPartitions("dim", "qg", "cg", "side"), k, kind), "nearest-of-cells")
        found = spread(lists, "row").sortWithinPartitions("row").mapInArrow(lambda batches: heaps(batches, k), "query_id long, rank int, vec_id long, score double")
        found = written(found, "nearest")
        kept.append(found)
    return found
