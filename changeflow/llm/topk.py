"""Exact top-k by integer inner product, as tiled matrix products.

Queries are dealt into groups by a hash, of bounded bytes each, and candidates into
shards. A group is sent to the shards' tasks once, so no vector is copied per pair of
blocks; the groups follow each other. A task takes its shard a few thousand candidates
at a time: each tile is one matrix product and a selection of what can be among the k
best of each of its queries so far, of which the task keeps k. The shards' short lists
are merged in a tree, ``fan_in`` lists at a time. A task's memory goes by a group, a
tile and k, no shuffle holds more than the vectors or k entries per query and shard, and
no list is longer than k * fan_in. The products themselves are all pairs.

Products are exact: float32 or float64 where every sum stays below 2^24 or 2^50,
Python integers beyond (scores outside 64 bits are held at the bounds).

Defined results: vectors that are null or hold null or non-finite components, and
rows with a null vec_id, take no part; vectors meet those of the same length only;
a row isn't compared with rows of its own vec_id; repeated rows are candidates each,
and one query; equal scores go by vec_id; an empty table gives no row; columns
besides the id and the vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm import common

LOW, HIGH = -(1 << 63), (1 << 63) - 1
KINDS = {2: np.int16, 4: np.int32, 8: np.float64}       # of packed components, by their bytes
COLUMNS, FIRST = 2048, 64       # candidates of a tile, and of a task's first one
TOP = pa.list_(pa.struct([("less", pa.int64()), ("vec_id", pa.int64())]))


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each row of whole numbers in the narrowest type that holds it."""
    most = np.maximum(vectors.max(1), -1 - vectors.min(1))
    kinds = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    out: list[bytes] = [b""] * len(vectors)
    for width, kind in KINDS.items():
        at = np.flatnonzero(kinds == width)
        for n, row in zip(at.tolist(), (vectors[at] + 0.0).astype(kind)):       # there is one zero
            out[n] = row.tobytes()
    return out


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each component, packed, of the rows that take part."""
    common.ship(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(n, 1024) for whole in batches for n in range(0, whole.num_rows, 1024)):
            ids, vectors = batch.columns
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten()
            x = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)      # nulls as NaN
            starts = np.cumsum(sizes) - sizes
            named = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero((sizes == dim) & named)
                part = x[starts[at][:, None] + np.arange(dim)] if len(at) * dim < len(x) else x.reshape(-1, dim)
                fits = np.isfinite(part).all(1)
                if fits.any():
                    yield pa.RecordBatch.from_arrays(
                        [pc.cast(ids.take(pa.array(at[fits])), pa.int64()), pa.array(np.full(int(fits.sum()), dim, np.int32)),
                         pa.array(packed(np.floor(scale * part[fits])), pa.binary())], names=["vec_id", "dim", "v"])

    return table.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, v binary")


def matrices(dims: np.ndarray, v: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of the packed vectors of each length."""
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        some = v.take(pa.array(at))
        widths = pc.binary_length(some).to_numpy(zero_copy_only=False) // dim
        out = np.empty((len(at), dim), KINDS[int(widths.max())])
        for width in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == width)
            out[mine] = np.frombuffer(b"".join(some.take(pa.array(mine)).to_pylist()), KINDS[width]).reshape(-1, dim)
        yield dim, at, out


def most(vectors: np.ndarray) -> float:
    return max(abs(float(vectors.max())), abs(float(vectors.min())))


class Best:
    """The k best candidates so far of each query; the queries have vectors of one length."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, rows: int):
        n = len(query_ids)
        self.query_ids, self.queries, self.k, self.rows = query_ids, queries, k, rows
        self.score, self.vec_id = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.held, self.seen, self.most = np.zeros(n, np.int64), 0, most(queries)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        bound, at = self.most * most(vectors) * vectors.shape[1], 0
        kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 50 else None
        while at < len(ids):
            # few at first, when all of them can be among the best
            end = at + min(max(FIRST, 8 * self.seen), COLUMNS)
            some, columns = ids[at:end], vectors[at:end] if kind is None else vectors[at:end].astype(kind).T
            for q in range(0, len(self.query_ids), self.rows):
                self.tile(slice(q, q + self.rows), some, columns, kind)
            self.seen += len(some)
            at = end

    def tile(self, q: slice, ids: np.ndarray, vectors: np.ndarray, kind: type | None) -> None:
        last, full = self.score[q, -1], self.held[q] == self.k
        if kind is None:
            whole = np.vectorize(int, otypes=[object])
            product = whole(self.queries[q]).dot(whole(vectors).T)
            scores = np.vectorize(lambda s: min(max(s, LOW), HIGH), otypes=[np.int64])(product)
            least = np.where(full, last, LOW)
        else:
            scores = self.queries[q].astype(kind) @ vectors
            # not over the last one's score, which may be another tile's and not fit the type
            least = np.where(full, np.nextafter(last.astype(kind), kind(-np.inf)), kind(-np.inf))
        hits = np.flatnonzero(scores >= least[:, None])
        if len(hits):
            row, column = np.divmod(hits, len(ids))
            self.take(row + q.start, scores.ravel()[hits].astype(np.int64), ids[column])

    def take(self, row: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        last = self.score[row, -1]
        better = (self.held[row] < self.k) | (score > last) | (score == last) & (vec_id < self.vec_id[row, -1])
        at = np.flatnonzero(better & (vec_id != self.query_ids[row]))
        if not len(at):
            return
        mine, new = np.unique(row[at], return_inverse=True)
        old = np.arange(self.k) < self.held[mine][:, None]
        row = np.concatenate([np.nonzero(old)[0], new])
        score, vec_id = np.concatenate([self.score[mine][old], score[at]]), np.concatenate([self.vec_id[mine][old], vec_id[at]])
        order = np.lexsort((vec_id, ~score, row))
        row, score, vec_id = row[order], score[order], vec_id[order]
        sizes = np.bincount(row)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        top = rank < self.k
        self.score[mine[row[top]], rank[top]], self.vec_id[mine[row[top]], rank[top]] = score[top], vec_id[top]
        self.held[mine] = np.minimum(sizes, self.k)

    def lists(self, at: np.ndarray) -> pa.Array:
        """The lists of some queries: ``less`` ascends with falling scores."""
        has = np.arange(self.k) < self.held[at][:, None]
        entries = pa.StructArray.from_arrays([pa.array(~self.score[at][has]), pa.array(self.vec_id[at][has])], fields=list(TOP.value_type))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.held[at])]), pa.int32()), entries)


def group_best(vectors: DataFrame, group: DataFrame, k: int, query_block: int, shards: int, fan_in: int) -> DataFrame:
    """(place, query_id, top) of the queries of one group, merged over the shards."""
    spark = vectors.sparkSession
    held = group.select("vec_id", "dim", "v").toArrow().combine_chunks()
    dims, query_ids, v = (held.column(c).combine_chunks() for c in ("dim", "vec_id", "v"))
    query_ids = query_ids.to_numpy()
    sent = spark.sparkContext.broadcast([(dim, at, query_ids[at], queries) for dim, at, queries in matrices(dims.to_numpy(), v)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(ids, queries, k, query_block) for dim, _, ids, queries in sent.value}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for dim, at, found in matrices(batch.column(1).to_numpy(), batch.column(2)):
                if dim in best:
                    best[dim].add(ids[at], found)
        s = TaskContext.get().partitionId()
        for dim, place, ids, _ in sent.value:
            some = np.flatnonzero(best[dim].held)
            for n in range(0, len(some), 8192):
                at = some[n:n + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(place[at], pa.int32()), pa.array(ids[at]), pa.array(np.full(len(at), s, np.int32)),
                                                  best[dim].lists(at)], names=["place", "query_id", "s", "top"])

    best = vectors.select("vec_id", "dim", "v").repartition(shards).mapInArrow(
        run, "place int, query_id long, s int, top array<struct<less:long,vec_id:long>>")
    while True:
        shards = -(-shards // fan_in)
        best = (best.withColumn("s", F.expr(f"cast(s div {fan_in} as int)")).groupBy("place", "query_id", "s")
                .agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")))
        if shards == 1:
            break
    best = common.saved(best.select("query_id", "top"), "best")
    sent.destroy()
    return best


def top_k(table: DataFrame, is_query: Column, k: int = 5, query_block: int = 512, shard_rows: int = 4096,
          fan_in: int = 16, group_bytes: int = 1 << 25) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest scores. ``query_block``: the
    queries of a tile; ``shard_rows``: the candidates of a shard, more for groups of more queries;
    ``group_bytes``: what a task holds of a group, about."""
    vectors = common.saved(integer_vectors(table), "vectors")
    queries = common.saved(vectors.filter(is_query).distinct(), "queries")
    n = vectors.count()
    sizes = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("v") + 16 * k + 16), F.lit(0)).alias("held")).first()
    groups = -(-sizes.held // group_bytes) or 1
    # a list for each query and shard: no more of them than twice the candidates
    shards = -(-n // max(shard_rows, -(-sizes.n // groups))) or 1
    group = F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups))
    best = reduce(DataFrame.unionByName, [group_best(vectors, queries.filter(group == g) if groups > 1 else queries, k, query_block, shards, fan_in)
                                          for g in range(groups)])
    return best.select("query_id", F.posexplode("top").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        F.bitwise_not("hit.less").alias("score"))
