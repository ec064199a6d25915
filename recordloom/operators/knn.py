"""Exact nearest neighbours by cosine, collapsed from chunks to records."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from recordloom.functions.vectors import cosine

MAX_QUERIES = 2048      # queries shipped to every task
MAX_BYTES = 64 << 20    # and their total size
TILE, CELL = 1024, 8192
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equal-length vectors as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(keys: pd.DataFrame, vectors: np.ndarray, queries: np.ndarray, k: int):
    """Per query: the k best records of this batch (and all that tie with the k-th), by their best chunk."""
    group = keys.groupby(list(keys.columns), sort=False).ngroup().to_numpy()
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
    sims = np.maximum.reduceat((_unit(vectors) @ queries.T)[order], starts, axis=0)
    rows = keys.iloc[order[starts]].reset_index(drop=True)
    n = len(rows)
    if n > k:
        edge = np.partition(sims, n - k, axis=0)[n - k]
        at, q = np.nonzero(sims >= edge)
    else:
        at, q = np.nonzero(np.ones_like(sims, dtype=bool))
    return rows.iloc[at], q, sims[at, q]


def _finish(found: DataFrame, query: str, keys: Sequence[str], k: int) -> DataFrame:
    """One row per (query, record) by its best chunk, then the k best; both steps combine before shuffling."""
    best = found.groupBy(query, *keys).agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("sim"), *keys))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def knn(chunks: DataFrame, queries: DataFrame, k: int, keys: Sequence[str] = ("chain_id", "idx"),
        vector: str = "vector", query: str = "query_id", max_queries: int = MAX_QUERIES) -> DataFrame:
    """The k records nearest to each query: (query, *keys, sim, rank).

    A query set of checked size is shipped to the tasks, which scan the chunks once
    and pass on only their own k best. A larger set is met tile by tile, so that no
    task sees more than one tile of queries and one cell of chunks.
    """
    if k <= 0:
        return chunks.sparkSession.createDataFrame([], _schema(chunks, queries, keys, query) + ", rank int")
    q = queries.select(query, vector)
    head = q.limit(max_queries + 1).collect()
    size = sum(len(r[1]) for r in head) * 8
    schema = _schema(chunks, queries, keys, query)
    if len(head) <= max_queries and size <= MAX_BYTES:
        ids = [r[0] for r in head]
        kind = _ARROW[queries.schema[query].dataType.simpleString()]
        if not ids:
            return chunks.sparkSession.createDataFrame([], schema + ", rank int")
        shipped = chunks.sparkSession.sparkContext.broadcast(
            (ids, _unit(np.array([r[1] for r in head], dtype=np.float64))))

        def scan(batches):
            names, matrix = shipped.value
            for b in batches:
                if b.num_rows == 0:
                    continue
                table = pa.Table.from_batches([b])
                rows, at, sims = _best(table.select(list(keys)).to_pandas(), _matrix(table[vector]), matrix, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in at], kind)]
                    + [pa.array(rows[c].to_numpy(), table.schema.field(c).type) for c in keys]
                    + [pa.array(sims, pa.float64())], names=[query, *keys, "sim"])
        return _finish(chunks.select(*keys, vector).mapInArrow(scan, schema), query, keys, k)
    return _finish(_tiled(chunks.select(*keys, vector), q, keys, vector, query, k, schema), query, keys, k)


def _schema(chunks, queries, keys, query) -> str:
    kinds = [f"{query} {queries.schema[query].dataType.simpleString()}"]
    kinds += [f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keys]
    return ", ".join(kinds) + ", sim double"


def _tiled(chunks, queries, keys, vector, query, k, schema):
    tiles = max(1, -(-queries.count() // TILE))
    cells = max(1, -(-chunks.count() // CELL))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (chunks.withColumn("_cell", F.pmod(F.xxhash64(*chunks.columns), F.lit(cells)).cast("int"))
            .withColumn("_tile", span(tiles)))
    right = (queries.withColumn("_tile", F.pmod(F.xxhash64(query), F.lit(tiles)).cast("int"))
             .withColumn("_cell", span(cells)))
    names = [query, *keys, "sim"]

    def meet(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if c.empty or q.empty:
            return pd.DataFrame(columns=names)
        rows, at, sims = _best(c[list(keys)], np.stack(c[vector].to_numpy()).astype(np.float64),
                               _unit(np.stack(q[vector].to_numpy()).astype(np.float64)), k)
        out = rows.reset_index(drop=True)
        out.insert(0, query, q[query].to_numpy()[at])
        return out.assign(sim=sims)[names]
    return left.groupBy("_tile", "_cell").cogroup(right.groupBy("_tile", "_cell")).applyInPandas(meet, schema)


def scoped_similarity(chunks: DataFrame, queries: DataFrame, scope: str = "chain_id",
                      vector: str = "vector", query: str = "query_id") -> DataFrame:
    """Similarity of each query to the chunks of its own scope (an equi-join on the scope key)."""
    q = queries.select(query, scope, F.col(vector).alias("_qv"))
    return chunks.join(q, scope).withColumn("sim", cosine(F.col(vector), F.col("_qv"))).drop("_qv", vector)


def knn_scoped(chunks: DataFrame, queries: DataFrame, k: int, keys: Sequence[str] = ("chain_id", "idx"),
               scope: str = "chain_id", vector: str = "vector", query: str = "query_id") -> DataFrame:
    """The k nearest records within each query's own scope."""
    return _finish(scoped_similarity(chunks, queries, scope, vector, query), query, keys, k)


def top_chunks(pairs: DataFrame, n: int = 3, keys: Sequence[str] = ("chain_id", "idx"),
               query: str = "query_id") -> DataFrame:
    """The n best chunks of each matched record, strongest first."""
    w = W.partitionBy(query, *keys).orderBy(F.desc("sim"), "chunk_index")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def drift(chunks: DataFrame, pairs: DataFrame, k: int = 5, threshold: float = 0.3,
          keys: Sequence[str] = ("chain_id", "idx"), vector: str = "vector") -> DataFrame:
    """Mean similarity around an anchor against a recent query: (pair_id, anchor vector, recent vector)."""
    ends = pairs.select("pair_id", F.explode(F.create_map(
        F.lit("a"), F.col("anchor"), F.lit("r"), F.col("recent"))).alias("end", vector))
    hits = knn(chunks, ends.withColumn("query_id", F.concat(F.col("pair_id").cast("string"), F.lit(":"), F.col("end"))),
               k, keys, vector)
    end = F.substring_index("query_id", ":", -1)
    means = (hits.groupBy(F.substring_index("query_id", ":", 1).alias("pair_key")).agg(
        F.avg(F.when(end == "a", F.col("sim"))).alias("anchor_mean"),
        F.avg(F.when(end == "r", F.col("sim"))).alias("recent_mean")))
    gap = F.col("anchor_mean") - F.col("recent_mean")
    return (pairs.select("pair_id").join(means, F.col("pair_id").cast("string") == F.col("pair_key"), "left")
            .select("pair_id", "anchor_mean", "recent_mean", gap.alias("gap"),
                    F.when(gap.isNull(), "insufficient_data").when(gap > threshold, "drift").otherwise("ok").alias("status")))
