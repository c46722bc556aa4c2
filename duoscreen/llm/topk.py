"""Exact top-k inner products by columnar branch and bound.

Vectors lie in vertical layout, one array for each dimension. Scores accumulate block of dimensions by block; what
the remaining dimensions can still add is at most the product of the remaining norms (Cauchy-Schwarz), so after each
block the candidates whose best case lies below the k-th worst case are dropped and the rest is compacted.

Both sides are dealt into blocks by a hash of the id; each block of queries meets each block of rows in a task of
bounded size, and a ranking keeps the best of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscreen.llm.common import stage

ROWS = 8192
QUERIES = 1024
DIMENSIONS = 16

#: Integers up to this are exact in doubles.
_EXACT = 1 << 52


def scaled(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and floor(256 x) of each component x; vectors that are null or hold null or non-finite ones are left out."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & finite).select("vec_id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))


def best_of(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its place, and ids and scores of its k best rows with another id; ties to smaller ids.

    queries, rows: two-dimensional integer arrays.
    """
    mass = np.abs(rows).astype(np.float64).sum(axis=0)
    order = np.argsort(-mass, kind="stable")
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    kind = np.float64 if largest < _EXACT else np.int64
    columns = np.ascontiguousarray(rows[:, order].T.astype(kind))
    wanted = queries[:, order].astype(kind)
    cuts = [*range(0, len(order), DIMENSIONS), len(order)]

    def remaining(x: np.ndarray) -> np.ndarray:
        """Norm of what lies from each cut on; one row for each cut."""
        squares = x.astype(np.float64) ** 2
        return np.sqrt(np.stack([squares[c:].sum(axis=0) for c in cuts]))

    row_rest, query_rest = remaining(columns), remaining(wanted.T)
    for q in range(len(wanted)):
        alive = np.flatnonzero(ids != own[q])
        score = np.zeros(len(alive), dtype=kind)
        for b in range(len(cuts) - 1):
            part = columns[cuts[b] : cuts[b + 1]]
            score = score + wanted[q, cuts[b] : cuts[b + 1]] @ (part if len(alive) == len(ids) else part[:, alive])
            if len(alive) > k:
                rest = row_rest[b + 1][alive] * query_rest[b + 1][q] * (1 + 1e-9) + 1e-3
                worst = np.partition(score - rest, len(alive) - k)[len(alive) - k]
                keep = score + rest >= worst
                alive, score = alive[keep], score[keep]
        first = np.lexsort((ids[alive], -score))[:k]
        yield q, ids[alive[first]], score[first].astype(np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows.

    is_query: a condition on ``vec_id``. Rows with the query's id are its own. A row without an id is a candidate
    like any other but no query. Only vectors of a query's own length are compared. Rows repeated with id and vector
    are one query; each of them is a candidate. An empty table gives an empty result, other columns are ignored.
    """
    data = stage(scaled(vectors, id_column, vector_column), "vectors")
    queries = stage(data.filter(is_query).filter("vec_id is not null").distinct(), "queries")
    n_rows, n_queries = data.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // ROWS)), max(1, -(-n_queries // QUERIES))

    def dealt(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(own)).cast("int")
        return df.select(
            block.alias(names[0]), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1]), F.size("v").alias("width"), "vec_id", "v"
        )

    keys = ["rb", "qb", "width"]
    schema = "query_id long, query_key long, vec_id long, score long"

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("v").combine_chunks()
        flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        return np.asarray(flat, dtype=np.int64).reshape(table.num_rows, -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            no_id = np.int64(-(1 << 63))
            ids = np.asarray(left.column("vec_id").fill_null(no_id))
            own, key = np.asarray(right.column("vec_id")), np.asarray(right.column("query_key"))
            for q, found, score in best_of(matrix(right), own, matrix(left), ids, k):
                out.append((np.full(len(found), own[q]), np.full(len(found), key[q]), found, score))
        columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
        return pa.table(columns, names=[x.split()[0] for x in schema.split(", ")])

    rows = dealt(data, row_blocks, query_blocks, ("rb", "qb")).groupBy(*keys)
    asked = dealt(queries, query_blocks, row_blocks, ("qb", "rb")).withColumn("query_key", F.xxhash64("vec_id", "v")).groupBy(*keys)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    found = rows.cogroup(asked).applyInArrow(meet, schema).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    vec_id = F.when(F.col("vec_id") != -(1 << 63), F.col("vec_id"))
    return found.select("query_id", "rank", vec_id.alias("vec_id"), "score")
