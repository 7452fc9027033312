"""Top-k search of query rows against all rows in blocks: tiles of bounded size, merged per query by heaps."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import stored

#: Rows of a block on either side; a tile holds two blocks at most.
BLOCK = 8192

#: queries, their row numbers, candidates, their row numbers and ids, k -> (query place, candidate place, score)
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vector: Column, zero: bool) -> Column:
    """Vectors without null or non-finite components; all-zero ones only with ``zero``."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return fine if zero else fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _tile(kernel: Kernel, k: int, score: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        asks = table.column("asks").to_numpy()
        rows, ids = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
        data = _matrix(table.column("vector"), dim)
        q, c, s = kernel(data[asks], rows[asks], data[~asks], rows[~asks], ids[~asks], k)
        return pa.table(
            {
                "query_row": pa.array(rows[asks][q], pa.int64()), "query_id": pa.array(ids[asks][q], pa.int64()),
                "vec_id": pa.array(ids[~asks][c], pa.int64()), "score": pa.array(s).cast(score),
            }
        )

    return run


def _merged(k: int, score: pa.DataType):
    """Rows in order of query_row: a heap of its k best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(heap: list) -> list:
            return [(now[1], place, -i, s) for place, (s, i) in enumerate(sorted(heap, reverse=True), 1)]

        now, heap, out = None, [], []
        for batch in batches:
            for row, query, vec, s in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or row != now[0]:
                    out += best(heap) if heap else []
                    now, heap = (row, query), []
                item = (s, -vec)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                else:
                    heapq.heappushpop(heap, item)
            if len(out) > 10_000:
                yield _answer(out, score)
                out = []
        out += best(heap) if heap else []
        yield _answer(out, score)

    return run


def _answer(rows: list, score: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int32(), pa.int64(), score)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "rank", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, kernel: Kernel, k: int, whole: bool, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query row, ties to the smaller id.

    ``vectors`` has vec_id and vector; rows are dealt evenly to blocks and every block of queries
    meets every block of rows once. A query's own row is no candidate; a row that repeats it is.
    Vectors of another length are not compared. ``whole`` tells scores that are integers.
    """
    score, kind = (pa.int64(), "long") if whole else (pa.float64(), "double")
    rows = stored(
        vectors.where(F.col("vec_id").isNotNull()).select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "vector",
            F.size("vector").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("ask"),
        ).where("dim > 0"),
        "tiles-rows",
    )
    n, asked = rows.agg(F.count("*"), F.sum(F.col("ask").cast("long"))).first()
    columns, parts = max(1, -(-n // block)), max(1, -(-(asked or 0) // block))
    place = F.pmod(F.xxhash64("row"), F.lit(1 << 40))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    candidates = rows.select("dim", every(parts).alias("p"), (place % columns).alias("c"), F.lit(False).alias("asks"), "row", "vec_id", "vector")
    queries = rows.where("ask").select("dim", (place % parts).alias("p"), every(columns).alias("c"), F.lit(True).alias("asks"), "row", "vec_id", "vector")
    tiles = candidates.unionByName(queries).withColumn("p", F.col("p").cast("long")).withColumn("c", F.col("c").cast("long"))
    found = tiles.groupBy("dim", "p", "c").applyInArrow(
        _tile(kernel, k, score), f"query_row long, query_id long, vec_id long, score {kind}"
    )
    return found.repartition("query_row").sortWithinPartitions("query_row").mapInArrow(
        _merged(k, score), f"query_id long, rank int, vec_id long, score {kind}"
    )
