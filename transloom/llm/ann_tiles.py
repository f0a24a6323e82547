"""Operator 4: nearest neighbours by a block matrix join on int8 tiles with error bounds.

Queries and candidates are dealt into blocks; a tile is one query block against one candidate block, and
all tiles run as independent groups. In a tile both sides are scaled to unit length and quantised to int8
codes. One matrix product of codes gives every cosine with a bound on its quantisation error; a pair
survives if its upper bound reaches the k-th largest lower bound of its query. Survivors are recomputed in
double precision on the original vectors, the best k of a query go into a heap, and the heaps of its tiles
are merged. The result is exact. The codes are held in a floating type whose sums of their products are exact
integers, because NumPy multiplies integer matrices without BLAS.

Every row is a candidate of every other row. Defined cases: vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do rows with a null id; rows that repeat an id are rows like any other, each
asked and found on its own (with the same id); only vectors of equal length meet; equal scores go to the smaller id;
a query with fewer than k candidates returns them all; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import written

#: Rows of a block; they grow with the table up to GROWTH times, so that each vector is copied to fewer tiles.
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
GROWTH = 8
#: Tiles from which on blocks grow.
MANY_TILES = 1 << 12
#: Queries whose products are held at once in a tile.
SLICE = 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale of each row, length of each row's quantisation error) of unit vectors."""
    scale = np.abs(u).max(axis=1, keepdims=True) / 127
    codes = np.rint(u / scale).astype(np.int8)
    return codes, scale[:, 0], np.sqrt(((u - codes * scale) ** 2).sum(axis=1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component on."""
    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def search_tile(q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best of each query in a tile."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    c_codes, c_scale, c_err = quantise(_unit(c))
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integer sums stay exact
    c_codes = c_codes.astype(exact).T.copy()
    for lo in range(0, len(q), SLICE):
        some, ids = q[lo : lo + SLICE], q_rows[lo : lo + SLICE]
        codes, scale, err = quantise(_unit(some))
        about = (codes.astype(exact) @ c_codes) * scale[:, None] * c_scale
        # |u.v - about| <= |e_u| |v| + |u - e_u| |e_v|, with a little for rounding
        bound = err[:, None] + (1 + err[:, None]) * c_err + 1e-9
        own = ids[:, None] == c_rows
        low = np.where(own, -np.inf, about - bound)
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(some), -np.inf)
        row, col = np.nonzero((about + bound >= kth[:, None]) & ~own)
        for part in np.array_split(np.arange(len(row)), max(1, len(row) >> 16)):  # survivors in float, a bounded number at once
            if not len(part):
                continue
            r, s = row[part], cosine(some[row[part]], c[col[part]])
            order = np.lexsort((c_ids[col[part]], -s, r))
            r, s, ids_found = r[order], s[order], c_ids[col[part]][order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            keep = nth < k
            out.append((ids[r[keep]], ids_found[keep], s[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def nearest(vectors: DataFrame, query_modulus: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row whose id is divisible by ``query_modulus``."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    # a query and a candidate are the same row by a number that is fixed once
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("id") % query_modulus == 0)).first()
    tiles = n / CANDIDATE_BLOCK * asked / QUERY_BLOCK
    growth = min(GROWTH, max(1, int((tiles / MANY_TILES) ** 0.5)))
    c_blocks, q_blocks = max(1, -(-n // (CANDIDATE_BLOCK * growth))), max(1, -(-asked // (QUERY_BLOCK * growth)))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    cands = rows.select(own(c_blocks).alias("c"), each(q_blocks).alias("q"), F.lit(False).alias("query"), "row", "id", "v")
    asked = rows.where(F.col("id") % query_modulus == 0).select(each(c_blocks).alias("c"), own(q_blocks).alias("q"), F.lit(True).alias("query"), "row", "id", "v")
    tiles = cands.unionByName(asked).withColumn("dim", F.size("v"))

    def run(t: pa.Table) -> pa.Table:
        query = t.column("query").to_numpy()
        row, ids = t.column("row").to_numpy(), t.column("id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if query.any() and not query.all():
            found = search_tile(row[query], x[query], row[~query], ids[~query], x[~query], k)
        return pa.table({"query_row": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = tiles.groupBy("c", "q", "dim").applyInArrow(run, "query_row long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for q, c, s in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                heap = heaps.setdefault(q, [])
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -c))
        best = [(q, i, -c, s) for q, heap in heaps.items() for i, (s, c) in enumerate(sorted(heap, reverse=True), 1)]
        columns = list(zip(*best, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["query_row", "rank", "vec_id", "score"])

    dealt = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_row")
    merged = dealt.mapInArrow(merge, "query_row long, rank int, vec_id long, score double")
    names = rows.where(F.col("id") % query_modulus == 0).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return merged.join(names, "query_row").select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the registered query: brute force, summed in the same order.
SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
  WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
g AS (SELECT *, list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b) AS s FROM e),
p AS (
  SELECT q.r AS query_row, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) / (sqrt(q.s) * sqrt(c.s)) AS score
  FROM g q JOIN g c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
