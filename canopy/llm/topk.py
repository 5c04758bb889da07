"""Exact top-k inner-product search by a three-phase uniform threshold.

Vectors become integers, floor(256 * x) of every component. Each vector's dimensions are dealt to ``SLICES`` slices; the
part of the inner product over a slice is the local score of that slice, and the score is the sum of the local scores.

1. Every partition lists, for each query and slice, the k rows of highest local score, completes the scores of these
   rows and hands over its k best. The k-th best of all partitions is a floor below which no result can lie.
2. That floor is broadcast. Rows whose norms by slice keep them below every query's floor (Cauchy-Schwarz) are passed
   over unscored. A row whose score reaches the floor has a local score of at least floor/SLICES in some slice; the other
   rows are asked for entries that reach this uniform threshold.
3. The scores of these rows alone are completed exactly; those at or above the floor compete for the k places.

Queries are a stated set against all rows, and come in blocks of ``QUERY_BLOCK`` at most: a block and its floors are all
that is ever broadcast or held at the driver. Scores are exact: floating-point products are used only while all sums
stay below 2^53, 64-bit integers beyond. Components so large that a sum could pass 64 bits are an error.

Vectors that are null or hold a null or non-finite component take no part, neither as query nor as candidate. Vectors
meet only vectors of their own length. A query's own row is no candidate, another row with the same id is. Ties go to
the smaller vec_id (null last). Queries with fewer than k candidates list them all. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.shared import as_id, materialize, pick, with_row_id

SLICES, QUERY_BLOCK, ROW_BLOCK = 4, 1024, 1024
LOWEST = -(1 << 62)


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the usable vectors, and the vectors as integers (in float64)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(np.maximum(length, 0))))[:-1]
    out = {}
    for n in np.unique(length[length >= 0]):
        at = np.flatnonzero(length == n)
        x = flat[start[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0))
        good = np.isfinite(x).all(axis=1)
        out[int(n)] = at[good], np.floor(256.0 * x[good])
    return out


def _local(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Local scores, SLICES x queries x rows."""
    cuts = np.linspace(0, q.shape[1], SLICES + 1).astype(int)
    big = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if big >= 2**63:
        raise ValueError("components are too large: inner products may pass 64 bits")
    if big >= 2**53:
        q, c = q.astype(np.int64), c.astype(np.int64)
    return np.stack([q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)])


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms by slice, SLICES x rows."""
    cuts = np.linspace(0, x.shape[1], SLICES + 1).astype(int)
    return np.stack([np.sqrt((x[:, a:b] ** 2).sum(axis=1)) for a, b in zip(cuts, cuts[1:], strict=False)])


def _best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query."""
    order = np.lexsort((row, vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[nth < k]


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` where ``is_query`` (over columns id and vec)."""
    spark = vectors.sparkSession
    base = pick(vectors, id=id_col, vec=vector_col).select(as_id(F.col("id")).alias("id"), "vec", is_query.alias("asks"))
    base = materialize(with_row_id(base, "row"), "vectors")
    asking = base.where("asks").select("row", "id", "vec")
    per_part = {r["p"]: r["n"] for r in asking.groupBy((F.shiftright("row", 33)).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    blocks, block, held = [], [], 0
    for p, n in sorted(per_part.items()):
        if held + n > QUERY_BLOCK and block:
            blocks.append(block)
            block, held = [], 0
        block, held = [*block, p], held + n
    blocks += [block] if block else []
    found = None
    for parts in blocks:
        lo, hi = parts[0] << 33, (parts[-1] + 1) << 33
        rows = asking.where((F.col("row") >= lo) & (F.col("row") < hi))
        whole = rows.collect() if sum(per_part[p] for p in parts) <= QUERY_BLOCK else None
        pieces = [whole] if whole is not None else _pieces(rows)
        for piece in pieces:
            one = _search_block(spark, base, piece, k)
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


def _pieces(rows: DataFrame):
    """Blocks of one partition with very many queries, in the order of row numbers."""
    last = -1
    while piece := rows.where(F.col("row") > last).orderBy("row").limit(QUERY_BLOCK).collect():
        yield piece
        last = piece[-1]["row"]


def _search_block(spark, base: DataFrame, rows: list, k: int) -> DataFrame:
    made = {n: (np.array([rows[i]["row"] for i in at], np.int64), x) for n, (at, x) in _vectors(pa.array([r["vec"] for r in rows], pa.list_(pa.float64()))).items() if len(at)}
    names = spark.createDataFrame([(r["row"], r["id"]) for r in rows], "query long, query_id long")
    asked = spark.sparkContext.broadcast(made)

    def scan(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            row, vec = b.column(0).to_numpy(), b.column(1)
            ids = np.where(vec.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, vec.fill_null(0).to_numpy(zero_copy_only=False))
            for n, (at, x) in _vectors(b.column(2)).items():
                if n in asked.value:
                    q_row, q = asked.value[n]
                    for s in range(0, len(at), ROW_BLOCK):
                        some = at[s : s + ROW_BLOCK]
                        yield q_row, q, row[some], ids[some], x[s : s + ROW_BLOCK]

    def merged(parts: Iterator[tuple], k: int) -> Iterator[pa.RecordBatch]:
        """Keep the k best of each query over the parts, in bounded memory."""
        held, size = [], 0

        def cut() -> list:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            best = _best(*cols, k)
            return [c[best] for c in cols]

        for part in parts:
            held.append(part)
            size += len(part[0])
            if size > 500_000:
                held = [cut()]
                size = len(held[0][0])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cut()], ["query", "score", "vec", "row"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for q_row, q, row, vec, x in scan(batches):
                local = _local(q, x)
                top = np.argpartition(-local, min(k, x.shape[0] - 1), axis=2)[:, :, : k + 1] if x.shape[0] > k + 1 else np.broadcast_to(np.arange(x.shape[0]), (SLICES, len(q), x.shape[0]))
                at = np.unique(np.arange(len(q))[None, :, None] * np.int64(x.shape[0]) + top)
                qi, ci = at // x.shape[0], at % x.shape[0]
                other = q_row[qi] != row[ci]
                qi, ci = qi[other], ci[other]
                yield q_row[qi], local[:, qi, ci].sum(axis=0).astype(np.int64), vec[ci], row[ci]

        return merged(parts(), k)

    schema = "query long, score long, vec long, row long"
    table = base.select("row", "id", "vec")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec", "row")
    gathered = table.mapInArrow(lists, schema).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    # one number for each query of the block
    floors = {r["query"]: r["floor"] for r in gathered.groupBy("query").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= k).collect()}
    floor = spark.sparkContext.broadcast({n: np.array([floors.get(int(r), LOWEST) for r in q_row], np.int64) for n, (q_row, _) in made.items()})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for q_row, q, row, vec, x in scan(batches):
                least = floor.value[q.shape[1]]
                high = _norms(q).T @ _norms(x)
                near = (high * (1 + 1e-9) + 1 >= least[:, None]).any(axis=0)
                row, vec, x = row[near], vec[near], x[near]
                local = _local(q, x)
                reach = (local >= (least / SLICES - 1)[None, :, None]).any(axis=0)  # 1 below: rounding must not lose any
                qi, ci = np.nonzero(reach)
                score = local[:, qi, ci].sum(axis=0).astype(np.int64)
                keep = (score >= least[qi]) & (q_row[qi] != row[ci])
                yield q_row[qi[keep]], score[keep], vec[ci[keep]], row[ci[keep]]

        return merged(parts(), k)

    best = table.mapInArrow(entries, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    vec = F.when(F.col("vec") != np.iinfo(np.int64).max, F.col("vec"))
    return materialize(best.join(F.broadcast(names), "query").select("query_id", F.col("rank").cast("int"), vec.alias("vec_id"), "score"), "topk")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.coalesce(F.col("id") % 50 == 0, F.lit(False)), 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
