"""Exact cosine top-k retrieval as a tiled Spark join.

Plan
----
* Query rows get a row number (two rows with one id stay two queries). Both sides are dealt into
  blocks by a hash of the row, so no id or repeated row makes a large block. The number of blocks
  comes from the row counts: a block holds at most about ``TILE_BYTES`` of vectors, and there are
  enough tiles to keep all cores busy. A block is written once, as one value (``tiles``).
* Every (query block, corpus block) pair is one tile and one task of a Cartesian product. No vector
  reaches the driver; building the plan reads two counts.
* A tile is one float64 GEMM, done for ``SLAB_BYTES`` of scores at a time, with an exact
  local top-k (score desc, case id asc), so a task holds two blocks and one slab
  of scores, and emits at most ``k`` rows per query and tile.
* The merge ranks those candidates per query row (k x corpus blocks at most); its k rows a query are written, so
  that readers of the result do not score again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from casewright.operators import tiles as T
from casewright.operators.common import written

# Bytes of one block's vectors, as float64.
TILE_BYTES = 16 << 20
# Bytes of the scores of a tile that are held at a time.
SLAB_BYTES = 32 << 20


def l2_normalize(c) -> Column:
    """X / ||x||_2 elementwise in double; a zero vector stays zero."""
    col = F.col(c) if isinstance(c, str) else c
    arr = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(arr, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def vector_norm(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.sqrt(F.aggregate(F.transform(col, lambda x: x.cast("double")), F.lit(0.0),
                              lambda acc, x: acc + x * x))


def _unit_rows(mat: np.ndarray) -> np.ndarray:
    norms = np.sqrt((mat * mat).sum(axis=1))
    norms[norms == 0] = 1.0
    return mat / norms[:, None]


def _local_topk(scores: np.ndarray, case_rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, case) positions of the exact top-k of each row; -inf never wins, ties by ``case_rank``."""
    kk = min(k, scores.shape[1])
    # threshold = k-th best score per query; keep every candidate >= it (ties
    # at the boundary included), then order exactly and cut at k.
    kth = np.partition(scores, scores.shape[1] - kk, axis=1)[:, scores.shape[1] - kk]
    qi, ci = np.nonzero((scores >= kth[:, None]) & np.isfinite(scores))
    order = np.lexsort((case_rank[ci], -scores[qi, ci], qi))
    qi, ci = qi[order], ci[order]
    starts = np.searchsorted(qi, np.arange(len(scores)))
    within = np.arange(len(qi)) - starts[qi] < kk
    return qi[within], ci[within]


def _matrix(table: pa.Table) -> np.ndarray:
    """Unit rows of a block's vectors."""
    vec = T.column(table, "vec")
    sizes = np.diff(vec.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors of different sizes")
    return _unit_rows(vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1))


def id_codes(q_ids: pa.Array, c_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal for equal ids; below 0 for a null id."""
    if q_ids.type != c_ids.type and pa.types.is_integer(q_ids.type) and pa.types.is_integer(c_ids.type):
        q_ids, c_ids = q_ids.cast(pa.int64()), c_ids.cast(pa.int64())
    codes = pa.concat_arrays([q_ids, c_ids]).dictionary_encode().indices.fill_null(-1).to_numpy()
    return codes[:len(q_ids)], codes[len(q_ids):]


def id_ranks(ids: pa.Array) -> np.ndarray:
    """Places of the ids in ascending order, nulls first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def _block_count(df: DataFrame, vec_col: str, cores: int, tile_bytes: int) -> int:
    """Blocks of at most about ``tile_bytes``, and enough for ``cores`` tiles when there are rows for them."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("dim")).first()
    by_bytes = math.ceil(r["n"] * (r["dim"] or 1) * 8 / tile_bytes)
    return max(1, by_bytes, min(math.ceil(math.sqrt(cores)), math.ceil(r["n"] / 256)))


def knn_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, query_col: str = "query_id",
             case_col: str = "case_id", vec_col: str = "embedding", exclude_self: bool = False,
             tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Exact cosine top-k: ``(query_id, rank, case_id, score, similarity)``.

    ``similarity`` is the score rounded to 4 dp; ``rank`` is 1-based in raw
    score order (score desc, case id asc). Ids keep their types (numbers or
    strings). ``k <= 0`` gives no rows; null vectors never match. Query rows
    with the same id are separate queries with ranks of their own.
    ``exclude_self`` drops case_id == query_id (leave-one-out evaluation); a null id is then in no pair.
    """
    spark = corpus.sparkSession
    q_type, c_type = queries.schema[query_col].dataType.simpleString(), corpus.schema[case_col].dataType.simpleString()
    if k <= 0:
        return spark.createDataFrame([], f"{query_col} {q_type}, rank int, {case_col} {c_type}, score double, similarity double")
    def rows(df: DataFrame, id_col: str) -> DataFrame:
        return df.filter(F.col(vec_col).isNotNull()).select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))

    q, c = rows(queries, query_col), rows(corpus, case_col)
    cores = spark.sparkContext.defaultParallelism
    n_q, n_c = _block_count(q, "vec", cores, tile_bytes), _block_count(c, "vec", cores, tile_bytes)
    schema = pa.schema([("row", pa.int64()), ("query_id", to_arrow_type(queries.schema[query_col].dataType)),
                        ("case_id", to_arrow_type(corpus.schema[case_col].dataType)), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, held in T.pairs(batches):
            q_ids, c_ids = T.column(asked, "id"), T.column(held, "id")
            q_code, c_code = id_codes(q_ids, c_ids) if exclude_self else (None, None)
            case_rank, rows, qmat, cmat = id_ranks(c_ids), T.column(asked, "row"), _matrix(asked), _matrix(held).T
            step = max(1, SLAB_BYTES // (8 * len(c_ids)))
            for lo in range(0, len(q_ids), step):
                scores = qmat[lo:lo + step] @ cmat
                if exclude_self:
                    asked_code = q_code[lo:lo + step]
                    scores[asked_code[:, None] == c_code[None, :]] = -np.inf
                    scores[asked_code < 0] = scores[:, c_code < 0] = -np.inf
                qi, ci = _local_topk(scores, case_rank, k)
                at = pa.array(qi + lo)
                yield pa.RecordBatch.from_arrays([rows.take(at), q_ids.take(at), c_ids.take(pa.array(ci)), pa.array(scores[qi, ci])], schema=schema)

    found = T.crossed(T.packed(q, n_q), T.packed(c, n_c)).mapInArrow(score, f"row long, query_id {q_type}, case_id {c_type}, score double")
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("case_id").asc())
    ranked = written(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "hits")
    return ranked.select(F.col("query_id").alias(query_col), "rank", F.col("case_id").alias(case_col),
                         "score", F.round("score", 4).alias("similarity"))


def attach_case_metadata(hits: DataFrame, corpus: DataFrame, case_col: str = "case_id",
                         columns: list[str] | None = None) -> DataFrame:
    """Look up case metadata by id (not by position); ids with no case are dropped."""
    cols = columns or [c for c in corpus.columns if c not in (case_col, "embedding")]
    return hits.join(corpus.select(case_col, *cols), case_col, "inner")


def label_centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding",
                    id_col: str = "vec_id") -> DataFrame:
    """Mean unit vector per label (elementwise average, then re-normalised).

    Averaging is an aggregate over exploded (label, index, value) rows, so a
    label holding a third of the table is combined map-side.
    """
    unit = vectors.select(label_col, F.posexplode(l2_normalize(vec_col)).alias("i", "x"))
    avg = unit.groupBy(label_col, "i").agg(F.avg("x").alias("x"))
    cent = avg.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return cent.select(F.col(label_col).cast("long").alias("centroid_id"),
                       l2_normalize(F.transform("p", lambda s: s["x"])).alias(vec_col))


def save_vectors(df: DataFrame, path: str, vec_col: str = "embedding") -> None:
    """One Parquet table holding vector + metadata (counts cannot diverge)."""
    df.write.mode("overwrite").parquet(path)


def load_vectors(spark, path: str, dim: int, vec_col: str = "embedding") -> DataFrame:
    """S8 reload with integrity checks: no null vectors, every size == dim."""
    df = spark.read.parquet(path)
    bad = df.agg(F.count_if(F.col(vec_col).isNull()).alias("nulls"),
                 F.count_if(F.size(vec_col) != dim).alias("wrong_dim")).first()
    if bad["nulls"] or bad["wrong_dim"]:
        raise ValueError(f"vector table {path}: {bad['nulls']} null and {bad['wrong_dim']} wrong-size vectors")
    return df
