"""Hard-negative mining by slot-decomposed selection.

For an anchor the rows of its label with the highest scores are its positives; a
positive with score p admits the different-label rows whose score lies in
[low p, high p] (``Settings.low`` and ``high``, in hundredths). The windows of an
anchor's positives overlap. Their upper limits, sorted downwards, cut the scores
into disjoint slots: slot j holds the scores above limit j + 1 and up to limit j, the
last slot all below. A row falls into one slot at most, so each task keeps only the
top k of each (anchor, slot), the combiner before the shuffle does the same
again, and the window of positive j is read off by merging slots j, j + 1, ...
downwards: the first k of that suffix, less those under the window's lower limit.

Scores are integer inner products of floor(scale * x). Anchors and rows are dealt
into blocks of bounded bytes; every (anchor block, row block) pair is one tile
of an equi-join, scored slab by slab. Positives are searched in tiles of one
label only, negatives in tiles of all rows. No vector reaches the driver and
nothing is broadcast: a label or a vector that a third of all rows share is spread over
many blocks. A task holds two blocks, one slab of scores and k rows for each
anchor and slot of its tile.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no
part. Vectors of different lengths are compared as if the shorter ended in zeros.
Ties go to the smaller id; rows with one id stay separate rows (an anchor is never
its own positive; a second row with its id may be), and repeated anchors give repeated
results. A window of a negative score is empty. Products are exact: blocks whose
sums could pass 2^53 are added up as whole numbers instead of doubles. An empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm import registry
from casewright.llm.session import prepare, read
from casewright.operators.common import reliable_checkpoint


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``negatives``: how many of each an anchor and a positive get. ``low`` and ``high``
    bound a negative's score in hundredths of the positive's. ``anchor_block``, ``row_block`` and
    ``slab`` are rows of a block and scores of a slab."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    anchor_block: int = 4096
    row_block: int = 16384
    slab: int = 1 << 21


def usable(vectors: DataFrame, vec_col: str, label: Column, s: Settings) -> DataFrame:
    """(row, id, label, vec) of the rows that take part; ``vec`` holds the whole-number components."""
    comps = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * s.scale).cast("double"))
    sound = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(vec_col).isNotNull() & sound))
    return reliable_checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", comps.alias("vec")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, as int64."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return (exact(a) @ exact(b).T).astype(np.int64)  # raises where a sum is no 64-bit number


def _slabs(table: pa.Table, s: Settings) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """(anchors, rows, scores) of a tile, some anchors at a time."""
    anchors, rows = table.filter(pc.field("side") == 0), table.filter(pc.field("side") == 1)
    if not anchors.num_rows or not rows.num_rows:
        return
    width = max(pc.max(pc.list_value_length(t.column("vec"))).as_py() for t in (anchors, rows))
    matrix = _matrix(rows.column("vec"), width)
    step = max(1, s.slab // rows.num_rows)
    for lo in range(0, anchors.num_rows, step):
        part = anchors.slice(lo, step)
        yield part, rows, _products(_matrix(part.column("vec"), width), matrix)


def _first(anchor: np.ndarray, group: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each (anchor, group): score descending, then id, then row."""
    order = np.lexsort((row, ids, -score, group, anchor))
    anchor, group = anchor[order], group[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _positive_tile(table: pa.Table, s: Settings) -> pa.Table:
    """The best rows of one label's block for each anchor of a block."""
    out = []
    for anchors, rows, scores in _slabs(table, s):
        a_row, ids, row = _column(anchors, "row"), _column(rows, "id"), _column(rows, "row")
        n = scores.shape[1]
        k = min(s.positives + 1, n)  # the anchor itself may be among them
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        a, r = np.nonzero((scores >= least[:, None]) & (a_row[:, None] != row))
        score = scores[a, r]
        at = _first(a, np.zeros(len(a), np.int64), score, ids[r], row[r], s.positives)
        out.append(pa.table({"row": a_row[a[at]], "other_row": row[r[at]], "id": ids[r[at]], "score": score[at]}))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("row", "other_row", "id", "score")})


def _negative_tile(table: pa.Table, s: Settings) -> pa.Table:
    """The top k of each (anchor, slot) among the different-label rows of a block."""
    out = []
    for anchors, rows, scores in _slabs(table, s):
        a_row, ids, row = _column(anchors, "row"), _column(rows, "id"), _column(rows, "row")
        limits = anchors.column("limits").to_pylist()
        least = _column(anchors, "least")
        inside = scores <= np.array([x[0] for x in limits])[:, None]
        inside &= scores >= least[:, None]
        inside &= _column(anchors, "label")[:, None] != _column(rows, "label")
        a, r = np.nonzero(inside)
        score = scores[a, r]
        # The slot is the last limit (they fall) that the score does not pass.
        slot = np.zeros(len(a), np.int64)
        for j in range(1, max(map(len, limits))):
            limit = np.array([x[j] if j < len(x) else np.iinfo(np.int64).min for x in limits])
            slot[score <= limit[a]] = j
        at = _first(a, slot, score, ids[r], row[r], s.negatives)
        out.append(pa.table({"row": a_row[a[at]], "slot": slot[at], "other_row": row[r[at]], "id": ids[r[at]], "score": score[at]}))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("row", "slot", "other_row", "id", "score")})


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("row"), blocks).cast("int")


def _tiles(anchors: DataFrame, rows: DataFrame, key: list[str], n_tiles: int) -> DataFrame:
    """Both sides of all tiles: anchors and rows repeated for the blocks of the other side.
    ``key`` names the columns that both sides of a tile share; a_blocks and r_blocks are their block counts."""
    cols = ["row", "id", "label", "vec"]
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = anchors.select(*cols, *[c for c in ("limits", "least") if c in anchors.columns],
                          F.lit(0).alias("side"), _block(F.col("a_blocks")).alias("i"), each("r_blocks").alias("j"))
    right = rows.select(*cols, F.lit(1).alias("side"), _block(F.col("r_blocks")).alias("j"), each("a_blocks").alias("i"))
    return left.unionByName(right, allowMissingColumns=True).repartition(n_tiles, *key, "i", "j").groupBy(*key, "i", "j")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group; Spark keeps k of a task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "other_row")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchor: Column, s: Settings = Settings(), vec_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and ``vec_col``; ``anchor`` marks the anchors by ``id`` and ``label``;
    ``label`` replaces the label column.
    """
    spark = prepare(vectors.sparkSession)
    rows = usable(vectors, vec_col, F.col("label") if label is None else label, s)
    cores = spark.sparkContext.defaultParallelism
    marked = rows.withColumn("anchor", anchor)
    per_label = reliable_checkpoint(marked.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if("anchor").alias("n_anchors")))
    # The counts bound the tiles: blocks of a fixed size, and enough of them for all cores when rows are few.
    n = per_label.agg(F.sum("n_rows").alias("rows"), F.sum("n_anchors").alias("anchors"), F.count("*").alias("labels")).first()
    n_rows, n_anchors = n["rows"] or 0, n["anchors"] or 0
    row_blocks = max(1, math.ceil(n_rows / s.row_block), min(2 * cores, math.ceil(n_rows / 256)))
    anchor_blocks = max(1, math.ceil(n_anchors / s.anchor_block))
    sizes = per_label.where("n_anchors > 0").select(
        F.col("label").alias("of"), F.ceil(F.col("n_anchors") / s.anchor_block).cast("int").alias("a_blocks"),
        F.ceil(F.col("n_rows") / s.row_block).cast("int").alias("r_blocks"))
    sized = marked.join(sizes, F.col("label") == F.col("of")).drop("of")
    # About as many tasks as tiles hold blocks of rows, at least all cores.
    tasks = max(cores, math.ceil(n_rows / s.row_block) * anchor_blocks)
    positive = "row long, other_row long, id long, score long"
    found = (_tiles(sized.where("anchor"), sized, ["label"], tasks)
             .applyInArrow(lambda t: _positive_tile(t, s), positive))
    positives = reliable_checkpoint(_ranked(found, ["row"], s.positives))

    limit = _floor_div(F.col("score") * s.high, 100)
    windows = (positives.where("score >= 0").groupBy("row")
               .agg(F.reverse(F.array_sort(F.collect_set(limit))).alias("limits"),
                    F.min(_floor_div(F.col("score") * s.low + 99, 100)).alias("least")))
    anchors = marked.where("anchor").join(windows, "row").withColumns(
        {"a_blocks": F.lit(anchor_blocks), "r_blocks": F.lit(row_blocks)})
    others = rows.withColumns({"a_blocks": F.lit(anchor_blocks), "r_blocks": F.lit(row_blocks)})
    negative = "row long, slot long, other_row long, id long, score long"
    in_slots = (_tiles(anchors, others, [], max(cores, anchor_blocks * row_blocks))
                .applyInArrow(lambda t: _negative_tile(t, s), negative))
    # At most one slot for each positive and k rows for each slot: a short, descending list for each anchor.
    slots = (_ranked(in_slots, ["row", "slot"], s.negatives).groupBy("row")
             .agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id", "other_row"))).alias("below")))
    answers = (positives.where("score >= 0").join(windows.select("row", "limits"), "row").join(slots, "row")
               .withColumn("slot", F.array_position("limits", limit) - 1)
               .select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                       F.slice(F.filter("below", lambda x: x["slot"] >= F.col("slot")), 1, s.negatives).alias("first"))
               .select("row", "positive_id", "positive_score",
                       F.posexplode(F.filter("first", lambda x: -x["down"] * 100 >= F.col("positive_score") * s.low)).alias("at", "hit")))
    return answers.join(rows.select("row", F.col("id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("negative_id"),
        "positive_score", (-F.col("hit.down")).alias("negative_score"))


def _floor_div(x: Column, by: int) -> Column:
    """floor(x / by) of a whole number, exact."""
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


@registry.query("op12_hard_negatives", sql=r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, a.label = b.label AS same, b.vec_id AS b, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("id") % 50 == 0, label=label)
