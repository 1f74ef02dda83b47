"""G1: conversation roots over the reply graph by pointer jumping.

Semantics: follow ``parent`` links to the last id that has no parent
entry (that id may have no row of its own). On a cycle the walk stops at
the first node it revisits, so a cycle member is its own root and a tail
leading into a cycle gets the node where it enters.

Plan: ``ptr := parent``; each round ``ptr := ptr[ptr]`` (one self-join,
then a reliable checkpoint so lineage stays one round deep). A node is
*resolved* when its pointer has no parent entry. After round k every node
within 2^k steps of a terminal is resolved, and distances along a chain are
contiguous, so a round that resolves nothing new proves every acyclic node
is done: O(log depth) rounds, no depth-linear recursion.

Nodes still unresolved lead into cycles. Jumping them further, the image
set {ptr(v)} shrinks to exactly the cycle nodes and then stays constant
(cycle members map bijectively onto the cycle). Those nodes become
self-rooted terminals, and the tails are resolved by a second, now
acyclic, run that stops at the entry node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators.common import reliable_checkpoint


def _flagged(ptr: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ptr) -> (id, ptr, open): ``open`` = the pointer still has a parent entry."""
    keys = edges.select(F.col("id").alias("ptr"), F.lit(True).alias("_has"))
    return ptr.join(keys, "ptr", "left").select("id", "ptr", F.coalesce("_has", F.lit(False)).alias("open"))


def _jump(ptr: DataFrame) -> DataFrame:
    """One doubling step; the ``open`` flag travels with the pointer, so the
    next round's unresolved count is a scan, not another join."""
    a, b = ptr.alias("a"), ptr.alias("b")
    return (a.join(b, F.col("a.ptr") == F.col("b.id"), "left")
             .select(F.col("a.id").alias("id"),
                     F.when(F.col("a.open"), F.col("b.ptr")).otherwise(F.col("a.ptr")).alias("ptr"),
                     F.when(F.col("a.open"), F.col("b.open")).otherwise(F.lit(False)).alias("open")))


def _resolve_acyclic(ptr: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Jump until a round resolves nothing new; returns (id, ptr, open) for all edge ids.

    Only open rows jump: a row leaves the join (and later checkpoints) in the round
    that resolves it, so a root that many rows share is never a hot join key.
    """
    first = reliable_checkpoint(_flagged(ptr, edges))
    done, todo = first.filter(~F.col("open")), first.filter("open")
    prev = todo.count()
    for _ in range(max_rounds):
        if prev == 0:
            return done
        known = done.unionByName(todo)
        a, b = todo.alias("a"), known.alias("b")
        moved = reliable_checkpoint(a.join(b, F.col("a.ptr") == F.col("b.id"))
                                    .select(F.col("a.id").alias("id"), F.col("b.ptr").alias("ptr"), F.col("b.open").alias("open")))
        done, todo = done.unionByName(moved.filter(~F.col("open"))), moved.filter("open")
        cur = todo.count()
        if cur == prev:
            return done.unionByName(todo)
        prev = cur
    raise RuntimeError(f"reply chains are not resolved after {max_rounds} doubling rounds")


def root_pointers(edges: DataFrame) -> DataFrame:
    """``edges(id, parent)`` -> ``(id, root)`` for every id that has a parent."""
    e = (edges.filter(F.col("parent").isNotNull())
              .groupBy("id").agg(F.max("parent").alias("parent")))   # duplicate ids: the largest parent
    e = reliable_checkpoint(e)
    ptr = _resolve_acyclic(e.select("id", F.col("parent").alias("ptr")), e)
    stuck = ptr.filter("open")
    if stuck.limit(1).count() == 0:
        return ptr.select("id", F.col("ptr").alias("root"))

    # Cycle handling on the (normally tiny) unresolved remainder: every pointer
    # of a stuck node targets another stuck node, so the jumps stay inside it.
    resolved = ptr.filter(~F.col("open"))
    cur = reliable_checkpoint(stuck)
    prev = cur.select("ptr").distinct().count()
    while True:
        cur = reliable_checkpoint(_jump(cur))
        n = cur.select("ptr").distinct().count()
        if n == prev:
            break
        prev = n
    cycle_nodes = reliable_checkpoint(cur.select(F.col("ptr").alias("id")).distinct())
    tails_e = (e.join(stuck.select("id"), "id", "left_semi")
                .join(cycle_nodes, "id", "left_anti"))
    tails = _resolve_acyclic(tails_e.select("id", F.col("parent").alias("ptr")), tails_e)
    return (resolved.select("id", F.col("ptr").alias("root"))
            .unionByName(cycle_nodes.select("id", F.col("id").alias("root")))
            .unionByName(tails.select("id", F.col("ptr").alias("root"))))


def conversation_roots(tweets: DataFrame, id_col: str = "tweet_id",
                       parent_col: str = "in_response_to_tweet_id") -> DataFrame:
    """``(tweet_id, conversation_id)`` for every tweet row."""
    edges = tweets.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"))
    roots = root_pointers(edges)
    nodes = tweets.select(F.col(id_col).cast("long").alias("id")).filter(F.col("id").isNotNull()).distinct()
    return (nodes.join(roots, "id", "left")
                 .select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("conversation_id")))
