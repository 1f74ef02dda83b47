"""G1 roots: chains, parents without a row, 2-cycles, tails, self-loops, 3-cycles."""
import random

from casewright.operators.graph import conversation_roots


def brute_roots(edges, ids):
    parent = dict(edges)
    out = {}
    for t in ids:
        seen, cur = set(), t
        while cur in parent:
            if cur in seen:
                break
            seen.add(cur)
            cur = parent[cur]
        out[t] = cur
    return out


def run(spark, edges, ids):
    rows = [(i, dict(edges).get(i)) for i in ids]
    df = spark.createDataFrame(rows, "tweet_id long, in_response_to_tweet_id long")
    return {r["tweet_id"]: r["conversation_id"] for r in conversation_roots(df).collect()}


def test_cycles_fixture(spark):
    edges = [(1, 2), (2, 3), (4, 99), (10, 11), (11, 10), (12, 10), (20, 20), (30, 31), (31, 32), (32, 30), (33, 31)]
    ids = [1, 2, 3, 4, 10, 11, 12, 20, 30, 31, 32, 33]
    got = run(spark, edges, ids)
    assert got == {1: 3, 2: 3, 3: 3, 4: 99, 10: 10, 11: 11, 12: 10, 20: 20, 30: 30, 31: 31, 32: 32, 33: 31}
    assert got == brute_roots(edges, ids)


def test_random_forests_with_cycles(spark):
    rng = random.Random(7)
    for _ in range(3):
        n = 60
        ids = list(range(n))
        edges = []
        for i in ids:
            r = rng.random()
            if r < 0.7:
                edges.append((i, rng.randrange(n + 10)))      # may point at an id without a row
        assert run(spark, edges, ids) == brute_roots(edges, ids)


def test_many_replies_to_one_deep_thread(spark):
    """A star of replies on the end of a chain: resolved rows leave the rounds."""
    edges = [(i, i + 1) for i in range(20)] + [(i, 0) for i in range(100, 400)]
    ids = [*range(21), *range(100, 400)]
    assert run(spark, edges, ids) == dict.fromkeys(ids, 20)


def test_rounds_that_run_out_raise(spark):
    import pytest
    from casewright.operators.graph import _resolve_acyclic
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "id long, parent long")
    with pytest.raises(RuntimeError):
        _resolve_acyclic(edges.selectExpr("id", "parent AS ptr"), edges, max_rounds=1)


def test_roots_match_spark_recursive_cte(spark):
    """Cross-check on the tweets view (acyclic): pointer jumping == a recursive CTE walk."""
    from casewright.sources import fixtures as FX
    from conftest import SF_SMALL
    tw = FX.tweets(spark, SF_SMALL)
    tw.select("tweet_id", "in_response_to_tweet_id").createOrReplaceTempView("cw_edges")
    rec = spark.sql("""
        WITH RECURSIVE walk(start, cur, depth) AS (
          SELECT tweet_id, tweet_id, 0 FROM cw_edges
          UNION ALL
          SELECT w.start, e.in_response_to_tweet_id, w.depth + 1
          FROM walk w JOIN cw_edges e ON e.tweet_id = w.cur
          WHERE e.in_response_to_tweet_id IS NOT NULL)
        SELECT start AS tweet_id, max_by(cur, depth) AS conversation_id FROM walk GROUP BY start""")
    got = {r[0]: r[1] for r in conversation_roots(tw).collect()}
    exp = {r[0]: r[1] for r in rec.collect()}
    assert got == exp and len(got) == tw.count()
