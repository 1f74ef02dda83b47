"""Exact top-k retrieval against a numpy brute force."""
import numpy as np

from casewright.operators.knn import knn_topk


def brute(q, c, k, exclude_self):
    out = {}
    qn = q[1] / np.linalg.norm(q[1], axis=1, keepdims=True)
    cn = c[1] / np.linalg.norm(c[1], axis=1, keepdims=True)
    s = qn @ cn.T
    for i, qid in enumerate(q[0]):
        cand = [(-s[i, j], c[0][j]) for j in range(len(c[0])) if not (exclude_self and c[0][j] == qid)]
        cand.sort()
        out[qid] = [cid for _, cid in cand[:k]]
    return out


def test_block_path_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    qv, cv = rng.normal(size=(17, 8)), rng.normal(size=(120, 8))
    cv[5] = cv[6]                                   # an exact tie: broken by case id
    qids, cids = list(range(1000, 1017)), list(range(120))
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in zip(qids, qv)], "query_id long, embedding array<double>")
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in zip(cids, cv)], "case_id long, embedding array<double>")
    got = {}
    for r in knn_topk(qdf, cdf, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["case_id"]))
    exp = brute((qids, qv), (cids, cv), 5, False)
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == exp


def test_blocks_and_leave_one_out(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    hits = knn_topk(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "case_id"), 3,
                    exclude_self=True, tile_bytes=7 * 6 * 8)  # forces several blocks on both sides
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["case_id"]))
    exp = brute((list(range(40)), v), (list(range(40)), v), 3, True)
    assert {k: [c for _, c in sorted(x)] for k, x in got.items()} == exp


def test_k_edge_cases(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "case_id long, embedding array<double>")
    assert knn_topk(q, c, 0).count() == 0
    rows = knn_topk(q, c, 10).orderBy("rank").collect()
    assert [r["case_id"] for r in rows] == [7, 8] and rows[0]["similarity"] == 1.0


def test_repeated_query_ids_stay_apart_beyond_a_block(spark):
    rng = np.random.default_rng(5)
    qv, cv = rng.normal(size=(30, 4)), rng.normal(size=(25, 4))
    q = spark.createDataFrame([(9, x.tolist()) for x in qv], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(cv)], "case_id long, embedding array<double>")
    rows = knn_topk(q, c, 2, tile_bytes=3 * 4 * 8).collect()
    assert len(rows) == 60 and sorted(r["rank"] for r in rows) == [1] * 30 + [2] * 30
    exp = brute((list(range(30)), qv), (list(range(25)), cv), 2, False)
    assert sorted(r["case_id"] for r in rows if r["rank"] == 1) == sorted(v[0] for v in exp.values())


def test_string_ids(spark):
    q = spark.createDataFrame([("case_b", [1.0, 0.0])], "query_id string, embedding array<double>")
    c = spark.createDataFrame([("case_c", [1.0, 0.0]), ("case_a", [1.0, 0.0]), ("case_b", [1.0, 0.0])],
                              "case_id string, embedding array<double>")
    rows = knn_topk(q, c, 5, exclude_self=True).orderBy("rank").collect()
    assert [r["case_id"] for r in rows] == ["case_a", "case_c"]


def test_planning_brings_no_vector_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(self.dtypes) or collect(self))
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(60)], "query_id long, embedding array<double>")
    knn_topk(q, q.withColumnRenamed("query_id", "case_id"), 3, tile_bytes=320)
    assert all("array" not in t for dtypes in seen for _, t in dtypes)
