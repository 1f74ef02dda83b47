"""Blocks written once, one tile a task, and text terms counted by chunk."""
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from casewright.operators import intent as I
from casewright.operators import tiles as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_holds_one_tile_and_pairs_are_not_shuffled(spark):
    df = spark.range(0, 500, 1, 7).select(F.col("id").alias("row"), (F.col("id") * 2).alias("x"))
    blocks = T.packed(df, 5)
    assert blocks.rdd.getNumPartitions() == 5 and blocks.count() == 5
    tiles = T.crossed(blocks, blocks)
    assert tiles.rdd.glom().map(len).collect() == [1] * 25
    assert "Exchange" not in plan(tiles)
    back = pa.concat_tables(T.to_table(r.body) for r in blocks.select("body").collect())
    assert sorted(back.column("x").to_pylist()) == list(range(0, 1000, 2))


def test_terms_go_to_the_corpus_once_for_each_chunk(spark):
    texts = [(i, f"alpha beta word{i} alpha") for i in range(60)] + [(3, "beta again"), (None, "alpha null"), (None, "null id"), (70, ""), (71, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tf = I.term_counts(docs, "doc_id", "text", chunk_bytes=400)
    rows = tf.collect()
    assert len(rows) > 2
    assert all(len(set(r.terms)) == len(r.terms) == len(r.dfs) for r in rows)       # a frequent term is one row of a chunk
    assert sorted((x for r in rows for x in r.ids), key=str) == sorted([*range(60), None], key=str)
    got = {(r.doc_id, r.term): r.weight for r in I.tfidf_rows(docs).collect()}
    terms = {}
    for i, text in texts:
        w = (text or "").split()
        terms.setdefault(i, Counter()).update(w + [" ".join(p) for p in zip(w, w[1:])])
    df = Counter(t for c in terms.values() for t in c)
    want = {}
    for i, c in terms.items():
        x = {t: n * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        want |= {(i, t): v / norm for t, v in x.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_chunk_is_rows_of_bounded_size(spark):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(900))) for i in range(12)] + [(20, ""), (21, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tf = I.term_counts(docs, "doc_id", "text", chunk_bytes=1 << 20)
    rows = tf.collect()
    terms = sum(2 * len(t.split()) - 1 for _, t in texts if t)
    assert len({r.chunk for r in rows}) == 1 and sum(len(r.terms) for r in rows) == terms
    assert max(len(r.terms) for r in rows) <= I.PART_TERMS and max(len(r.body) for r in rows) <= I.PART_BYTES
    n = docs.count()
    got = {r.id: sorted(zip(r.nos, r.weights)) for r in I.tfidf_vectors(tf, I.idf_table(tf, n), n).collect()}
    assert got.keys() == set(range(12)) and all(len({no for no, _ in v}) == 1799 for v in got.values())
    assert all(abs(sum(w * w for _, w in v) - 1) < 1e-9 for v in got.values())
    assert len({no for v in got.values() for no, _ in v}) == terms      # parts keep their terms' numbers apart


def test_written_tables_have_small_row_groups(spark):
    import pyarrow.parquet as pq

    from casewright.operators.common import written
    digests = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256))
    df = written(spark.range(0, 400, 1, 1).select("id", F.array_join(digests, "").alias("x")), "long-rows")
    sizes = [g for f in df.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata]
             for g in [m.row_group(i).total_byte_size for i in range(m.num_row_groups)]]
    assert len(sizes) > 1 and max(sizes) < 32 << 20 and df.count() == 400


def test_terms_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (None, " ")], "doc_id long, text string")
    assert I.term_counts(docs, "doc_id", "text").count() == 0 and I.tfidf_rows(docs).count() == 0


def test_a_task_answers_for_a_run_of_blocks(spark, monkeypatch):
    from casewright.operators import sparse_knn as S
    blocks = T.packed(spark.range(0, 500, 1, 7).select(F.col("id").alias("row")), 5)
    runs = T.runs(blocks.select(F.col("block").alias("no"), "body"), blocks, 2)
    assert sorted(runs.rdd.glom().map(len).collect()) == [2] * 5 + [3] * 5 and "Exchange" not in plan(runs)
    assert all(len({r.no for r in part}) == 1 for part in runs.rdd.glom().collect())
    rows = [(f"c{i:03d}", [i % 7, 7 + i % 11, 40], [0.2 + i % 5 / 10, 0.3, 0.1]) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, nos array<long>, weights array<double>").repartition(3)
    kept, ranked = [], S._ranked
    monkeypatch.setattr(S, "TASKS", 0)
    monkeypatch.setattr(S, "_ranked", lambda found, k: (kept.append(found), ranked(found, k))[1])
    got = sorted(tuple(r) for r in S.sparse_topk(df, df, 4, "id", "id", True, 1200).collect())
    # Thresholds and the best of a run: at most k rows of a query for the first block and k for its only run.
    assert kept[0].count() <= 2 * 4 * len(rows)
    score = lambda a, b: round(sum(x * y for n, x in zip(a[1], a[2]) for m, y in zip(b[1], b[2]) if n == m), 9)
    want = [(a[0], i + 1, c, s) for a in rows for i, (s, c) in enumerate(sorted(((-score(a, b), b[0]) for b in rows if b[0] != a[0]))[:4])]
    assert [g[:3] for g in got] == [(a, i, c) for a, i, c, _ in sorted(want)]
    assert all(abs(g[3] + w[3]) < 1e-12 for g, w in zip(got, sorted(want)))
