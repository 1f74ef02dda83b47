"""Queries for kNN retrieval, retrieval metrics, margins and kNN classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import knn as K
from casewright.operators import metrics as M
from casewright.plans.catalog import query
from casewright.plans.oracle_views import with_views, words_sql
from casewright.sources import fixtures as FX
from casewright.sources.tables import read_table

TOP_K = 5
LABELS = list(range(10))


def _unit_sql(e: str) -> str:
    return f"list_transform({e}, lambda x: x / sqrt(list_sum(list_transform({e}, lambda y: y * y))))"


KNN_CTES = [
    f"qn AS (SELECT query_id, label AS query_label, {_unit_sql('embedding')} AS v FROM vec_queries)",
    f"cn AS (SELECT case_id, label AS case_label, {_unit_sql('embedding')} AS v FROM vec_corpus)",
    """scored AS (SELECT q.query_id, q.query_label, c.case_id, c.case_label, list_dot_product(q.v, c.v) AS score
    FROM qn q JOIN cn c ON c.case_id <> q.query_id)""",
    f"""knn AS (SELECT query_id, query_label, case_id, case_label, score, round(score, 4) AS similarity, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM scored) r
    WHERE rank <= {TOP_K})"""]


def knn_result(spark, sf_dir):
    """Leave-one-out top-5 over the whole embeddings table, with labels."""
    q = FX.vec_queries(spark, sf_dir)
    c = FX.vec_corpus(spark, sf_dir)
    hits = K.knn_topk(q, c, TOP_K, exclude_self=True)
    hits = K.attach_case_metadata(hits, c.select("case_id", F.col("label").alias("case_label")))
    return hits.join(q.select("query_id", F.col("label").alias("query_label")), "query_id")


def _with_knn(body: str, extra: list[str] | None = None) -> str:
    return with_views(["vec_queries", "vec_corpus"], body, extra=KNN_CTES + (extra or []))


@query("knn_topk", "T1 J7 J8", _with_knn(
    "SELECT query_id, CAST(rank AS BIGINT) AS rank, case_id, similarity, case_label FROM knn"))
def q_knn_topk(spark, sf_dir):
    return knn_result(spark, sf_dir).select("query_id", F.col("rank").cast("long"), "case_id", "similarity",
                                            "case_label")


@query("normalized_vectors", "T2", f"""
SELECT vec_id, CAST(i AS BIGINT) AS i, round(x, 6) AS x, dim, input_norm FROM (
  SELECT vec_id, unnest(u) AS x, generate_subscripts(u, 1) AS i, dim, input_norm FROM (
    SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim,
           round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 6) AS input_norm,
           {_unit_sql('CAST(embedding AS DOUBLE[])')} AS u
    FROM embeddings) a) b""")
def q_normalized(spark, sf_dir):
    """T2 in long form: one row per (vector, component) of the unit vector."""
    v = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    u = v.select("vec_id", F.size("embedding").cast("long").alias("dim"),
                 F.round(K.vector_norm("embedding"), 6).alias("input_norm"),
                 F.posexplode(K.l2_normalize("embedding")).alias("pos", "x"))
    return u.select("vec_id", (F.col("pos") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"), "dim",
                    "input_norm")


CENTROID_CTES = [
    f"u AS (SELECT label, {_unit_sql('CAST(embedding AS DOUBLE[])')} AS v FROM embeddings)",
    """e AS (SELECT label, i, avg(x) AS x FROM (
        SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) t GROUP BY label, i)""",
    "cent AS (SELECT CAST(label AS BIGINT) AS centroid_id, list(x ORDER BY i) AS raw FROM e GROUP BY label)",
    f"centn AS (SELECT centroid_id, {_unit_sql('raw')} AS v FROM cent)"]


def _centroids(spark, sf_dir):
    return K.label_centroids(FX.vectors(spark, sf_dir))


@query("pairwise_similarity", "T4", with_views([], """
SELECT a.centroid_id AS centroid_a, b.centroid_id AS centroid_b, round(list_dot_product(a.v, b.v), 4) AS similarity
FROM centn a JOIN centn b ON true""", extra=CENTROID_CTES))
def q_pairwise(spark, sf_dir):
    cent = _centroids(spark, sf_dir)
    n = cent.count()                      # one centroid per label: bounded by the label set
    hits = K.knn_topk(cent.withColumnRenamed("centroid_id", "query_id"),
                      cent.withColumnRenamed("centroid_id", "case_id"), k=n)
    return hits.select(F.col("query_id").alias("centroid_a"), F.col("case_id").alias("centroid_b"), "similarity")


@query("archetype_retrieval", "T6 T1", with_views([], f"""
SELECT centroid_id, CAST(rank AS BIGINT) AS rank, case_id, round(score, 4) AS similarity, case_label FROM (
  SELECT c.centroid_id, e.vec_id AS case_id, e.label AS case_label, list_dot_product(c.v, e.v) AS score,
         row_number() OVER (PARTITION BY c.centroid_id ORDER BY list_dot_product(c.v, e.v) DESC, e.vec_id) AS rank
  FROM centn c JOIN ev e ON true) t
WHERE rank <= {TOP_K}""", extra=CENTROID_CTES + [
    f"ev AS (SELECT vec_id, label, {_unit_sql('CAST(embedding AS DOUBLE[])')} AS v FROM embeddings)"]))
def q_archetype(spark, sf_dir):
    cent = _centroids(spark, sf_dir).withColumnRenamed("centroid_id", "query_id")
    corpus = FX.vec_corpus(spark, sf_dir)
    hits = K.knn_topk(cent, corpus, TOP_K)
    hits = K.attach_case_metadata(hits, corpus.select("case_id", F.col("label").alias("case_label")))
    return hits.select(F.col("query_id").alias("centroid_id"), F.col("rank").cast("long"), "case_id",
                       "similarity", "case_label")


_RM_BODY = """
SELECT count(*) AS n_queries,
       round(avg(coalesce(m1, 0)), 4) AS consistency_at_1, round(avg(coalesce(c3, 0)), 4) AS consistency_at_3,
       round(avg(coalesce(c5, 0)), 4) AS consistency_at_5, round(avg(coalesce(m1, 0)), 4) AS hit_rate_at_1,
       round(avg(coalesce(h3, 0)), 4) AS hit_rate_at_3, round(avg(coalesce(h5, 0)), 4) AS hit_rate_at_5,
       round(avg(top1_sim), 4) AS top1_sim_mean, round(median(top1_sim), 4) AS top1_sim_median,
       round(min(top1_sim), 4) AS top1_sim_min, round(max(top1_sim), 4) AS top1_sim_max,
       round(stddev_pop(top1_sim), 4) AS top1_sim_std
FROM vec_queries q LEFT JOIN pq ON pq.query_id = q.query_id"""


def _pq_cte(ref: str) -> str:
    m = f"CAST(k.case_label = {ref} AS INTEGER)"
    return f"""pq AS (SELECT k.query_id,
      max(CASE WHEN rank = 1 THEN {m} END) AS m1,
      sum(CASE WHEN rank <= 3 THEN {m} END) / least(3, count(*)) AS c3,
      sum(CASE WHEN rank <= 5 THEN {m} END) / least(5, count(*)) AS c5,
      max(CASE WHEN rank <= 3 THEN {m} END) AS h3,
      max(CASE WHEN rank <= 5 THEN {m} END) AS h5,
      max(CASE WHEN rank = 1 THEN similarity END) AS top1_sim
    FROM knn_p k GROUP BY k.query_id)"""


@query("retrieval_metrics", "A11 A13", _with_knn(_RM_BODY, [
    "knn_p AS (SELECT * FROM knn)", _pq_cte("k.query_label")]))
def q_retrieval_metrics(spark, sf_dir):
    return M.retrieval_metrics(FX.vec_queries(spark, sf_dir), knn_result(spark, sf_dir), "query_label")


MARGIN_CTES = CENTROID_CTES + [
    f"ue AS (SELECT vec_id, {_unit_sql('CAST(embedding AS DOUBLE[])')} AS v FROM embeddings)",
    """margins AS (SELECT e.vec_id, list(list_dot_product(e.v, c.v) ORDER BY c.centroid_id) AS mg
    FROM ue e JOIN centn c ON true GROUP BY e.vec_id)"""]


def _margins(spark, sf_dir):
    """(vec_id, m): the margin of each class is the vector's dot product with the class centroid,
    over all components. There is one centroid for each label of ``LABELS``, so they are literals."""
    cents = _centroids(spark, sf_dir).orderBy("centroid_id").limit(len(LABELS) + 1).collect()
    if len(cents) > len(LABELS):
        raise ValueError("more labels than LABELS lists")
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", K.l2_normalize("embedding").alias("u"))
    dot = lambda v: F.aggregate(F.zip_with("u", F.array(*[F.lit(float(x)) for x in v]), lambda x, y: x * y),
                                F.lit(0.0), lambda acc, x: acc + x)
    return e.select("vec_id", F.array(*[dot(r["embedding"]) for r in cents]).alias("m"))


@query("retrieval_metrics_pred", "A12 M4", _with_knn(_RM_BODY, MARGIN_CTES + [
    """knn_p AS (SELECT k.*, list_position(m.mg, list_max(m.mg)) - 1 AS pred_label FROM knn k
      JOIN margins m ON m.vec_id = k.query_id)""",
    _pq_cte("k.pred_label")]))
def q_retrieval_metrics_pred(spark, sf_dir):
    pred = _margins(spark, sf_dir).select(F.col("vec_id").alias("query_id"), M.margin_argmax(F.col("m")).alias("pred_label"))
    hits = knn_result(spark, sf_dir).join(pred, "query_id")
    return M.retrieval_metrics(FX.vec_queries(spark, sf_dir), hits, "pred_label")


def _rel_sql(s: str) -> str:
    return (f"CASE WHEN {s} >= 0.70 THEN 'relevant' WHEN {s} >= 0.52 THEN 'partially_relevant' "
            f"ELSE 'irrelevant' END")


@query("relevance_precision_row", "T5 A15", _with_knn("""
SELECT n_rows, strict_p_at_1, strict_p_at_3, lenient_p_at_1, lenient_p_at_3, n_queries, hit_rate_at_3 FROM
 (SELECT count(*) AS n_rows,
    round(coalesce(avg(CASE WHEN rank = 1 THEN CAST(rel = 'relevant' AS INTEGER) END), 0), 4) AS strict_p_at_1,
    round(coalesce(avg(CASE WHEN rank <= 3 THEN CAST(rel = 'relevant' AS INTEGER) END), 0), 4) AS strict_p_at_3,
    round(coalesce(avg(CASE WHEN rank = 1 THEN CAST(rel <> 'irrelevant' AS INTEGER) END), 0), 4) AS lenient_p_at_1,
    round(coalesce(avg(CASE WHEN rank <= 3 THEN CAST(rel <> 'irrelevant' AS INTEGER) END), 0), 4) AS lenient_p_at_3
  FROM lab) a,
 (SELECT count(*) AS n_queries, round(coalesce(avg(coalesce(hit, 0)), 0), 4) AS hit_rate_at_3 FROM
   (SELECT query_id, max(CASE WHEN rank <= 3 THEN CAST(rel = 'relevant' AS INTEGER) END) AS hit FROM lab GROUP BY 1) t) b""",
    [f"lab AS (SELECT *, {_rel_sql('similarity')} AS rel FROM knn)"]))
def q_relevance_row(spark, sf_dir):
    return M.relevance_precision_row(knn_result(spark, sf_dir)).select(
        "n_rows", "strict_p_at_1", "strict_p_at_3", "lenient_p_at_1", "lenient_p_at_3", "n_queries", "hit_rate_at_3")


@query("relevance_precision_query", "A16", _with_knn("""
SELECT count(*) AS n_queries,
       round(sum(coalesce(l1, 0)) / count(*), 4) AS precision_at_1,
       round(sum(coalesce(s1, 0)) / count(*), 4) AS strict_precision_at_1,
       round(avg(l3), 4) AS precision_at_3, round(avg(s3), 4) AS strict_precision_at_3,
       round(avg(hit), 4) AS hit_rate_at_3
FROM (SELECT query_id,
        max(CASE WHEN rank = 1 THEN CAST(rel <> 'irrelevant' AS INTEGER) END) AS l1,
        max(CASE WHEN rank = 1 THEN CAST(rel = 'relevant' AS INTEGER) END) AS s1,
        avg(CAST(rel <> 'irrelevant' AS INTEGER)) AS l3, avg(CAST(rel = 'relevant' AS INTEGER)) AS s3,
        max(CAST(rel <> 'irrelevant' AS INTEGER)) AS hit
      FROM lab GROUP BY 1) t""", [f"lab AS (SELECT *, {_rel_sql('similarity')} AS rel FROM knn WHERE rank <= 3)"]))
def q_relevance_query(spark, sf_dir):
    return M.relevance_precision_query(knn_result(spark, sf_dir))


@query("retrieval_errors_a", "T7", _with_knn("""
SELECT * FROM (
  SELECT query_id, query_label,
         max(CASE WHEN rank = 1 THEN case_id END) AS top1_case_id,
         max(CASE WHEN rank = 1 THEN similarity END) AS top1_similarity,
         max(CASE WHEN rank = 1 THEN case_label END) AS top1_label,
         coalesce(bool_or(CASE WHEN rank <= 3 THEN case_label = query_label END), false) AS hit_in_top3
  FROM knn GROUP BY query_id, query_label) t
WHERE top1_similarity < 0.45 OR NOT hit_in_top3"""))
def q_errors_a(spark, sf_dir):
    return M.retrieval_errors_a(knn_result(spark, sf_dir))


def _minority_labels(spark, sf_dir) -> list:
    """The three least frequent labels (ties by label): a 3-row result."""
    v = FX.vectors(spark, sf_dir)
    rows = (v.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "label").limit(3).collect())
    return [r["label"] for r in rows]


@query("retrieval_errors_b", "T8", _with_knn(f"""
SELECT k.query_id, k.query_label, k.case_id, k.similarity, k.case_label,
       CASE WHEN len({words_sql("coalesce(d.text, '')")}) < 6 THEN 'ambiguous_short_query'
            WHEN k.query_label IN (SELECT label FROM minority) THEN 'minority_intent_sparse_historical_coverage'
            WHEN {' OR '.join(f"contains(lower(coalesce(d.text, '')), '{w}')" for w in M.SLANG_MARKERS)}
              THEN 'noisy_twitter_slang'
            ELSE 'cross_domain_lexical_overlap' END AS failure_reason
FROM knn k LEFT JOIN documents d ON d.doc_id = k.query_id
WHERE k.rank = 1 AND (k.similarity < 0.48 OR (k.similarity < 0.58 AND k.case_label <> k.query_label))""", [
    "minority AS (SELECT label FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) t ORDER BY n, label LIMIT 3)"]))
def q_errors_b(spark, sf_dir):
    texts = read_table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    return M.retrieval_errors_b(knn_result(spark, sf_dir), texts, _minority_labels(spark, sf_dir))


# ----------------------------------------------------------- kNN classification

def knn_predictions(spark, sf_dir):
    """Leave-one-out kNN classifier: the rank-1 case label is the prediction."""
    return (knn_result(spark, sf_dir).filter(F.col("rank") == 1)
            .select(F.lit("knn_top1").alias("model"), "query_id",
                    F.col("query_label").cast("long").alias("truth"), F.col("case_label").cast("long").alias("pred")))


PRED_CTE = "preds AS (SELECT 'knn_top1' AS model, query_id, CAST(query_label AS BIGINT) AS truth, " \
           "CAST(case_label AS BIGINT) AS pred FROM knn WHERE rank = 1)"
COUNTS_CTES = [PRED_CTE, """lc AS (
    SELECT model, label, sum(is_true) AS support, sum(is_pred) AS predicted, sum(tp) AS tp FROM (
      SELECT model, truth AS label, 1 AS is_true, 0 AS is_pred, CAST(truth = pred AS INTEGER) AS tp FROM preds
      UNION ALL
      SELECT model, pred AS label, 0, 1, 0 FROM preds) x GROUP BY model, label)""",
               """prf AS (SELECT *,
      coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS precision,
      coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS recall,
      coalesce(CAST(2 * tp AS DOUBLE) / nullif(support + predicted, 0), 0) AS f1 FROM lc)"""]


@query("classification_summary", "A8", _with_knn("""
SELECT model, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 4) AS accuracy,
       round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall,
       round(avg(f1), 4) AS macro_f1,
       round(sum(precision * support) / sum(support), 4) AS weighted_precision,
       round(sum(recall * support) / sum(support), 4) AS weighted_recall,
       round(sum(f1 * support) / sum(support), 4) AS weighted_f1
FROM prf GROUP BY model""", COUNTS_CTES))
def q_classification_summary(spark, sf_dir):
    return M.classification_summary(knn_predictions(spark, sf_dir))


@query("per_class_metrics", "A9", _with_knn("""
SELECT m.model, CAST(l.label AS BIGINT) AS label, round(coalesce(p.precision, 0), 4) AS precision,
       round(coalesce(p.recall, 0), 4) AS recall, round(coalesce(p.f1, 0), 4) AS f1,
       CAST(coalesce(p.support, 0) AS BIGINT) AS support
FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN (SELECT unnest(range(10)) AS label) l
LEFT JOIN prf p ON p.model = m.model AND p.label = l.label""", COUNTS_CTES))
def q_per_class(spark, sf_dir):
    return M.per_class_metrics(knn_predictions(spark, sf_dir), LABELS)


@query("confusion_matrix", "A10", _with_knn("SELECT m.model, CAST(l.label AS BIGINT) AS true_label, " + ", ".join(
    f"CAST(count(p.pred) FILTER (WHERE p.pred = {v}) AS BIGINT) AS pred_{v}" for v in LABELS) + """
FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN (SELECT unnest(range(10)) AS label) l
LEFT JOIN preds p ON p.model = m.model AND p.truth = l.label
GROUP BY m.model, l.label""", [PRED_CTE]))
def q_confusion(spark, sf_dir):
    return M.confusion_matrix(knn_predictions(spark, sf_dir), LABELS)


@query("misclassified", "P8", _with_knn("SELECT model, query_id, truth, pred FROM preds WHERE truth <> pred",
                                        [PRED_CTE]))
def q_misclassified(spark, sf_dir):
    p = knn_predictions(spark, sf_dir)
    return p.filter(F.col("truth") != F.col("pred"))


# ----------------------------------------------------------- margins

@query("margin_confidence", "M4", with_views([], """
SELECT vec_id, CAST(list_position(mg, list_max(mg)) - 1 AS BIGINT) AS pred_class,
       round(1.0 / list_sum(list_transform(mg, lambda x: exp(x - list_max(mg)))), 4) AS confidence
FROM margins t""", extra=MARGIN_CTES))
def q_margin_confidence(spark, sf_dir):
    e, m = _margins(spark, sf_dir), F.col("m")
    return e.select("vec_id", M.margin_argmax(m).alias("pred_class"),
                    F.round(M.softmax_confidence(m), 4).alias("confidence"))


@query("runner_up_classes", "W3", with_views([], """
SELECT vec_id, """ + ", ".join(
    f"max(CASE WHEN rn = {j} THEN cls END) AS top{j}_class, max(CASE WHEN rn = {j} THEN round(p, 4) END) AS top{j}_score"
    for j in (1, 2, 3)) + """
FROM (SELECT vec_id, cls, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS rn FROM (
        SELECT vec_id, CAST(i - 1 AS BIGINT) AS cls, exp(x - mx) / z AS p FROM (
          SELECT vec_id, unnest(mg) AS x, generate_subscripts(mg, 1) AS i, list_max(mg) AS mx,
                 list_sum(list_transform(mg, lambda y: exp(y - list_max(mg)))) AS z
          FROM margins a) b) c) d
GROUP BY vec_id""", extra=MARGIN_CTES))
def q_runner_up(spark, sf_dir):
    return M.runner_up_classes(_margins(spark, sf_dir), "vec_id", "m")


@query("vector_store_roundtrip", "S8 T2", """
SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dim,
       round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 6) AS norm
FROM embeddings""")
def q_vector_store(spark, sf_dir):
    """Persist vectors with their metadata in one Parquet table, reload with the
    size/null checks, and report per-vector dimension and norm."""
    import uuid
    from casewright.session import scratch_dir
    path = scratch_dir(spark, f"vectors-{uuid.uuid4().hex}")
    v = FX.vectors(spark, sf_dir)
    dim = v.select(F.max(F.size("embedding"))).first()[0]
    K.save_vectors(v, path)
    back = K.load_vectors(spark, path, dim)
    return back.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"),
                       F.round(K.vector_norm("embedding"), 6).alias("norm"))


@query("weakest_retrievals", "W8 W9 A13", _with_knn("""
SELECT query_id, query_label, case_id AS top1_case_id, similarity AS top1_similarity FROM knn
WHERE rank = 1 ORDER BY similarity, query_id LIMIT 20"""))
def q_weakest(spark, sf_dir):
    """Top-n report: the 20 queries whose best match is weakest (the limit is the
    report; it plans as a distributed top-n, not a global sort)."""
    top1 = knn_result(spark, sf_dir).filter(F.col("rank") == 1)
    return (top1.select("query_id", "query_label", F.col("case_id").alias("top1_case_id"),
                        F.col("similarity").alias("top1_similarity"))
                .orderBy("top1_similarity", "query_id").limit(20))
