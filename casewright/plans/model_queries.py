"""Queries for the majority baseline, Spark ML intent models and TF-IDF vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import intent as I
from casewright.operators import metrics as M
from casewright.operators import quality as Q
from casewright.operators.common import reliable_checkpoint
from casewright.plans.catalog import query
from casewright.plans.corpus_queries import _clean_sql
from casewright.plans.oracle_views import with_views
from casewright.plans.quality_queries import SPLIT_CTES
from casewright.sources import fixtures as FX
from casewright.sources.tables import read_table


def _split(spark, sf_dir):
    return Q.stratified_split(FX.labelled_docs(spark, sf_dir))


@query("majority_baseline", "A27 A8", with_views(["labelled_docs"], """
SELECT model, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 4) AS accuracy,
       round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1,
       round(sum(precision * support) / sum(support), 4) AS weighted_precision,
       round(sum(recall * support) / sum(support), 4) AS weighted_recall,
       round(sum(f1 * support) / sum(support), 4) AS weighted_f1
FROM prf GROUP BY model""", extra=SPLIT_CTES + [
    """maj AS (SELECT intent FROM split WHERE split = 'train' AND intent IS NOT NULL GROUP BY intent
              ORDER BY count(*) DESC, intent LIMIT 1)""",
    "preds AS (SELECT 'majority' AS model, s.tweet_id, s.intent AS truth, m.intent AS pred FROM split s, maj m WHERE s.split = 'test')",
    """lc AS (SELECT model, label, sum(is_true) AS support, sum(is_pred) AS predicted, sum(tp) AS tp FROM (
      SELECT model, truth AS label, 1 AS is_true, 0 AS is_pred, CAST(truth = pred AS INTEGER) AS tp FROM preds
      UNION ALL SELECT model, pred AS label, 0, 1, 0 FROM preds) x GROUP BY model, label)""",
    """prf AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS precision,
      coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS recall,
      coalesce(CAST(2 * tp AS DOUBLE) / nullif(support + predicted, 0), 0) AS f1 FROM lc)"""]))
def q_majority(spark, sf_dir):
    s = _split(spark, sf_dir)
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    # one label: computed by an aggregate, then used as a literal
    maj = M.majority_class(train.filter(F.col("intent").isNotNull())).first()["majority"]
    preds = test.select(F.lit("majority").alias("model"), "tweet_id", F.col("intent").alias("truth"),
                        F.lit(maj).alias("pred"))
    return M.classification_summary(preds)


@query("intent_models", "M1 M2 M3 M5 M6 M7")
def q_intent_models(spark, sf_dir):
    """Three models fitted on the train split, predictions for the test split."""
    # the split feeds training, the majority count and the test predictions: compute it once
    s = reliable_checkpoint(_split(spark, sf_dir).select("tweet_id", "text", "intent", "split"))
    models = I.train_models(s.filter(F.col("split") == "train"), FX.DOC_TAXONOMY)
    return I.predict(models, s.filter(F.col("split") == "test"))


@query("intent_model_metrics", "M6 A8")
def q_intent_model_metrics(spark, sf_dir):
    """Accuracy, macro and weighted scores of the three models on the test split."""
    return M.classification_summary(q_intent_models(spark, sf_dir).select("model", "tweet_id", "truth", "pred"))


@query("intent_model_confusion", "M6 A10")
def q_intent_model_confusion(spark, sf_dir):
    """(model, truth, pred, n) of the three models on the test split."""
    return (q_intent_models(spark, sf_dir).groupBy("model", "truth", "pred").agg(F.count(F.lit(1)).alias("n")))


@query("tfidf_vectors", "T3 P6", f"""
WITH c AS (SELECT doc_id, regexp_extract_all(lower({_clean_sql('text')}), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1) AS w FROM documents),
t AS (SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM c),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT doc_id, tf.term, tf * (ln(((SELECT count(*) FROM documents) + 1) / CAST(df + 1 AS DOUBLE)) + 1) AS x FROM tf JOIN df ON df.term = tf.term)
SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def q_tfidf(spark, sf_dir):
    """TF-IDF vector of every cleaned document, as sparse rows."""
    return I.tfidf_rows(read_table(spark, sf_dir, "documents", "doc_id", "text")).withColumn("weight", F.round("weight", 6))


@query("retrieved_intent_metrics", "M5 A11 T1")
def q_retrieved_intents(spark, sf_dir):
    """The retrieved cases' texts are labelled by the LR intent model (fitted on
    the train split) and compared with the query document's own label."""
    from casewright.operators.metrics import retrieval_metrics
    from casewright.plans.vector_queries import knn_result
    s = reliable_checkpoint(_split(spark, sf_dir).select("tweet_id", "text", "intent", "split"))
    models = I.train_models(s.filter(F.col("split") == "train"), FX.DOC_TAXONOMY, with_svm=False)
    docs = FX.labelled_docs(spark, sf_dir)
    hits = knn_result(spark, sf_dir).select("query_id", "rank", "case_id", "similarity")
    texts = docs.select(F.col("tweet_id").alias("case_id"), "text")
    scored = I.score_texts(models, hits.join(texts, "case_id"), out_col="case_label").drop("text")
    truth = docs.select(F.col("tweet_id").alias("query_id"), F.col("intent").alias("query_label"))
    return retrieval_metrics(FX.vec_queries(spark, sf_dir).select("query_id"),
                             scored.join(truth, "query_id"), "query_label")
