"""Classification, retrieval and margin metrics.

Every metric is a grouped aggregate over whole prediction / retrieval
tables; per-query or per-class intermediate tables are bounded by the
number of queries or classes, never by pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.common import safe_ratio
from casewright.functions.text import word_count

# Relevance thresholds on rounded similarity.
RELEVANT_MIN, PARTIAL_MIN = 0.70, 0.52
# Retrieval error thresholds.
ERR_A_TOP1_MIN = 0.45
ERR_B_SIM_MIN, ERR_B_MISMATCH_SIM_MIN, ERR_B_SHORT_WORDS = 0.48, 0.58, 6
# Slang markers of the noisy-query failure reason.
SLANG_MARKERS = ["pls", "wtf", "ugh", "bruh", "smh", "shit", "fuck"]


def r4(c) -> Column:
    return F.round(c, 4)


# ------------------------------------------------------------ classification

def label_counts(preds: DataFrame, truth: str = "truth", pred: str = "pred", model: str = "model") -> DataFrame:
    """tp / support / predicted count per (model, label) from one grouped pass."""
    ex = preds.select(model, F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred"),
                 (F.col(truth) == F.col(pred)).cast("int").alias("tp")),
        F.struct(F.col(pred).alias("label"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred"),
                 F.lit(0).alias("tp")))).alias("e"))
    return ex.groupBy(model, F.col("e.label").alias("label")).agg(
        F.sum("e.is_true").cast("long").alias("support"),
        F.sum("e.is_pred").cast("long").alias("predicted"),
        F.sum("e.tp").cast("long").alias("tp"))


def _prf(c: DataFrame) -> DataFrame:
    return c.select("*",
                    safe_ratio(F.col("tp"), F.col("predicted")).alias("precision"),
                    safe_ratio(F.col("tp"), F.col("support")).alias("recall"),
                    safe_ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def classification_summary(preds: DataFrame, truth: str = "truth", pred: str = "pred",
                           model: str = "model") -> DataFrame:
    """Accuracy, macro and weighted P/R/F1 per model. Macro averages run
    over labels present in truth or prediction; undefined ratios are 0."""
    c = _prf(label_counts(preds, truth, pred, model))
    n = F.sum("support")
    return c.groupBy(model).agg(
        n.alias("n"),
        r4(F.sum("tp") / n).alias("accuracy"),
        r4(F.avg("precision")).alias("macro_precision"),
        r4(F.avg("recall")).alias("macro_recall"),
        r4(F.avg("f1")).alias("macro_f1"),
        r4(F.sum(F.col("precision") * F.col("support")) / n).alias("weighted_precision"),
        r4(F.sum(F.col("recall") * F.col("support")) / n).alias("weighted_recall"),
        r4(F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"))


def per_class_metrics(preds: DataFrame, labels: list, truth: str = "truth", pred: str = "pred",
                      model: str = "model") -> DataFrame:
    """P/R/F1/support on the full label set (zero rows for absent labels).

    The (model, label) grid is the distinct models with the label list
    exploded onto each (the taxonomy is a short literal list)."""
    c = label_counts(preds, truth, pred, model)
    lab_type = preds.schema[truth].dataType
    grid = preds.select(model).distinct().select(
        model, F.explode(F.array(*[F.lit(v).cast(lab_type) for v in labels])).alias("label"))
    full = grid.join(c, [model, "label"], "left").na.fill(0, ["support", "predicted", "tp"])
    p = _prf(full)
    return p.select(model, "label", r4("precision").alias("precision"), r4("recall").alias("recall"),
                    r4("f1").alias("f1"), "support")


def confusion_matrix(preds: DataFrame, labels: list, truth: str = "truth", pred: str = "pred",
                     model: str = "model") -> DataFrame:
    """A10: rows = true label (every label, zero-filled), one column per predicted label."""
    cm = (preds.groupBy(model, F.col(truth).alias("true_label"))
               .pivot(pred, labels).agg(F.count(F.lit(1))).na.fill(0))
    for v in labels:
        cm = cm.withColumnRenamed(str(v), f"pred_{v}")
    grid = preds.select(model).distinct().select(
        model, F.explode(F.array(*[F.lit(v).cast(preds.schema[truth].dataType) for v in labels])).alias("true_label"))
    out = grid.join(cm, [model, "true_label"], "left").na.fill(0)
    return out.select(model, "true_label", *[F.col(f"pred_{v}").cast("long").alias(f"pred_{v}") for v in labels])


def majority_class(train: DataFrame, label_col: str = "intent") -> DataFrame:
    """Most frequent training label, lexicographically smallest on ties (one row)."""
    counts = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(label_col, F.struct((-F.col("n")).alias("neg"), F.col(label_col))).alias("majority"))


# ------------------------------------------------------------ margins

def margin_argmax(m) -> Column:
    col = F.col(m) if isinstance(m, str) else m
    return (F.array_position(col, F.array_max(col)) - 1).cast("long")


def softmax_confidence(m) -> Column:
    """M4: max softmax probability over margins (shifted by the max)."""
    col = F.col(m) if isinstance(m, str) else m
    mx = F.array_max(col)
    return 1.0 / F.aggregate(col, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx))


def runner_up_classes(df: DataFrame, id_col: str, m: str, top: int = 3) -> DataFrame:
    """Top-n classes and softmax scores per row (score desc, index asc)."""
    mx = F.array_max(m)
    z = F.aggregate(F.col(m), F.lit(0.0), lambda acc, x: acc + F.exp(x - mx))
    scored = F.transform(m, lambda x, i: F.struct((-F.exp(x - mx) / z).alias("neg"), i.cast("long").alias("cls")))
    s = df.select(id_col, F.array_sort(scored).alias("_s"))
    cols = [id_col]
    for j in range(1, top + 1):
        cols += [F.element_at("_s", j)["cls"].alias(f"top{j}_class"),
                 r4(-F.element_at("_s", j)["neg"]).alias(f"top{j}_score")]
    return s.select(*cols)


# ------------------------------------------------------------ retrieval

def per_query_matches(hits: DataFrame, ref_label: str, query_col: str = "query_id",
                      case_label: str = "case_label") -> DataFrame:
    """Per query: match@1, consistency@3/5 (divided by min(k, n results)), hit@3/5, top-1 sim."""
    match = (F.col(case_label) == F.col(ref_label)).cast("int")
    n = F.count(F.lit(1))
    return hits.groupBy(query_col).agg(
        F.max(F.when(F.col("rank") == 1, match)).alias("m1"),
        (F.sum(F.when(F.col("rank") <= 3, match)) / F.least(F.lit(3), n)).alias("c3"),
        (F.sum(F.when(F.col("rank") <= 5, match)) / F.least(F.lit(5), n)).alias("c5"),
        F.max(F.when(F.col("rank") <= 3, match)).alias("h3"),
        F.max(F.when(F.col("rank") <= 5, match)).alias("h5"),
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("top1_sim"))


def retrieval_metrics(queries: DataFrame, hits: DataFrame, ref_label: str, query_col: str = "query_id",
                      case_label: str = "case_label") -> DataFrame:
    """Averages over *all* queries (no result counts as a miss)."""
    pq = per_query_matches(hits, ref_label, query_col, case_label)
    q = queries.select(query_col).join(pq, query_col, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return q.agg(
        F.count(F.lit(1)).alias("n_queries"),
        r4(F.avg(z("m1"))).alias("consistency_at_1"), r4(F.avg(z("c3"))).alias("consistency_at_3"),
        r4(F.avg(z("c5"))).alias("consistency_at_5"),
        r4(F.avg(z("m1"))).alias("hit_rate_at_1"), r4(F.avg(z("h3"))).alias("hit_rate_at_3"),
        r4(F.avg(z("h5"))).alias("hit_rate_at_5"),
        r4(F.avg("top1_sim")).alias("top1_sim_mean"), r4(F.median("top1_sim")).alias("top1_sim_median"),
        r4(F.min("top1_sim")).alias("top1_sim_min"), r4(F.max("top1_sim")).alias("top1_sim_max"),
        r4(F.stddev_pop("top1_sim")).alias("top1_sim_std"))


def relevance_label(sim) -> Column:
    """T5: threshold relevance (a similarity cut-off, not a human judgement)."""
    s = F.col(sim) if isinstance(sim, str) else sim
    return (F.when(s >= RELEVANT_MIN, "relevant").when(s >= PARTIAL_MIN, "partially_relevant")
             .otherwise("irrelevant"))


def relevance_precision_row(hits: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Row-weighted strict/lenient P@1, P@3; hit@3 = >=1 strict in top 3."""
    lab = hits.withColumn("rel", relevance_label("similarity"))
    strict = (F.col("rel") == "relevant").cast("long")
    lenient = F.col("rel").isin("relevant", "partially_relevant").cast("long")
    r1, r3 = F.col("rank") == 1, F.col("rank") <= 3
    # two-level aggregate: per-query numerators/denominators, then sums of them
    # (row-weighted precision = sum of counts / sum of denominators)
    per_q = lab.groupBy(query_col).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(r1).alias("d1"), F.sum(F.when(r1, strict)).alias("s1"), F.sum(F.when(r1, lenient)).alias("l1"),
        F.count_if(r3).alias("d3"), F.sum(F.when(r3, strict)).alias("s3"), F.sum(F.when(r3, lenient)).alias("l3"),
        F.max(F.when(r3, strict)).alias("hit"))
    ratio = lambda a, b: r4(F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b)), F.lit(0.0)))
    return per_q.agg(
        F.sum("rows").cast("long").alias("n_rows"),
        ratio("s1", "d1").alias("strict_p_at_1"), ratio("s3", "d3").alias("strict_p_at_3"),
        ratio("l1", "d1").alias("lenient_p_at_1"), ratio("l3", "d3").alias("lenient_p_at_3"),
        F.count(F.lit(1)).alias("n_queries"),
        r4(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0))).alias("hit_rate_at_3"))


def relevance_precision_query(hits: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Query-weighted means over the top-3 review rows; hit@3 is lenient here."""
    lab = hits.filter(F.col("rank") <= 3).withColumn("rel", relevance_label("similarity"))
    strict = (F.col("rel") == "relevant").cast("int")
    lenient = F.col("rel").isin("relevant", "partially_relevant").cast("int")
    per_q = lab.groupBy(query_col).agg(
        F.max(F.when(F.col("rank") == 1, lenient)).alias("l1"), F.max(F.when(F.col("rank") == 1, strict)).alias("s1"),
        F.avg(lenient).alias("l3"), F.avg(strict).alias("s3"), F.max(lenient).alias("hit"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return per_q.agg(
        F.count(F.lit(1)).alias("n_queries"),
        r4(F.sum(z("l1")) / F.count(F.lit(1))).alias("precision_at_1"),
        r4(F.sum(z("s1")) / F.count(F.lit(1))).alias("strict_precision_at_1"),
        r4(F.avg("l3")).alias("precision_at_3"), r4(F.avg("s3")).alias("strict_precision_at_3"),
        r4(F.avg("hit")).alias("hit_rate_at_3"))


def retrieval_errors_a(hits: DataFrame, query_col: str = "query_id", ref_label: str = "query_label",
                       case_label: str = "case_label") -> DataFrame:
    """Queries whose top-1 similarity < 0.45 or with no label match in the top 3."""
    pq = hits.groupBy(query_col, ref_label).agg(
        F.max(F.when(F.col("rank") == 1, F.col("case_id"))).alias("top1_case_id"),
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("top1_similarity"),
        F.max(F.when(F.col("rank") == 1, F.col(case_label))).alias("top1_label"),
        F.coalesce(F.max(F.when(F.col("rank") <= 3, F.col(case_label) == F.col(ref_label))), F.lit(False))
         .alias("hit_in_top3"))
    return pq.filter((F.col("top1_similarity") < ERR_A_TOP1_MIN) | ~F.col("hit_in_top3"))


def retrieval_errors_b(hits: DataFrame, query_text: DataFrame, minority: list, query_col: str = "query_id",
                       ref_label: str = "query_label", case_label: str = "case_label") -> DataFrame:
    """Top-1 errors (sim < 0.48, or < 0.58 with a label mismatch), first-match reason."""
    top = hits.filter(F.col("rank") == 1).join(query_text, query_col, "left")
    err = top.filter((F.col("similarity") < ERR_B_SIM_MIN) |
                     ((F.col("similarity") < ERR_B_MISMATCH_SIM_MIN) & (F.col(case_label) != F.col(ref_label))))
    low = F.lower(F.coalesce(F.col("query_text"), F.lit("")))
    slang = F.lit(False)
    for w in SLANG_MARKERS:
        slang = slang | low.contains(w)
    reason = (F.when(word_count(F.coalesce(F.col("query_text"), F.lit(""))) < ERR_B_SHORT_WORDS, "ambiguous_short_query")
               .when(F.col(ref_label).isin(*minority), "minority_intent_sparse_historical_coverage")
               .when(slang, "noisy_twitter_slang").otherwise("cross_domain_lexical_overlap"))
    return err.select(query_col, ref_label, "case_id", "similarity", case_label, reason.alias("failure_reason"))
