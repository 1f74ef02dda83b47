"""Queries for labelled-set validation, distributions, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import quality as Q
from casewright.plans.catalog import query
from casewright.plans.oracle_views import norm_sql, strip_sql, with_views
from casewright.sources import fixtures as FX

_H = "md5(CAST(tweet_id AS VARCHAR) || ':2026')"


def _blank(c: str) -> str:
    return f"({c} IS NULL OR {strip_sql(c)} = '')"


@query("class_distribution", "A2 J10", with_views(["labelled_docs", "taxonomy"], """
SELECT t.ord, t.intent, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
       CASE WHEN n.n > 0 THEN round(coalesce(c.cnt, 0) * CAST(100 AS DOUBLE) / n.n, 2) ELSE CAST(0 AS DOUBLE) END
         AS percentage
FROM taxonomy t LEFT JOIN c ON c.intent = t.intent CROSS JOIN n""", extra=[
    "c AS (SELECT intent, count(*) AS cnt FROM labelled_docs WHERE intent IS NOT NULL GROUP BY 1)",
    "n AS (SELECT count(*) AS n FROM labelled_docs)"]))
def q_class_distribution(spark, sf_dir):
    return Q.class_distribution(FX.labelled_docs(spark, sf_dir), FX.taxonomy(spark))


_DUP_CTES = [
    "dup_ids AS (SELECT tweet_id, count(*) AS group_size FROM labelled_docs GROUP BY 1 HAVING count(*) > 1)",
    "keyed AS (SELECT tweet_id, " + norm_sql("text") + " AS k FROM labelled_docs WHERE text IS NOT NULL)",
    "dup_txt AS (SELECT k, count(*) AS group_size FROM keyed GROUP BY 1 HAVING count(*) > 1)",
    """dups AS (
    SELECT 'tweet_id' AS dup_kind, l.tweet_id, d.group_size FROM labelled_docs l JOIN dup_ids d ON d.tweet_id = l.tweet_id
    UNION ALL
    SELECT 'text' AS dup_kind, k.tweet_id, d.group_size FROM keyed k JOIN dup_txt d ON d.k = k.k)"""]


@query("duplicate_rows", "A4", with_views(["labelled_docs"], "SELECT dup_kind, tweet_id, group_size FROM dups",
                                          extra=_DUP_CTES))
def q_duplicate_rows(spark, sf_dir):
    return Q.duplicate_rows(FX.labelled_docs(spark, sf_dir))


_OFFENDERS = f"""offenders AS (
    SELECT 'empty_text' AS "check", tweet_id, NULL AS value FROM labelled_docs WHERE {_blank('text')}
    UNION ALL SELECT 'empty_intent', tweet_id, NULL FROM labelled_docs WHERE {_blank('intent')}
    UNION ALL SELECT 'taxonomy_membership', tweet_id, intent FROM labelled_docs WHERE intent NOT IN (SELECT intent FROM taxonomy)
    UNION ALL SELECT CASE dup_kind WHEN 'text' THEN 'duplicate_texts' ELSE 'duplicate_tweet_ids' END, tweet_id, NULL FROM dups)"""

_REPORT = [_OFFENDERS, f"""agg AS (
    SELECT count(*) AS row_count, count(*) FILTER (WHERE {_blank('text')}) AS empty_text,
           count(*) FILTER (WHERE {_blank('intent')}) AS empty_intent, count(DISTINCT intent) AS classes_represented
    FROM labelled_docs)""", """wrong AS (
    SELECT count(*) FILTER (WHERE "check" = 'duplicate_tweet_ids') AS duplicate_id_rows,
           count(*) FILTER (WHERE "check" = 'duplicate_texts') AS duplicate_text_rows,
           count(DISTINCT value) AS invalid_classes FROM offenders)""", """found AS (
    SELECT *, list_filter([CASE WHEN row_count <> 200 THEN 'Expected 200 rows, found ' || row_count END,
        CASE WHEN empty_text > 0 THEN 'Found ' || empty_text || ' empty or null text entries' END,
        CASE WHEN empty_intent > 0 THEN 'Found ' || empty_intent || ' empty or null intent entries' END,
        CASE WHEN invalid_classes > 0 THEN 'Found ' || invalid_classes || ' invalid intent labels not in taxonomy' END,
        CASE WHEN duplicate_id_rows > 0 THEN 'Found ' || duplicate_id_rows || ' duplicate tweet_id rows' END,
        CASE WHEN duplicate_text_rows > 0 THEN 'Found ' || duplicate_text_rows || ' duplicate or identical text messages' END],
      lambda x: x IS NOT NULL) AS found FROM agg, wrong)""", """report AS (
    SELECT CASE WHEN len(found) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, CAST(len(found) AS BIGINT) AS total_issues,
           array_to_string(found, '; ') AS issues, '' AS missing_columns, row_count, CAST(200 AS BIGINT) AS expected_rows,
           empty_text, empty_intent, classes_represented, invalid_classes, duplicate_id_rows, duplicate_text_rows,
           'labelled documents' AS dataset_source, row_count AS total_examples FROM found)"""]


@query("golden_report", "A4 A5 A6 A7", with_views(["labelled_docs", "taxonomy"], "SELECT * FROM report", extra=_DUP_CTES + _REPORT))
def q_golden_report(spark, sf_dir):
    return Q.golden_report(FX.labelled_docs(spark, sf_dir), FX.taxonomy(spark))


@query("golden_offenders", "A4 A5 A6", with_views(["labelled_docs", "taxonomy"], "SELECT * FROM offenders", extra=_DUP_CTES + [_OFFENDERS]))
def q_golden_offenders(spark, sf_dir):
    return Q.golden_offenders(FX.labelled_docs(spark, sf_dir), FX.taxonomy(spark))


@query("golden_report_json", "S7 A7", with_views(["labelled_docs", "taxonomy"], """
SELECT 'checks' AS section, CAST(to_json(r) AS VARCHAR) AS body FROM report r
UNION ALL SELECT 'invalid_classes', CAST(to_json(coalesce(list(DISTINCT value ORDER BY value) FILTER (WHERE value IS NOT NULL), [])) AS VARCHAR) FROM offenders
UNION ALL SELECT 'duplicate_sample_ids', CAST(to_json(coalesce(list(tweet_id ORDER BY tweet_id), [])) AS VARCHAR)
  FROM (SELECT tweet_id FROM offenders WHERE "check" = 'duplicate_texts' ORDER BY tweet_id LIMIT 5) t
UNION ALL SELECT 'class_distribution', CAST(to_json(list({'intent': intent, 'count': n, 'percentage': p} ORDER BY ord)) AS VARCHAR)
  FROM (SELECT t.ord, t.intent, count(l.tweet_id) AS n, round(count(l.tweet_id) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM labelled_docs), 2) AS p
        FROM taxonomy t LEFT JOIN labelled_docs l ON l.intent = t.intent GROUP BY ALL) d""", extra=_DUP_CTES + _REPORT))
def q_golden_report_json(spark, sf_dir):
    d, t = FX.labelled_docs(spark, sf_dir), FX.taxonomy(spark)
    return Q.report_json(Q.golden_report(d, t), Q.class_distribution(d, t), Q.golden_offenders(d, t))


@query("label_disagreements", "A28", with_views(["label_review"], """
SELECT tweet_id, candidate_intent, human_verified_intent FROM label_review
WHERE candidate_intent IS DISTINCT FROM human_verified_intent"""))
def q_label_disagreements(spark, sf_dir):
    return Q.label_disagreements(FX.label_review(spark, sf_dir))


@query("label_review_agreement", "A28", with_views(["label_review"], """
SELECT coalesce(a.intent, b.intent) AS intent, coalesce(a.candidate_count, 0) AS candidate_count,
       coalesce(b.verified_count, 0) AS verified_count, coalesce(a.changed_from, 0) AS disagreements,
       round(sum(coalesce(a.agreed, 0)) OVER () / sum(coalesce(a.candidate_count, 0)) OVER (), 4) AS agreement_rate
FROM a FULL OUTER JOIN b ON a.intent = b.intent""", extra=[
    """a AS (SELECT candidate_intent AS intent, count(*) AS candidate_count,
           count(*) FILTER (WHERE candidate_intent = human_verified_intent) AS agreed,
           count(*) FILTER (WHERE candidate_intent <> human_verified_intent) AS changed_from
    FROM label_review GROUP BY 1)""",
    "b AS (SELECT human_verified_intent AS intent, count(*) AS verified_count FROM label_review GROUP BY 1)"]))
def q_label_review(spark, sf_dir):
    return Q.label_review_agreement(FX.label_review(spark, sf_dir))


SPLIT_CTES = [
    "counts AS (SELECT intent, count(*) AS n_c FROM labelled_docs WHERE intent IS NOT NULL GROUP BY 1)",
    "tot AS (SELECT sum(n_c) AS N, (sum(n_c) * 25 + 99) // 100 AS nt FROM counts)",
    "q0 AS (SELECT c.intent, (c.n_c * t.nt) // t.N AS base, (c.n_c * t.nt) % t.N AS rem, t.nt FROM counts c CROSS JOIN tot t)",
    """q1 AS (SELECT intent, base, nt - sum(base) OVER () AS left_,
           row_number() OVER (ORDER BY rem DESC, intent) AS r FROM q0)""",
    "quota AS (SELECT intent, base + CASE WHEN r <= left_ THEN 1 ELSE 0 END AS quota FROM q1)",
    f"""ranked AS (SELECT tweet_id, intent, text,
           row_number() OVER (PARTITION BY intent ORDER BY {_H}, tweet_id) AS rn FROM labelled_docs)""",
    """split AS (SELECT r.tweet_id, r.intent, r.text,
           CASE WHEN r.rn <= q.quota THEN 'test' ELSE 'train' END AS split
    FROM ranked r LEFT JOIN quota q ON q.intent = r.intent)"""]


@query("stratified_split", "W5", with_views(["labelled_docs"], "SELECT tweet_id, intent, split FROM split",
                                            extra=SPLIT_CTES))
def q_split(spark, sf_dir):
    return Q.stratified_split(FX.labelled_docs(spark, sf_dir)).select("tweet_id", "intent", "split")


@query("quota_sample", "W6 J6 U1", with_views(["labelled_docs"], """
SELECT tweet_id, intent FROM (
  SELECT tweet_id, intent, row_number() OVER (ORDER BY h, tweet_id) AS fr FROM (
    SELECT tweet_id, intent, h FROM first
    UNION ALL
    SELECT tweet_id, intent, h FROM rest WHERE rk <= 30 - (SELECT count(*) FROM first)) u) v
WHERE fr <= 30""", extra=[
    f"h AS (SELECT tweet_id, intent, {_H} AS h FROM labelled_docs WHERE intent IS NOT NULL)",
    "per AS (SELECT greatest(1, 30 // count(DISTINCT intent)) AS per FROM labelled_docs WHERE intent IS NOT NULL)",
    """first AS (SELECT tweet_id, intent, h FROM (
        SELECT *, row_number() OVER (PARTITION BY intent ORDER BY h, tweet_id) AS rn FROM h) x
      WHERE rn <= (SELECT per FROM per))""",
    """rest AS (SELECT tweet_id, intent, h, row_number() OVER (ORDER BY h, tweet_id) AS rk
      FROM h WHERE tweet_id NOT IN (SELECT tweet_id FROM first))"""]))
def q_quota_sample(spark, sf_dir):
    d = FX.labelled_docs(spark, sf_dir).filter(F.col("intent").isNotNull())
    return Q.quota_sample(d, 30).select("tweet_id", "intent")


@query("proportional_sample", "W7", with_views(["labelled_docs"], """
SELECT tweet_id, intent FROM (
  SELECT tweet_id, intent, row_number() OVER (ORDER BY h, tweet_id) AS fr FROM (
    SELECT p.tweet_id, p.intent, p.h FROM (
      SELECT *, row_number() OVER (PARTITION BY intent ORDER BY h, tweet_id) AS rn FROM h) p
    JOIN quota q ON q.intent = p.intent WHERE p.rn <= q.quota) u) v
WHERE fr <= 40""", extra=[
    f"h AS (SELECT tweet_id, intent, {_H} AS h FROM labelled_docs)",
    "c AS (SELECT intent, count(*) AS n_c FROM labelled_docs GROUP BY 1)",
    "quota AS (SELECT intent, least(n_c, greatest(2, (40 * n_c) // sum(n_c) OVER ())) AS quota FROM c)"]))
def q_proportional_sample(spark, sf_dir):
    return Q.proportional_sample(FX.labelled_docs(spark, sf_dir), 40).select("tweet_id", "intent")
