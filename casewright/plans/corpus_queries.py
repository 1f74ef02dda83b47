"""Queries for the case-reconstruction ETL (C1 and its parts) and text prep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright.functions.text import clean_for_embedding, truncate
from casewright.operators import corpus as C
from casewright.operators.admission import admit_messages, flag_messages
from casewright.operators.graph import conversation_roots
from casewright.operators.quality import corpus_profile, merge_parts, profile_parts
from casewright.plans.catalog import query
from casewright.plans.oracle_views import norm_sql, strip_sql, with_views
from casewright.session import scratch_dir
from casewright.sources import fixtures as FX
from casewright.sources.tables import read_table

_TS = "try_strptime(created_at, '%a %b %d %H:%M:%S %z %Y')"

SUP_CTE = f"""sup AS (
    SELECT tweet_id, text, created_at, in_response_to_tweet_id, {_TS} AS ts FROM tweets
    WHERE NOT inbound AND author_id = 'support' AND in_response_to_tweet_id IS NOT NULL)"""
MERGED_CTE = f"""merged AS (
    SELECT in_response_to_tweet_id AS customer_tweet_id,
           string_agg(CAST(tweet_id AS VARCHAR), ',' ORDER BY ts ASC NULLS LAST, tweet_id) AS support_tweet_id,
           coalesce(string_agg(NULLIF({strip_sql('text')}, ''), chr(10) ORDER BY ts ASC NULLS LAST, tweet_id), '') AS support_text,
           first(created_at ORDER BY ts ASC NULLS LAST, tweet_id) FILTER (WHERE created_at IS NOT NULL) AS support_created_at
    FROM sup GROUP BY 1)"""
PAIRED_CTE = """paired AS (
    SELECT m.customer_tweet_id, m.support_tweet_id, m.support_text, m.support_created_at,
           c.author_id AS customer_author_id, c.created_at AS customer_created_at, c.text AS customer_text
    FROM merged m JOIN tweets c ON c.inbound AND c.tweet_id = m.customer_tweet_id)"""
ROOTS_CTES = ["""edges AS (
    SELECT tweet_id AS id, max(in_response_to_tweet_id) AS parent FROM tweets
    WHERE in_response_to_tweet_id IS NOT NULL GROUP BY 1)""",
              """walk(start, cur, depth) AS (
    SELECT tweet_id, tweet_id, 0 FROM tweets
    UNION ALL
    SELECT w.start, e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.id = w.cur)""",
              """roots AS (SELECT start AS tweet_id, arg_max(cur, depth) AS conversation_id FROM walk GROUP BY start)"""]


def _leak_filter(id_col: str, text_col: str, golden: str) -> str:
    return (f"{id_col} NOT IN (SELECT tweet_id FROM {golden}) AND NOT coalesce({norm_sql(text_col)} IN "
            f"(SELECT {norm_sql('text')} FROM {golden} WHERE text IS NOT NULL), false)")


CASE_CORPUS_SQL = with_views(["tweets", "tweet_golden"], f"""
SELECT printf('case_%05d', row_number() OVER (ORDER BY customer_tweet_id)) AS case_id,
       customer_tweet_id, support_tweet_id, customer_text, support_text, customer_created_at AS created_at,
       CAST(NULL AS VARCHAR) AS intent, conversation_id, customer_author_id
FROM (
  SELECT *, row_number() OVER (PARTITION BY {norm_sql('customer_text')}
                               ORDER BY length(support_text) DESC, customer_tweet_id) AS rn
  FROM (SELECT p.*, coalesce(r.conversation_id, p.customer_tweet_id) AS conversation_id
        FROM paired p LEFT JOIN roots r ON r.tweet_id = p.customer_tweet_id) x
  WHERE {_leak_filter('customer_tweet_id', 'customer_text', 'tweet_golden')}
    AND customer_text IS NOT NULL AND support_text IS NOT NULL
    AND {strip_sql('customer_text')} <> '' AND {strip_sql('support_text')} <> '') y
WHERE rn = 1""", extra=[SUP_CTE, MERGED_CTE, PAIRED_CTE] + ROOTS_CTES, recursive=True)


@query("case_corpus", "C1 S1 P1 P2 P3 P4 P5 A1 J1 J2 J3 G1 W1 W2", CASE_CORPUS_SQL)
def q_case_corpus(spark, sf_dir):
    return C.build_case_corpus(FX.tweets(spark, sf_dir), FX.tweet_golden(spark, sf_dir), FX.BRAND)


@query("tweet_partition_counts", "S1 P1 P2 P3 A31", with_views(["tweets"], f"""
SELECT count(*) AS raw_tweets,
       count(*) FILTER (WHERE inbound) AS customer_tweets,
       count(*) FILTER (WHERE NOT inbound AND author_id = 'support') AS brand_tweets,
       count(*) FILTER (WHERE NOT inbound AND author_id = 'support' AND in_response_to_tweet_id IS NOT NULL)
         AS brand_replies_with_parent,
       count(*) FILTER (WHERE {_TS} IS NULL) AS unparsed_timestamps,
       count(DISTINCT in_response_to_tweet_id) AS distinct_parents
FROM tweets"""))
def q_tweet_partition_counts(spark, sf_dir):
    return C.tweet_partition_counts(FX.tweets(spark, sf_dir), FX.BRAND)


@query("merge_multipart_replies", "P3 A1 W8", with_views(["tweets"], """
SELECT customer_tweet_id, support_tweet_id, support_text, support_created_at FROM merged""",
                                                           extra=[SUP_CTE, MERGED_CTE]))
def q_merge(spark, sf_dir):
    return C.merge_multipart_replies(C.brand_replies(FX.tweets(spark, sf_dir), FX.BRAND))


@query("conversation_roots", "G1", with_views(["tweets"], "SELECT tweet_id, conversation_id FROM roots",
                                               extra=ROOTS_CTES, recursive=True))
def q_roots(spark, sf_dir):
    return conversation_roots(FX.tweets(spark, sf_dir))


@query("pair_cases", "J1 J2", with_views(["tweets"], """
SELECT p.customer_tweet_id, p.support_tweet_id, p.customer_author_id, p.customer_text,
       coalesce(r.conversation_id, p.customer_tweet_id) AS conversation_id
FROM paired p LEFT JOIN roots r ON r.tweet_id = p.customer_tweet_id""",
                                         extra=[SUP_CTE, MERGED_CTE, PAIRED_CTE] + ROOTS_CTES, recursive=True))
def q_pair(spark, sf_dir):
    tw = FX.tweets(spark, sf_dir)
    paired = C.pair_cases(C.merge_multipart_replies(C.brand_replies(tw, FX.BRAND)), C.customer_tweets(tw))
    roots = conversation_roots(tw).withColumnRenamed("tweet_id", "customer_tweet_id")
    return (paired.join(roots, "customer_tweet_id", "left")
                  .select("customer_tweet_id", "support_tweet_id", "customer_author_id", "customer_text",
                          F.coalesce("conversation_id", "customer_tweet_id").alias("conversation_id")))


@query("leakage_exclusion", "J3", with_views(["docs_cases", "docs_golden"], f"""
SELECT customer_tweet_id, customer_text, support_text FROM docs_cases
WHERE {_leak_filter('customer_tweet_id', 'customer_text', 'docs_golden')}"""))
def q_leakage_exclusion(spark, sf_dir):
    return C.exclude_leakage(FX.docs_cases(spark, sf_dir), FX.docs_golden(spark, sf_dir))


@query("leakage_check", "J4 U2", with_views(["docs_cases", "docs_golden"], f"""
SELECT 'id' AS match_kind, CAST(tweet_id AS VARCHAR) AS match_key FROM
  (SELECT customer_tweet_id AS tweet_id FROM docs_cases INTERSECT SELECT tweet_id FROM docs_golden)
UNION ALL
SELECT 'text' AS match_kind, k AS match_key FROM
  (SELECT {norm_sql('customer_text')} AS k FROM docs_cases INTERSECT SELECT {norm_sql('text')} FROM docs_golden)"""))
def q_leakage_check(spark, sf_dir):
    return C.leakage_overlap(FX.docs_cases(spark, sf_dir), FX.docs_golden(spark, sf_dir))


@query("dedup_longest_reply", "P5 W1", with_views(["docs_cases"], f"""
SELECT customer_tweet_id, customer_text, support_text FROM (
  SELECT *, row_number() OVER (PARTITION BY {norm_sql('customer_text')}
                               ORDER BY length(support_text) DESC, customer_tweet_id) AS rn
  FROM docs_cases) t WHERE rn = 1"""))
def q_dedup(spark, sf_dir):
    return C.dedup_longest_reply(FX.docs_cases(spark, sf_dir))


# The entities that DuckDB's side decodes (it has no function for the whole table;
# &amp; last so that "&amp;lt;" decodes once). Tests compare the whole table with Python's.
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")]


def _clean_sql(expr: str) -> str:
    from casewright.functions.text import NON_WS, WORD, WS
    s = f"coalesce({expr}, '')"
    for ent, ch in HTML_ENTITIES:
        s = f"replace({s}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    s = f"regexp_replace({s}, 'https?://{NON_WS}+', '', 'g')"
    s = f"regexp_replace({s}, '@{WORD}+', '', 'g')"
    s = f"regexp_replace({s}, '{WS}+', ' ', 'g')"
    return strip_sql(s)


@query("clean_text", "P6 P10", f"""
SELECT doc_id, {_clean_sql('text')} AS clean_text,
       length({_clean_sql('text')}) AS clean_chars,
       CASE WHEN length(text) > 350 THEN substr(text, 1, 347) || '...' ELSE text END AS preview
FROM documents""")
def q_clean_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    cleaned = clean_for_embedding("text")
    return d.select("doc_id", cleaned.alias("clean_text"), F.length(cleaned).cast("long").alias("clean_chars"),
                    truncate("text", 350).alias("preview"))


@query("admission_filter", "P7", with_views(["messages"], f"""
SELECT msg_id, {strip_sql('text')} AS message,
       {strip_sql('text')} <> '' AND length({strip_sql('text')}) <= 2000 AS accepted,
       CASE WHEN {strip_sql('text')} = '' THEN 'empty'
            WHEN length({strip_sql('text')}) > 2000 THEN 'too_long' END AS reject_reason
FROM messages"""))
def q_admission(spark, sf_dir):
    return admit_messages(FX.messages(spark, sf_dir), "msg_id", "text")


@query("admission_limits", "P7", with_views(["messages"], f"""
SELECT msg_id, top_k, reject_reason IS NULL AS accepted, reject_reason FROM (
  SELECT msg_id, top_k, CASE WHEN strip = '' THEN 'empty' WHEN length(strip) > 2000 THEN 'too_long' WHEN top_k < 1 OR top_k > 10 THEN 'bad_top_k' END AS reject_reason
  FROM (SELECT msg_id, CAST(msg_id % 13 AS INTEGER) AS top_k, {strip_sql("coalesce(text, '')")} AS strip FROM messages))"""))
def q_admission_limits(spark, sf_dir):
    """Admission with the requested number of cases, which must lie within its limits."""
    asked = FX.messages(spark, sf_dir).withColumn("top_k", (F.col("msg_id") % 13).cast("int"))
    return flag_messages(asked, "text", "top_k").select("msg_id", "top_k", "accepted", "reject_reason")


@query("profile_parts", "A3", with_views(["docs_cases"], f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE customer_text IS NULL) AS null_customer_text,
       count(*) FILTER (WHERE support_text IS NULL) AS null_support_text, true AS ids_close, true AS texts_close, true AS replies_close
FROM docs_cases"""))
def q_profile_parts(spark, sf_dir):
    """Profiles of seven parts, stored and merged; their distinct counts are within 3 % of the exact ones."""
    cases = FX.docs_cases(spark, sf_dir)
    path = f"{scratch_dir(spark, 'profile')}-{uuid.uuid4().hex}"
    profile_parts(cases, F.col("customer_tweet_id") % 7).write.parquet(path)
    exact = corpus_profile(cases).select(*[F.col(c).alias(f"exact_{c}") for c in ("distinct_customer_ids", "distinct_customer_texts", "distinct_replies")])
    both = merge_parts(spark.read.parquet(path)).unionByName(exact, allowMissingColumns=True)     # one row each
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    close = lambda c: F.abs(F.col(c) - F.col(f"exact_{c}")) <= 0.03 * F.col(f"exact_{c}")
    return both.select("n_rows", "null_customer_text", "null_support_text", close("distinct_customer_ids").alias("ids_close"),
                       close("distinct_customer_texts").alias("texts_close"), close("distinct_replies").alias("replies_close"))


@query("corpus_profile", "S3 A3 A5", with_views(["docs_cases"], f"""
SELECT count(*) AS n_rows,
       count(DISTINCT customer_tweet_id) AS distinct_customer_ids,
       count(DISTINCT {norm_sql('customer_text')}) AS distinct_customer_texts,
       count(DISTINCT support_text) AS distinct_replies,
       count(*) FILTER (WHERE customer_text IS NULL) AS null_customer_text,
       count(*) FILTER (WHERE support_text IS NULL) AS null_support_text,
       count(*) FILTER (WHERE customer_text IS NOT NULL AND {strip_sql('customer_text')} = '') AS blank_customer_text,
       count(*) FILTER (WHERE support_text IS NOT NULL AND {strip_sql('support_text')} = '') AS blank_support_text
FROM docs_cases"""))
def q_corpus_profile(spark, sf_dir):
    return corpus_profile(FX.docs_cases(spark, sf_dir))


ETL_AUDIT_SQL = with_views(["tweets", "tweet_golden"], f"""
SELECT '1_raw_tweets' AS stage, count(*) AS n FROM tweets
UNION ALL SELECT '2_customer_tweets', count(*) FROM tweets WHERE inbound
UNION ALL SELECT '3_brand_tweets', count(*) FROM tweets WHERE NOT inbound AND author_id = 'support'
UNION ALL SELECT '4_pairs', count(*) FROM paired
UNION ALL SELECT '5_after_leakage', count(*) FROM lf
UNION ALL SELECT '6_after_quarantine', count(*) FROM kept
UNION ALL SELECT '7_final_cases', count(DISTINCT {norm_sql('customer_text')}) FROM kept""",
    extra=[SUP_CTE, MERGED_CTE, PAIRED_CTE,
           f"lf AS (SELECT * FROM paired WHERE {_leak_filter('customer_tweet_id', 'customer_text', 'tweet_golden')})",
           f"""kept AS (SELECT * FROM lf WHERE customer_text IS NOT NULL AND support_text IS NOT NULL
                AND {strip_sql('customer_text')} <> '' AND {strip_sql('support_text')} <> '')"""])


@query("etl_audit", "A31 C1", ETL_AUDIT_SQL)
def q_etl_audit(spark, sf_dir):
    return C.etl_audit(FX.tweets(spark, sf_dir), FX.tweet_golden(spark, sf_dir), FX.BRAND)


@query("etl_run_audit", "A31 C1", ETL_AUDIT_SQL)
def q_etl_run_audit(spark, sf_dir):
    """The same counters, reported by the stages of one build of the corpus."""
    audit = C.RunAudit()
    cases = C.build_case_corpus(FX.tweets(spark, sf_dir), FX.tweet_golden(spark, sf_dir), FX.BRAND, audit=audit)
    cases.write.format("noop").mode("overwrite").save()
    return audit.rows(spark)
