"""Queries for batch assist (C2), streaming assist (X1), running stats (X2) and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright.operators import knn as K
from casewright.operators import quality as Q
from casewright.plans.catalog import query
from casewright.plans.corpus_queries import q_dedup
from casewright.plans.oracle_views import norm_sql, strip_sql, with_views
from casewright.plans.policy_queries import decisions_cte, flags_cte
from casewright.plans.reply_queries import DRAFT_CTES, message_evidence
from casewright.plans.policy_queries import POLICY_CTES
from casewright.session import scratch_dir
from casewright.sources import fixtures as FX
from casewright.sources import sinks as S
from casewright.sources.tables import read_table
from casewright.streaming import assist_stream as X
from casewright.streaming import message_stream as MS
from casewright.operators import policy as P

ASSIST_COLS = ["msg_id", "predicted_intent", "intent_confidence", "top_similarity", "evidence_count",
               "evidence_case_ids", "grounding_status", "decision", "risk_level", "primary_rule"]

ASSIST_CTES = DRAFT_CTES + [
    """asrc AS (SELECT f.msg_id, f.text, f.predicted_intent, s.intent_confidence, f.top_similarity AS top_retrieval_similarity,
        coalesce(e.n_cases, 0) AS evidence_count, f.grounding_status, f.reply AS reply_text, f.evidence_case_ids
      FROM final_drafts f JOIN signals s ON s.msg_id = f.msg_id LEFT JOIN evagg e ON e.msg_id = f.msg_id)""",
    flags_cte("asrc", P.PolicyConfig())] + decisions_cte()


@query("assist_batch", "C2 P11", with_views(["vec_queries", "vec_corpus", "signals"], """
SELECT msg_id, predicted_intent, round(intent_confidence, 4) AS intent_confidence,
       round(top_retrieval_similarity, 4) AS top_similarity, CAST(evidence_count AS BIGINT) AS evidence_count,
       evidence_case_ids, grounding_status, decision, risk_level, primary_rule FROM decisions""", extra=ASSIST_CTES))
def q_assist_batch(spark, sf_dir):
    s = FX.signals(spark, sf_dir).select("msg_id", "text", "predicted_intent", "intent_confidence", "human_decision")
    return X.assist_batch(s, message_evidence(spark, sf_dir))


def _evidence_for(spark, sf_dir):
    """Per micro-batch retrieval: the batch's own vectors against the static corpus."""
    corpus = FX.vec_corpus(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")

    def fn(batch):
        q = batch.select(F.col("msg_id").alias("query_id")).join(
            FX.vec_queries(spark, sf_dir).select("query_id", "embedding"), "query_id")
        hits = K.knn_topk(q, corpus, 5, exclude_self=True)
        h = hits.join(docs.select(F.col("doc_id").alias("case_id"), F.col("text").alias("t")), "case_id", "left")
        case = F.struct(F.col("rank"), F.format_string("case_%05d", F.col("case_id")).alias("case_id"),
                        "similarity", F.col("t").alias("customer_text"), F.col("t").alias("support_text"))
        g = h.groupBy(F.col("query_id").alias("msg_id")).agg(F.array_sort(F.collect_list(case)).alias("_c"))
        return g.select("msg_id", F.transform("_c", lambda c: c.dropFields("rank")).alias("cases"))
    return fn


SIGNAL_SCHEMA = ("msg_id long, text string, predicted_intent string, intent_confidence double, "
                 "top_retrieval_similarity double, evidence_count int, grounding_status string, reply_text string, "
                 "human_decision string")


@query("stream_assist", "X1 P7", with_views(["vec_queries", "vec_corpus", "signals"], f"""
SELECT msg_id, predicted_intent, round(intent_confidence, 4) AS intent_confidence,
       round(top_retrieval_similarity, 4) AS top_similarity, CAST(evidence_count AS BIGINT) AS evidence_count,
       evidence_case_ids, grounding_status, decision, risk_level, primary_rule FROM decisions
WHERE msg_id IN (SELECT msg_id FROM messages WHERE {strip_sql('text')} <> '' AND length({strip_sql('text')}) <= 2000)""", extra=ASSIST_CTES))
def q_stream_assist(spark, sf_dir):
    base = scratch_dir(spark, f"stream-assist-{uuid.uuid4().hex}")
    src = FX.signals(spark, sf_dir).select(*[c.split()[0] for c in SIGNAL_SCHEMA.split(", ")])
    each = X.stage_files(src, f"{base}/in", 4)
    X.run_assist_stream(spark, f"{base}/in", SIGNAL_SCHEMA, _evidence_for(spark, sf_dir), f"{base}/out",
                        f"{base}/errors", f"{base}/ckpt", each)
    return spark.read.parquet(f"{base}/out").select(*ASSIST_COLS)


@query("stream_stats", "X2", with_views(["signals"], """
SELECT count(*) AS analysed, count(*) FILTER (WHERE decision = 'auto_handle') AS auto_handled,
       count(*) FILTER (WHERE decision = 'escalate') AS escalated, round(avg(intent_confidence), 4) AS mean_confidence
FROM decisions""", extra=POLICY_CTES))
def q_stream_stats(spark, sf_dir):
    base = scratch_dir(spark, f"stream-stats-{uuid.uuid4().hex}")
    src = FX.signals(spark, sf_dir).select(*[c.split()[0] for c in SIGNAL_SCHEMA.split(", ")])
    each = X.stage_files(src, f"{base}/in", 4)
    X.run_stats_stream(spark, f"{base}/in", SIGNAL_SCHEMA, f"{base}/out", f"{base}/ckpt", each)
    return spark.read.parquet(f"{base}/out").select("analysed", "auto_handled", "escalated", "mean_confidence")


@query("csv_roundtrip", "S1 S2 S6 S7", with_views(["tweets", "labelled_docs"], """
SELECT 'tweets' AS source, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT text) AS n_texts FROM tweets
UNION ALL SELECT 'golden', count(*), CAST(sum(length(text)) AS BIGINT), count(DISTINCT text) FROM labelled_docs
UNION ALL SELECT 'metrics', 5, NULL, 5
UNION ALL SELECT 'report', 4, NULL, 4"""))
def q_csv_roundtrip(spark, sf_dir):
    """Raw tweets, golden set, a metric table and the JSON report written and read back; the counts
    are of what was read."""
    base = scratch_dir(spark, f"csv-{uuid.uuid4().hex}")
    tweets = FX.tweets(spark, sf_dir).withColumn("response_tweet_id", F.lit(None).cast("string"))
    S.write_csv(tweets.select(*[c.split()[0] for c in S.TWEET_SCHEMA.split(", ")]), f"{base}/tweets")
    golden = FX.labelled_docs(spark, sf_dir)
    S.write_csv(golden.select("tweet_id", "text", "intent", F.lit(None).cast("string").alias("notes")), f"{base}/golden")
    dist = Q.class_distribution(golden, FX.taxonomy(spark))
    S.write_metrics_csv(dist, f"{base}/metrics")
    S.write_json_report(Q.report_json(Q.golden_report(golden, FX.taxonomy(spark)), dist, Q.golden_offenders(golden, FX.taxonomy(spark))), f"{base}/report")

    def counted(df, name, text, chars=True):
        return df.agg(F.count(F.lit(1)).alias("n_rows"), (F.sum(F.length(text)) if chars else F.max(F.lit(None).cast("long"))).cast("long").alias("n_chars"),
                      F.countDistinct(text).alias("n_texts")).select(F.lit(name).alias("source"), "n_rows", "n_chars", "n_texts")
    return (counted(S.read_tweets_csv(spark, f"{base}/tweets"), "tweets", "text")
            .unionByName(counted(S.read_golden_csv(spark, f"{base}/golden"), "golden", "text"))
            .unionByName(counted(spark.read.options(**S.CSV_OPTIONS).csv(f"{base}/metrics"), "metrics", "intent", chars=False))
            .unionByName(counted(spark.read.json(f"{base}/report"), "report", "section", chars=False)))


@query("sink_roundtrip", "S5 S4", with_views(["docs_cases"], f"""
SELECT customer_tweet_id, customer_text, support_text FROM (
  SELECT *, row_number() OVER (PARTITION BY {norm_sql('customer_text')}
                               ORDER BY length(support_text) DESC, customer_tweet_id) AS rn
  FROM docs_cases) t WHERE rn = 1"""))
def q_sink_roundtrip(spark, sf_dir):
    """Write the deduplicated corpus as Parquet and as quoted multi-line CSV,
    read the CSV back with an explicit schema, check counts agree."""
    base = scratch_dir(spark, f"sinks-{uuid.uuid4().hex}")
    cases = q_dedup(spark, sf_dir)
    S.write_cases(cases, f"{base}/cases.parquet", f"{base}/cases.csv")
    back = S.read_cases_csv(spark, f"{base}/cases.csv", S.DOC_CASE_SCHEMA)
    S.assert_same_count(spark.read.parquet(f"{base}/cases.parquet"), back)
    return back


# --- arriving events: replays, bad lines, sessions -------------------------------------------

def event_columns(df):
    """session_id and event_time (over two days) of messages, by their id."""
    seconds = F.lit(1_704_067_200) + F.pmod(F.col("msg_id") * 97, F.lit(172_800))
    return df.withColumns({"session_id": F.floor(F.col("msg_id") / 20).cast("long"), "event_time": F.timestamp_seconds(seconds)})


def message_lines(messages):
    """JSON lines of the messages, every ninth twice; every fiftieth has a cut copy, every seventieth one without an id."""
    whole = event_columns(messages).select("msg_id", F.to_json(F.struct("msg_id", "session_id", "event_time", "text")).alias("value"))
    cut = whole.where("msg_id % 50 = 0").select("msg_id", F.substring("value", 1, 14).alias("value"))
    no_id = whole.where("msg_id % 70 = 0").select("msg_id", F.lit('{"event_time":"2024-01-01T00:00:00.000Z","text":"who am I"}').alias("value"))
    return whole.union(whole.where("msg_id % 9 = 0")).union(cut).union(no_id).select("value")


EVENT_RESULT = "msg_id long, decision string, primary_rule string"


@query("stream_replays", "X1 P7", with_views(["signals"], """
SELECT a.msg_id, coalesce(a.reason, d.decision) AS outcome, CASE WHEN a.reason IS NULL THEN d.primary_rule END AS primary_rule
FROM admitted a JOIN decisions d ON d.msg_id = a.msg_id
UNION ALL SELECT NULL, 'malformed', NULL FROM messages WHERE msg_id % 50 = 0
UNION ALL SELECT NULL, 'no msg_id', NULL FROM messages WHERE msg_id % 70 = 0""", extra=POLICY_CTES + [f"""admitted AS (
  SELECT msg_id, CASE WHEN {strip_sql("coalesce(text, '')")} = '' THEN 'empty' WHEN length({strip_sql('text')}) > 2000 THEN 'too_long' END AS reason
  FROM messages)"""]))
def q_stream_replays(spark, sf_dir):
    """Messages as arriving lines, some repeated and some broken: every message is decided once, every bad line is reported."""
    base = scratch_dir(spark, f"stream-replays-{uuid.uuid4().hex}")
    lines = message_lines(FX.messages(spark, sf_dir))
    each = X.files_per_arrival(lines, 4, "value")
    lines.repartition(4 * each).write.text(f"{base}/in")
    signals = FX.signals(spark, sf_dir).drop("text")
    MS.run_messages(spark, f"{base}/in", lambda b: P.decide(b.join(signals, "msg_id")).select("msg_id", "decision", "primary_rule"),
                    f"{base}/out", f"{base}/errors", f"{base}/ckpt", delay="3 days", files_per_batch=2 * each)
    done = MS.results(spark, f"{base}/out", EVENT_RESULT).select("msg_id", F.col("decision").alias("outcome"), "primary_rule")
    errors = MS.results(spark, f"{base}/errors", MS.ERRORS)
    return done.unionByName(errors.select(F.when(F.col("line").isNull(), F.col("msg_id")).alias("msg_id"), F.col("reason").alias("outcome"),
                                          F.lit(None).cast("string").alias("primary_rule")))


@query("session_stats", "X2 P3", with_views(["signals"], """
SELECT strftime(TIMESTAMP '2024-01-01' + to_days(CAST((msg_id * 97 % 172800) // 86400 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS day,
       msg_id // 20 AS session_id, count(*) AS analysed, count(*) FILTER (WHERE decision = 'auto_handle') AS auto_handled,
       count(*) FILTER (WHERE decision = 'escalate') AS escalated,
       round(CAST(sum(round(intent_confidence * 10000)) AS DOUBLE) / count(*) / 10000, 4) AS mean_confidence
FROM decisions GROUP BY ALL""", extra=POLICY_CTES))
def q_session_stats(spark, sf_dir):
    """Running statistics per session from files of decided messages, as the last upserted version."""
    base = scratch_dir(spark, f"session-stats-{uuid.uuid4().hex}")
    columns = [c.split()[0] for c in SIGNAL_SCHEMA.split(", ")]
    each = X.stage_files(event_columns(FX.signals(spark, sf_dir).select(*columns)), f"{base}/in", 3)
    MS.run_session_stats(spark, f"{base}/in", f"{SIGNAL_SCHEMA}, session_id long, event_time timestamp", f"{base}/out", f"{base}/ckpt",
                         files_per_batch=each)
    return MS.latest(spark, f"{base}/out").withColumn("day", F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
