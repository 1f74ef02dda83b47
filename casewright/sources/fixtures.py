"""Derived input views built by Spark from the driver tables.

Each view re-shapes whole driver tables into the inputs the support-case
operators expect (raw tweets, labelled sets, policy signals, vectors,
ratings, judge rows). Nothing here filters rows to keep a check cheap:
labelled/golden sets are defined by data relationships (rows that carry a
label, conversations opened by a system turn), and the query side of the
vector search is the whole embeddings table (leave-one-out).
The DuckDB twins of these views live in ``casewright.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.sources.tables import read_table

# Fixed value: author id of the brand account in the tweets view.
BRAND = "support"


def _lpad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations re-shaped as a raw tweet table.

    Assistant turns are split on newlines into multi-part replies; every
    turn replies to part 0 of the previous turn.
    """
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    single = (conv.filter(F.col("role") != "assistant")
                  .select("conv_id", "turn", "role", "text", F.lit(0).alias("part")))
    multi = (conv.filter(F.col("role") == "assistant")
                 .select("conv_id", "turn", "role",
                         F.posexplode(F.split(F.col("text"), "\n", -1)).alias("part", "text"))
                 .select("conv_id", "turn", "role", "text", "part"))
    parts = single.unionByName(multi)
    turn_key = F.col("conv_id") * 100 + F.col("turn")
    part = F.col("part").cast("long")
    return parts.select(
        ((turn_key * 1000) + part).alias("tweet_id"),
        F.when(F.col("role") == "assistant", F.lit(BRAND))
         .when(F.col("role") == "system", F.lit("system"))
         .otherwise(F.concat(F.lit("u"), F.col("conv_id").cast("string"))).alias("author_id"),
        (F.col("role") == "user").alias("inbound"),
        F.concat(F.lit("Wed Oct 11 "), _lpad2(F.col("turn")), F.lit(":"),
                 _lpad2(F.floor(part / 60) % 60), F.lit(":"), _lpad2(part % 60),
                 F.lit(" +0000 2017")).alias("created_at"),
        F.col("text"),
        F.when(F.col("turn") > 0, (turn_key - 1) * 1000).cast("long").alias("in_response_to_tweet_id"),
    )


def tweet_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden set for the corpus ETL: customer tweets of conversations that
    open with a system turn (a data-defined evaluation set)."""
    tw = tweets(spark, sf_dir)
    sys_convs = (read_table(spark, sf_dir, "conversations", "conv_id", "role")
                 .filter(F.col("role") == "system").select("conv_id").distinct())
    return (tw.filter(F.col("inbound"))
              .withColumn("conv_id", F.floor(F.col("tweet_id") / 100000).cast("long"))
              .join(sys_convs, "conv_id", "left_semi")
              .select("tweet_id", "text"))


def docs_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select(F.col("doc_id").alias("customer_tweet_id"), F.col("text").alias("customer_text"),
                    F.repeat(F.lit("x"), (1 + F.col("doc_id") % 7).cast("int")).alias("support_text"))


def docs_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden set for leakage checks: the documents that carry a label row."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    lab = read_table(spark, sf_dir, "labels", "doc_id")
    return (d.join(lab, "doc_id", "left_semi")
             .select(F.col("doc_id").alias("tweet_id"), "text", F.col("lang").alias("intent")))


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return d.select(F.col("doc_id").alias("tweet_id"), "text", F.col("lang").alias("intent"))


# The label taxonomy of labelled_docs, in display order
# ("it" has no rows, so zero-filling is exercised).
DOC_TAXONOMY = ["en", "fr", "de", "es", "it"]


def taxonomy(spark: SparkSession, labels: list[str] | None = None) -> DataFrame:
    labels = labels or DOC_TAXONOMY
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(labels)], "ord int, intent string")


def label_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate vs verified labels: reviewers overrode toxic documents to 'en'."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "lang")
    lab = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    return (d.join(lab, "doc_id", "left")
             .select(F.col("doc_id").alias("tweet_id"), F.col("lang").alias("candidate_intent"),
                     F.when(F.col("toxic") == 1, F.lit("en")).otherwise(F.col("lang"))
                      .alias("human_verified_intent")))


# Message ids of the literal messages start here (document ids are far below).
LITERAL_BASE = 10_000_000_000


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming messages: every document's whole text, and as further rows seven of every
    twelve document ids with a literal support phrase, a blank or nothing."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    k = F.col("doc_id") % 12
    text = (F.when(k == 0, F.lit("")).when(k == 1, F.lit(" ")).when(k == 2, F.lit("Thanks a lot!"))
             .when(k == 3, F.lit("I was charged twice, want a refund"))
             .when(k == 4, F.lit("my account was hacked, reset password"))
             .when(k == 5, F.lit("cancel subscription & bank dispute"))
             .when(k == 6, F.lit("hello there")))
    literal = d.filter(k < 7).select((F.col("doc_id") + LITERAL_BASE).alias("msg_id"), text.alias("text"))
    return d.select(F.col("doc_id").alias("msg_id"), "text").unionByName(literal)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-message policy signals (intent, confidence, similarity, evidence, reply)."""
    m = messages(spark, sf_dir)
    i = F.col("msg_id")
    intent = (F.when(i % 6 == 0, "account_and_login").when(i % 6 == 1, "playback_and_app_issues")
               .when(i % 6 == 2, "other_non_actionable").when(i % 6 == 3, "billing_and_payment")
               .when(i % 6 == 4, "account_and_login").otherwise("feature_requests"))
    return m.select(
        "msg_id", "text", intent.alias("predicted_intent"),
        (((i * 37) % 100).cast("double") / 100).alias("intent_confidence"),
        (((i * 53) % 101).cast("double") / 100).alias("top_retrieval_similarity"),
        (F.floor(i / 12) % 4).cast("int").alias("evidence_count"),
        F.when(i % 23 == 0, "generation_failed").when(i % 11 == 0, "insufficient_evidence")
         .otherwise("grounded").alias("grounding_status"),
        F.when(i % 29 == 0, "").otherwise("We can help, send us a DM").alias("reply_text"),
        F.when(i % 5 == 0, " Escalate").when(i % 5 == 1, "").otherwise("auto_handle").alias("human_decision"),
    )


# The true intent of a message, by the language of its document.
TRUE_INTENT = {"en": "account_and_login", "fr": "playback_and_app_issues", "de": "billing_and_payment", "es": "feature_requests"}


def true_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, true_intent) of the messages that are documents."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "lang")
    mapping = F.create_map(*[F.lit(x) for kv in TRUE_INTENT.items() for x in kv])
    return d.select(F.col("doc_id").alias("msg_id"), F.element_at(mapping, F.col("lang")).alias("true_intent"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings table as (id, embedding, label)."""
    return read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding", "label")


def vec_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("case_id"), "embedding", "label")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    llm = 1 + (F.col("o_custkey") % 9).cast("double") / 2
    human = F.least(F.lit(5.0), F.greatest(F.lit(1.0), llm + ((F.col("o_orderkey") % 5) - 2).cast("double") / 2))
    return o.select(F.col("o_orderkey").alias("tweet_id"), F.col("o_orderpriority").alias("dimension"),
                    llm.alias("llm"), human.alias("human"))


def judge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    a = conv.filter(F.col("role") == "assistant").alias("a")
    u = conv.filter(F.col("role") == "user").alias("u")
    j = a.join(u, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("u.turn") == F.col("a.turn") - 1))
    cid, turn = F.col("a.conv_id"), F.col("a.turn")
    return j.select(
        (cid * 100 + turn).alias("tweet_id"), F.col("u.text").alias("customer_text"),
        F.col("a.text").alias("generated_reply"),
        F.when(cid % 3 == 0, "billing_and_payment").when(cid % 3 == 1, "playback_and_app_issues")
         .otherwise("account_and_login").alias("predicted_intent"),
        (((cid * 41 + turn * 7) % 101).cast("double") / 100).alias("top_sim"),
        F.when(cid % 13 == 0, "insufficient_evidence").otherwise("grounded").alias("grounding_status"),
    )
