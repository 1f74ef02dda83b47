"""Rebuild customer -> support cases from a raw tweet table.

Stages (each a DataFrame, composed lazily into one plan):
  P1/P2  split inbound customer tweets from brand replies with a parent
  P3     parse the tweet timestamp (bad values -> null, sorted last)
  A1     merge multi-part replies per customer tweet
  J1     pair merged replies with the customer tweet
  G1/J2  attach the conversation root
  J3     drop golden-set leaks by id and by normalised text
  W1     dedup repeated customer texts, keep the longest reply
  W2     dense ``case_%05d`` ids ordered by customer tweet id
  P4     final projection
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from casewright.functions.text import norm_key, py_strip
from casewright.operators.common import bounded_broadcast, reliable_checkpoint
from casewright.operators.graph import conversation_roots

TWEET_COLUMNS = ["tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id"]
CASE_COLUMNS = ["case_id", "customer_tweet_id", "support_tweet_id", "customer_text", "support_text",
                "created_at", "intent", "conversation_id", "customer_author_id"]


def parse_tweet_time(c) -> Column:
    """'%a %b %d %H:%M:%S %z %Y' with errors -> null (the weekday is skipped:
    Spark rejects the EEE pattern when parsing)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(F.substr(col, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy"))


def customer_tweets(tweets: DataFrame) -> DataFrame:
    return tweets.filter(F.col("inbound") == F.lit(True))


def brand_replies(tweets: DataFrame, brand: str) -> DataFrame:
    """Brand replies that answer something, parent cast to long."""
    return (tweets.filter((F.col("inbound") == F.lit(False)) & (F.col("author_id") == F.lit(brand)))
                  .filter(F.col("in_response_to_tweet_id").isNotNull())
                  .withColumn("in_response_to_tweet_id", F.col("in_response_to_tweet_id").cast("long")))


def merge_multipart_replies(replies: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """A1: one row per answered tweet; parts ordered by (time nulls last, id).

    ids joined with ',', stripped non-blank texts joined with newline, and the
    first non-null ``created_at`` string.

    Two phases, so a parent holding a third of all replies is never sorted or
    collected by one task: replies are range-partitioned on the full sort key
    (a hot parent spans many partitions, each a contiguous run of its parts),
    each (parent, partition) chunk builds its ordered partial strings, and the
    final step joins at most one partial per partition. Only that final row
    (the output itself) is as large as the group.
    """
    spark = replies.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ts = parse_tweet_time("created_at")
    r = replies.select(F.col("in_response_to_tweet_id").alias("customer_tweet_id"), ts.isNull().alias("ts_null"),
                       ts.alias("ts"), F.col("tweet_id").cast("long").alias("id"),
                       py_strip("text").alias("text"), "created_at")
    chunked = (r.repartitionByRange(n, "customer_tweet_id", "ts_null", "ts", "id")
                .withColumn("_chunk", F.spark_partition_id()))
    part = F.struct("ts_null", "ts", "id", "text", "created_at")
    p1 = (chunked.groupBy("customer_tweet_id", "_chunk")
                 .agg(F.array_sort(F.collect_list(part)).alias("parts"))
                 .select("customer_tweet_id", "_chunk",
                         F.array_join(F.transform("parts", lambda p: p["id"].cast("string")), ",").alias("ids"),
                         F.array_join(F.filter(F.transform("parts", lambda p: p["text"]),
                                               lambda t: t.isNotNull() & (t != "")), "\n").alias("texts"),
                         F.element_at(F.filter("parts", lambda p: p["created_at"].isNotNull()), 1)["created_at"]
                          .alias("created")))
    p2 = p1.groupBy("customer_tweet_id").agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "ids", "texts", "created"))).alias("chunks"))
    return p2.select(
        "customer_tweet_id",
        F.array_join(F.transform("chunks", lambda c: c["ids"]), ",").alias("support_tweet_id"),
        F.array_join(F.filter(F.transform("chunks", lambda c: c["texts"]), lambda t: t != ""), "\n")
         .alias("support_text"),
        F.element_at(F.filter("chunks", lambda c: c["created"].isNotNull()), 1)["created"].alias("support_created_at"),
    )


def pair_cases(merged: DataFrame, customers: DataFrame) -> DataFrame:
    """Inner equi-join of merged replies with their customer tweet."""
    cust = customers.select(F.col("tweet_id").cast("long").alias("customer_tweet_id"),
                            F.col("author_id").alias("customer_author_id"),
                            F.col("created_at").alias("customer_created_at"),
                            F.col("text").alias("customer_text"))
    return merged.join(cust, "customer_tweet_id", "inner")


def exclude_leakage(cases: DataFrame, golden: DataFrame, id_col: str = "customer_tweet_id",
                    text_col: str = "customer_text") -> DataFrame:
    """Drop rows whose id OR normalised text is in the golden set.

    Written as two anti joins (an OR join condition would plan a nested
    loop). The golden side is small by nature; it is broadcast only behind
    a row-count check.
    """
    g_ids = bounded_broadcast(golden.select(F.col("tweet_id").cast("long").alias("_gid")).distinct())
    g_txt = bounded_broadcast(_text_digests(golden, "_gkey"))
    out = cases.join(g_ids, F.col(id_col) == F.col("_gid"), "left_anti")
    return out.join(g_txt, F.sha2(norm_key(text_col), 256) == F.col("_gkey"), "left_anti")


def _text_digests(golden: DataFrame, name: str) -> DataFrame:
    """SHA-256 of the normalised texts: rows of a fixed width, however long the texts are, so
    that a bound on rows is a bound on bytes."""
    return golden.select(F.sha2(norm_key("text"), 256).alias(name)).filter(F.col(name).isNotNull()).distinct()


def leakage_overlap(cases: DataFrame, golden: DataFrame, id_col: str = "customer_tweet_id",
                    text_col: str = "customer_text") -> DataFrame:
    """Golden rows that still occur in the corpus, by id or by text. Texts are matched by their digests; only those that
    match are shuffled."""
    by_id = (cases.select(F.col(id_col).cast("long").alias("tweet_id"))
                  .intersect(golden.select(F.col("tweet_id").cast("long"))))
    by_id = by_id.select(F.lit("id").alias("match_kind"), F.col("tweet_id").cast("string").alias("match_key"))
    keys = cases.select(norm_key(text_col).alias("k")).withColumn("digest", F.sha2("k", 256))
    by_text = keys.join(bounded_broadcast(_text_digests(golden, "digest")), "digest", "left_semi").dropDuplicates(["digest"])
    by_text = by_text.select(F.lit("text").alias("match_kind"), F.col("k").alias("match_key"))
    return by_id.unionByName(by_text)


def dedup_longest_reply(cases: DataFrame, text_col: str = "customer_text", reply_col: str = "support_text",
                        id_col: str = "customer_tweet_id") -> DataFrame:
    """One row per normalised customer text: longest reply, then smallest id.

    Expressed as a ``min(struct)`` aggregate rather than a window: the
    aggregate has a partial (map-side) step — a sort-based one, since the
    struct holds strings — so a hot text (even a third of all rows) is
    reduced to one candidate per task before the shuffle.
    """
    others = [c for c in cases.columns if c not in (id_col,)]
    best = F.min(F.struct((-F.length(reply_col)).alias("_neg_len"), F.col(id_col).alias("_id"),
                          *[F.col(c) for c in others])).alias("_best")
    g = cases.groupBy(norm_key(text_col).alias("_norm")).agg(best)
    return g.select(F.col("_best._id").alias(id_col), *[F.col(f"_best.{c}").alias(c) for c in others])


def assign_case_ids(cases: DataFrame, order_col: str = "customer_tweet_id", fmt: str = "case_%05d",
                    num_partitions: int | None = None) -> DataFrame:
    """Dense 1-based sequence by ``order_col`` without a global window.

    Range-partition and sort within partitions; ``monotonically_increasing_id``
    then encodes (partition, position). The partition layout is pinned by a
    reliable checkpoint, per-partition counts (one row per partition) give
    offsets, and the offsets are joined back with a broadcast whose size is
    the number of partitions.
    """
    spark = cases.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid = F.monotonically_increasing_id()
    laid = (cases.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
                 .withColumn("_pid", F.shiftright(mid, 33))
                 .withColumn("_pos", mid.bitwiseAND(F.lit((1 << 33) - 1))))
    laid = reliable_checkpoint(laid)
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    seq = F.col("_off") + F.col("_pos") + 1
    return (laid.join(F.broadcast(offsets), "_pid")
                .withColumn("case_id", F.format_string(fmt, seq))
                .withColumn("_seq", seq)
                .drop("_pid", "_pos", "_off"))


def quarantine_blank(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows with null/blank customer or support text (the reference
    aborts the whole run on one such row; we set them aside)."""
    bad = (F.col("customer_text").isNull() | F.col("support_text").isNull()
           | (py_strip("customer_text") == "") | (py_strip("support_text") == ""))
    return cases.filter(~bad), cases.filter(bad)


class RunAudit:
    """A31 of the run itself: counters that the stages of C1 report while they run, so nothing runs twice for counting.

    ``watch`` lets a stage's rows through and counts them; ``rows`` are the counts once the corpus was built. A stage
    that Spark repeats after losing an executor may be counted again, as its metrics are accumulators."""

    def __init__(self):
        self.seen: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        seen = Observation(f"audit-{uuid.uuid4().hex}")
        self.seen += [(name, seen) for name in counts]
        return df.observe(seen, *[c.alias(name) for name, c in counts.items()])

    def rows(self, spark: SparkSession) -> DataFrame:
        """(stage, n), one row for each counter."""
        counts = [(name, int(seen.get.get(name) or 0)) for name, seen in self.seen]
        return spark.createDataFrame(counts, "stage string, n long")


def build_case_corpus(tweets: DataFrame, golden: DataFrame | None, brand: str,
                      deduplicate: bool = True, audit: RunAudit | None = None) -> DataFrame:
    """C1 end to end; returns the case table ordered by ``case_id``. ``audit`` gets the row count of every stage."""
    one = F.count(F.lit(1))
    watch = audit.watch if audit is not None else lambda df, **counts: df
    tw = tweets.select(*TWEET_COLUMNS)
    merged = merge_multipart_replies(brand_replies(tw, brand))
    is_brand = (F.col("inbound") == F.lit(False)) & (F.col("author_id") == F.lit(brand))
    # The rows of the customers' side pass the raw counters before any is left out.
    customers = customer_tweets(watch(tw, **{"1_raw_tweets": one, "2_customer_tweets": F.count_if(F.col("inbound") == F.lit(True)),
                                             "3_brand_tweets": F.count_if(is_brand)}))
    paired = watch(pair_cases(merged, customers), **{"4_pairs": one})
    roots = conversation_roots(tw)
    paired = (paired.join(roots.withColumnRenamed("tweet_id", "customer_tweet_id"), "customer_tweet_id", "left")
                    .withColumn("conversation_id", F.coalesce("conversation_id", "customer_tweet_id")))
    if golden is not None:
        paired = exclude_leakage(paired, golden)
    kept, _ = quarantine_blank(watch(paired, **{"5_after_leakage": one}))
    kept = watch(kept, **{"6_after_quarantine": one})
    if deduplicate:
        kept = dedup_longest_reply(kept)
    # Counted behind the range sort, whose sampling reads what is before it twice.
    numbered = watch(assign_case_ids(kept), **{"7_final_cases": one})
    return numbered.select(
        "case_id", "customer_tweet_id", "support_tweet_id", "customer_text", "support_text",
        F.col("customer_created_at").alias("created_at"), F.lit(None).cast("string").alias("intent"),
        F.col("conversation_id").cast("long").alias("conversation_id"), "customer_author_id")


def tweet_partition_counts(tweets: DataFrame, brand: str) -> DataFrame:
    """A31 (input side): one pass over the raw table, all counters at once."""
    is_support = (F.col("inbound") == F.lit(False)) & (F.col("author_id") == F.lit(brand))
    return tweets.agg(
        F.count(F.lit(1)).alias("raw_tweets"),
        F.count_if(F.col("inbound") == F.lit(True)).alias("customer_tweets"),
        F.count_if(is_support).alias("brand_tweets"),
        F.count_if(is_support & F.col("in_response_to_tweet_id").isNotNull()).alias("brand_replies_with_parent"),
        F.count_if(parse_tweet_time("created_at").isNull()).alias("unparsed_timestamps"),
        F.countDistinct("in_response_to_tweet_id").alias("distinct_parents"),
    )


def assert_no_leakage(cases: DataFrame, golden: DataFrame, id_col: str = "customer_tweet_id",
                      text_col: str = "customer_text") -> None:
    """J4 hard stop: raise if any golden id or normalised text is still in the corpus."""
    overlap = leakage_overlap(cases, golden, id_col, text_col)
    sample = overlap.orderBy("match_kind", "match_key").limit(5).collect()
    if sample:
        raise ValueError(f"golden-set leakage into the corpus, e.g. {[tuple(r) for r in sample]}")


def etl_audit(tweets: DataFrame, golden: DataFrame | None, brand: str) -> DataFrame:
    """Row counter per ETL stage as (stage, n) rows, from two scans.

    One aggregate over the raw table gives the input counters; the pairs are
    then *marked* (leak by id or text, blank texts) with left joins against
    the bounded golden keys, and one aggregate over the marked pairs gives
    the remaining counters (the final count is the number of distinct
    normalised texts left, which is what dedup keeps).
    """
    tw = tweets.select(*TWEET_COLUMNS)
    is_brand = (F.col("inbound") == F.lit(False)) & (F.col("author_id") == F.lit(brand))
    raw = tw.agg(F.count(F.lit(1)).alias("1_raw_tweets"),
                 F.count_if(F.col("inbound") == F.lit(True)).alias("2_customer_tweets"),
                 F.count_if(is_brand).alias("3_brand_tweets"))
    paired = pair_cases(merge_multipart_replies(brand_replies(tw, brand)), customer_tweets(tw))
    marked = paired.withColumn("_key", norm_key("customer_text"))
    if golden is not None:
        g_ids = bounded_broadcast(golden.select(F.col("tweet_id").cast("long").alias("customer_tweet_id"),
                                                F.lit(True).alias("_lid")).distinct())
        g_txt = bounded_broadcast(_text_digests(golden, "_digest").withColumn("_ltx", F.lit(True)))
        marked = (marked.join(g_ids, "customer_tweet_id", "left")
                  .withColumn("_digest", F.sha2("_key", 256)).join(g_txt, "_digest", "left"))
        leak = F.coalesce(F.col("_lid"), F.lit(False)) | F.coalesce(F.col("_ltx"), F.lit(False))
    else:
        leak = F.lit(False)
    blank = (F.col("customer_text").isNull() | F.col("support_text").isNull()
             | (py_strip("customer_text") == "") | (py_strip("support_text") == ""))
    kept = ~leak & ~blank
    pairs = marked.agg(F.count(F.lit(1)).alias("4_pairs"), F.count_if(~leak).alias("5_after_leakage"),
                       F.count_if(kept).alias("6_after_quarantine"),
                       F.count_distinct(F.when(kept, F.col("_key"))).alias("7_final_cases"))
    def as_rows(one_row: DataFrame) -> DataFrame:
        cols = one_row.columns
        stack = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in cols)
        return one_row.selectExpr(f"stack({len(cols)}, {stack}) AS (stage, n)")
    return as_rows(raw).unionByName(as_rows(pairs))
