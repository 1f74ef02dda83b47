"""Data-quality checks, class distributions, splits and samples over labelled sets.

Covers A2-A7, A28, J10, W5-W7, U1, U2, S3. All checks are aggregates with
map-side combine; no check collects an unbounded id list: all offending ids
are returned as rows of (check, tweet_id). Only the sample of duplicate texts in
the JSON report is cut at ``SAMPLE_IDS``, as that is what it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import norm_key, py_strip
from casewright.operators.common import reliable_checkpoint

SAMPLE_IDS = 5
# Default seed of the reference's splits and samples (fixed value).
SEED = 2026


def blank(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.isNull() | (py_strip(col) == "")


def corpus_profile(cases: DataFrame, id_col: str = "customer_tweet_id", approximate: bool = False,
                   rsd: float = 0.01) -> DataFrame:
    """A3/A5: one aggregate pass with all profile counters.

    Exact distinct counts plan as an Expand (each row once per distinct
    aggregate) before the shuffle; ``approximate=True`` uses HyperLogLog++
    sketches instead (``rsd`` relative error), which merge map-side."""
    def distinct(c):
        return F.approx_count_distinct(c, rsd) if approximate else F.countDistinct(c)

    def text(c):  # exact counts shuffle digests, not texts
        return distinct(c if approximate else F.sha2(c, 256))
    return cases.agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct(F.col(id_col)).alias("distinct_customer_ids"),
        text(norm_key("customer_text")).alias("distinct_customer_texts"),
        text(F.col("support_text")).alias("distinct_replies"),
        F.count_if(F.col("customer_text").isNull()).alias("null_customer_text"),
        F.count_if(F.col("support_text").isNull()).alias("null_support_text"),
        F.count_if(F.col("customer_text").isNotNull() & (py_strip("customer_text") == "")).alias("blank_customer_text"),
        F.count_if(F.col("support_text").isNotNull() & (py_strip("support_text") == "")).alias("blank_support_text"),
    )


#: Size of a distinct-count sketch: 2^14 registers of 4 bits, relative error about 0.6 %.
SKETCH_LOG = 14
_DISTINCT = ["distinct_customer_ids", "distinct_customer_texts", "distinct_replies"]
_COUNTED = ["n_rows", "null_customer_text", "null_support_text"]


def profile_parts(cases: DataFrame, part: Column, id_col: str = "customer_tweet_id") -> DataFrame:
    """A3, incremental: one row for each part of the input with its counts and distinct-count sketches. Stored, it is
    never computed again: what arrives later is a part of its own. Sketches combine before the shuffle and have a bounded size."""
    values = (F.col(id_col).cast("string"), norm_key("customer_text"), F.col("support_text"))
    return cases.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("customer_text").isNull()).alias("null_customer_text"),
        F.count_if(F.col("support_text").isNull()).alias("null_support_text"),
        *[F.hll_sketch_agg(v, F.lit(SKETCH_LOG)).alias(name) for v, name in zip(values, _DISTINCT)])


def merge_parts(parts: DataFrame) -> DataFrame:
    """The profile of all stored parts: counts summed, sketches united. The result does not depend on how the input was split."""
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTED],
                     *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in _DISTINCT])


def check_case_contract(cases: DataFrame) -> None:
    """S3: required columns, non-empty, no blank texts; raises on violation."""
    from casewright.sources.tables import require_columns
    require_columns(cases, ["case_id", "customer_text", "support_text"], "support cases")
    row = cases.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(blank("customer_text") | blank("support_text")).alias("bad")).first()
    if row["n"] == 0:
        raise ValueError("support cases: table is empty")
    if row["bad"]:
        raise ValueError(f"support cases: {row['bad']} rows with blank customer/support text")


def class_distribution(df: DataFrame, taxonomy: DataFrame, label_col: str = "intent") -> DataFrame:
    """A2 + J10: count and percent (2 dp) per taxonomy class, zero-filled, in taxonomy order."""
    n = df.count()
    counts = df.groupBy(F.col(label_col).alias("intent")).agg(F.count(F.lit(1)).alias("count"))
    # no broadcast hint: the label column may hold arbitrary (invalid) values, so AQE sizes this join
    dist = taxonomy.join(counts.filter(F.col("intent").isNotNull()), "intent", "left")
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    pct = F.round(cnt * 100.0 / F.lit(n), 2) if n else F.lit(0.0)
    return dist.select("ord", "intent", cnt.alias("count"), pct.alias("percentage"))


def duplicate_rows(df: DataFrame, id_col: str = "tweet_id", text_col: str = "text") -> DataFrame:
    """A4: every member of a duplicated id or duplicated normalised text (keep=False).

    Keys with count > 1 come from an aggregate (combined map-side, so a hot
    key is pre-counted) and are joined back; AQE splits skewed partitions. Texts
    are shuffled as SHA-256 digests. Null ids and null texts are no duplicates.
    """
    keyed = df.select(F.col(id_col).alias("tweet_id"), F.explode(F.map_from_arrays(
        F.array(F.lit("tweet_id"), F.lit("text")),
        F.array(F.col(id_col).cast("string"), F.sha2(norm_key(text_col), 256)))).alias("dup_kind", "_k")).filter(F.col("_k").isNotNull())
    # written out, so that the join has an exchange of its own on both sides and a hot key can be split
    many = reliable_checkpoint(keyed.groupBy("dup_kind", "_k").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    return keyed.join(many, ["dup_kind", "_k"]).select("dup_kind", "tweet_id", "group_size")


# Columns and number of rows that a golden set must have.
GOLDEN_COLUMNS = ["tweet_id", "text", "intent"]
GOLDEN_ROWS = 200


def golden_offenders(df: DataFrame, taxonomy: DataFrame, id_col: str = "tweet_id", text_col: str = "text",
                     label_col: str = "intent") -> DataFrame:
    """(check, tweet_id, value) of every offending row; ``value`` is the invalid label."""
    valid = [r["intent"] for r in taxonomy.select("intent").collect()]   # taxonomy: a handful of rows
    label = F.col(label_col)
    checks = F.array_compact(F.array(
        F.when(blank(text_col), F.lit("empty_text")), F.when(blank(label_col), F.lit("empty_intent")),
        F.when(label.isNotNull() & ~label.isin(valid), F.lit("taxonomy_membership"))))
    own = df.select(F.explode(checks).alias("check"), F.col(id_col).alias("tweet_id"), label.alias("value"))
    own = own.withColumn("value", F.when(F.col("check") == "taxonomy_membership", F.col("value")))
    dups = duplicate_rows(df, id_col, text_col).select(
        F.when(F.col("dup_kind") == "text", "duplicate_texts").otherwise("duplicate_tweet_ids").alias("check"), "tweet_id",
        F.lit(None).cast("string").alias("value"))
    return own.unionByName(dups)


def golden_report(df: DataFrame, taxonomy: DataFrame, expected_rows: int = GOLDEN_ROWS, source: str = "labelled documents",
                  id_col: str = "tweet_id", text_col: str = "text", label_col: str = "intent") -> DataFrame:
    """The seven validation checks, the issues found and the provenance as one row.

    A missing required column is an issue of its own; the checks that need it are
    null (not run) instead of failing on the column.
    """
    missing = [c for c in (id_col, text_col, label_col) if c not in df.columns]
    zero = F.lit(None).cast("long")
    aggs = {"row_count": F.count(F.lit(1)),
            "empty_text": zero if text_col in missing else F.count_if(blank(text_col)),
            "empty_intent": zero if label_col in missing else F.count_if(blank(label_col)),
            "classes_represented": zero if label_col in missing else F.countDistinct(label_col)}
    r = df.agg(*[F.max(v).alias(k) if v is zero else v.alias(k) for k, v in aggs.items()])
    if not missing:
        off = golden_offenders(df, taxonomy, id_col, text_col, label_col)
        # Invalid classes are counted by label first, so the list is as long as the set of wrong labels.
        wrong = off.groupBy("check", "value").agg(F.count(F.lit(1)).alias("n")).groupBy().agg(
            F.coalesce(F.sum(F.when(F.col("check") == "duplicate_tweet_ids", F.col("n"))), F.lit(0)).alias("duplicate_id_rows"),
            F.coalesce(F.sum(F.when(F.col("check") == "duplicate_texts", F.col("n"))), F.lit(0)).alias("duplicate_text_rows"),
            F.count_if(F.col("check") == "taxonomy_membership").alias("invalid_classes"))
        r = combine_scalar_rows([r, wrong])
    else:
        r = r.withColumns({"duplicate_id_rows": zero, "duplicate_text_rows": zero, "invalid_classes": zero})
    found = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, F.col(c)))
    issues = F.array_compact(F.array(
        F.lit(f"Missing required column(s): {', '.join(missing)}" if missing else None).cast("string"),
        F.when(F.col("row_count") != expected_rows, F.format_string(f"Expected {expected_rows} rows, found %d", F.col("row_count"))),
        found("empty_text", "Found %d empty or null text entries"), found("empty_intent", "Found %d empty or null intent entries"),
        found("invalid_classes", "Found %d invalid intent labels not in taxonomy"), found("duplicate_id_rows", "Found %d duplicate tweet_id rows"),
        found("duplicate_text_rows", "Found %d duplicate or identical text messages")))
    return r.select(
        F.when(F.size(issues) == 0, "PASSED").otherwise("FAILED").alias("status"),
        F.size(issues).cast("long").alias("total_issues"), F.array_join(issues, "; ").alias("issues"),
        F.lit(", ".join(missing)).alias("missing_columns"), "row_count", F.lit(expected_rows).cast("long").alias("expected_rows"),
        "empty_text", "empty_intent", "classes_represented", "invalid_classes", "duplicate_id_rows", "duplicate_text_rows",
        F.lit(source).alias("dataset_source"), F.col("row_count").alias("total_examples"))


def report_json(report: DataFrame, distribution: DataFrame, offenders: DataFrame) -> DataFrame:
    """The validation report as JSON, one record per section: the checks, the class
    distribution, the invalid classes and (at most ``SAMPLE_IDS``) ids of duplicate texts."""
    checks = report.select(F.lit("checks").alias("section"), F.to_json(F.struct(*report.columns)).alias("body"))
    dist = distribution.groupBy().agg(F.array_sort(F.collect_list(F.struct("ord", "intent", "count", "percentage"))).alias("x")).select(
        F.lit("class_distribution").alias("section"), F.to_json(F.transform("x", lambda r: r.dropFields("ord"))).alias("body"))
    invalid = (offenders.filter(F.col("check") == "taxonomy_membership").groupBy("value").agg(F.count(F.lit(1)).alias("n")).groupBy()
               .agg(F.array_sort(F.collect_list("value")).alias("x")).select(F.lit("invalid_classes").alias("section"), F.to_json("x").alias("body")))
    sample = (offenders.filter(F.col("check") == "duplicate_texts").select("tweet_id").orderBy("tweet_id").limit(SAMPLE_IDS).groupBy()
              .agg(F.array_sort(F.collect_list("tweet_id")).alias("x")).select(F.lit("duplicate_sample_ids").alias("section"), F.to_json("x").alias("body")))
    return checks.unionByName(dist).unionByName(invalid).unionByName(sample)


def combine_scalar_rows(frames: list[DataFrame]) -> DataFrame:
    """Put the columns of several single-row aggregates side by side without
    a join: stack each into (name, value) rows, union, fold back into one row."""
    long = None
    for f in frames:
        cols = f.columns
        part = f.selectExpr(f"stack({len(cols)}, " + ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in cols)
                            + ") AS (name, value)")
        long = part if long is None else long.unionByName(part)
    names = [c for f in frames for c in f.columns]
    return long.groupBy().agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in names])


def label_review_agreement(review: DataFrame, label_a: str = "candidate_intent",
                           label_b: str = "human_verified_intent") -> DataFrame:
    """Per-label candidate vs verified counts, plus global agreement."""
    a = review.groupBy(F.col(label_a).alias("intent")).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(F.col(label_a) == F.col(label_b)).alias("agreed"),
        F.count_if(F.col(label_a) != F.col(label_b)).alias("changed_from"))
    b = review.groupBy(F.col(label_b).alias("intent")).agg(F.count(F.lit(1)).alias("verified_count"))
    j = a.join(b, "intent", "full_outer").na.fill(0, ["candidate_count", "agreed", "changed_from", "verified_count"])
    w = Window.partitionBy()   # over the per-label rows only (one row per label)
    n = F.sum("candidate_count").over(w)
    return j.select("intent", F.col("candidate_count").cast("long"), F.col("verified_count").cast("long"),
                    F.col("changed_from").cast("long").alias("disagreements"),
                    F.round(F.sum("agreed").over(w) / n, 4).alias("agreement_rate"))


def label_disagreements(review: DataFrame, id_col: str = "tweet_id", label_a: str = "candidate_intent",
                        label_b: str = "human_verified_intent") -> DataFrame:
    """Every row whose verified label is not the candidate's (a null on one side only counts)."""
    return review.filter(~F.col(label_a).eqNullSafe(F.col(label_b))).select(id_col, label_a, label_b)


# ---------------------------------------------------------------- sampling

def hash_key(id_col: str, seed: int) -> Column:
    """Deterministic shuffle key: md5 of '<id>:<seed>' (same hex in DuckDB)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


ROWS_PER_BUCKET = 100_000


def prefix_length(max_group_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex characters of the hash prefix so that one bucket of the largest
    group holds about ``rows_per_bucket`` rows (1..8 characters)."""
    import math
    need = max(1.0, max_group_rows / rows_per_bucket)
    return max(1, min(8, math.ceil(math.log(need, 16))))


def take_per_group(df: DataFrame, group_col: str, quotas: DataFrame, id_col: str, seed: int,
                   prefix_chars: int | None = None) -> DataFrame:
    """Exact top-``quota`` rows per group in (md5 key, id) order, without a
    per-group window over whole groups.

    A histogram of hash prefixes per group (an aggregate, combined
    map-side) locates the one boundary bucket per group; rows of buckets
    below it are taken whole, rows above are dropped, and only the
    boundary bucket is ranked with a window. The prefix length adapts to
    the largest group (one extra count aggregate), so the boundary bucket
    stays around ``ROWS_PER_BUCKET`` rows even for a group holding a third
    of all rows. ``quotas(group, quota)`` has one row per group.
    """
    if prefix_chars is None:
        biggest = (df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"))
                     .agg(F.max("_n").alias("m")).first()["m"] or 0)
        prefix_chars = prefix_length(biggest)
    keyed = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, prefix_chars))
    hist = keyed.groupBy(group_col, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(group_col).orderBy("_b")
    hist = (hist.withColumn("_cum", F.sum("_cnt").over(w))
                .join(quotas, group_col)
                .withColumn("_before", F.col("_cum") - F.col("_cnt"))
                .withColumn("_take", F.when(F.col("_cum") <= F.col("quota"), F.lit(-1))      # whole bucket
                                      .when(F.col("_before") < F.col("quota"), F.col("quota") - F.col("_before"))
                                      .otherwise(F.lit(0)))
                .filter(F.col("_take") != 0)
                .select(group_col, "_b", "_take"))
    picked = keyed.join(hist, [group_col, "_b"])
    whole = picked.filter(F.col("_take") == -1)
    edge = picked.filter(F.col("_take") > 0)
    rn = F.row_number().over(Window.partitionBy(group_col, "_b").orderBy("_h", id_col))
    edge = edge.withColumn("_rn", rn).filter(F.col("_rn") <= F.col("_take")).drop("_rn")
    return whole.unionByName(edge).drop("_b", "_take")


def split_quotas(df: DataFrame, label_col: str, test_pct: int) -> DataFrame:
    """Largest-remainder test quota per class, integer arithmetic only.

    n_test = ceil(N * pct / 100); base_c = n_c * n_test div N; the leftover
    goes to the classes with the largest remainders (ties by label).
    """
    counts = df.groupBy(F.col(label_col).alias("_label")).agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy()      # one row per class
    n = F.sum("n_c").over(w_all)
    c = (counts.withColumn("_N", n)
               .withColumn("_nt", F.expr(f"(_N * {test_pct} + 99) div 100"))
               .withColumn("_base", F.expr("(n_c * _nt) div _N"))
               .withColumn("_rem", F.expr("(n_c * _nt) % _N")))
    c = c.withColumn("_left", F.col("_nt") - F.sum("_base").over(w_all))
    c = c.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col("_label"))))
    return c.select(F.col("_label").alias(label_col),
                    (F.col("_base") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).alias("quota"))


def stratified_split(df: DataFrame, label_col: str = "intent", id_col: str = "tweet_id",
                     test_pct: int = 25, seed: int = SEED) -> DataFrame:
    """Adds ``split`` in {train, test}; per-class test quotas, hash order."""
    quotas = split_quotas(df.filter(F.col(label_col).isNotNull()), label_col, test_pct)
    test = take_per_group(df, label_col, quotas, id_col, seed).select(id_col, F.lit("test").alias("_s"))
    return (df.join(test, id_col, "left")
              .withColumn("split", F.coalesce(F.col("_s"), F.lit("train"))).drop("_s"))


def quota_sample(df: DataFrame, sample_size: int = 30, label_col: str = "intent", id_col: str = "tweet_id",
                 seed: int = SEED) -> DataFrame:
    """W6 + J6 + U1: max(1, S // classes) per class, topped up from the rest
    in hash order, then exactly S rows (hash order)."""
    classes = df.select(label_col).distinct()
    k = classes.count()          # number of classes: a bounded scalar
    per = max(1, sample_size // max(k, 1))
    quotas = classes.select(label_col, F.lit(per).alias("quota"))
    first = take_per_group(df, label_col, quotas, id_col, seed).dropDuplicates([id_col])
    rest = df.join(first.select(id_col), id_col, "left_anti")
    n_first = first.count()
    if n_first < sample_size:
        need = sample_size - n_first
        top_up = (rest.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(need))
        first = first.unionByName(top_up, allowMissingColumns=True)
    out = first.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(sample_size)
    return out.drop("_h")


def proportional_sample(df: DataFrame, sample_size: int = 40, label_col: str = "intent",
                        id_col: str = "tweet_id", seed: int = SEED) -> DataFrame:
    """Per class min(n_c, max(2, int(S * n_c / N))), then at most S rows."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    n = F.sum("n_c").over(Window.partitionBy())
    quotas = counts.withColumn("_N", n).select(
        label_col, F.least(F.col("n_c"), F.greatest(F.lit(2).cast("long"),
                                                     F.expr(f"({sample_size} * n_c) div _N"))).alias("quota"))
    picked = take_per_group(df, label_col, quotas, id_col, seed)
    return (picked.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(sample_size).drop("_h"))
