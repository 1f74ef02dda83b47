"""Human vs judge rating agreement per dimension.

All statistics come from grouped aggregates:
* Pearson = ``corr`` with the zero-variance rule.
* Spearman = Pearson on average ranks; ranks come from per-value counts
  (a handful of distinct rating values per dimension), not row windows.
* Quadratic weighted kappa in closed form: with ratings rounded half-even
  and clipped to 1..5, sum(w*O) = sum((h-l)^2)/(16N) and
  sum(w*E) = (N*(sum h^2 + sum l^2) - 2*sum h*sum l)/(16N^2), so one
  aggregate of six sums replaces the 5x5 contingency table. Linear
  weights use the 25-cell table (cells x marginals, still bounded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.common import bounded_broadcast

PASS_THRESHOLD = 3.5
# Distinct (dimension, rating) pairs that are broadcast.
MAX_RATING_VALUES = 10_000
MIN_SAMPLES = 3
MIN_RATING, MAX_RATING = 1, 5


def pair_ratings(human: DataFrame, judge: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise-complete (human, llm) rows on the keys."""
    h = human.filter(F.col("human").isNotNull())
    j = judge.filter(F.col("llm").isNotNull())
    return h.join(j, keys, "inner")


def clip_round(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.least(F.lit(MAX_RATING), F.greatest(F.lit(MIN_RATING), F.bround(col, 0))).cast("int")


def average_ranks(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Average rank with ties = (# smaller) + (# equal + 1) / 2 within ``group``."""
    vc = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_eq"))
    w = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    vc = vc.withColumn("_lt", F.coalesce(F.sum("_eq").over(w), F.lit(0)))
    vc = vc.select(group, value, (F.col("_lt") + (F.col("_eq") + 1) / 2.0).alias(out))
    # One row per distinct rating of a dimension; broadcast only behind the check of their number.
    return df.join(bounded_broadcast(vc, MAX_RATING_VALUES), [group, value])


def _corr_rule(x: str, y: str) -> Column:
    """corr, or 1.0/0.0 by equal means when either side has zero variance."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    zero_var = (sx == 0) | (sy == 0)
    # covariance / (sd * sd) with try_divide: Spark's corr raises under ANSI on zero variance
    pearson = F.try_divide(F.covar_pop(x, y), sx * sy)
    return F.when(zero_var, F.when(F.avg(x) == F.avg(y), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(pearson)


def quadratic_kappa(h: Column, l: Column) -> list[Column]:
    """Aggregates whose combination gives quadratic weighted kappa."""
    return [F.sum(h.cast("double")).alias("_sh"), F.sum((h * h).cast("double")).alias("_sh2"),
            F.sum(l.cast("double")).alias("_sl"), F.sum((l * l).cast("double")).alias("_sl2"),
            F.sum(((h - l) * (h - l)).cast("double")).alias("_sd2")]


def kappa_from_sums(n: Column) -> Column:
    swo = F.col("_sd2") / n
    swe = (n * (F.col("_sh2") + F.col("_sl2")) - 2 * F.col("_sh") * F.col("_sl")) / (n * n)
    return (F.when(n == 0, F.lit(0.0))
             .when(swe == 0, F.when(swo == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
             .otherwise(1.0 - swo / swe))


def agreement_table(pairs: DataFrame, dim: str = "dimension") -> DataFrame:
    """Per dimension n, means, Pearson, Spearman, binned agreement, kappa, status."""
    ranked = average_ranks(average_ranks(pairs, dim, "human", "_rh"), dim, "llm", "_rl")
    hr, lr = clip_round("human"), clip_round("llm")
    g = ranked.groupBy(dim).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("human").alias("_hm"), F.avg("llm").alias("_lm"),
        _corr_rule("human", "llm").alias("_p"), _corr_rule("_rh", "_rl").alias("_s"),
        F.avg(((F.col("human") >= PASS_THRESHOLD) == (F.col("llm") >= PASS_THRESHOLD)).cast("double")).alias("_a"),
        *quadratic_kappa(hr, lr))
    ok = F.col("sample_count") >= MIN_SAMPLES
    z = lambda c: F.when(ok, F.round(c, 4)).otherwise(F.lit(0.0))
    return g.select(
        dim, "sample_count", F.round("_hm", 2).alias("human_mean"), F.round("_lm", 2).alias("llm_mean"),
        z(F.col("_p")).alias("pearson_correlation"), z(F.col("_s")).alias("spearman_correlation"),
        z(F.col("_a")).alias("agreement_rate"), z(kappa_from_sums(F.col("sample_count"))).alias("weighted_kappa"),
        F.when(ok, "COMPUTED").otherwise("INSUFFICIENT_SAMPLES").alias("status"))


# Completed human ratings below which no agreement is computed.
MIN_HUMAN_REVIEWS = 5
REVIEW_REQUIRED = "HUMAN_REVIEW_REQUIRED"


def gated_agreement(human: DataFrame, judge: DataFrame, keys: list[str], dim: str = "dimension") -> DataFrame:
    """A26 with its gate: with fewer than ``MIN_HUMAN_REVIEWS`` rated items the table has the judge's
    means only and says that human review is required; else it is ``agreement_table``."""
    items = [k for k in keys if k != dim]
    rated = human.filter(F.col("human").isNotNull()).select(*items).distinct().limit(MIN_HUMAN_REVIEWS).count()
    if rated >= MIN_HUMAN_REVIEWS:
        return agreement_table(pair_ratings(human, judge, keys), dim)
    none = F.lit(None).cast("double")
    return judge.groupBy(dim).agg(F.round(F.avg("llm"), 2).alias("llm_mean")).select(
        dim, F.lit(0).cast("long").alias("sample_count"), none.alias("human_mean"), "llm_mean",
        *[none.alias(c) for c in ("pearson_correlation", "spearman_correlation", "agreement_rate", "weighted_kappa")],
        F.lit(REVIEW_REQUIRED).alias("status"))


def weighted_kappa(pairs: DataFrame, dim: str = "dimension") -> DataFrame:
    """Quadratic (closed form) and linear (25-cell table) kappa per dimension."""
    hr, lr = clip_round("human"), clip_round("llm")
    base = pairs.select(dim, hr.alias("h"), lr.alias("l"))
    quad = base.groupBy(dim).agg(F.count(F.lit(1)).alias("n"), *quadratic_kappa(F.col("h"), F.col("l")))
    quad = quad.select(dim, "n", F.round(kappa_from_sums(F.col("n")), 4).alias("quadratic_kappa"))
    span = float(MAX_RATING - MIN_RATING)
    cells = base.groupBy(dim, "h", "l").agg(F.count(F.lit(1)).alias("c"))
    rows = base.groupBy(dim, "h").agg(F.count(F.lit(1)).alias("r"))
    cols = base.groupBy(dim, "l").agg(F.count(F.lit(1)).alias("k"))
    wo = cells.groupBy(dim).agg(F.sum(F.abs(F.col("h") - F.col("l")) / span * F.col("c")).alias("wo"),
                                F.sum("c").alias("n"))
    we = (rows.join(cols, dim).groupBy(dim)
              .agg(F.sum(F.abs(F.col("h") - F.col("l")) / span * F.col("r") * F.col("k")).alias("we")))
    lin = wo.join(we, dim).select(dim, F.when(F.col("we") == 0, F.when(F.col("wo") == 0, 1.0).otherwise(0.0))
                                  .otherwise(1.0 - (F.col("wo") / F.col("n")) / (F.col("we") / (F.col("n") * F.col("n"))))
                                  .alias("_lk"))
    return quad.join(lin, dim).select(dim, "n", "quadratic_kappa", F.round("_lk", 4).alias("linear_kappa"))
