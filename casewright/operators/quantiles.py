"""Exact quantiles per group as a distributed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.common import reliable_checkpoint


def exact_quantiles(df: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """``group`` and one column per named quantile (linear interpolation between neighbours).

    Distinct (group, value) counts are range-partitioned, so a group of many values
    spans many tasks; positions are running counts within a partition plus one
    offset per (group, partition). Only the two neighbours of each quantile are kept.
    Null values are ignored; a group without a value is left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    ranged = reliable_checkpoint(counts.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy(group, "part").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(group)
    offsets = sums.select(F.col(group).alias("_group"), F.col("part").alias("_part"),
                          (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"))
    within = F.sum("n").over(Window.partitionBy(group, "part").orderBy(value))
    placed = (ranged.withColumn("upto", within)
              .join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part")))
              .select(group, value, (F.col("before") + F.col("upto") - F.col("n")).alias("first"),
                      (F.col("before") + F.col("upto") - 1).alias("last"), "total"))
    aggs = []
    for name, q in quantiles.items():
        at = (F.col("total") - 1) * F.lit(q)
        of = lambda k: F.max(F.when((F.col("first") <= k) & (k <= F.col("last")), F.col(value)))
        aggs += [of(F.floor(at)).alias(f"{name}_lo"), of(F.ceil(at)).alias(f"{name}_hi")]
    found = placed.groupBy(group).agg(F.max("total").alias("total"), *aggs)
    share = lambda q: (F.col("total") - 1) * F.lit(q) - F.floor((F.col("total") - 1) * F.lit(q))
    return found.select(group, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * share(q)).alias(n) for n, q in quantiles.items()])
