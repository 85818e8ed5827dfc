"""Exact distributions of integer measures without gathering the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET_BITS = 16


def one_decimal(numerator: Column, denominator: Column) -> Column:
    """Quotient of two non-negative integers, rounded half up to one decimal."""
    scaled = F.call_function("div", numerator * 20 + denominator, denominator * 2)
    return F.when(denominator == 0, F.lit(0.0)).otherwise(scaled / F.lit(10.0))


def distributions(df: DataFrame, key: str, value: str) -> DataFrame:
    """min, max, average and median of a non-negative integer column per key.

    Equal values are counted first. The median is then located in two steps: a running
    total over buckets of 65,536 consecutive values, and one inside the bucket that holds
    it. Neither window can see more rows than there are buckets or values in a bucket.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v"))
              .agg(F.count("*").alias("n"))
              .withColumn("bucket", F.shiftright("v", _BUCKET_BITS)))
    basic = counts.groupBy(key).agg(
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.sum("n").alias("count"), F.sum(F.col("v") * F.col("n")).alias("total"))
    per_bucket = counts.groupBy(key, "bucket").agg(F.sum("n").alias("bucket_n"))
    running = Window.partitionBy(key).orderBy("bucket")
    located = (per_bucket.withColumn("upto", F.sum("bucket_n").over(running))
               .join(basic.select(key, "count"), key)
               .withColumn("lo", F.shiftright(F.col("count") + 1, 1))
               .withColumn("hi", F.shiftright(F.col("count") + 2, 1))
               .withColumn("before", F.col("upto") - F.col("bucket_n"))
               .where((F.col("before") < F.col("hi")) & (F.col("upto") >= F.col("lo"))))
    inside = Window.partitionBy(key, "bucket").orderBy("v")
    middle = (counts.join(located.select(key, "bucket", "before", "lo", "hi"), [key, "bucket"])
              .withColumn("last", F.col("before") + F.sum("n").over(inside))
              .withColumn("first", F.col("last") - F.col("n") + 1)
              .groupBy(key).agg(
                  F.max(F.when((F.col("first") <= F.col("lo")) & (F.col("last") >= F.col("lo")), F.col("v"))).alias("low"),
                  F.max(F.when((F.col("first") <= F.col("hi")) & (F.col("last") >= F.col("hi")), F.col("v"))).alias("high")))
    return basic.join(middle, key).select(
        key, "min", "max", one_decimal(F.col("total"), F.col("count")).alias("avg"),
        ((F.col("low") + F.col("high")) / F.lit(2.0)).alias("median"))
