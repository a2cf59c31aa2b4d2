"""Checks of outputs: equality as multisets of records, and order against an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_digest(columns: list[str]) -> Column:
    """SHA-256 of the columns as text; lengths go before the values, so no two records share one text, and null differs from empty."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(",", *parts), 256)


def multiset_difference(one: DataFrame, two: DataFrame, columns: list[str]) -> DataFrame:
    """(digest, in_one, in_two) of the records that are not as often in one as in two; empty if the multisets are equal.

    One shuffle of digests, summed before it: +1 for a record of one, -1 for one of two.
    """
    own = lambda df, a, b: df.select(record_digest(columns).alias("digest"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    sums = own(one, 1, 0).unionByName(own(two, 0, 1)).groupBy("digest").agg(F.sum("a").alias("in_one"), F.sum("b").alias("in_two"))
    return sums.where("in_one <> in_two")


def out_of_order(output: DataFrame, source: DataFrame, key: str, order: str = "idx") -> DataFrame:
    """Rows of output whose predecessor (by output's `order`) comes later in source: key, the two places in source.

    The predecessor is found in ranges: each row of a range looks back one row, then the ranges' first rows look back among the first
    and last rows of all ranges, two a range. Rows are dealt to ranges once in the plan: bounds are sampled, and a second time may differ.
    """
    placed = output.select(F.col(order).alias("at"), F.col(key).alias("key")).join(source.select(F.col(key).alias("key"), F.col(order).alias("place")), "key")
    ranged = placed.repartitionByRange("at").withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("part").orderBy("at")
    seen = ranged.select("*", F.lag("place").over(own).alias("before"), F.row_number().over(own).alias("nth"), F.lead(F.lit(True), 1, False).over(own).alias("more"))
    kept = seen.where("before > place OR nth = 1 OR NOT more").withColumn("edge", F.expr("CASE WHEN nth = 1 OR NOT more THEN -1 ELSE part END"))
    carried = F.lag("place").over(Window.partitionBy("edge").orderBy("at"))
    rows = kept.withColumn("carried", carried).withColumn("before", F.when(F.col("nth") == 1, F.col("carried")).otherwise(F.col("before")))
    return rows.where("before > place").select(F.col("key").alias(key), "place", "before")
