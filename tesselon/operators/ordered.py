"""Joins by order over range partitions: the next row at or after a key, for any number of equal beginnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tesselon.sources import files


def next_in_order(wanted: DataFrame, known: DataFrame, key: str, value: str, partitions: int | None = None) -> DataFrame:
    """(key, next, value): for each distinct key of ``wanted`` the smallest key of ``known`` that is not before it.

    ``known`` has one row for each key.  Both are dealt out together by ranges of keys, so that no key and
    no common beginning of keys gathers rows; in a range the next row is carried backwards, and what begins
    the ranges after it, a row for each range, closes its end.
    """
    spark = wanted.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = wanted.select(F.col(key).alias("k")).filter("k is not null").distinct().select("k", F.lit(0).alias("kind"), F.lit(None).cast(known.schema[value].dataType).alias("v"))
    both = asked.unionByName(known.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(1).alias("kind"), F.col(value).alias("v")))
    # kept, as the ranges must be the same for the rows and for their beginnings
    dealt = files.checkpointed(both.repartitionByRange(n, "k", "kind").withColumn("part", F.spark_partition_id()))
    one = F.when(F.col("kind") == 1, F.struct("k", "v"))
    backwards = Window.partitionBy("part").orderBy(F.desc("k"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    carried = dealt.select("part", "k", "kind", F.last(one, ignorenulls=True).over(backwards).alias("found")).filter("kind = 0")
    heads = dealt.groupBy("part").agg(F.min(one).alias("head"))  # a row for each range
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    after = heads.select("part", F.last("head", ignorenulls=True).over(later).alias("after"))
    found = carried.join(F.broadcast(after), "part").select("k", F.coalesce("found", "after").alias("f"))
    return found.select(F.col("k").alias(key), F.col("f.k").alias("next"), F.col("f.v").alias(value))
