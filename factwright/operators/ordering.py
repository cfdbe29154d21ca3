"""Ordered neighbours and positions without one task per key.

A plain window sorts all rows of a key in one task, and one log may hold a third of all rows. Here a
key is cut into buckets along its order (a day, a block of positions). Rows are windowed inside
(key, bucket); what has to cross a bucket border is one aggregated row per bucket.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def row_numbers(df: DataFrame, keys, order, bucket: Column, name: str = "seq") -> DataFrame:
    """1-based position of each row within ``keys`` by ``order``. ``bucket`` must not decrease along
    the order."""
    keys, order = list(keys), list(order)
    df = df.withColumn("__bucket", bucket)
    sizes = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order)
    return (
        df.join(offsets, [*keys, "__bucket"])
        .withColumn(name, F.row_number().over(inside) + F.col("__off"))
        .drop("__bucket", "__off")
    )


def previous(df: DataFrame, keys, order, bucket: Column, columns) -> DataFrame:
    """Adds ``prev_<c>`` of the row before, within ``keys`` by ``order``."""
    keys, order, columns = list(keys), list(order), list(columns)
    df = df.withColumn("__bucket", bucket)
    lasts = df.groupBy(*keys, "__bucket").agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("__last")
    )
    along = W.partitionBy(*keys).orderBy("__bucket")
    carried = lasts.select(*keys, "__bucket", F.lag("__last").over(along).alias("__carry"))
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order)
    out = df.join(carried, [*keys, "__bucket"]).withColumn(
        "__prev", F.coalesce(F.lag(F.struct(*columns)).over(inside), F.col("__carry"))
    )
    return out.select(
        *[c for c in df.columns if c != "__bucket"],
        *[F.col(f"__prev.{c}").alias(f"prev_{c}") for c in columns],
    )


def first_named(events: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per ``__fact`` (:func:`factwright.functions.envelopes.id_key`) of ``facts`` that an event names. Copies are
    dropped after the join, so that the facts no event names move once and no further."""
    return facts.join(events.select("__fact"), "__fact", "left_semi").dropDuplicates(["__fact"])
