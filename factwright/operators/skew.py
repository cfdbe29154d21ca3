"""Joins on a key of which a few values hold a large share of one side's rows."""

from pyspark.sql import DataFrame, functions as F

from factwright.session import cut

SHARE = 1 / 512  # of the rows, above which a key counts as heavy: there are fewer than 512 such keys
LEAST = 10_000  # rows that a heavy key has at least
SALTS = 32


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The keys with more than ``share`` of the rows: fewer than 1 / ``share`` of them, however many rows there are."""
    counts = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total), F.col("n") > F.col("total") * share).select(key, F.lit(True).alias("__heavy"))


def spread_join(many: DataFrame, few: DataFrame, key: str, share: float = SHARE, least: int = LEAST, salts: int = SALTS) -> DataFrame:
    """Inner join of ``many`` and ``few`` on ``key``. Heavy keys of ``many`` are dealt over ``salts`` tasks, to each of which the rows of
    ``few`` under such a key go; all other rows move once."""
    heavy = F.broadcast(cut(heavy_keys(many, key, share, least)))
    # a row's salt follows from its content, so that a repeated task deals it alike
    dealt = F.when(F.col("__heavy"), F.pmod(F.xxhash64(*many.columns), F.lit(salts))).otherwise(0).cast("int")
    copies = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(heavy, key, "left").withColumn("__salt", dealt).drop("__heavy")
    right = few.join(heavy, key, "left").withColumn("__salt", F.explode(copies)).drop("__heavy")
    return left.join(right, [key, "__salt"]).drop("__salt")
