"""Sharding by sampled splitters, with shards of near equal bytes.

A record's key is the hash of its text (its high bits) and of its id (its low ones), so that equal texts lie together. A
sample in proportion to size gives splitters at equal steps of bytes, which cut the keys into many ranges. The
ranges are then measured exactly; those of more than twice their share, which hold few distinct keys, are
subdivided by another hash of the id. Whole ranges in key order make up the shards, so that a shard's bytes are off by a range
at most. A splitter inside a group of equal texts moves to its begin, unless the group fills several ranges.

Only DataFrame functions are used. To the driver come the splitters, ``ranges`` at most. Records are numbered within
their ranges, ranges by the sums of those before.

Defined cases: a null or empty text has size 1; nulls share one key group; repeated rows tie and lie together, in any order
among themselves; an empty table gives no rows; with fewer records than shards some stay empty."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from factwright.llm.common import carry, id_text
from factwright.session import cut

ID_BITS = 23
SAMPLES = 8  # expected sampled records of each range


def size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def key() -> Column:
    group = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()), 1)
    by_id = F.shiftrightunsigned(F.xxhash64(id_text(), F.lit("place")), 64 - ID_BITS)
    return F.shiftleft(F.shiftright(group, ID_BITS), ID_BITS).bitwiseOR(by_id)


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Keys at equal steps of bytes, from a sample that holds a record with probability ``rate * size``. The sample has
    ``ranges * SAMPLES`` records on average whatever the size of the table."""
    rate = ranges * SAMPLES / total
    chance = F.shiftrightunsigned(F.xxhash64("_key", "_tie", F.lit("sample")), 11) / float(1 << 53)
    sample = rows.where(chance < F.col("_size") * F.lit(rate)).select("_key", F.greatest(F.col("_size").cast("double"), F.lit(1 / rate)).alias("bytes"))
    along = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = sample.withColumn("upto", F.sum("bytes").over(along)).withColumn("all", F.sum("bytes").over(Window.partitionBy()))
    step = F.ceil(F.col("upto") * ranges / F.col("all"))
    cuts = [r[0] for r in placed.groupBy(step.alias("step")).agg(F.max("_key").alias("k")).orderBy("step").select("k").collect()][:-1]
    groups = [c >> ID_BITS for c in cuts]
    heavy = {g for g, following in zip(groups, groups[1:]) if g == following}
    return sorted({c if g in heavy else g << ID_BITS for c, g in zip(cuts, groups)})


def _range(cuts: list[int]) -> Column:
    """The number of splitters at or below a key, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    array = F.lit(cuts).cast("array<bigint>")

    def further(at, step):
        ahead = at + step
        return F.when((ahead <= len(cuts)) & (F.get(array, ahead - 1) <= F.col("_key")), ahead).otherwise(at)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), further)


def keyed(docs: DataFrame) -> DataFrame:
    return carry(docs, _size=size(), _key=key(), _tie=F.xxhash64(id_text(), F.lit("tie")))


def place(rows: DataFrame, shards: int = 8, ranges_per_shard: int = 256) -> DataFrame:
    """Of ``keyed`` rows: row, shard, and slot, gapless from 0 in every shard."""
    narrow = cut(rows.select("_size", "_key", "_tie"))
    total = narrow.agg(F.sum("_size")).first()[0] or 1
    cuts = splitters(narrow, total, shards * ranges_per_shard)
    share = total / (shards * ranges_per_shard)

    ranged = narrow.withColumn("_range", _range(cuts))
    parts = ranged.groupBy("_range").agg(F.sum("_size").alias("bytes")).select(
        "_range", F.when(F.col("bytes") > 2 * share, F.ceil(F.col("bytes") / share)).otherwise(1).alias("parts"))
    parts = cut(parts)
    part = F.pmod("_tie", "parts").cast("int").alias("_part")
    units = ranged.join(F.broadcast(parts), "_range").groupBy("_range", part).agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("bytes") / 2
    units = units.withColumn("shard", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int"))
    inside = Window.partitionBy("shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    units = cut(units.withColumn("offset", F.coalesce(F.sum("n").over(inside), F.lit(0))))

    # parts and units are bounded by the number of ranges: at most three times as many
    placed = rows.withColumn("_range", _range(cuts)).join(F.broadcast(parts), "_range").withColumn("_part", part)
    placed = placed.join(F.broadcast(units.select("_range", "_part", "shard", "offset")), ["_range", "_part"])
    order = Window.partitionBy("_range", "_part").orderBy("_key", "_tie")
    return placed.select("row", "shard", (F.col("offset") + F.row_number().over(order) - 1).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 8, ranges_per_shard: int = 256) -> DataFrame:
    """Adds shard and slot to documents, in place of columns of these names."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return place(keyed(docs), shards, ranges_per_shard).select(*own, "shard", "slot")
