"""Mixing sources to target weights by hash thresholds.

Each document has a 60-bit hash of its content. A source whose target is r times its size takes every document
floor(r) times, and once more each document whose hash lies below the source's threshold, so that a smaller target takes a
subset of what a larger one takes. The threshold comes from sums of words by source and hash bucket: the bucket in which
the budget runs out is the only one looked into further, by more bits of the hash, until single hashes are left.
Nothing is sorted, and what is left in a boundary bucket shrinks by the number of buckets at each level.

Sources weigh ``weights``, repeating, in code point order, null last. Targets share the words of all sources; one beyond
``cap`` times its source's size stops there, and the excess goes to the others by weight until none is above.

Defined cases: null, empty and wordless texts have size 0 and follow their source's threshold; documents of equal id and text
fare alike, as do those whose hashes tie; at the boundary the group that ties is taken if half of it fits; an empty
table gives an empty mix."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from factwright.llm.common import WORD, carry, id_text
from factwright.operators.ordering import row_numbers
from factwright.session import cut

#: Bits of the hash that have been looked at after each level.
LEVELS = (8, 24, 60)


def size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash() -> Column:
    whole = F.md5(F.concat(id_text(), F.lit("\n"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(whole, 1, 15), 16, 10).cast("long")


def targets(rows: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source of rows (source, size): source, source_size, weight, target."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = sums.withColumn("all", F.lit(0))
    first = F.struct(F.col("source").isNull(), F.coalesce(F.substring("source", 1, 1), F.lit("")))
    ranked = row_numbers(one, ["all"], [F.col("source").isNull(), "source"], first, "rank").drop("all")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("most")))
    level = 0.0  # words per unit of weight
    while True:
        capped = F.col("most") < F.lit(level) * F.col("weight")
        total, held, free = sources.agg(
            F.sum(F.col("source_size").cast("double")), F.sum(F.when(capped, F.col("most")).otherwise(0.0)),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not free or (total - held) / free <= level:
            break
        level = (total - held) / free
    return sources.withColumn("target", F.round(F.least("most", F.lit(level) * F.col("weight")), 6))


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds to ``sources`` whole, the times that every document is taken, and limit, below which a hash is taken once more."""
    plan = sources.where("source_size > 0").withColumn("whole", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state = cut(plan.select("source", "budget", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below")).where("budget > 0"))
    left, seen = rows.select("source", "size", "hash"), 0
    for bits in LEVELS:
        last = bits == LEVELS[-1]
        s = state.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "budget", "below")
        within = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("hash", 60 - seen) == F.col("_bucket"))
        left = left.join(s, within).select("source", "size", "hash", "budget", "below")
        if seen:
            left = cut(left)
        hist = left.groupBy("source", F.shiftright("hash", 60 - bits).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("below").alias("below"))
        along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("below", F.col("below") + F.coalesce(F.sum("words").over(along), F.lit(0)))
        over = hist.where(F.col("below") + F.col("words") * (0.5 if last else 1.0) > F.col("budget"))
        outer = state.select("source", F.shiftleft(F.col("bucket") + 1, 60 - seen).alias("end"))
        state = cut(over.groupBy("source").agg(F.min_by(F.struct("budget", "bucket", "below"), "bucket").alias("b")).select("source", "b.*"))
        left, seen = left.select("source", "size", "hash"), bits
    inner = state.select(F.col("source").alias("_inner"), "bucket")
    found = outer.join(inner, F.col("source").eqNullSafe(F.col("_inner")), "left")
    # where the last group fits too, the boundary is the end of its bucket
    found = found.select(F.col("source").alias("_source"), F.coalesce("bucket", "end").alias("limit"))
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
    limit = F.when(F.col("budget") > 0, F.coalesce("limit", F.lit(1 << 60))).otherwise(0)
    return cut(joined.select("source", "source_size", "target", "whole", limit.alias("limit")))


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and copies, how often the mix takes the row, to rows with source, size and hash."""
    p = plan.withColumnRenamed("source", "_source")
    taken = F.coalesce(F.col("whole") + (F.col("hash") < F.col("limit")).cast("long"), F.lit(0).cast("long"))
    return rows.join(p, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("copies", taken).withColumn(
        "source_size", F.coalesce("source_size", F.lit(0).cast("long"))).withColumn("target", F.coalesce("target", F.lit(0.0))).drop("_source", "whole", "limit")


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    sized = carry(docs, _source=F.col("source"), size=size(), hash=mix_hash())
    rows = cut(sized.select(F.col("_source").alias("source"), "size", "hash"))
    p = thresholds(rows, targets(rows, weights, cap)).select("source", "whole", "limit")
    times = F.coalesce(F.col("whole") + (F.col("hash") < F.col("limit")).cast("long"), F.lit(0).cast("long"))
    taken = sized.join(p, F.col("source").eqNullSafe(F.col("_source")), "left").select("row", times.cast("int").alias("times"))
    return taken.where("times > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
