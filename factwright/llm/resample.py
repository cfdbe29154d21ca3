"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled good and not toxic) and one of raw text (all documents),
give every document an importance weight: the ratio of its probabilities under them. Documents are drawn without replacement
in proportion to their weights by taking the k largest of log weight plus Gumbel noise.

N-grams are words, lower-cased, and runs of three bytes as they stand, each with a table of fixed size. A bucket whose counts do
not clearly differ has ratio 1. Sums of log ratios grow with length, so each is centred and divided by its spread
among good texts of that length; a document's log weight is ``SHARP`` times the lesser of both, so that it must be like the
target in both views.

The raw model counts every document. The target model uses at most ``SAMPLE`` labelled rows in expectation, drawn by the hash of
their ids; a fifth of them are held out, and k is the number of documents whose log weight, without noise, is above the cut that best tells
good from bad held-out rows, a lost good one counting ``LOSS`` times. Which k documents are drawn is up to the noise too. The k-th largest key is found by counts over ranges of
keys, refined where k falls, so that nothing is sorted or collected.

Defined cases: null, empty and wordless texts have the weight of a text of length 1 without evidence; without good or bad
held-out labels k is the number of documents; repeated rows share their key, and all rows that tie with the k-th are taken; a
label with a null quality or toxic does not count; of several labels of one id the worst counts."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factwright.llm import words as W
from factwright.llm.common import row_key, without
from factwright.session import cut

SAMPLE = 40_000
WORDS, BYTES = 1 << 16, 1 << 14
SMOOTH = 2.0
SHARP, LOSS = 4.0, 5.0
CLEAR = 4.0  # standard deviations by which a bucket's counts must differ to have a ratio other than 1


def _features(offsets, raw):
    """(text of each feature, bucket of each feature) for one block."""
    w = W.split(offsets, raw, W.LETTERS)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(w.bound))
    bucket = (w.hash & np.uint64(WORDS - 1)).astype(np.int32)
    if len(raw) < 3:
        return of, bucket
    x = raw.astype(np.uint32)
    tri = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 14)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:-2] == text[2:]
    return np.concatenate([of, text[:-2][inside]]), np.concatenate([bucket, tri[inside].astype(np.int32) + WORDS])


def sample(labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, good, held_out) of about ``bound`` labelled documents; a bound of memory for what is broadcast."""
    n = labels.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, bound / max(n, 1)))
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").where(chance)
    good = F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good")
    return rows.groupBy("doc_id").agg(good).withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0)


def ratios(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """Log of target over raw probability of every bucket. Counts are summed within tasks and then in Spark."""

    def count(batches):
        total = np.zeros((2, WORDS + BYTES), np.int64)
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False)
            for first, offsets, raw in W.blocks(batch.column("text")):
                of, bucket = _features(offsets, raw)
                total[0] += np.bincount(bucket, minlength=WORDS + BYTES)
                total[1] += np.bincount(bucket[target[first : first + len(offsets) - 1][of]], minlength=WORDS + BYTES)
        at = np.flatnonzero(total[0])
        for i in range(0, len(at), 10_000):
            k = at[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[0][k]), pa.array(total[1][k])], names=["bucket", "raw", "target"])

    mine = labelled.where("good = 1 and not held_out").select("doc_id", F.lit(True).alias("target"))
    rows = docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    sums = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = sums.toPandas()  # at most one row for each of WORDS + BYTES buckets
    raw, target = np.zeros(WORDS + BYTES), np.zeros(WORDS + BYTES)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    out = np.zeros(WORDS + BYTES)
    for part in (slice(0, WORDS), slice(WORDS, None)):
        r, t = raw[part], target[part]
        if not r.sum() or not t.sum():
            continue
        expected = r * (t.sum() / r.sum())
        sure = (t - expected) ** 2 > CLEAR**2 * (expected + 1)
        out[part] = np.where(sure, np.log((t + SMOOTH) / (expected + SMOOTH)), 0.0)
    return out


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Per document: doc_id, key, and for words and byte runs their number (n0, n1) and the sum of their log ratios (w0, w1)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches):
        for batch in batches:
            for first, offsets, raw in W.blocks(batch.column("text")):
                n = len(offsets) - 1
                of, bucket = _features(offsets, raw)
                out = []
                for part in (bucket < WORDS, bucket >= WORDS):
                    at = of[part]
                    out += [pa.array(np.bincount(at, minlength=n).astype(np.int64)), pa.array(np.bincount(at, weights=shared.value[bucket[part]], minlength=n))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("key").slice(first, n), *out], names=["doc_id", "key", "n0", "w0", "n1", "w1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    return keyed.mapInArrow(score, f"doc_id {kind}, key long, n0 long, w0 double, n1 long, w1 double")


def gumbel() -> Column:
    """Noise that depends on a row's content alone."""
    u = (F.shiftrightunsigned(F.xxhash64("key", F.lit("gumbel")), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def spread(total: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """(mean, s, t) of good texts: a sum over n features has mean n * mean and variance s^2 n + t^2 n^2. Medians, so that a
    few wrong labels do not matter; short texts give s, long ones t."""
    total, n = total[n > 0], n[n > 0].astype(float)
    if len(n) < 20:
        return 0.0, 1.0, 0.0
    mean = total.sum() / n.sum()
    m2 = (total / n - mean) ** 2
    s2 = max(float(np.median((n * m2)[n <= np.median(n)])) / 0.455, 1e-6)
    longer = n >= np.quantile(n, 0.75)
    t2 = max(0.0, float(np.median((m2 - s2 / n)[longer])) / 0.455)
    return float(mean), s2**0.5, t2**0.5


def log_weight(views: list[tuple[float, float, float]]) -> Column:
    z = []
    for i, (mean, s, t) in enumerate(views):
        n = F.greatest(F.col(f"n{i}"), F.lit(1)).cast("double")
        z.append((F.col(f"w{i}") - mean * F.col(f"n{i}")) / F.sqrt(s * s * n + t * t * n * n))
    return SHARP * F.least(*z)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the largest sum of LOSS times the share of good rows above it and the share of bad rows below it, in the
    middle of its gap; minus infinity where either side is empty."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    good, bad = np.sort(good), np.sort(bad)
    worth = LOSS * (1 - np.searchsorted(good, values, "left") / len(good)) + np.searchsorted(bad, values, "left") / len(bad)
    best = int(np.argmax(worth))
    return float(values[0]) - 1 if best == 0 else float(values[best - 1] + values[best]) / 2


def top(scored: DataFrame, k: int, column: str = "draw") -> Column:
    """Whether a row is among the k largest of a column: the range of values is cut into 1,024, the part that holds the
    k-th is cut again, until it holds one value. Every pass is one aggregate."""
    n, lo, hi = scored.agg(F.count(column), F.min(column), F.max(column)).first()
    if k >= n:
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    above = 0
    while lo < hi:
        width = (hi - lo) / 1024
        within = scored.where(F.col(column).between(lo, hi))
        part = F.least(F.floor((F.col(column) - lo) / width), F.lit(1023)) if width > 0 else F.lit(0)
        parts = within.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).toPandas()
        parts = parts.sort_values("part", ascending=False)
        at = int(np.argmax(above + parts["n"].cumsum().to_numpy() >= k))
        above += int(parts["n"].iloc[:at].sum())
        before, (lo, hi) = (lo, hi), (float(parts["lo"].iloc[at]), float(parts["hi"].iloc[at]))
        if before == (lo, hi) and len(parts) == 1:
            break
    return F.col(column) >= F.lit(lo)


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, key, n_words, log_weight, draw (log weight and noise), kept."""
    labelled = cut(sample(labels, bound))
    sums = cut(weigh(docs, ratios(docs, labelled)))
    # the sample bounds what comes here; of repeated ids every row is judged
    held_out = F.broadcast(labelled.where("held_out").select("doc_id", "good"))
    held: pd.DataFrame = sums.join(held_out, "doc_id").toPandas()
    good = held["good"] == 1
    views = [spread(held.loc[good, f"w{i}"].to_numpy(), held.loc[good, f"n{i}"].to_numpy()) for i in range(2)]
    scored = sums.withColumn("log_weight", log_weight(views)).withColumn("draw", F.col("log_weight") + gumbel())
    scored = cut(scored.select("doc_id", "key", F.col("n0").alias("n_words"), "log_weight", "draw"))
    weights = scored.join(held_out, "doc_id").select("good", "log_weight").toPandas()
    good = weights["good"] == 1
    least = best_cut(weights.loc[good, "log_weight"].to_numpy(), weights.loc[~good, "log_weight"].to_numpy())
    k = scored.where(F.col("log_weight") >= F.lit(least)).count()
    return scored.withColumn("kept", top(scored, k))


def keep(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """The documents drawn."""
    return without(docs, classify(docs, labels, bound).where("not kept"))
