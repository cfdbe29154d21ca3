"""Hard negatives by cluster lists with certified ends.

Anchors are put in clusters around centroids fitted on a bounded sample of them. Per cluster a task sorts its candidates once by an
upper bound on their score with any member: |candidate| * cos(max(0, angle to the centroid - widest angle of a member)), times the
member's own length. Every member walks that list in chunks until nothing behind can change its rows: the bound of the next chunk
is below its last kept score, or below the least score that counts. So results are exact, whatever the clusters are like.

Two walks follow each other: one over rows of the anchor's label gives its positives, one over rows of other labels the negatives
below each positive. Anchors come in groups of about ``GROUP`` components, each broadcast (its size is checked) and held against all
candidates in blocks of ``LIST`` components, so that no candidate is shuffled; only what tasks keep for an anchor is, and it is merged by
two aggregations.

Scores are exact: 64-bit floats hold integer products up to 2^53, and rows that could pass this take the same walk in Python
integers; a score beyond the range of a long counts as the nearest long.

Defined cases: rows with a null label, a null vector or a component that is null, NaN or infinite take no part; a shorter vector
counts as filled up with zeros, an empty one scores 0; a null id is no anchor, is not divisible by 7 and comes after all others in ties;
equal rows are rows of their own, each with its own partners; anchors without a positive, and positives without a negative in the
band, give no rows; empty tables give none."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factwright.session import cut, union_all

GROUP = 1 << 21  # components of anchors that are broadcast at once (16 MB), in expectation; over twice as many and 64 anchors is an error
SAMPLE = 8_192  # anchors of a group that centroids are fitted on
LIST = 1 << 22  # components of candidates in one task's list (32 MB)
FAN = 256  # groups in which the rows that tasks keep for an anchor are merged first
CHUNK = 1_024  # candidates that members step over at once
EXACT = 2.0**52
LAST = 2**63 - 1


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part: id, label, vector (array of doubles)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v")).where(
        F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(True)))


def scaled(rows: DataFrame, factor: int = 256) -> DataFrame:
    """Components as whole numbers: floor(factor * x)."""
    most = 1.7e308
    times = lambda x: F.greatest(F.least(x * F.lit(float(factor)), F.lit(most)), F.lit(-most))
    down = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    return rows.withColumn("v", F.transform("v", times)).withColumn("v", F.transform("v", down))


def keyed(rows: DataFrame) -> DataFrame:
    """Adds ``key``, equal for equal rows only (but for chance), which tells an anchor from other rows of its id."""
    return rows.withColumn("key", F.xxhash64("id", "label", "v"))


class Vectors:
    """Rows of one block: ids, labels, keys, a matrix of whole numbers, lengths, and whether each may pass 2^53 in a product."""

    def __init__(self, ids, labels, keys, offsets, values, width):
        n = len(ids)
        self.id, self.label, self.key = ids, labels, keys
        size = np.diff(offsets)
        m = np.zeros((n, width))
        row = np.repeat(np.arange(n), size)
        place = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)
        inside = place < width
        m[row[inside], place[inside]] = values[inside]
        self.m = m
        most = np.maximum(np.abs(m).max(axis=1, initial=0), 1)[:, None]
        with np.errstate(over="ignore"):
            self.length = np.sqrt(((m / most) ** 2).sum(axis=1)) * most[:, 0]
        self.large = ~(self.length < math.sqrt(EXACT / CHUNK))

    @classmethod
    def of(cls, batch: pa.RecordBatch, width: int | None = None):
        v = batch.column("v")
        offsets = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        ids = batch.column("id").fill_null(LAST).to_numpy(zero_copy_only=False)
        width = int(np.diff(offsets).max(initial=0)) if width is None else width
        return cls(ids, batch.column("label").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False), offsets, v.flatten().to_numpy(zero_copy_only=False), width)


def centroids(unit: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means on a bounded sample; about the root of the members' number."""
    some = unit[:: max(1, -(-len(unit) // SAMPLE))]
    k = max(1, int(math.sqrt(len(some))))
    c = some[np.linspace(0, len(some) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (some @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, some)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def unit_rows(v: Vectors) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        most = np.abs(v.m).max(axis=1, initial=0)
        m = np.where(most[:, None] > 0, v.m / most[:, None], 0.0)
        return np.where(most[:, None] > 0, m / np.sqrt((m * m).sum(axis=1))[:, None], 0.0)


class Clusters:
    """Members of each cluster and the widest angle between a member and the centroid."""

    def __init__(self, anchors: Vectors):
        unit = unit_rows(anchors)
        self.c = centroids(unit) if len(unit) else np.zeros((0, anchors.m.shape[1]))
        near = unit @ self.c.T
        own = near.argmax(axis=1) if len(unit) else np.zeros(0, int)
        angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
        self.members = [np.flatnonzero(own == k) for k in range(len(self.c))]
        self.wide = np.array([angle[m].max() if len(m) else 0.0 for m in self.members])

    def bounds(self, k: int, unit: np.ndarray) -> np.ndarray:
        """Upper bound on the cosine of each candidate with any member, a little above it for the sake of rounding."""
        angle = np.arccos(np.clip(unit @ self.c[k], -1, 1))
        return np.minimum(np.cos(np.maximum(angle - self.wide[k], 0)) + 1e-6, 1.0)


def products(a: Vectors, rows: np.ndarray, x: Vectors, columns: np.ndarray) -> np.ndarray:
    """Exact inner products: as int64 where floats hold them, else as Python integers."""
    if not (a.large[rows].any() or x.large[columns].any()):
        return (a.m[rows] @ x.m[columns].T).astype(np.int64)
    whole = lambda m: np.array([[int(y) for y in r] for r in m], object).reshape(m.shape)
    return np.minimum(np.maximum(whole(a.m[rows]) @ whole(x.m[columns]).T, -LAST - 1), LAST)


def _no(kind):
    return np.int64(-(2**62)) if kind == np.int64 else -(10**400)


def best(score: np.ndarray, allowed: np.ndarray, k: int):
    """(row, column) of the k largest allowed scores of each row; columns are in the order that decides ties."""
    n = score.shape[1]
    order = score * n + np.arange(n - 1, -1, -1)
    order = np.where(allowed, order, _no(score.dtype))
    if n > k:
        if order.dtype == object:
            at = np.array([sorted(range(n), key=r.__getitem__, reverse=True)[:k] for r in order]).reshape(len(order), k)
        else:
            at = np.argpartition(order, n - k, axis=1)[:, n - k :]
    else:
        at = np.broadcast_to(np.arange(n), (len(order), n))
    row = np.repeat(np.arange(len(order)), at.shape[1])
    ok = allowed[row, at.reshape(-1)]
    return row[ok], at.reshape(-1)[ok]


class Kept:
    """The k best (score, id, key) found so far for each member and slot. ``least`` and ``most`` bound the scores that count, ``last`` is
    the score that a candidate must reach: minus infinity while there is room, infinity where a member has no such slot."""

    def __init__(self, bands: list, k: int):
        n, slots = len(bands), max(map(len, bands), default=0)
        ends = [e for b in bands for pair in b for e in pair if e is not None]
        kind, far = (np.int64, LAST) if all(abs(e) < EXACT for e in ends) else (object, LAST + 1)
        self.k, self.rows = k, {}
        self.least, self.most = np.full((n, slots), far, kind), np.full((n, slots), -far, kind)
        self.last = np.full((n, slots), np.inf)
        for i, b in enumerate(bands):
            for j, (lo, hi) in enumerate(b):
                self.least[i, j], self.most[i, j], self.last[i, j] = -far if lo is None else lo, far if hi is None else hi, -np.inf

    def open(self, members: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Members that a candidate with a score up to ``bound`` could still give a row to."""
        least = np.clip(self.least[members], -1e300, 1e300).astype(float)
        return ((bound[:, None] >= least) & (bound[:, None] >= self.last[members])).any(axis=1)

    def add(self, member, slot, scores, ids, keys):
        for a, score, i, key in zip(member.tolist(), scores.tolist(), ids.tolist(), keys.tolist()):
            own = self.rows.setdefault((a, slot), [])
            own.append((-score, i, key))
            if len(own) >= self.k:
                own.sort()
                del own[self.k :]
                last = -own[-1][0]  # as a float, rounded down
                self.last[a, slot] = last if abs(last) <= 2**53 else np.nextafter(float(last), -np.inf)


def walk(anchors: Vectors, clusters: Clusters, x: Vectors, same_label: bool, kept: Kept) -> int:
    """Walks every cluster's list over the candidates ``x``. Gives the number of pairs that were scored."""
    unit, steps = unit_rows(x), 0
    for k, members in enumerate(clusters.members):
        members = members[np.isfinite(kept.last[members]).any(axis=1) | np.isneginf(kept.last[members]).any(axis=1)]
        if not len(members) or not len(x.id):
            continue
        with np.errstate(all="ignore"):
            top = np.nan_to_num(clusters.bounds(k, unit) * x.length, nan=np.inf, neginf=np.inf)
        order = np.argsort(-top, kind="stable")
        for at in range(0, len(order), CHUNK):
            step = order[at : at + CHUNK]
            with np.errstate(all="ignore"):
                bound = top[order[at]] * anchors.length[members]
                bound = np.nan_to_num(bound + np.abs(bound) * 1e-9 + 1, nan=np.inf, neginf=np.inf)
            members = members[kept.open(members, bound)]
            if not len(members):
                break
            steps += len(members) * len(step)
            step = step[np.argsort(x.id[step], kind="stable")]
            score = products(anchors, members, x, step)
            fits = (anchors.label[members][:, None] == x.label[step][None, :]) == same_label
            for j in range(kept.last.shape[1]):
                sides = ((np.greater_equal, kept.least), (np.less_equal, kept.most), (np.greater_equal, kept.last))
                allowed = fits.copy()
                for side, edge in sides:
                    allowed &= side(score, edge[members, j][:, None]).astype(bool)
                row, column = best(score, allowed, kept.k)
                kept.add(members[row], j, score[row, column], x.id[step[column]], x.key[step[column]])
    return steps


def _walks(candidates: DataFrame, shared, same_label: bool, k: int) -> DataFrame:
    """(part, anchor, slot, id, key, score) of what each task keeps."""

    def run(batches):
        from pyspark import TaskContext

        group, part = shared.value, TaskContext.get().partitionId()
        anchors, kept, held, n = group["anchors"], Kept(group["bands"], k), [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            walk(anchors, group["clusters"], Vectors.of(t.to_batches()[0], anchors.m.shape[1]), same_label, kept)

        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n * max(anchors.m.shape[1], 1) >= LIST:
                flush()
                held, n = [], 0
        if held:
            flush()
        out = [(part, a, j, None if i == LAST else i, key, -score) for (a, j), rows in kept.rows.items() for score, i, key in rows]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10_000]), kinds)], names=["part", "anchor", "slot", "id", "key", "score"])

    return candidates.mapInArrow(run, "part int, anchor int, slot int, id long, key long, score long")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best per (anchor, slot) in order, first of ``FAN`` groups of tasks, then of these."""
    order = F.struct((-F.col("score").cast("decimal(20,0)")).alias("low"), F.col("id").isNull().alias("no_id"), "id", "key", "score")
    first = found.groupBy("anchor", "slot", F.pmod("part", F.lit(FAN)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return first.groupBy("anchor", "slot").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def mine(candidates: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Both frames hold
    (id, label, v, key) with whole components; anchors are rows of the candidates."""
    spark = candidates.sparkSession
    each = cut(anchors.groupBy("id", "label", "v", "key").agg(F.count(F.lit(1)).alias("copies")))
    n, width = each.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    size = max(1, GROUP // max(width, 1))
    found = [
        _mine_group(candidates, each.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).limit(2 * size + 65).toArrow(), 2 * size + 64, positives, negatives, least_percent)
        for groups in [max(1, -(-n // size))] for g in range(groups)]
    return union_all(found)


def _mine_group(candidates, table: pa.Table, most: int, positives: int, negatives: int, least_percent: int) -> DataFrame:
    if len(table) > most:
        raise ValueError(f"a group of anchors is over {most}")
    spark = candidates.sparkSession
    batch = pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], names=table.column_names)
    members = Vectors.of(batch)
    clusters, copies = Clusters(members), batch.column("copies").to_pylist()
    group = {"anchors": members, "clusters": clusters, "bands": [[(None, None)]] * len(members.id)}
    # one more than asked for, as an anchor's own row is among its neighbours
    near = _merge(_walks(candidates, spark.sparkContext.broadcast(group), True, positives + 1), positives + 1).collect()
    ids, chosen = batch.column("id").to_pylist(), {}
    for r in near:
        rows, own = list(r.best), int(members.key[r.anchor])
        at = next((i for i, b in enumerate(rows) if b.key == own), None)
        if at is not None:
            del rows[at]
        chosen[r.anchor] = [(b.id, b.score) for b in rows[:positives]]
    edges = [sorted({s for _, s in chosen.get(a, [])}, reverse=True) for a in range(len(ids))]
    group = dict(group, bands=[[(-(-least_percent * s // 100), s) for s in own] for own in edges])
    found = _merge(_walks(candidates, spark.sparkContext.broadcast(group), False, negatives), negatives)
    pairs = [(a, edges[a].index(s), ids[a], i, s, copies[a]) for a, own in chosen.items() for i, s in own]
    wanted = spark.createDataFrame(pairs, "anchor int, slot int, anchor_id long, positive_id long, positive_score long, copies long")
    each = wanted.join(found, ["anchor", "slot"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    found = each.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "b")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"), "positive_score", F.col("b.score").alias("negative_score"))
    return cut(found)


def label_noise(label: Column, vec_id: Column, every: int = 7, labels: int = 10) -> Column:
    """Labels with a stated error: where the id is divisible by ``every``, the next label."""
    return F.when(vec_id % every == 0, (label + 1) % labels).otherwise(label)
