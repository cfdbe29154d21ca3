"""Near-duplicate groups by b-bit MinHash.

One pass over the texts gives each document the number of its distinct shingles, a 128-bit hash of the set, minima
of ``ROWS`` permutations a band folded into a hash per band, and the two low bits of ``SLOTS`` minima, packed. Documents of
equal sets form a class, and only classes are compared. Classes that share a band are candidates; the packed bits give
an estimate of their similarity, corrected for bits that agree by chance, which discards those far below the
threshold. What is left is confirmed on the full sets.

No bucket is expanded into its pairs. Its members are first compared with one hub, the class that shares most
buckets (the text that edited copies come from, as a rule). Only members which that leaves in different components are compared
further, in blocks of bounded size: the packed bits first, then the full sets. A pair is looked at in the first bucket
that it shares, and only links that join two components become rows.

Defined cases: a null, empty or wordless text has no shingles and no links; a text of fewer words than a shingle has
one shingle, the whole sequence; documents without id get the least id of their group, or null, and are never kept;
repeated rows share their group and their verdict.

The number of bands follows the threshold: a pair right at it shares no band with probability ``MISS`` at most (2e-6 at 0.85 with
28 bands, 3e-5 at 0.8 with 34), less above; a component with more than one link to a document makes a miss rarer still. No pair that
shares a band is lost. The estimate's margin is over five standard deviations."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factwright.llm import words as W
from factwright.llm.common import carry, components, in_arrow, row_key, without
from factwright.session import cut

BANDS, ROWS = 28, 6  # bands at least
MISS = 4e-5
SLOTS = 160  # minima whose two low bits are kept, 32 to a long
LONGS = SLOTS // 32
MARGIN = 0.2
BLOCK = 1024  # members of a bucket that one group compares with as many others
BLOCK_SHINGLES = 1 << 20  # and their shingles

_LOW = [f"s{i}" for i in range(LONGS)]


def band_count(percent: int) -> int:
    """Bands with which a pair at the threshold shares none with probability MISS at most."""
    return BANDS if percent >= 100 else max(BANDS, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS))))


def _permutations(bands: int) -> np.ndarray:
    return (np.random.default_rng(20240607).integers(0, 1 << 31, bands * ROWS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def _band(bands: int) -> list[str]:
    return [f"b{i}" for i in range(bands)]


def _minima(u: np.ndarray, permutations: np.ndarray) -> np.ndarray:
    x = (u >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(permutations), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[None, i : i + 1024] * permutations[:, None]).min(axis=1), out=out)
    return out


def _bands(minima: np.ndarray) -> np.ndarray:
    """A hash per document and band. minima: documents by permutations."""
    m = minima.reshape(len(minima), minima.shape[1] // ROWS, ROWS).astype(np.uint64)
    out = np.tile(np.arange(1, m.shape[1] + 1, dtype=np.uint64), (len(m), 1))
    for i in range(ROWS):
        out = W.mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, :, i])
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """The two low bits of the mixed minima, 32 to a 64-bit value."""
    low = (W.mix(minima[:, :SLOTS].astype(np.uint64)) & np.uint64(3)).reshape(len(minima), LONGS, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def signatures(docs: DataFrame, size: int, bands: int = BANDS) -> DataFrame:
    """Per row of (doc_id, text): key, n_shingles, the hash of the set (h1, h2), band hashes and packed bits."""
    names, permutations = _band(bands) + _LOW, _permutations(bands)
    schema = "doc_id long, key long, n_shingles long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in names)

    def each(batch):
        ids, keys = batch.column("doc_id"), batch.column("key")
        for first, offsets, raw in W.blocks(batch.column("text")):
            w = W.split(offsets, raw)
            n = len(offsets) - 1
            count, h1, h2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            minima = np.full((n, len(permutations)), 0xFFFFFFFF, np.uint32)
            for i in range(n):
                u = W.shingles(w.hash[w.bound[i] : w.bound[i + 1]], size)
                if len(u):
                    count[i], h1[i], h2[i] = len(u), u.sum(dtype=np.uint64), W.mix(u).sum(dtype=np.uint64)
                    minima[i] = _minima(u, permutations)
            cols = [ids.slice(first, n), keys.slice(first, n), pa.array(count), W.signed(h1), W.signed(h2)]
            banded, packed = _bands(minima), _packed(minima)
            cols += [W.signed(np.ascontiguousarray(banded[:, i])) for i in range(bands)]
            cols += [W.signed(np.ascontiguousarray(packed[:, i])) for i in range(LONGS)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_shingles", "h1", "h2", *names])

    return in_arrow(docs.select("doc_id", "text", row_key("doc_id", "text").alias("key")), schema, each)


def estimate(left: str, right: str) -> Column:
    """Similarity by the bits that agree, corrected for the quarter that agrees by chance."""
    differ = F.lit(0)
    for c in _LOW:
        x = F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return (1 - differ / SLOTS - 0.25) / 0.75


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """Per row of (node, text): node, shingles, the sorted hashes of its set, 8 bytes each."""

    def each(batch):
        for first, offsets, raw in W.blocks(batch.column("text")):
            w = W.split(offsets, raw)
            sets = [W.shingles(w.hash[w.bound[i] : w.bound[i + 1]], size).tobytes() for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, len(sets)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return in_arrow(docs.select("node", "text"), "node long, shingles binary", each)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= percent * union."""

    def each(batch):
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return in_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b"), "a long, b long", each)


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether sizes and packed bits allow the similarity asked for."""
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (estimate(x, y) >= percent / 100 - MARGIN)


def _passing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that may be as similar as asked for."""
    cols = ["node", "n_shingles", *_LOW]
    x, y = classes.select(*cols).alias("x"), classes.select(*cols).alias("y")
    joined = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    return joined.where(_alike("x", "y", percent)).select("a", "b")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component yet: (bucket, node, component)."""
    own = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = own.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return own.join(mixed, "bucket")


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``estimate`` for packed bits a against each row of b."""
    x = b ^ a
    return (1 - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int32) / SLOTS - 0.25) / 0.75


def _links(rows: pa.Table, percent: int, band: list[str]) -> list[tuple[int, int]]:
    """Links between the components of one group's members, enough to join all that are linked. A pair is looked at in
    the first bucket that it shares. Members of one block are compared among themselves, of two with the other's."""
    block, node, comp, n = (rows.column(c).to_numpy() for c in ("block", "node", "component", "n_shingles"))
    bits = np.stack([rows.column(c).to_numpy() for c in _LOW], axis=1).view(np.uint64)
    bands = np.stack([rows.column(c).to_numpy() for c in band], axis=1)
    here = int(np.argmax(bands[0] == rows.column("bucket")[0].as_py()))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    ids = np.split(ids, ends[:-1])
    lone = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out, mine, flag = [], comp.copy(), np.zeros(len(values), np.int32)
    counts = {c: k for c, k in zip(*np.unique(comp, return_counts=True))}
    order = sorted(range(len(node)), key=lambda k: (counts[comp[k]], node[k]))  # members of small components first
    done = np.zeros(len(node), bool)
    for a in order:
        done[a] = True
        other = (mine != mine[a]) & ~done & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
        if not lone:
            other &= block != block[a]
        b = np.flatnonzero(other)
        b = b[_estimates(bits[a], bits[b]) >= percent / 100 - MARGIN]
        b = b[np.argmax(bands[b] == bands[a], axis=1) == here]
        if not len(b):
            continue
        flag[ids[a]] = 1
        both = np.add.reduceat(flag[np.concatenate([ids[k] for k in b])], np.concatenate([[0], np.cumsum(n[b])[:-1]]))
        flag[ids[a]] = 0
        linked = False
        for k in b[100 * both >= percent * (n[b] + n[a] - both)]:
            x, y = find(comp[a].item()), find(comp[k].item())
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((node[a].item(), node[k].item()))
                linked = True
        if linked:
            mine = np.array([find(c) for c in comp.tolist()])
    return out


def _blockwise(apart: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact links between components that share a bucket. A bucket is dealt to groups of at most two blocks of
    about BLOCK members and BLOCK_SHINGLES shingles, so that each pair of blocks meets once; only links become rows."""
    band = _band(band_count(percent))
    own = apart.join(classes.select("node", "n_shingles", *_LOW, *band), "node").join(sets, "node")
    many = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    sizes = apart.join(classes.select("node", "n_shingles"), "node").groupBy("bucket").agg(F.ceil(many).alias("blocks"))
    dealt = own.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    keys = ["bucket", "i", "j"]
    dealt = dealt.select(*keys, "block", "node", "component", "n_shingles", *_LOW, *band, "shingles").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held, last = [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            k = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            starts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for x, y in zip(starts, starts[1:]):
                if x == y:
                    continue
                key = tuple(k[x].tolist())
                if key != last and held:
                    yield from emit(held)
                    held = []
                held.append(table.slice(x, y - x))
                last = key
        if held:
            yield from emit(held)

    def emit(held):
        out = _links(pa.concat_tables(held).combine_chunks(), percent, band)
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of (doc_id, text): doc_id, key (see ``row_key``), n_shingles, component_id, the least doc_id reachable."""
    bands = band_count(percent)
    rows = cut(signatures(docs, size, bands))
    some = rows.where("n_shingles > 0")
    node = F.xxhash64("n_shingles", "h1", "h2").alias("node")
    classes = cut(
        some.groupBy("n_shingles", "h1", "h2")
        .agg(F.min("doc_id").alias("least_id"), F.min("key").alias("key"), *[F.first(c).alias(c) for c in _band(bands) + _LOW])
        .withColumn("node", node)
    )
    members = classes.select("node", F.explode(F.array(*_band(bands))).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("shared")).where("shared > 1")
    members = cut(members.join(shared, "bucket"))

    busy = members.groupBy("node").agg(F.sum("shared").alias("busy"))
    hubs = members.join(busy, "node").groupBy("bucket").agg(F.max(F.struct("busy", "node")).getField("node").alias("hub"))
    pairs = members.join(hubs, "bucket").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tested = cut(_passing(pairs, classes, percent))

    wanted = members.select("node").distinct().join(classes.select("node", "key"), "node")
    # equal rows share a key, hence one text of each
    texts = docs.select(row_key("doc_id", "text").alias("key"), "text").join(wanted, "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = cut(shingle_sets(texts, size))
    links = cut(_confirm(tested, sets, percent))
    labels = components(links)
    left = cut(_apart(members.select("bucket", "node"), labels))
    more = cut(_blockwise(left, classes, sets, percent))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = named.join(least, "component").select("n_shingles", "h1", "h2", "component_id")
    joined = rows.select("doc_id", "key", "n_shingles", "h1", "h2").join(found, ["n_shingles", "h1", "h2"], "left")
    return joined.select(
        "doc_id", "key", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose id is the least of their group, repeated rows of it once; texts without words and
    documents without id stay, as nothing says that they are copies."""
    found = groups(docs, size, percent)
    rest = without(docs, found.where("doc_id is not null and doc_id <> component_id"))
    once = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    rows = carry(rest, key=row_key("doc_id", "text"), id=F.col("doc_id"), once=once)
    return rows.where("once").dropDuplicates(["id", "key"]).unionByName(rows.where("not once")).select("row.*")
