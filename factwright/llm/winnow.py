"""Benchmark decontamination by winnowing.

A fingerprint is the least hash of the KGRAM-word runs in a window of SPAN words. Every span of SPAN words that a text
shares with a benchmark item therefore has an equal fingerprint on both sides, and neighbouring windows mostly
share one. The fingerprints of the benchmark go into a bit table whose size follows their number up to a bound; windows of a document whose
fingerprint is in it become rows, are extended to the exact words and joined with the benchmark's windows by those, so
that neither chance nor the size of the table decides a hit. An item of fewer than SPAN words is one window and
its own fingerprint; documents are searched for runs of its length.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Defined cases: a null text or one without
words is hit by nothing and hits nothing; items without id count as hits, under no id; repeated items count once;
repeated rows get equal results."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factwright.llm import words as W
from factwright.llm.common import in_arrow, row_key, without
from factwright.session import cut

KGRAM, SPAN = 5, 10
TABLE_BITS = 1 << 24, 1 << 28  # of 2 to 32 MB, with room for SPARSE bits a window; beyond 16 million windows more chance hits become rows
SPARSE = 16


def _least(h: np.ndarray) -> np.ndarray:
    """Fingerprint of the window that begins at each word."""
    g = W.grams(h, KGRAM)
    n = len(h) - SPAN + 1
    out = g[:n].copy()
    for i in range(1, SPAN - KGRAM + 1):
        np.minimum(out, g[i : i + n], out=out)
    return out


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, n, window, fingerprint) of every window of every item."""

    def each(batch):
        ids = batch.column("item_id")
        for first, offsets, raw in W.blocks(batch.column("text")):
            w = W.split(offsets, raw, W.LETTERS)
            out = []
            for i in range(len(offsets) - 1):
                a, b = int(w.bound[i]), int(w.bound[i + 1])
                if b - a >= SPAN:
                    prints = _least(w.hash[a:b])
                    out += [(first + i, SPAN, w.text(a + k, a + k + SPAN), prints[k]) for k in range(len(prints))]
                elif b > a:
                    out.append((first + i, b - a, w.text(a, b), W.whole(w.hash[a:b])))
            if out:
                row, n, text, prints = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(n, pa.int32()), pa.array(text, pa.string()), W.signed(np.array(prints, np.uint64))],
                    names=["item_id", "n", "window", "fingerprint"])

    kind = items.schema["item_id"].dataType.simpleString()
    return in_arrow(items.select("item_id", "text"), f"item_id {kind}, n int, window string, fingerprint long", each)


def _table(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bit table of all fingerprints, and the lengths of windows shorter than SPAN. Bits are merged in Spark; at
    most a row for 64 bits and SPAN lengths come to the driver."""
    least, most = TABLE_BITS
    bits = min(max(least, 1 << (SPARSE * windows.count() - 1).bit_length()), most)
    bit = F.col("fingerprint").bitwiseAND(F.lit(bits - 1))
    cells = windows.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(fingerprint & 63 as int))")).alias("bits"))
    found = cells.toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["cell"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    short = [r.n for r in windows.where(F.col("n") < SPAN).select("n").distinct().collect()]
    return out, short


def _in(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    b = prints & np.uint64(64 * len(table) - 1)
    return (table[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1


def _candidates(docs: DataFrame, table: np.ndarray, short: list[int]) -> DataFrame:
    """A row (key, n_words, null) per document and a row (key, position, n, window) per window that may be a hit."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def each(batch):
        ids, keys, table = batch.column("doc_id"), batch.column("key"), shared.value
        for first, offsets, raw in W.blocks(batch.column("text")):
            w = W.split(offsets, raw, W.LETTERS)
            n = len(offsets) - 1
            count = np.diff(w.bound)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n), keys.slice(first, n), pa.array(count, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
            out = []
            for size in (SPAN, *short):
                if len(w.hash) < size:
                    continue
                if size == SPAN:
                    prints = _least(w.hash)
                    head = np.ones(len(prints), bool)
                    head[1:] = prints[1:] != prints[:-1]  # neighbouring windows share one fingerprint
                    hit = _in(table, prints[head])[np.cumsum(head) - 1]
                else:
                    hit = _in(table, _runs(w.hash, size))
                at = np.flatnonzero(hit)
                doc = np.searchsorted(w.bound, at, "right") - 1
                inside = at + size <= w.bound[doc + 1]
                out += [(first + d, a - w.bound[d], size, w.text(a, a + size)) for d, a in zip(doc[inside], at[inside])]
            if out:
                row, at, size, text = zip(*out)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), keys.take(row), pa.nulls(len(row), pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(text, pa.string())], names=names)

    names = ["doc_id", "key", "n_words", "at", "n", "window"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    return in_arrow(keyed, f"doc_id {kind}, key long, n_words long, at long, n int, window string", each)


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """``W.whole`` of the run of ``size`` words at each position."""
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size) * W._R, np.uint64)
        for i in range(size):
            out = out * W._Q + h[i : i + n]
    return W.mix(out)


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents (doc_id, text) and items (item_id, text): per document (doc_id, key, n_words), the exact window hits
    (key, at, n, window), and the items (item_id, window)."""
    windows = cut(benchmark_windows(items))
    table, short = _table(windows)
    found = cut(_candidates(docs, table, short))
    known = windows.select("window").distinct()
    exact = found.where("at is not null").select("key", "at", "n", "window").distinct().join(known, "window")
    return found.where("at is null").select("doc_id", "key", "n_words"), exact, windows.select("item_id", "window").distinct()


def spans(exact: DataFrame) -> DataFrame:
    """Hits extended to maximal spans: per document key an array of (at, end) in words, and n_hit, the words in them."""
    one = Window.partitionBy("key").orderBy("at", "end")
    before = F.max("end").over(one.rowsBetween(Window.unboundedPreceding, -1))
    hits = exact.select("key", "at", (F.col("at") + F.col("n")).alias("end")).distinct()
    begun = hits.withColumn("new", F.coalesce(F.col("at") > before, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(one))
    found = begun.groupBy("key", "span").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("spans"), F.sum(F.col("end") - F.col("at")).alias("n_hit"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit, spans, n_items and items, the ids as sorted text."""
    rows, exact, named = hits(docs, items)
    exact = cut(exact)
    by_item = exact.select("key", "window").distinct().join(named, "window").select("key", "item_id").distinct()
    ids = by_item.groupBy("key").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    joined = rows.join(spans(exact), "key", "left").join(ids, "key", "left")
    return joined.select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "spans",
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that share no window with an item."""
    _, exact, _ = hits(docs, items)
    return without(docs, exact)
