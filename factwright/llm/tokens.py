"""Token counts by distinct pre-tokens.

The vocabulary has no piece that goes on after a word into a space, nor one with a line end, so that the pieces of a text are the pieces
of its pre-tokens: spaces with the word behind them, or a line end with the word behind it. Every distinct
pre-token is split into pieces once.

Frequent pre-tokens, found in a sample of bounded size, are counted first and handed to all tasks. A scan then sums these
within documents and gives the other pre-tokens as rows with the documents and frequencies of a block of texts. Those rows
meet by pre-token in one shuffle, each is split into pieces once, and the counts, times the frequencies, are summed back by
document. Which pre-tokens are thought frequent changes the cost, never a count. No ids are kept.

Defined cases: null and empty texts have no tokens; a lone space or line end has tokens as the library gives them; repeated rows are
counted each for themselves."""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from factwright.llm import words as W
from factwright.llm.common import in_arrow, row_key
from factwright.session import cut

SAMPLE = 20_000  # documents, in expectation, in which frequent pre-tokens are looked for
SHARE = 2e-7  # of the sample's pre-tokens that a frequent one has at least: there are at most 1 / SHARE
FLUSH = 32 << 20  # bytes of text after which a task writes what it has gathered


@lru_cache(1)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_pieces(path: str, pre: list[str]) -> np.ndarray:
    """Pieces of each pre-token. The library puts a space before what it is given: a leading space is taken off, and
    before a line end, with which it never merges, its piece is taken off the count."""
    given = [p[1:] if p[0] == " " else p for p in pre]
    counts = np.array([len(x) for x in _model(path).encode(given, num_threads=1)], np.int64)
    lone = np.array([p == " " for p in pre], bool)
    line = np.array([p[0] == "\n" for p in pre], bool)
    return np.where(lone, 1, counts - line)


def _pre_tokens(texts: pa.Array):
    """(first, texts, buf, start, end, hash, text of each) of the pre-tokens of blocks of texts."""
    spaced = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "▁", " ")
    some = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), spaced, pa.scalar("", pa.large_string()))
    spaced = pc.if_else(pc.equal(spaced, ""), spaced, some)
    for first, offsets, buf in W.blocks(spaced):
        n = len(offsets) - 1
        if not len(buf):
            yield first, n, buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        space = buf == 32
        begin = buf == 10
        begin[0] = True
        begin[1:] |= space[1:] & ~space[:-1]
        begin[offsets[offsets < len(buf)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(buf))
        yield first, n, buf, start, end, W._hash(buf, start, end), np.searchsorted(offsets, start, "right") - 1


def _strings(buf, start, end) -> list[str]:
    raw = buf.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]


def frequent(docs: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted, and pieces) of pre-tokens that are frequent in a sample of documents."""

    def count(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            for _, _, buf, start, end, h, _ in _pre_tokens(batch.column("text")):
                _, at, n = np.unique(h, return_index=True, return_counts=True)
                for s, k in zip(_strings(buf, start[at], end[at]), n.tolist()):
                    seen[s] = seen.get(s, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre", "n"])

    def split(batch):
        pre = batch.column("pre")
        hashes = [W._hash(b, np.array([0]), np.array([len(b)]))[0] for b in (np.frombuffer(x.encode(), np.uint8) for x in pre.to_pylist())]
        yield pa.RecordBatch.from_arrays([W.signed(np.array(hashes, np.uint64)), pa.array(count_pieces(path, pre.to_pylist()) if len(pre) else np.zeros(0, np.int64))], names=["h", "pieces"])

    n = docs.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit("frequent")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    found = cut(docs.where(chance).select("text").mapInArrow(count, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    kept = in_arrow(found.where(F.col("n") >= max(2.0, total * SHARE)).select("pre"), "h long, pieces long", split).toPandas()
    h = kept["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], kept["pieces"].to_numpy(dtype=np.int64)[order]


_NAMES = ["key", "doc_id", "n_bytes", "n", "pre", "docs", "ns"]
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _scan(docs: DataFrame, head: np.ndarray, pieces: np.ndarray) -> DataFrame:
    """A row per document: key, doc_id, n_bytes and n, the pieces of its frequent pre-tokens. A row per other pre-token and
    block of texts: pre, the keys of its documents and its frequencies there."""
    shared = docs.sparkSession.sparkContext.broadcast((head, pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        head, pieces = shared.value
        size, held, id_type = 0, [], None
        for batch in batches:
            ids, texts, keys = batch.column("doc_id"), batch.column("text"), batch.column("key").to_numpy()
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            sums, id_type, m = np.zeros(len(ids), np.int64), ids.type, len(ids)
            for first, n, buf, start, end, h, of in _pre_tokens(texts):
                at = np.minimum(np.searchsorted(head, h), max(len(head) - 1, 0))
                known = head[at] == h if len(head) else np.zeros(len(h), bool)
                if len(head):
                    sums[first : first + n] += np.bincount(of[known], weights=pieces[at[known]], minlength=n).astype(np.int64)
                rest = np.flatnonzero(~known)
                if len(rest):
                    u, i, back = np.unique(h[rest], return_index=True, return_inverse=True)
                    held.append((u, _strings(buf, start[rest][i], end[rest][i]), back, keys[of[rest] + first]))
                size += len(buf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), ids, n_bytes, pa.array(sums), pa.nulls(m, pa.string()), pa.nulls(m, _LONGS), pa.nulls(m, _INTS)], names=_NAMES)
            if size >= FLUSH:
                yield from places(held, id_type)
                size, held = 0, []
        yield from places(held, id_type)

    def places(held, id_type):
        if not held:
            return
        h = np.concatenate([u[back] for u, _, back, _ in held])
        keys = np.concatenate([k for _, _, _, k in held])
        text = dict(zip(np.concatenate([u for u, _, _, _ in held]).tolist(), (s for _, t, _, _ in held for s in t)))
        order = np.lexsort((keys, h))
        h, keys = h[order], keys[order]
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (keys[1:] != keys[:-1])))
        n = np.diff(np.append(at, len(h))).astype(np.int32)
        h, keys = h[at], keys[at]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        ends = np.append(first, len(h)).astype(np.int32)
        for k in range(0, len(first), 10_000):
            to = min(k + 10_000, len(first))
            lo, hi, m, own = ends[k], ends[to], to - k, h[first[k:to]]
            offs = pa.array(ends[k : to + 1] - lo, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.nulls(m, pa.int64()), pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([text[x] for x in own.tolist()], pa.string()),
                pa.ListArray.from_arrays(offs, pa.array(keys[lo:hi])), pa.ListArray.from_arrays(offs, pa.array(n[lo:hi]))], names=_NAMES)

    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    return keyed.mapInArrow(run, f"key long, doc_id {kind}, n_bytes long, n long, pre string, docs array<bigint>, ns array<int>")


def counts(docs: DataFrame, path: str) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_bytes, n_tokens under the sentencepiece model at ``path``."""
    found = _scan(docs, *frequent(docs, path))
    dealt = found.repartition(F.coalesce("pre", F.col("key").cast("string"))).sortWithinPartitions("pre")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def split(batches):
        last = {}  # the pre-token that a batch may share with the one before
        for batch in batches:
            own = pc.is_valid(batch.column("key"))
            rows = batch.filter(own)
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [rows.column("key"), rows.column("doc_id"), rows.column("n_bytes"), rows.column("n"), pa.array(np.zeros(m, np.int64)), pa.array(np.ones(m, np.int64))], names=names)
            rest = batch.filter(pc.invert(own))
            if not len(rest):
                continue
            coded = rest.column("pre").dictionary_encode()
            pre, back = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            new = [i for i, x in enumerate(pre) if x not in last]
            pieces = np.array([last.get(x, 0) for x in pre], np.int64)
            if new:
                pieces[new] = count_pieces(path, [pre[i] for i in new])
            last = {pre[-1]: int(pieces[-1])}
            size = pc.list_value_length(rest.column("docs")).to_numpy()
            keys, back_of = np.unique(rest.column("docs").flatten().to_numpy(), return_inverse=True)
            more = np.bincount(back_of, weights=np.repeat(pieces[back], size) * rest.column("ns").flatten().to_numpy(), minlength=len(keys)).astype(np.int64)
            m, zero = len(keys), pa.array(np.zeros(len(keys), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(m, rest.column("doc_id").type), zero, zero, pa.array(more), zero], names=names)

    names = ["key", "doc_id", "n_bytes", "n", "more", "rows"]
    parts = dealt.mapInArrow(split, f"key long, doc_id {kind}, n_bytes long, n long, more long, rows long")
    sums = parts.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.max("n").alias("n"), F.sum("more").alias("more"), F.sum("rows").alias("rows"))
    # equal rows share a key: each brought the same, and each is given back
    each = sums.withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return each.select("doc_id", "n_bytes", (F.col("n") + (F.col("more") / F.col("rows")).cast("long")).alias("n_tokens"))
