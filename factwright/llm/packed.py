"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id and sorted; each task encodes its texts and gives whole files of about ``FILE_IDS`` ids,
which Spark's text sink writes as they are, one record a file, so that its commit protocol holds and only committed files are read.

A file holds, little-endian and without gaps: a header (``HEADER``: magic, part, number within the part, documents, ids, blocks,
exceptions, bytes of packed data); per document its id (int64), whether that is null (uint8) and its number of ids (uint32); the block
index: where each block starts in the packed data (uint64), its first exception (uint64), its minimum (uint32), its width in bits
(uint8); the packed data; the exceptions: place in the block (uint8) and the bits beyond the width (uint32); one line end. A block is
128 ids less their minimum, packed at the width that holds the 98th percentile of them; what is larger is an exception. The last block
is filled up with its minimum. ``part`` and number order the files, so that the position of a document among all is the sum of what
earlier files hold and its place in its own.

Words between ASCII white space are encoded once while they are remembered, their runs of Latin letters apart from the marks around
them, and put together: exact for a model that lowers case and whose pre-tokens are runs of letters or of marks and never cross white
space, as this vocabulary's are. The first texts of every task are encoded whole as well; a difference is an error.

Defined cases: null and empty texts hold the end id alone; a null doc_id comes first; rows of one doc_id are ordered by a hash of
their text, and equal rows all stay; no documents give no files and no rows; a text is one row and is held whole, as Spark holds it."""

import os
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from factwright.llm.common import in_arrow
from factwright.session import cut

BLOCK = 128
PERCENTILE = 98
FILE_IDS = 1 << 22  # ids after which a file is closed: 16 MB before, about 8 MB after packing
KNOWN_BYTES = 128 << 20  # of words and their ids that a Python process remembers
TRIED = 8  # texts of a task that are encoded whole as well
HEADER = struct.Struct("<8sIIQQQQQ")
MAGIC = b"PFORIDS1"
CHUNK = 4096  # blocks that are packed at once


@lru_cache(1)
def _model(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _encode(path: str, text: str) -> bytes:
    return _packed(_model(path).encode(text, add_special_tokens=False).ids)


#: ASCII marks that never join the letters beside them: no apostrophe, digit or sign of a special token.
_MARKS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")  # less I with a dot, which is two characters in lower case
#: Bytes as byte-level models spell them: printable Latin-1 characters are themselves, the others follow from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_SPELLED = {b: 256 + _OTHERS.index(b) for b in _OTHERS}


class Encoder:
    """Ids of texts as bytes of little-endian 32-bit integers. Words are remembered, and so are the parts that new ones are taken into."""

    def __init__(self, path: str):
        self.path, self.known, self.parts, self.size, self.tried = path, {}, {}, 0, 0

    def __call__(self, text: bytes) -> bytes:
        words = text.split()
        found = list(map(self.known.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.known.get(words[i]) or self.word(words[i])
        ids = b"".join(found)
        if self.tried < TRIED and 0 < len(text) < 1 << 16:
            self.tried += 1
            if _encode(self.path, text.decode("utf-8", "replace")) != ids:
                raise ValueError(f"pre-tokens of {self.path} aren't runs of letters, or cross white space")
        if self.size > KNOWN_BYTES:
            self.known, self.size = {}, 0
            if len(self.parts) > KNOWN_BYTES >> 8:
                self.parts = {}
        return ids

    def word(self, word: bytes) -> bytes:
        core = word.strip(_MARKS)
        if core.isalpha() or _LATIN.fullmatch(core.decode("utf-8", "replace")):
            at = word.index(core)
            ids = self.letters(core)
            if len(core) < len(word):
                ids = b"".join([self.marks(word[:at]), ids, self.marks(word[at + len(core) :])])
        else:
            ids = _encode(self.path, word.decode("utf-8", "replace"))
        self.known[word] = ids
        self.size += len(word) + len(ids) + 160
        return ids

    def letters(self, core: bytes) -> bytes:
        """A run of letters, as the model has its pre-tokens: composed, in lower case, each byte as a character."""
        ids = self.parts.get(core)
        if ids is None:
            if core.isascii():
                spelled = core.decode().lower()
            else:
                spelled = unicodedata.normalize("NFC", core.decode()).lower().encode().decode("latin-1").translate(_SPELLED)
            ids = self.parts[core] = _packed([t.id for t in _model(self.path).model.tokenize(spelled)])
        return ids

    def marks(self, marks: bytes) -> bytes:
        if not marks:
            return b""
        ids = self.parts.get(marks)
        if ids is None:
            ids = self.parts[marks] = _encode(self.path, marks.decode())
        return ids


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The encoder of this Python process, which remembers words from task to task; every task tries its first texts anew."""
    found = _encoder(path)
    found.tried = 0
    return found


def _bits(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.uint64(1) << np.arange(33, dtype=np.uint64), x.astype(np.uint64), "right").astype(np.uint8)


def _pack_width(delta: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values as rows of 16 * width bytes."""
    kind, n = (">u2", 16) if width <= 16 else (">u4", 32)
    low = (delta & np.uint32((1 << width) - 1)).astype(kind)
    bits = np.unpackbits(low.view(np.uint8).reshape(len(low), BLOCK, n // 8), axis=2)[:, :, n - width :]
    return np.packbits(bits.reshape(len(low), BLOCK * width), axis=1)


def _unpack_width(data: np.ndarray, width: int) -> np.ndarray:
    kind, n = (">u2", 16) if width <= 16 else (">u4", 32)
    bits = np.zeros((len(data), BLOCK, n), np.uint8)
    bits[:, :, n - width :] = np.unpackbits(data, axis=1).reshape(len(data), BLOCK, width)
    return np.packbits(bits, axis=2).reshape(len(data), -1).view(kind).astype(np.uint32)


def pack(ids: np.ndarray):
    """(start, first exception, minimum, width of each block, packed data, exceptions' places, exceptions' high bits)."""
    blocks = -(-len(ids) // BLOCK)
    width, least = np.zeros(blocks, np.uint8), np.zeros(blocks, np.uint32)
    start, first = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64)
    data, places, highs = [], [], []
    at = seen = 0
    rank = -(-PERCENTILE * BLOCK // 100) - 1
    for k in range(0, blocks, CHUNK):
        own = ids[k * BLOCK : (k + CHUNK) * BLOCK]
        m = -(-len(own) // BLOCK)
        x = np.full(m * BLOCK, own[(m - 1) * BLOCK :].min(), np.uint32)
        x[: len(own)] = own
        x = x.reshape(m, BLOCK)
        low = x.min(axis=1)
        x = x - low[:, None]
        w = _bits(np.partition(x, rank, axis=1)[:, rank])
        beyond = (x.astype(np.uint64) >> w[:, None].astype(np.uint64)).astype(np.uint32)
        row, place = np.nonzero(beyond)
        first[k : k + m] = seen + np.searchsorted(row, np.arange(m))
        seen += len(row)
        places.append(place.astype(np.uint8))
        highs.append(beyond[row, place])
        size = 16 * w.astype(np.uint64)
        begin = np.cumsum(size) - size
        packed = np.zeros(int(size.sum()), np.uint8)
        for b in np.unique(w):
            rows = np.flatnonzero(w == b)
            if b:
                packed[(begin[rows, None] + np.arange(16 * int(b), dtype=np.uint64)).astype(np.int64)] = _pack_width(x[rows], int(b))
        start[k : k + m], least[k : k + m], width[k : k + m] = at + begin, low, w
        at += len(packed)
        data.append(packed)
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return start, first, least, width, joined(data, np.uint8), joined(places, np.uint8), joined(highs, np.uint32)


def header(raw) -> tuple:
    return HEADER.unpack_from(raw)


class File:
    """A file's bytes by its parts; ``ids`` opens only the blocks asked for."""

    def __init__(self, raw):
        magic, self.part, self.number, self.n_docs, self.n_ids, blocks, wide, size = header(raw)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at = HEADER.size

        def take(kind, n):
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        self.doc_id, self.no_id, self.length = take("<i8", self.n_docs), take("u1", self.n_docs), take("<u4", self.n_docs)
        self.start, self.first, self.least, self.width = take("<u8", blocks), take("<u8", blocks), take("<u4", blocks), take("u1", blocks)
        self.data, self.places, self.highs = take("u1", size), take("u1", wide), take("<u4", wide)
        if at + 1 != len(raw):
            raise ValueError("a file of packed ids is cut short")

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` - 1 of the file."""
        a, b = begin // BLOCK, -(-end // BLOCK)
        out = np.empty((max(b - a, 0), BLOCK), np.uint32)
        for k in range(a, b, CHUNK):
            to = min(k + CHUNK, b)
            w, x = self.width[k:to], np.zeros((to - k, BLOCK), np.uint32)
            for n in np.unique(w):
                rows = np.flatnonzero(w == n)
                if n:
                    where = self.start[k:to][rows, None].astype(np.int64) + np.arange(16 * int(n))
                    x[rows] = _unpack_width(self.data[where], int(n))
            lo = int(self.first[k])
            hi = int(self.first[to]) if to < len(self.first) else len(self.highs)
            row = np.repeat(np.arange(to - k), np.diff(np.append(self.first[k:to].astype(np.int64), hi)))
            x[row, self.places[lo:hi]] |= self.highs[lo:hi] << w[row].astype(np.uint32)
            out[k - a : to - a] = x + self.least[k:to, None]
        return out.reshape(-1)[begin - a * BLOCK : end - a * BLOCK]


def build(part: int, number: int, doc_ids: list, parts: list[bytes]) -> bytes:
    """The bytes of one file but for the line end that the sink adds: documents and the bytes of their ids."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    start, first, least, width, data, places, highs = pack(ids)
    head = HEADER.pack(MAGIC, part, number, len(parts), len(ids), len(start), len(highs), len(data))
    columns = [
        np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.array([len(p) // 4 for p in parts], "<u4"),
        start.astype("<u8"), first.astype("<u8"), least.astype("<u4"), width, data, places, highs.astype("<u4")]
    return b"".join([head, *(c.tobytes() for c in columns)])


def write(docs: DataFrame, model: str, path: str, end_id: int = 1, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of documents (doc_id integer, text) under ``path``, in ascending order of doc_id."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    # the last key only parts equal rows, so that many of them do not fill one range
    dealt = keyed.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, number, size, ids, parts, encode = TaskContext.get().partitionId(), 0, 0, [], [], encoder(model)

        def close():
            return pa.RecordBatch.from_arrays([pa.array([build(part, number, ids, parts)], pa.binary())], names=["file"])

        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            for d, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids.append(d)
                parts.append(encode(text.as_py()) + end)
                size += len(parts[-1]) // 4
                if size >= file_ids:
                    yield close()
                    number, size, ids, parts = number + 1, 0, [], []
        if parts:
            yield close()

    files = dealt.mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _offsets(found: DataFrame) -> DataFrame:
    """(part, number, before): the ids in all earlier files. Windows run over sums of parts, then within a part."""
    sums = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    whole = sums.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = whole.select("part", earlier(W.orderBy("part")).alias("begun"))
    return sums.join(begun, "part").select("part", "number", (F.col("begun") + earlier(W.partitionBy("part").orderBy("number"))).alias("before"))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files under ``path``: doc_id, start (ids before it in all files), n_tokens, ids_crc32, and their ids if asked for."""

    def run(batch):
        for value in batch.column("content"):
            f = File(value.as_buffer())
            to = np.cumsum(f.length.astype(np.int64))
            k = 0
            while k < f.n_docs:
                last = max(int(np.searchsorted(to, (to[k - 1] if k else 0) + (1 << 20), "right")), k + 1)
                begin = to[k] - f.length[k]
                some = f.ids(int(begin), int(to[last - 1]))
                raw, m = some.astype("<u4").tobytes(), last - k
                at = np.append(begin, to[k:last]) - begin
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                columns = [
                    pa.array(np.full(m, f.part, np.int32)), pa.array(np.full(m, f.number, np.int32)),
                    pa.array(f.doc_id[k:last], mask=f.no_id[k:last].astype(bool)), pa.array(to[k:last] - f.length[k:last]),
                    pa.array(f.length[k:last].astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(some.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in schema.split(", ")])
                k = last

    schema = "part int, number int, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    found = cut(in_arrow(files(spark, path).select("content"), schema, run))
    placed = found.join(_offsets(found), ["part", "number"]).withColumn("start", F.col("before") + F.col("within"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def slice_ids(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(position, id) of ids ``begin`` to ``end`` - 1 of all files: of each file only the blocks that the index names are opened."""

    def sizes(batch):
        heads = [header(v.as_buffer()) for v in batch.column("content")]
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in heads], pa.int64()) for i in (1, 2, 4)], names=["part", "number", "n_tokens"])

    where = cut(files(spark, path).select("content").mapInArrow(lambda b: (x for a in b for x in sizes(a)), "part long, number long, n_tokens long"))
    before = {(r.part, r.number): r.before for r in _offsets(where).join(where, ["part", "number"]).where(
        (F.col("before") < end) & (F.col("before") + F.col("n_tokens") > begin)).collect()}

    def run(batch):
        for value in batch.column("content"):
            f = File(value.as_buffer())
            at = before.get((f.part, f.number))
            if at is not None:
                a, b = max(begin - at, 0), min(end - at, f.n_ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at + a, at + b)), pa.array(f.ids(a, b).astype(np.int64))], names=["position", "id"])

    return in_arrow(files(spark, path).select("content"), "position long, id long", run)
