"""A content-addressed WARC archive.

Payloads are stored once under their SHA-256, written from bytes whose digest is worked out anew when they are read; record
headers are stored apart, byte for byte, under the record's id and the digest of its payload. A record is rebuilt by joining
both. The record with the largest id of those with equal payloads is the response, which other records of the same payload
revisit. ``export`` writes the rebuilt records as WARC files of at most ``PER_FILE`` records, plain or compressed; ``load``
reads such files, from record to record by their Content-Length, and ``resolve`` joins revisits to the response that holds their
payload. A task holds one file and its text at a time.

Defined cases: a null payload is an empty one; null urls have an empty target; records without id are kept, and are the response
only where no record of their payload has an id; repeated rows are kept, all as responses if they have the largest id; payloads
under ``least`` bytes, by parameter, are always stored as responses; ids that are no whole numbers are told apart in the files (they must have no
line ends), but ``parse`` gives null for them; a file that ends within a record, a response whose payload does not give its digest and a revisit without
response fail the job."""

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factwright.session import cut

CRLF = "\r\n"
PER_FILE = 4_000  # records; a file has to fit in a task and below 2 GB
FLUSH = 16 << 20  # bytes of payload in a batch, about


def base32(hex_text: Column) -> Column:
    """RFC 4648 base32, upper case, of 40 hexadecimal digits: ten at a time, as eight digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_text, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Per page (page_id, url, html): page_id, address, payload, header, record_type."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    # what headers need is taken here, so that no payload goes through the join unless it is asked for
    rows = rows.withColumns({"address": F.sha2("payload", 256), "digest": base32(F.sha1("payload")), "bytes": F.octet_length("payload")})
    newest = rows.where(F.col("bytes") >= least).groupBy("address").agg(F.max("page_id").alias("refers_to"))
    rows = rows.join(newest, "address", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    kind = F.when(revisit, "revisit").otherwise("response")
    uid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), uid(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")), F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uid(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    return rows.select("page_id", "address", "payload", F.encode(header, "UTF-8").alias("header"), kind.alias("record_type"))


def write(found: DataFrame, path: str) -> None:
    """Headers and payloads of ``records``, each payload once."""
    found.select("page_id", "address", "header", "record_type").write.parquet(f"{path}/headers")
    # copies of one payload are folded before they are shuffled; the bytes themselves are no key
    found.groupBy("address").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt: page_id, header, payload. A payload whose bytes do not give their address any more fails the job."""
    headers, stored = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    broken = F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("address")))
    stored = stored.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(broken).alias("payload"))
    return headers.join(stored, "address").select("page_id", "header", "payload")


def field(header: Column, name: str) -> Column:
    """Value of a header field, null where it is absent. Only LF begins a line."""
    found = F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)", 1)
    return F.when(header.rlike(rf"(?md)^{name}: "), found)


def parse(found: DataFrame, *also: str) -> DataFrame:
    """Per record what its header says, beside the length and digest of its payload, and the columns ``also``."""
    text = F.decode("header", "UTF-8")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return found.select(
        number(field(text, "WARC-Record-ID")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"), F.substring_index(field(text, "WARC-Payload-Digest"), ":", -1).alias("stated_digest"),
        field(text, "WARC-Type").alias("record_type"), number(field(text, "WARC-Refers-To")).alias("refers_to"), field(text, "WARC-Target-URI").alias("url"), *also)


def export(found: DataFrame, path: str, compression: str = "none", per_file: int = PER_FILE) -> None:
    """Rebuilt records as WARC files: header, payload (none in a revisit) and two line ends each."""
    revisit = field(F.decode("header", "UTF-8"), "WARC-Type") == "revisit"
    record = F.concat(F.decode("header", "UTF-8"), F.when(revisit, F.lit("")).otherwise(F.decode("payload", "UTF-8")))
    how = {"lineSep": CRLF + CRLF, "compression": compression, "maxRecordsPerFile": per_file}
    found.select(record.alias("value")).write.options(**how).text(path)


def _plain(raw: bytes) -> bytes:
    """A file's bytes; gzip members, of which there may be one per record, are joined."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        if not member.eof:
            raise ValueError("a WARC file ends within a compressed member")
        raw = member.unused_data
    return b"".join(out) if out else raw


def _records(raw: bytes):
    """(header with its empty line, payload) of each record of a file."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at) + 4
        header = raw[at:end] if end > 3 else b""
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r$", header)
        to = end + int(length[1]) if length else 0
        if not header.startswith(b"WARC/") or raw[to : to + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        yield header, raw[end:to]
        at = to + 4


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files in a folder, plain or gzip: header, payload (empty in a revisit)."""

    def run(batches):
        for batch in batches:
            for value in batch.column("content"):
                held, size = [], 0
                for record in _records(_plain(value.as_buffer().to_pybytes())):
                    held.append(record)
                    size += len(record[1])
                    if size >= FLUSH:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*held)], names=["header", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, payload binary")


def resolve(found: DataFrame) -> DataFrame:
    """``parse`` of loaded records, revisits with the length and digest of the payload that their response holds. Only lengths
    and digests are joined."""
    text = F.decode("header", "UTF-8")
    named = parse(found.select("header", "payload", field(text, "WARC-Record-ID").alias("record"), field(text, "WARC-Refers-To").alias("target")), "record", "target")
    named = cut(named)
    broken = F.raise_error(F.concat(F.lit("payload differs from the digest of "), F.col("record")))
    held = named.where("record_type = 'response'")
    held = held.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("stated_digest"), F.col("payload_digest")).otherwise(broken))
    known = held.select(F.col("record").alias("target"), "stated_digest", F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest")).distinct()
    lost = F.raise_error(F.concat(F.lit("no response for "), F.col("record")))
    revisits = named.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(known, ["target", "stated_digest"], "left")
    revisits = revisits.withColumn("payload_digest", F.coalesce("held_digest", lost)).withColumnRenamed("held_bytes", "payload_bytes")
    columns = [c for c in named.columns if c not in ("record", "target")]
    return held.select(*columns).unionAll(revisits.select(*columns))
