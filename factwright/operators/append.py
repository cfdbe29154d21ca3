"""Appending events to hash-chained logs.

An event's id holds the chain hash before it, so a log can only be extended one event after the
other. The logs run in parallel; within a log the work is one pass with constant memory: Spark sorts
the rows on disk if need be, and the fold below keeps the current head and nothing else.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factwright.constants import GENESIS
from factwright.functions.envelopes import id_key, id_text, occurrence_json_head

ADDED = ("seq", "prev_chain_hash", "id", "chain_hash")


def _fold(batches):
    log, seq, head = None, 0, GENESIS
    for batch in batches:
        seqs, prevs, ids, heads = [], [], [], []
        logs = batch.column("log_id").to_pylist()
        texts = batch.column("__head").to_pylist()
        starts = batch.column("__seq").to_pylist()
        stored = batch.column("__stored").to_pylist()
        for i, name in enumerate(logs):
            if name != log:
                log, seq, head = name, starts[i], stored[i]
            event = hashlib.sha256(f'{texts[i]}"{head}"}}'.encode())
            seq += 1
            seqs.append(seq)
            prevs.append(head)
            ids.append(event.hexdigest())
            head = hashlib.sha256(bytes.fromhex(head) + event.digest()).hexdigest()
            heads.append(head)
        kept = [n for n in batch.schema.names if not n.startswith("__")]
        columns = [batch.column(n) for n in kept]
        columns += [pa.array(seqs, pa.int64())] + [pa.array(v, pa.string()) for v in (prevs, ids, heads)]
        yield pa.RecordBatch.from_arrays(columns, names=kept + list(ADDED))


def append_occurrences(new: DataFrame, heads: DataFrame | None = None, order=("ingested_at", "identity_id")) -> DataFrame:
    """Adds seq, prev_chain_hash, id and chain_hash to new events (identity_id, attestor,
    attestor_role, ingested_at, log_id). ``heads`` (log_id, seq, chain_hash) holds the stored heads;
    a log without one starts at genesis. ``order`` is the order within a log."""
    # what names a fact moves as bytes, and an event's text is put together where it has moved to
    rows = new.withColumn("identity_id", id_key("identity_id"))
    if heads is None:
        rows = rows.withColumn("__seq", F.lit(0).cast("long")).withColumn("__stored", F.lit(GENESIS))
    else:
        known = heads.select("log_id", F.col("seq").alias("__seq"), F.col("chain_hash").alias("__stored"))
        rows = rows.join(known, "log_id", "left").fillna({"__seq": 0, "__stored": GENESIS})
        rows = rows.select(*new.columns, "__seq", "__stored")
    schema = T.StructType(
        [f for f in new.schema.fields]
        + [T.StructField("seq", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in ADDED[1:]]
    )
    return (
        rows.repartition("log_id")
        .withColumn("identity_id", id_text("identity_id"))
        .sortWithinPartitions("log_id", *order)
        .withColumn("__head", occurrence_json_head())
        .mapInArrow(_fold, schema)
    )


def shard_of(log_id: str, key: str, shards: int) -> Column:
    """The log of an event: the named one, or one of ``shards`` logs ``<log_id>-<n>`` by a key. A chain is built in
    order by one task, so a large recorder wants as many logs as it has tasks."""
    if shards == 1:
        return F.lit(log_id)
    return F.concat(F.lit(f"{log_id}-"), F.pmod(F.crc32(F.col(key)), F.lit(shards)).cast("string"))


def is_shard(log: Column, log_id: str) -> Column:
    """Whether a log is the named one or one of its shards."""
    return (log == log_id) | (log.startswith(f"{log_id}-") & F.substr(log, F.lit(len(log_id) + 2)).rlike("^[0-9]+$"))


def heads(chain: DataFrame) -> DataFrame:
    """Newest position and chain hash of each log."""
    return chain.groupBy("log_id").agg(
        F.max("seq").alias("seq"), F.max_by("chain_hash", "seq").alias("chain_hash")
    )
