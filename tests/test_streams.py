"""Streams end with what the batch operators give."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from factwright import schemas
from factwright.functions import envelopes as E
from factwright.operators import append, audit as A, ordering
from factwright.streaming import streams
from tests import fixtures as X


def test_identities(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    os.makedirs(folder)

    def put(name, rows):
        lines = []
        for r in rows:
            d = dict(zip(schemas.IDENTITY.names, r))
            d["object"] = {k: v for k, v in zip(schemas.OBJECT.names, r[3]) if v is not None}
            lines.append(json.dumps(d) + "\n")
        open(f"{folder}/{name}.jsonl", "w").write("".join(lines))

    def run():
        q = streams.stream_identities(streams.identity_files(spark, folder), store, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        return sorted(r.id for r in spark.read.parquet(store).collect())

    bad = ("0" * 64,) + X.IDENTITIES[0][1:]
    put("a", X.IDENTITIES[:2] + [bad])
    assert run() == sorted(r[0] for r in X.IDENTITIES[:2])
    put("b", X.IDENTITIES[1:] + X.IDENTITIES[:1])
    assert run() == sorted(r[0] for r in X.IDENTITIES)


def test_a_batch_opens_only_the_folders_it_names(spark, tmp_path):
    store = str(tmp_path / "store")
    ids = spark.range(600).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    ids.withColumn("prefix", F.substring("id", 1, streams.PREFIX)).coalesce(1).write.partitionBy("prefix").parquet(store)
    files = lambda rows: rows.select(F.input_file_name()).distinct().count()
    assert files(spark.read.parquet(store)) > 200
    batch = ids.orderBy("id").limit(3)
    found = streams.stored_ids(spark, store, batch)
    assert files(found) <= 3 and found.join(batch, "id").count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "prefix" in plan


def events(spark, n=40, logs=3):
    rows = [(E_ID % i, "a", "observer", f"2026-01-01T00:{i // 60:02}:{i % 60:02}Z", f"log:{i % logs}") for i in range(n)]
    return spark.createDataFrame(rows, "identity_id string, attestor string, attestor_role string, ingested_at string, log_id string")


E_ID = "%064x"


def test_append(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = events(spark)
    q = None
    for i in range(2):
        rows.where((F.substring("ingested_at", 18, 2).cast("int") >= 20) == F.lit(bool(i))).coalesce(1).write.mode("append").parquet(source)
        q = streams.stream_append(spark.readStream.schema(rows.schema).parquet(source), out, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    got = {(r.log_id, r.seq, r.id, r.chain_hash) for r in streams.appended(spark, out).collect()}
    want = {(r.log_id, r.seq, r.id, r.chain_hash) for r in append.append_occurrences(rows).collect()}
    assert got == want and len(got) == 40


def chain(spark, n=40, tamper=True):
    built = append.append_occurrences(events(spark, n))
    rows = built.select("log_id", "seq", "prev_chain_hash", F.col("id").alias("occurrence_id"), "chain_hash")
    return rows.withColumn("chain_hash", F.when((F.col("seq") % 7 == 0) & F.lit(tamper), F.sha2("chain_hash", 256)).otherwise(F.col("chain_hash")))


def test_chain_audit(spark, tmp_path):
    """Lines arrive in two batches, the later ones first; without gaps the stream finds what the batch finds."""
    source = str(tmp_path / "in")
    rows = chain(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = str(tmp_path / "found")
    for late in (True, False):
        rows.where((F.col("seq") > 5) == F.lit(late)).coalesce(1).write.mode("append").parquet(source)
        audit = streams.stream_chain_audit(spark.readStream.schema(rows.schema).parquet(source), patience=None)
        q = audit.writeStream.format("parquet").option("path", found).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    got = {(r.log_id, r.seq, r.reason) for r in spark.read.parquet(found).collect()}
    want = {(r.log_id, int(r.key.rsplit(":", 1)[1]), r.reason) for r in A.chain_integrity(rows).collect()}
    assert got == want and got


def test_chain_audit_reports_gaps(spark, tmp_path):
    """Lines that never come: with patience the stream ends with what the batch finds."""
    source, found = str(tmp_path / "in"), str(tmp_path / "found")
    rows = chain(spark).where(~F.col("seq").isin(4, 5, 9))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows.coalesce(1).write.parquet(source)
    want = {(r.log_id, int(r.key.rsplit(":", 1)[1]), r.reason) for r in A.chain_integrity(rows).collect()}
    assert {r[2] for r in want} >= {"seq gap", "chain_hash mismatch"}
    audit = streams.stream_chain_audit(spark.readStream.schema(rows.schema).parquet(source), patience=50)
    q = audit.writeStream.format("parquet").option("path", found).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    got, end = set(), time.time() + 90
    try:
        while got != want and time.time() < end and q.isActive:
            time.sleep(2)
            got = {(r.log_id, r.seq, r.reason) for r in spark.read.schema("log_id string, seq bigint, reason string").parquet(found).collect()} if os.path.isdir(found) else set()
    finally:
        q.stop()
    assert got == want


def test_runs_keep_their_ends_only():
    """Lines in any order, some absent, changed or repeated: what is found in the end follows from the lines alone."""
    rng = random.Random(4)
    for _ in range(60):
        head, lines = streams.GENESIS, {}
        for seq in range(1, 40):
            occurrence = f"{rng.getrandbits(256):064x}"
            lines[seq] = (head, occurrence, streams.link(head, occurrence))
            head = lines[seq][2]
        for seq in rng.sample(range(1, 40), 4):
            k = rng.randrange(3)
            lines[seq] = tuple("0" * 64 if i == k else v for i, v in enumerate(lines[seq]))
        for seq in rng.sample(range(1, 39), rng.randrange(8)):
            del lines[seq]
        order, runs, repeated = list(lines), streams.Runs(0, streams.GENESIS, {}), []
        rng.shuffle(order)
        for n, seq in enumerate(order):
            runs.add(seq, *lines[seq])
            if n % 9 == 4:  # a line comes again
                repeated.append(seq)
                runs.add(seq, *lines[seq])
            runs = rng.random() < 0.3 and _reloaded(runs) or runs
        gaps = sum(s - 1 not in lines for s in lines if s > 1) + (1 not in lines)
        assert len(runs.runs) <= gaps
        while runs.give_up():
            pass
        want = [(s, "seq repeated") for s in repeated]
        for s, (prev, occurrence, got) in lines.items():
            before = streams.GENESIS if s == 1 else lines[s - 1][2] if s - 1 in lines else None
            if before is None:
                want.append((s, "seq gap"))
            elif prev != before:
                want.append((s, "prev_chain_hash mismatch"))
            elif streams.link(prev, occurrence) != got:
                want.append((s, "chain_hash mismatch"))
        assert sorted(runs.found) == sorted(want)


def _reloaded(runs):
    again = streams.Runs(runs.seq, runs.hash, dict(runs.runs))
    again.found = runs.found
    return again


def test_chain_forms_agree(spark):
    rows = chain(spark, 200).where(F.col("seq") % 31 != 0)
    rows = rows.unionByName(rows.where(F.col("seq") % 11 == 0))
    a = sorted(tuple(r) for r in A.chain_integrity(rows).collect())
    for block in (4, 1000):
        assert sorted(tuple(r) for r in A.chain_integrity_windowed(rows, block=block).collect()) == a


def test_positions_and_neighbours_of_one_large_key(spark):
    """One key holds nearly all rows; buckets cut it up and the result stays that of a plain window."""
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("t"), F.when(F.col("id") % 50 == 0, F.lit("b")).otherwise(F.lit("a")).alias("k"))
    got = ordering.row_numbers(df, ["k"], ["t"], F.floor(F.col("t") / 100), "n")
    got = ordering.previous(got, ["k"], ["t"], F.floor(F.col("t") / 100), ["t"])
    rows = {}
    for r in got.collect():
        rows.setdefault(r.k, []).append((r.t, r.n, r.prev_t))
    for k, values in rows.items():
        values.sort()
        assert [v[1] for v in values] == list(range(1, len(values) + 1))
        assert [v[2] for v in values] == [None] + [v[0] for v in values[:-1]]


def test_published_event_is_reproduced_by_append(spark):
    o = X.OCCURRENCES[0]
    new = spark.createDataFrame([(o[1], o[2], o[3], o[4], o[5])], "identity_id string, attestor string, attestor_role string, ingested_at string, log_id string")
    r = append.append_occurrences(new).first()
    assert (r.id, r.chain_hash, r.seq) == (o[0], o[7], 1)
    assert spark.createDataFrame([o], schemas.OCCURRENCE).select(E.occurrence_id()).first()[0] == r.id
