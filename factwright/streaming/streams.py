"""The append-only logs as streams. Each ends with what its batch operator gives on the same files."""

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factwright import schemas
from factwright.constants import GENESIS
from factwright.functions import envelopes as E
from factwright.functions.checks import identity_violation
from factwright.operators.append import append_occurrences, heads
from factwright.session import cut
from factwright.sources.commits import or_empty


def identity_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.IDENTITY).option("pathGlobFilter", "*.jsonl").json(path)


PREFIX = 2  # hex digits of an id that name its folder


def stored_ids(spark: SparkSession, store: str, ids: DataFrame) -> DataFrame:
    """Ids in the store, of the folders that ``ids`` fall in. There are at most 256 folders, whose names the driver reads off the batch,
    so that the scan opens no other."""
    named = [r.prefix for r in ids.select(F.substring("id", 1, PREFIX).alias("prefix")).distinct().collect()]
    rows = or_empty(spark, store, spark.read.schema("id string, prefix string").parquet, "id string, prefix string")
    return rows.where(F.col("prefix").isin(*named))


def stream_identities(stream: DataFrame, store: str, checkpoint: str):
    """New day files into the fact store: valid facts with a true id, each once. The store lies in folders by the first digits of an
    id; known ids are found by an anti join with the folders that a batch names, so no state grows or expires, and a batch written twice
    after a failure adds nothing."""
    def write(batch: DataFrame, _epoch: int) -> None:
        good = cut(batch.where(identity_violation().isNull() & (E.identity_id() == F.col("id"))).dropDuplicates(["id"]))
        fresh = good.join(stored_ids(batch.sparkSession, store, good).select("id"), "id", "left_anti")
        fresh.withColumn("prefix", F.substring("id", 1, PREFIX)).write.mode("append").partitionBy("prefix").parquet(store)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


class ChainAudit(StatefulProcessor):
    """Per log: the position and head up to which it is whole, the runs of lines that came before their turn, and the gaps that were
    given up. A line is judged once the line before it is there; of a run only its two ends are kept, so that the state follows the
    number of gaps. A run that has waited ``patience`` milliseconds for the line before it ends the wait."""

    def __init__(self, patience: int | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gaps = handle.getMapState("gaps", "first bigint", "last bigint")
        self.head = handle.getValueState("head", "seq bigint, hash string")
        # prev and bad are of the run's first line, which is not judged yet; hash is of its last
        self.runs = handle.getMapState("runs", "first bigint", "last bigint, prev string, bad boolean, hash string")

    def _load(self):
        seq, head = self.head.get() if self.head.exists() else (0, GENESIS)
        return Runs(seq, head, {k[0]: tuple(v) for k, v in self.runs.iterator()})

    def _save(self, key, runs, timerValues, expired=False):
        for first in runs.old.keys() - runs.runs.keys():
            self.runs.removeKey((first,))
        for first, run in runs.runs.items():
            if runs.old.get(first) != run:
                self.runs.updateValue((first,), run)
        self.head.update((runs.seq, runs.hash))
        if self.patience is not None and runs.runs and (expired or not any(True for _ in self.handle.listTimers())):  # the expired one is still listed
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        return pd.DataFrame({
            "log_id": pd.Series([key[0]] * len(runs.found), dtype="object"),
            "seq": pd.Series([f[0] for f in runs.found], dtype="int64"),
            "reason": pd.Series([f[1] for f in runs.found], dtype="object"),
        })

    def handleInputRows(self, key, rows, timerValues):
        runs = self._load()
        given_up = [(first[0], last[0]) for first, last in self.gaps.iterator()]
        for frame in rows:
            for r in frame.sort_values("seq").itertuples(index=False):
                if any(first <= r.seq <= last for first, last in given_up):
                    runs.found.append((r.seq, "arrived after its gap was reported"))
                else:
                    runs.add(int(r.seq), r.prev_chain_hash, r.occurrence_id, r.chain_hash)
        yield self._save(key, runs, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        runs = self._load()
        gap = runs.give_up()
        if gap:
            self.gaps.updateValue((gap[0],), (gap[1],))
        yield self._save(key, runs, timerValues, expired=True)

    def close(self) -> None:
        pass


class Runs:
    """A log as a whole part up to ``seq`` and runs behind gaps: first -> (last, prev, bad, hash)."""

    def __init__(self, seq: int, head: str, runs: dict):
        self.seq, self.hash, self.runs, self.old, self.found = seq, head, runs, dict(runs), []
        self.firsts = sorted(runs)

    def _judge(self, seq, prev, bad, before):
        if prev != before:
            self.found.append((seq, "prev_chain_hash mismatch"))
        elif bad:
            self.found.append((seq, "chain_hash mismatch"))

    def add(self, seq, prev, occurrence, got):
        at = bisect.bisect_right(self.firsts, seq)
        left = self.firsts[at - 1] if at else None
        if seq <= self.seq or left is not None and seq <= self.runs[left][0]:
            self.found.append((seq, "seq repeated"))
            return
        bad = link(prev, occurrence) != got
        if seq == self.seq + 1:
            self._judge(seq, prev, bad, self.hash)
            self.seq, self.hash, left = seq, got, None
        elif left is not None and self.runs[left][0] == seq - 1:
            self._judge(seq, prev, bad, self.runs[left][3])
            self.runs[left] = (seq, *self.runs[left][1:3], got)
        else:
            left = seq
            self.runs[seq] = (seq, prev, bad, got)
            self.firsts.insert(at, seq)
            at += 1
        if at < len(self.firsts) and self.firsts[at] == seq + 1:
            last, prev, bad, after = self.runs.pop(self.firsts.pop(at))
            self._judge(seq + 1, prev, bad, got)
            if left is None:
                self.seq, self.hash = last, after
            else:
                self.runs[left] = (last, *self.runs[left][1:3], after)

    def give_up(self):
        """Goes on behind the first gap, whose ends it gives."""
        if not self.firsts:
            return None
        first = self.firsts.pop(0)
        gap = (self.seq + 1, first - 1)
        self.seq, _, _, self.hash = self.runs.pop(first)
        self.found.append((first, "seq gap"))
        return gap


def link(prev: str, occurrence: str) -> str:
    import hashlib

    try:
        raw = bytes.fromhex(prev) + bytes.fromhex(occurrence)
    except ValueError:
        return ""
    return hashlib.sha256(raw).hexdigest() if len(raw) == 64 else ""


def stream_chain_audit(chain: DataFrame, patience: int | None = 60_000) -> DataFrame:
    """Violations of streamed chain lines (log_id, seq, prev_chain_hash, occurrence_id, chain_hash). Lines
    may come late or out of order; a line waits in the state until the line before it is there, or until it has
    waited ``patience`` milliseconds of processing time. Then the line behind the gap is reported, as
    :func:`factwright.operators.audit.chain_integrity` does, and the audit goes on from it. Timers run batches even without new lines;
    without ``patience`` there are none, and what follows a gap is not judged across it."""
    return chain.groupBy("log_id").transformWithStateInPandas(
        ChainAudit(patience), outputStructType="log_id string, seq bigint, reason string", outputMode="Append",
        timeMode="None" if patience is None else "ProcessingTime")


def stream_append(stream: DataFrame, path: str, checkpoint: str, order=("ingested_at", "identity_id")):
    """Streamed events appended to their hash chains. A batch starts from the heads the batch before it
    left, one row per log, and writes events and heads to folders of its own, so a batch repeated after
    a failure replaces itself."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/heads/{epoch - 1}") if epoch > 0 else None
        append_occurrences(batch, before, order).write.mode("overwrite").parquet(f"{path}/events/{epoch}")
        after = heads(spark.read.parquet(f"{path}/events/{epoch}"))
        if before is not None:
            after = heads(after.unionByName(before))
        after.write.mode("overwrite").parquet(f"{path}/heads/{epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/events")
