"""Evaluation records: a verdict with the ids of everything it was derived from.

A claim is a row beside two long tables, the ids of its facts and of its evidence, at every size. Its content id hashes
the text of the document that would list them, as a stream over the sorted long rows with constant memory: marks between pieces are put
in by column, a batch's pieces lie in one buffer, and each run of a claim goes into its hash at once. Lists are
built only in :func:`documents`, an export for named subjects.
"""

from typing import NamedTuple

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from factwright.functions.envelopes import _json, claim_json_parts
from factwright.operators import policy as policies_, snapshot
from factwright.session import cut

KEYS = ["subject", "policy_id", "policy_version"]
EVALUATOR = "factwright@0.1.0/evaluator"


def _headers(verdicts: DataFrame, evaluator: str, evaluated_at: str, identities_hash: str, manifest_hash: str) -> DataFrame:
    return (
        verdicts.where(F.col("error").isNull())
        .withColumn("evaluator_version", F.lit(evaluator))
        .withColumn("evaluated_at", F.lit(evaluated_at))
        .withColumn("identities_hash", F.lit(identities_hash))
        .withColumn("projection_manifest_hash", F.lit(manifest_hash))
        .withColumn("derivation", F.struct(
            "rules_fired", "missing_predicates", "input_counts",
            F.lit(None).cast("map<string,array<string>>").alias("occurrences_cited"),
        ))
        .withColumn("__key", F.monotonically_increasing_id())
    )


def _versions(entries) -> Column:
    """Normaliser name to version; a claim without facts has an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.map_from_entries(entries), empty).alias("normalizer_versions")


_MARKS = pa.array(["", ",", "[", "]", "null"], pa.string())


def _hash_runs(batches):
    """Sections 0, 2 and 4 are the document around its lists, 1 and 3 their elements, of which copies lie side by side."""
    key, digest, last = None, None, (-1, None)
    for batch in batches:
        if not len(batch):
            continue
        keys, sections, texts = (batch.column(n) for n in ("__key", "__section", "__text"))
        # each row beside the one before, the first one beside the last of the batch before
        before = pa.concat_arrays([pa.array([last[1]], texts.type), texts.slice(0, len(texts) - 1)])
        section = sections.to_numpy()
        prior = np.append(last[0], section[:-1])
        new = np.append(key is None or keys[0].as_py() != key, pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)).astype(bool)
        prior = np.where(new, 0, prior)
        listed = section % 2 == 1
        copy = listed & ~new & (prior == section) & pc.fill_null(pc.equal(texts, before), False).to_numpy(zero_copy_only=False)
        mark = np.where(listed, np.where(prior == section, 1, 2), np.where(section == 0, 0, np.where(prior % 2 == 1, 3, 4)))
        pieces = pc.binary_join_element_wise(_MARKS.take(pa.array(np.where(copy, 0, mark))), pc.if_else(pa.array(copy), "", texts), "")
        offsets = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset).tolist()
        raw = memoryview(pieces.buffers()[2])
        starts = np.flatnonzero(new).tolist()
        done = []
        if digest is not None:
            digest.update(raw[offsets[0] : offsets[starts[0] if starts else -1]])
            if starts:
                done.append((key, digest.hexdigest()))
        names = keys.take(pa.array(starts, pa.int64())).to_pylist()
        for k, (i, j) in zip(names, zip(starts, [*starts[1:], len(keys)])):
            if i != starts[0]:
                done.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(raw[offsets[i] : offsets[j]])
        last = (int(section[-1]), texts[-1].as_py())
        if done:
            yield _keyed(done, keys.type)
    if digest is not None:
        yield _keyed([(key, digest.hexdigest())], keys.type)


def _keyed(rows, kind):
    keys, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(ids, pa.string())], names=["__key", "id"])


def streamed_ids(headers: DataFrame, ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """(__key, id) from headers with a ``__key`` and long rows of fact ids (``identity_id``) and evidence ids
    (``evidence_id``) under it; copies count once. The text is hashed in the order of (section, value); Spark sorts on disk."""
    head, middle, tail = claim_json_parts()

    def piece(section, value):
        return F.struct(F.lit(section).alias("__section"), value.alias("__value"))

    fixed = headers.select("__key", F.inline(F.array(piece(0, head), piece(2, middle), piece(4, tail))))
    rows = ids.select("__key", F.lit(1).alias("__section"), F.col("identity_id").alias("__value"))
    rows = rows.unionByName(evidence.select("__key", F.lit(3).alias("__section"), F.col("evidence_id").alias("__value")))
    stream = fixed.unionByName(rows).repartition("__key").sortWithinPartitions("__key", "__section", "__value")
    value = F.col("__value")
    text = F.when(F.col("__section") % 2 == 1, _json([value], lambda s, t: s(value))).otherwise(value)
    kind = headers.schema["__key"].dataType.simpleString()
    return stream.select("__key", "__section", text.alias("__text")).mapInArrow(_hash_runs, f"__key {kind}, id string")


COLUMNS = [
    "id", *KEYS, "policy_hash", "query", "verdict", "qualifiers", "evaluated_at", "evaluator_version",
    "identities_hash", "projection_manifest_hash", "vocab_version", "normalizer_versions", "derivation",
]


class Claims(NamedTuple):
    rows: DataFrame  # COLUMNS
    facts: DataFrame  # (claim_id, identity_id), distinct
    evidence: DataFrame  # (claim_id, evidence_id), distinct


def claims(facts: DataFrame, raw: DataFrame, policies, subjects: DataFrame | None = None, *,
           evaluator: str = EVALUATOR, evaluated_at: str = "", identities_hash: str = "",
           manifest_hash: str = "", subject_scoped: bool = False) -> Claims:
    """Claims with their content ids. Subjects whose verdict rules conflict give no claim.

    A claim names all evidence of its policy's sources, so claims about many subjects grow with
    subjects times evidence. ``subject_scoped`` keeps to the evidence that names the claim's subject
    and grows with the evidence alone; use it to evaluate everything."""
    policies = list(policies)
    verdicts = policies_.evaluate(facts, raw, policies, subjects, subject_scoped)
    headers = cut(_headers(verdicts, evaluator, evaluated_at, identities_hash, manifest_hash))  # which fixes their numbers
    keys = headers.select(*KEYS, "__key")
    # the one join by the names of a claim; from here on its number stands for it
    consumed = cut(snapshot.consumed_facts(facts, policies, subjects).join(keys, KEYS).select("__key", "identity_id", "evidence_id", "position", "normalizer"))
    names = snapshot.normalizer_versions(consumed, ["__key"]).groupBy("__key").agg(F.collect_list(F.struct("name", "version")).alias("__versions"))
    headers = headers.join(names, "__key", "left").withColumn("normalizer_versions", _versions(F.col("__versions"))).drop("__versions")
    ids = consumed.select("__key", "identity_id")
    own = consumed.where(F.coalesce("evidence_id", F.lit("")) != "").select("__key", "evidence_id")
    shared = snapshot.subject_raw_evidence(raw, policies) if subject_scoped else snapshot.policy_raw_evidence(raw, policies)
    evidence = own.unionByName(shared.join(keys, [k for k in KEYS if k in shared.columns]).select("__key", "evidence_id"))
    hashed = cut(streamed_ids(headers, ids, evidence))

    def named(rows, one):
        return rows.join(hashed.withColumnRenamed("id", "claim_id"), "__key").select("claim_id", one).distinct()

    return Claims(headers.join(hashed, "__key").select(*COLUMNS), named(ids, "identity_id"), named(evidence, "evidence_id"))


def derived_ids(claims: Claims, key: str = "id") -> DataFrame:
    """(``key``, derived): the id that each stored claim's row and long tables give."""
    def under(rows):
        return rows.withColumnRenamed("claim_id", "__key")

    again = streamed_ids(claims.rows.withColumn("__key", F.col("id")).dropDuplicates(["__key"]), under(claims.facts), under(claims.evidence))
    return again.select(F.col("__key").alias(key), F.col("id").alias("derived"))


def from_documents(documents: DataFrame) -> Claims:
    """Claims of documents that list their ids (``schemas.CLAIM``)."""
    def long(name, one):
        return documents.select(F.col("id").alias("claim_id"), F.explode(name).alias(one)).distinct()

    rows = documents.drop("identity_ids_consumed", "raw_evidence_ids_consumed")
    return Claims(rows, long("identity_ids_consumed", "identity_id"), long("raw_evidence_ids_consumed", "evidence_id"))


def documents(claims: Claims, subjects: DataFrame) -> DataFrame:
    """Claims of the named subjects with their ids listed in the row. A list is as long as its claim."""
    rows = claims.rows.join(subjects.select("subject").distinct(), "subject", "left_semi")
    wanted = rows.select(F.col("id").alias("claim_id"))

    def listed(table, one, name):
        return table.join(wanted, "claim_id", "left_semi").groupBy(F.col("claim_id").alias("id")).agg(F.array_sort(F.collect_set(one)).alias(name))

    return rows.join(listed(claims.facts, "identity_id", "identity_ids_consumed"), "id", "left").join(
        listed(claims.evidence, "evidence_id", "raw_evidence_ids_consumed"), "id", "left")


def with_citations(claims: Claims, occurrences: DataFrame) -> DataFrame:
    """(claim_id, identity_id, occurrence_id, ingested_at): the events behind a claim's facts. They are
    not part of the claim's id."""
    return claims.facts.join(snapshot.occurrences_by_identity(occurrences), "identity_id")
