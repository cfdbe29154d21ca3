"""Audits by recomputation. Each check gives every violation as a row:
``(check_no, check, log_id, key, reason)``. Checks do not depend on each other.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factwright import schemas
from factwright.constants import GENESIS
from factwright.functions import envelopes as E, text as X
from factwright.functions.checks import identity_violation, occurrence_violation
from factwright.operators import claims as claims_
from factwright.operators.ordering import first_named, previous
from factwright.session import cut, union_all

CHECKS = {
    1: "identity reproducibility",
    2: "occurrence signatures",
    3: "chain integrity",
    4: "identity occurrence linkage",
    5: "raw evidence resolvability",
    6: "projection determinism",
    7: "claim envelope consistency",
    8: "re-verification of verified facts",
    9: "claim re-derivation",
    10: "foreign chain integrity",
    11: "foreign occurrence signatures",
    12: "no laundering",
    13: "anchor integrity",
    14: "orphans and mismatches",
    16: "anchor equivocation",
    17: "role and class",
}


def violations(df: DataFrame, no: int, key, reason: Column, log_id=None) -> DataFrame:
    """The rows of ``df`` with a reason, in the form all checks share."""
    log = F.lit(None).cast("string") if log_id is None else F.col(log_id)
    return df.select(
        F.lit(no).alias("check_no"), F.lit(CHECKS[no]).alias("check"), log.alias("log_id"),
        F.col(key).cast("string").alias("key"), reason.alias("reason"),
    ).where(F.col("reason").isNotNull())


# -- 1, 2, 11: ids and signatures ---------------------------------------------------------------


def identity_reproducibility(identities: DataFrame) -> DataFrame:
    drift = F.when(E.identity_id() != F.coalesce("id", F.lit("")), F.lit("id mismatch"))
    return violations(identities, 1, "id", F.coalesce(identity_violation(), drift))


def occurrence_ids(occurrences: DataFrame, no: int = 2) -> DataFrame:
    drift = F.when(E.occurrence_id() != F.coalesce("id", F.lit("")), F.lit("id mismatch"))
    return violations(occurrences, no, "id", F.coalesce(occurrence_violation(), drift), "log_id")


def _signature_reasons(rows: DataFrame, by: str, named: str, keys: DataFrame, outcomes: DataFrame, unknown: str) -> DataFrame:
    """``rows`` with ``reason``, null where the signature is good. A signature with a usable header, key and encoding that ``outcomes``
    (``named``, valid) do not name is ``not_run``."""
    parsed = rows.withColumn("__s", E.split_signature("signature")).withColumn("fingerprint", F.col("__s.fingerprint"))
    known = parsed.join(keys.select(by, "public_key"), by, "left").withColumn(
        "__sig", F.try_to_binary(F.col("__s.signature"), F.lit("base64"))
    )
    header = F.coalesce(
        F.when(F.col("__s.algorithm").isNull(), F.lit("malformed signature")),
        F.when(F.col("__s.algorithm") != "ed25519", F.lit("unsupported signature algorithm")),
        F.when(F.col("public_key").isNull(), F.lit(unknown)),
        F.when(F.col("__sig").isNull(), F.lit("signature is not base64")),
    )
    found = outcomes.groupBy(named).agg(F.min("valid").alias("__valid"))  # one bad outcome counts
    verdict = F.when(F.col("__valid").isNull(), F.lit("not_run")).when(~F.col("__valid"), F.lit("signature does not verify"))
    return known.withColumn("__header", header).join(found, named, "left").withColumn("reason", F.coalesce("__header", verdict))


def occurrence_signatures(occurrences: DataFrame, keys: DataFrame, outcomes: DataFrame, no: int = 2) -> DataFrame:
    """Signatures against known keys. ``keys`` holds (fingerprint, public_key) for local logs; for
    foreign logs (``no=11``) it holds (log_id, public_key), and the peer's key counts whatever
    fingerprint the header names. ``outcomes`` (id, valid) is what a verifier found for the records."""
    by, unknown = ("log_id", "peer not registered") if no == 11 else ("fingerprint", "unknown key")
    return violations(_signature_reasons(occurrences, by, "id", keys, outcomes, unknown), no, "id", F.col("reason"), "log_id")


def evidence_digests(raw: DataFrame) -> DataFrame:
    """(key, digest, signature) of sidecars: the digest is of the text that a sidecar's signature covers. Copies of a sidecar count once."""
    return raw.select(F.col("id").alias("key"), F.sha2(E.raw_metadata_json(), 256).alias("digest"), "signature").distinct()


def claim_digests(claims: claims_.Claims) -> DataFrame:
    """The same of claims, whose signature covers the text that their id hashes."""
    return claims.rows.select(F.col("id").alias("key"), F.col("id").alias("digest"), "signature").distinct()


def document_signatures(documents: DataFrame, keys: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Signatures of evidence and claims: ``documents`` (key, digest, signature) against local keys (fingerprint, public_key) and what a
    verifier found for digests (digest, valid)."""
    rows = _signature_reasons(documents, "fingerprint", "digest", keys, outcomes, "unknown key")
    unsigned = F.when(F.coalesce("signature", F.lit("")) == "", F.lit("unsigned")).otherwise(F.col("reason"))
    return violations(rows, 14, "key", unsigned)


def foreign_signatures(occurrences: DataFrame, peer_keys: DataFrame, outcomes: DataFrame) -> DataFrame:
    return occurrence_ids(occurrences, 11).unionByName(occurrence_signatures(occurrences, peer_keys, outcomes, 11))


# -- 3, 10: chains ------------------------------------------------------------------------------


def _chain_reason(prev_hash: Column, has_prev: Column, copies: Column) -> Column:
    first = F.col("seq") == 1
    want = F.when(first, F.lit(GENESIS)).otherwise(prev_hash)
    link = E.chain_hash("prev_chain_hash", "occurrence_id")
    return F.coalesce(
        F.when(F.col("seq").isNull(), F.lit("malformed line")),
        F.when(copies > 1, F.lit("seq repeated")),
        F.when((F.col("seq") < 1) | (~first & ~has_prev), F.lit("seq gap")),
        F.when(F.col("prev_chain_hash") != want, F.lit("prev_chain_hash mismatch")),
        F.when(F.coalesce(link, F.lit("")) != F.col("chain_hash"), F.lit("chain_hash mismatch")),
    )


def chain_integrity(chain: DataFrame, no: int = 3) -> DataFrame:
    """Every line of every log against the line before it. The line before is found by joining on
    (log_id, seq), which spreads one long log over all tasks; repeated positions are folded to one row
    first, so they cannot multiply."""
    lines = chain.withColumn("key", F.concat_ws(":", "log_id", "seq"))
    if "malformed" in chain.columns:
        lines = lines.withColumn("key", F.coalesce(F.when(F.col("seq").isNull(), F.col("line")), F.col("key")))
    at = chain.where(F.col("seq").isNotNull()).groupBy("log_id", "seq").agg(
        F.max("chain_hash").alias("hash"), F.count(F.lit(1)).alias("copies")
    )
    before = at.select("log_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    positions = at.join(before, ["log_id", "seq"], "left").select("log_id", "seq", "copies", "before")
    rows = lines.join(positions, ["log_id", "seq"], "left")
    reason = _chain_reason(F.col("before"), F.col("before").isNotNull(), F.coalesce("copies", F.lit(1)))
    return violations(rows, no, "key", reason, "log_id")


def chain_integrity_windowed(chain: DataFrame, no: int = 3, block: int = 1 << 16) -> DataFrame:
    """The same violations from windows over blocks of positions."""
    rows = chain.where(F.col("seq").isNotNull()).withColumn("hash", F.col("chain_hash")).withColumn("at", F.col("seq"))
    rows = previous(rows, ["log_id"], ["seq", "chain_hash"], F.floor(F.col("seq") / block), ["at", "hash"])
    rows = rows.withColumn("__copies", F.count(F.lit(1)).over(W.partitionBy("log_id", "seq")))
    rows = rows.withColumn("key", F.concat_ws(":", "log_id", "seq"))
    adjacent = F.coalesce(F.col("prev_at") == F.col("seq") - 1, F.lit(False))
    return violations(rows, no, "key", _chain_reason(F.col("prev_hash"), adjacent, F.col("__copies")), "log_id")


# -- 4, 5, 6, 12, 14, 17: links -----------------------------------------------------------------


def linkage(local_occurrences: DataFrame, identities: DataFrame) -> DataFrame:
    events = local_occurrences.select("id", "log_id", E.id_key("identity_id").alias("__fact"))
    missing = events.join(identities.select(E.id_key("id").alias("__fact")), "__fact", "left_anti")
    return violations(missing, 4, "id", F.lit("names a missing fact"), "log_id")


def evidence_resolvability(identities: DataFrame, payloads: DataFrame) -> DataFrame:
    """``payloads``: (id, payload_hash), content already reduced to its hash. Facts are grouped by
    evidence id only through the join, for which both ids of a fact are bytes, and payloads are one row per id."""
    found = payloads.groupBy("id").agg(F.max((F.col("payload_hash") == F.col("id")).cast("int")).alias("sound"))
    rows = identities.select(E.id_key("id").alias("__fact"), E.id_key("evidence_id").alias("__evidence")).join(
        found.select(E.id_key("id").alias("__evidence"), "sound"), "__evidence", "left"
    ).select(E.id_text("__fact").alias("fact"), "sound")
    reason = F.when(F.col("sound").isNull(), F.lit("evidence missing")).when(
        F.col("sound") == 0, F.lit("payload hash drift")
    )
    return violations(rows, 5, "fact", reason)


def projection_determinism(recorded: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Recorded and rebuilt digests per table: (table, digest)."""
    both = recorded.select("table", F.col("digest").alias("a")).join(
        rebuilt.select("table", F.col("digest").alias("b")), "table", "full_outer"
    )
    return violations(both, 6, "table", F.when(~F.col("a").eqNullSafe(F.col("b")), F.lit("projection drift")))


def no_laundering(occurrences: DataFrame, identities: DataFrame, cls: Column | None = None) -> DataFrame:
    imported = occurrences.where(F.col("attestor_role") == "federated_importer")
    events = imported.select("id", "log_id", E.id_key("identity_id").alias("__fact"))
    known = first_named(events, identities.select(E.id_key("id").alias("__fact"), "predicate"))
    rows = events.join(known, "__fact", "left")
    cls = X.vocab_class("predicate") if cls is None else cls
    reason = F.when(F.col("predicate").isNull(), F.lit("names an unknown fact")).when(
        cls.isin("verification", "refutation"), F.concat(F.lit("laundering: "), cls)
    )
    return violations(rows, 12, "id", reason, "log_id")


def role_class(occurrences: DataFrame, identities: DataFrame) -> DataFrame:
    """Verification and refutation facts recorded under another role than verifier."""
    known = identities.where(X.vocab_class("predicate").isin("verification", "refutation")).select(
        E.id_key("id").alias("__fact")
    )
    others = occurrences.where(F.coalesce(F.col("attestor_role"), F.lit("")) != "verifier")
    rows = others.select("id", "log_id", E.id_key("identity_id").alias("__fact")).join(known, "__fact", "left_semi")
    return violations(rows, 17, "id", F.lit("verification fact under another role"), "log_id")


def orphans(occurrences: DataFrame, chain: DataFrame) -> DataFrame:
    """Records outside the chain, chain lines without a record, and records whose hashes differ from
    their chain line."""
    a = occurrences.select("log_id", "id", "prev_chain_hash", "chain_hash")
    b = chain.select(
        "log_id", F.col("occurrence_id").alias("id"), F.col("prev_chain_hash").alias("p"), F.col("chain_hash").alias("c"),
        F.lit(1).alias("in_chain"),
    )
    both = a.withColumn("recorded", F.lit(1)).join(b, ["log_id", "id"], "full_outer")
    reason = (
        F.when(F.col("in_chain").isNull(), F.lit("record not in chain"))
        .when(F.col("recorded").isNull(), F.lit("chain line without record"))
        .when(F.col("prev_chain_hash") != F.col("p"), F.lit("prev_chain_hash differs from chain"))
        .when(F.col("chain_hash") != F.col("c"), F.lit("chain_hash differs from chain"))
    )
    return violations(both, 14, "id", reason, "log_id")


# -- 7, 9: claims -------------------------------------------------------------------------------


def claim_envelopes(claims: claims_.Claims) -> DataFrame:
    """``file_id`` is the name the claim is stored under. The id is derived again from the row and both long tables."""
    rows = claims.rows.join(claims_.derived_ids(claims), "id", "left")
    reason = F.coalesce(
        F.when(~F.col("id").eqNullSafe(F.col("file_id")), F.lit("id differs from name")),
        F.when(~F.col("derived").eqNullSafe(F.col("id")), F.lit("id drift")),
    )
    return violations(rows, 7, "file_id", reason)


def claim_rederivation(claims: claims_.Claims, facts: DataFrame, raw: DataFrame, policies,
                       evaluator: str = claims_.EVALUATOR, subject_scoped: bool = False) -> DataFrame:
    """Evaluates every claim's subject and policy again and compares the ids."""
    stored = claims.rows.select("id", *claims_.KEYS)
    again = claims_.claims(facts, raw, policies, stored.select("subject"), evaluator=evaluator, subject_scoped=subject_scoped).rows
    both = stored.join(again.select(*claims_.KEYS, F.col("id").alias("again")), claims_.KEYS, "left")
    absent = F.lit(False)
    for k in claims_.KEYS:
        absent = absent | (F.coalesce(k, F.lit("")) == "")
    reason = F.coalesce(
        F.when(absent, F.lit("missing subject or policy")),
        F.when(F.col("again").isNull(), F.lit("evaluation error")),
        F.when(F.col("again") != F.col("id"), F.lit("claim id drift")),
    )
    return violations(both, 9, "id", reason)


# -- 8: verified facts --------------------------------------------------------------------------


def reverification(identities: DataFrame, payloads: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """What can be checked of verified facts without a verifier: evidence, bundle and digests resolve.
    The verifier's own outcome comes from ``results`` (bundle_id, verified, reason, certificate
    subject); a fact without one is reported as ``not_run``. ``payloads``: (id, body)."""
    wanted = identities.where(F.col("predicate") == "cryptographically_verified_signature_by").select("id", "evidence_id").dropDuplicates(["id"])
    ids = wanted.select("evidence_id").distinct()
    # a body is reduced to what is asked of it in the scan; no shuffle carries the bytes
    narrow = payloads.select(
        "id", X.bundle_pointer("body").alias("pointer"), F.col("body").isNotNull().alias("there"), X.bundle_digests("body")["error"].alias("error")
    ).dropDuplicates(["id"])
    # evidence without a pointer, most of it, meets nothing and is dealt by its own id, not as one group
    own = F.col("pointer").isNull()
    direct = narrow.join(ids.withColumnRenamed("evidence_id", "id"), "id", "left_semi").select(
        F.col("id").alias("evidence_id"), "pointer", "there", "error", F.coalesce("pointer", "id").alias("bundle_id"), own.alias("own"))
    pointed = narrow.select(F.col("id").alias("bundle_id"), F.lit(False).alias("own"), F.col("there").alias("other_there"), F.col("error").alias("other_error"))
    bundles = direct.join(pointed, ["bundle_id", "own"], "left").select(
        "evidence_id", "bundle_id",
        F.when(own, F.col("there")).otherwise(F.coalesce("other_there", F.lit(False))).alias("resolved"),
        F.when(own, F.col("error")).otherwise(F.col("other_error")).alias("digest_error"),
    )
    rows = wanted.join(bundles, "evidence_id", "left")
    if results is None:
        rows = rows.select("*", F.lit(None).cast("boolean").alias("verified"), F.lit(None).cast("string").alias("why"),
                           F.lit(None).cast("string").alias("repo_subject"))
    else:
        known = results.select("bundle_id", "verified", F.col("reason").alias("why"), F.col("oidc_subject").alias("repo_subject"))
        rows = rows.join(known, "bundle_id", "left")
    repo = X.owner_repo("repo_subject")
    reason = F.coalesce(
        F.when(F.col("bundle_id").isNull(), F.lit("evidence missing")),
        F.when(~F.col("resolved"), F.lit("bundle missing")),
        F.col("digest_error"),
        F.when(F.col("verified").isNull(), F.lit("not_run")),
        F.when((repo["owner"] == "") | (repo["repo"] == ""), F.lit("no repository in certificate")),
        F.when(~F.col("verified"), F.concat(F.lit("re-verification failed: "), F.coalesce("why", F.lit("")))),
    )
    return violations(rows, 8, "id", reason)


# -- 13, 16: anchors ----------------------------------------------------------------------------

ANCHOR = "transparency_log_records_checkpoint"


def anchored_checkpoints(identities: DataFrame, payloads: DataFrame) -> DataFrame:
    """Anchors with the checkpoint they name: (id, subject, checkpoint_id: a key as of :func:`envelopes.id_key`, body found, cp struct)."""
    named = F.col("subject").startswith("checkpoint:")
    anchors = identities.where(F.col("predicate") == ANCHOR).select(
        "id", F.when(named, E.id_key(F.substr("subject", F.lit(12)))).alias("checkpoint_id"), F.when(~named, F.col("subject")).alias("other")).dropDuplicates(["id"])
    cp = F.from_json("body", schemas.SIGNED_CHECKPOINT)["checkpoint"]
    hash_ = E.id_key(cp["chain_hash"]).alias("chain_hash")
    parsed = payloads.select(E.id_key("id").alias("checkpoint_id"), F.struct(cp["log_id"].alias("log_id"), cp["seq"].alias("seq"), hash_).alias("cp"))
    # ids and hashes move as bytes, and a payload once
    parsed = parsed.where(F.col("checkpoint_id").isNotNull()).dropDuplicates(["checkpoint_id"]).withColumn("found", F.lit(True))
    subject = F.coalesce("other", F.concat(F.lit("checkpoint:"), E.id_text("checkpoint_id")))
    return anchors.join(parsed, "checkpoint_id", "left").select("id", subject.alias("subject"), "checkpoint_id", "found", "cp")


def anchor_outcomes(identities: DataFrame, payloads: DataFrame, chain: DataFrame) -> DataFrame:
    """(id, subject, log_id, seq, outcome) of every anchor, ``ok`` included."""
    rows = anchored_checkpoints(identities, payloads).select("id", "subject", "checkpoint_id", "found", "cp.*")
    hashes = ("chain_hash", "prev_chain_hash", "occurrence_id")
    chain = chain.select("log_id", "seq", *[E.id_key(c).alias(c) for c in hashes])
    # one row per position, from which both what stands there and whether its log holds together follow
    at = cut(chain.groupBy("log_id", "seq").agg(*[F.max(c).alias(c) for c in hashes], F.count(F.lit(1)).alias("copies")))
    before = at.select("log_id", (F.col("seq") + 1).alias("seq"), F.col("chain_hash").alias("before"))
    judged = at.join(before, ["log_id", "seq"], "left").withColumns({c: E.id_text(c) for c in (*hashes, "before")})
    judged = judged.withColumn("reason", _chain_reason(F.col("before"), F.col("before").isNotNull(), F.col("copies")))
    logs = judged.groupBy("log_id").agg(F.lit(True).alias("has_log"), F.max(F.when(F.col("reason").isNotNull(), True)).alias("broken"))
    there = at.where(F.col("seq").isNotNull()).select("log_id", "seq", F.col("chain_hash").alias("there"))
    rows = rows.join(logs, "log_id", "left").join(there, ["log_id", "seq"], "left")
    outcome = (
        F.when(F.col("checkpoint_id").isNull(), F.lit("malformed subject"))
        .when(F.col("found").isNull(), F.lit("checkpoint missing"))
        .when(F.col("log_id").isNull(), F.lit("checkpoint unparseable"))
        .when(F.col("has_log").isNull(), F.lit("MISSING_LOG"))
        .when(F.col("broken").isNotNull(), F.lit("chain broken"))
        .when(F.col("there").isNull(), F.lit("TRUNCATED"))
        .when(F.col("there") != F.col("chain_hash"), F.lit("TAMPER"))
        .otherwise(F.lit("ok"))
    )
    return rows.select("id", "subject", "log_id", "seq", outcome.alias("outcome"))


def anchor_integrity(identities: DataFrame, payloads: DataFrame, chain: DataFrame) -> DataFrame:
    rows = anchor_outcomes(identities, payloads, chain)
    return violations(rows, 13, "id", F.when(F.col("outcome") != "ok", F.col("outcome")), "log_id")


def anchor_equivocation(identities: DataFrame, payloads: DataFrame) -> DataFrame:
    rows = anchored_checkpoints(identities, payloads).select("cp.log_id", "cp.seq", "cp.chain_hash").where(F.col("log_id").isNotNull())
    groups = rows.groupBy("log_id", "seq").agg(F.count_distinct("chain_hash").alias("n")).where("n > 1")
    groups = groups.withColumn("key", F.concat_ws(":", "log_id", "seq"))
    return violations(groups, 16, "key", F.concat(F.col("n").cast("string"), F.lit(" chain hashes")), "log_id")


# -- 15: summary --------------------------------------------------------------------------------


def summary(found: DataFrame, ran=tuple(CHECKS)) -> DataFrame:
    """One row per check that ran, and one for the whole audit (check 0)."""
    spark = found.sparkSession
    checks = spark.createDataFrame([(n, CHECKS[n]) for n in ran], "check_no int, check string")
    counts = found.groupBy("check_no").agg(F.count(F.lit(1)).alias("violations"))
    rows = checks.join(counts, "check_no", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    rows = rows.withColumn("passed", F.col("violations") == 0)
    total = rows.agg(F.sum("violations").alias("violations")).select(
        F.lit(0).alias("check_no"), F.lit("audit").alias("check"), "violations", (F.col("violations") == 0).alias("passed")
    )
    return rows.unionByName(total)


def audit(checks) -> DataFrame:
    return union_all(checks)
