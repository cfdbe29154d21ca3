"""Lineage and inspection queries over the projected tables."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factwright import schemas
from factwright.functions import text as X
from factwright.functions.envelopes import id_key, id_text
from factwright.operators.claims import Claims
from factwright.operators.ordering import first_named
from factwright.session import cut, union_all

VERIFIED = "cryptographically_verified_signature_by"
FAILED = "cryptographic_verification_failed"


def claim_lineage(claims: Claims, identities: DataFrame, raw: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(claim_id, kind, id, found, detail, occurrences): every fact and evidence id a claim consumed,
    with what it is or that it is missing. The events of each fact are counted here and listed by
    :func:`cited_occurrences`; spelling them out per claim would multiply the two."""
    facts = claims.facts.select("claim_id", F.lit("fact").alias("kind"), F.col("identity_id").alias("id"))
    evidence = claims.evidence.select("claim_id", F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"))
    return lineage_of(facts.unionByName(evidence), identities, raw, occurrences)


def lineage_of(ids: DataFrame, identities: DataFrame, raw: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The same from long rows (claim_id, kind, id)."""
    about = F.concat_ws(" ", "subject", "predicate", X.render_object("object"))
    facts = identities.select("id", F.lit("fact").alias("kind"), about.alias("detail"), "observed_at", "evidence_id", "normalizer")
    evidence = raw.select(
        "id", F.lit("evidence").alias("kind"), F.concat_ws(" ", "source", "endpoint").alias("detail"),
        F.col("fetched_at").alias("observed_at"), F.lit(None).cast("string").alias("evidence_id"),
        F.lit(None).cast("string").alias("normalizer"),
    )
    known = facts.unionByName(evidence).dropDuplicates(["kind", "id"])
    counts = occurrences.groupBy(F.col("identity_id").alias("id")).agg(F.count(F.lit(1)).alias("occurrences"))
    known = known.join(counts.withColumn("kind", F.lit("fact")), ["kind", "id"], "left")
    rows = ids.join(known, ["kind", "id"], "left")
    return rows.select(
        "claim_id", "kind", "id", F.col("detail").isNotNull().alias("found"), "detail", "observed_at", "evidence_id",
        "normalizer", F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
    )


def cited_occurrences(ids: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Events of the facts in ``ids`` (an ``id`` column)."""
    wanted = ids.select(F.col("id").alias("identity_id"))
    rows = occurrences.join(wanted, "identity_id", "left_semi")
    return rows.select("identity_id", F.col("id").alias("occurrence_id"), "attestor", "attestor_role", "log_id", "ingested_at")


def _brought(rows: DataFrame, table: DataFrame, key: str, within, parts: int) -> DataFrame:
    """(*within, *table's columns): the rows of ``table``, one per ``key``, that ``rows`` name, brought to where these lie. Of all rows only a hash of four bytes
    moves with ``within``; rows that it finds by chance have a key that is not there, and join nothing."""
    short = F.hash(key).alias("__short")
    named = rows.select(*within, short).distinct()
    return named.join(table.withColumn("__short", short), "__short").drop("__short").repartition(parts, *within)


def fact_dossier(identities: DataFrame, occurrences: DataFrame, raw: DataFrame, within=(), parts: int | None = None) -> DataFrame:
    """Each fact with its evidence and the number of events that cite it; none makes it an orphan. ``within`` may name columns of the content that
    facts are dealt by, in ``parts`` parts, where ids are known to be those of their content: facts then stay where they are."""
    counts = occurrences.groupBy(id_key("identity_id").alias("__id")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("ingested_at").alias("first_seen")
    ).withColumn("id", id_text("__id")).drop("__id")
    # facts and sidecars may be stored more than once: the one with the least path counts, as in a projection
    about = ("source", "endpoint", "fetched_at", "fetcher", "payload_path")
    evidence = raw.groupBy(F.col("id").alias("evidence_id")).agg(F.min_by(F.struct(*about), F.struct("payload_path", "endpoint")).alias("e"))
    if within:
        rows = _joined_within(identities, counts, evidence, tuple(within), parts)
    else:
        rows = identities.dropDuplicates(["id"]).join(counts, "id", "left").join(evidence, "evidence_id", "left")
    n = F.coalesce("occurrences", F.lit(0))
    return rows.select(
        "id", "subject", "predicate", X.render_object("object").alias("object"), "observed_at", "normalizer", "vocab",
        "revises", n.alias("occurrences"), (n == 0).alias("orphan"), "first_seen", "evidence_id",
        F.col("e.source").isNotNull().alias("evidence_found"), *[F.col(f"e.{c}").alias(c) for c in about],
    )


def _joined_within(identities: DataFrame, counts: DataFrame, evidence: DataFrame, within: tuple, parts: int) -> DataFrame:
    """The joins of :func:`fact_dossier` as groups of what lies together: copies of a fact and its count, then facts and their evidence."""
    rest = [c for c in ("subject", "predicate", "object", "observed_at", "normalizer", "vocab", "revises", "evidence_id") if c not in within]
    fact = identities.select(*within, "id", F.struct(*rest).alias("f"), F.lit(None).alias("c"))
    cited = _brought(identities, counts, "id", within, parts).select(*within, "id", F.lit(None).alias("f"), F.struct("occurrences", "first_seen").alias("c"))
    folded = fact.unionByName(cited).groupBy(*within, "id").agg(F.any_value("f", True).alias("f"), F.max("c").alias("c")).where("f IS NOT NULL")
    facts = folded.select(*within, F.col("f.evidence_id").alias("evidence_id"), F.struct("id", "f", "c").alias("r"), F.lit(None).alias("e"))
    known = _brought(identities, evidence, "evidence_id", within, parts).select(*within, "evidence_id", F.lit(None).alias("r"), "e")
    along = W.partitionBy(*within, "evidence_id").orderBy(F.col("r").isNotNull())
    both = facts.unionByName(known).withColumn("e", F.first("e", True).over(along)).where("r IS NOT NULL")
    return both.select(*within, "r.id", *[F.col(f"r.f.{c}").alias(c) for c in rest], "r.c.*", "e")


def occurrence_dossier(occurrences: DataFrame, identities: DataFrame) -> DataFrame:
    facts = identities.select(
        id_key("id").alias("__fact"), "subject", "predicate", X.render_object("object").alias("object"),
        "observed_at", "normalizer", "evidence_id",
    )
    events = occurrences.withColumn("__fact", id_key("identity_id"))
    return events.join(first_named(events, facts), "__fact", "left").drop("__fact")


def subject_facts(identities: DataFrame, subjects: DataFrame) -> DataFrame:
    """Report rows: facts of the subjects with class and whether a peer reported them."""
    rows = identities.join(subjects.select("subject").distinct(), "subject", "left_semi")
    return rows.select(
        "subject", "id", X.vocab_class("predicate").alias("class"), "predicate",
        F.col("predicate").startswith("peer_reports_").alias("peer_imported"),
        X.render_object("object", quoted=False).alias("object"), "observed_at", "normalizer", "evidence_id",
    )


def subject_claims(claims: Claims, subjects: DataFrame) -> DataFrame:
    return claims.rows.join(subjects.select("subject").distinct(), "subject", "left_semi")


def evidence_list(raw: DataFrame) -> DataFrame:
    """All evidence, as a report lists it; it is not tied to a subject."""
    return raw.select("id", "source", "endpoint", "fetched_at", "payload_path", "result_count")


def locally_witnessed(occurrences: DataFrame) -> DataFrame:
    rows = occurrences.where(F.col("attestor_role").isin("observer", "verifier")).select(id_key("identity_id").alias("k")).distinct()
    return rows.select(id_text("k").alias("identity_id"))


def peer_only_verifications(facts: DataFrame) -> DataFrame:
    """Reports that a peer verified a subject for which we hold no verification of our own."""
    reports = facts.where(F.col("predicate") == "peer_reports_cryptographic_verification_of")
    ours = facts.where(F.col("predicate") == VERIFIED).select("subject")
    return reports.join(ours, "subject", "left_anti").select("subject", "identity_id", F.col("object").alias("foreign_id"))


def corroboration(occurrences: DataFrame) -> DataFrame:
    """Events, distinct logs and roles per fact. Distinct logs count witnesses; one log may record a
    fact many times."""
    return occurrences.groupBy("identity_id").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct("log_id").alias("logs"),
        *[F.max(F.col("attestor_role") == r).alias(r) for r in ("observer", "verifier", "federated_importer")],
    )


def locally_verified(facts: DataFrame, local_occurrences: DataFrame) -> DataFrame:
    """Facts of the verification class with a verifier's event in a local log."""
    events = local_occurrences.where(F.col("attestor_role") == "verifier").select("identity_id")
    return facts.where(X.vocab_class("predicate") == "verification").join(events, "identity_id", "left_semi")


def reasons(failures: DataFrame) -> DataFrame:
    """(id, reason_code) of stored failure records (id, body)."""
    return failures.select("id", F.from_json("body", schemas.FAILURE_RECORD)["reason_code"].alias("reason_code"))


def reason_rollup(failures: DataFrame) -> DataFrame:
    return reasons(failures).groupBy(F.coalesce("reason_code", F.lit("unknown")).alias("reason_code")).agg(
        F.count(F.lit(1)).alias("failures")
    )


def evidence_state(subjects: DataFrame, attempts: DataFrame, facts: DataFrame, failures: DataFrame) -> DataFrame:
    """One state per subject. ``attempts``: (subject, result_count) of attestation queries;
    ``failures``: (id, reason_code). Failures outside the named states give ``attempted_other``."""
    tried = attempts.groupBy("subject").agg(
        F.lit(True).alias("tried"), F.max(F.coalesce("result_count", F.lit(0))).alias("results")
    )
    # facts are read once; only a failure's evidence is looked up
    facts = cut(facts.where(F.col("predicate").isin(VERIFIED, FAILED)).select(
        "subject", "predicate", F.when(F.col("predicate") == FAILED, F.col("evidence_id")).alias("evidence_id"), F.col("superseded_by").isNull().alias("current")))
    verified = facts.where((F.col("predicate") == VERIFIED) & F.col("current")).groupBy("subject").agg(F.lit(True).alias("verified"))
    codes = failures.select(F.col("id").alias("evidence_id"), "reason_code")
    refuted = facts.where(F.col("predicate") == FAILED).join(codes, "evidence_id", "left")
    malformed = F.col("reason_code") == "bundle_parse_failed"
    incoherent = F.col("reason_code") == "oidc_subject_coherence_failed"
    invalid = F.col("reason_code").isin(
        "signature_invalid", "certificate_chain_invalid", "transparency_log_proof_invalid", "subject_digest_mismatch"
    )
    refuted = refuted.groupBy("subject").agg(
        F.lit(True).alias("refuted"), F.max(malformed).alias("malformed"), F.max(incoherent).alias("incoherent"),
        F.max(invalid).alias("invalid"),
    )
    rows = subjects.select("subject").distinct()
    for part in (tried, verified, refuted):
        rows = rows.join(part, "subject", "left")
    state = (
        F.when(F.col("verified"), F.lit("verified"))
        .when(F.col("incoherent"), F.lit("semantically_incoherent"))
        .when(F.col("invalid"), F.lit("cryptographically_invalid"))
        .when(F.col("malformed"), F.lit("malformed"))
        .when(F.col("refuted"), F.lit("attempted_other"))
        .when(F.col("tried") & (F.col("results") == 0), F.lit("attempted_empty"))
        .when(F.col("tried"), F.lit("attempted_other"))
        .otherwise(F.lit("not_attempted"))
    )
    return rows.select("subject", state.alias("state"))


def as_of(lines: DataFrame, occurrences: DataFrame, moment: str) -> DataFrame:
    """The lines of facts that some event had recorded by ``moment``; project them to get the tables,
    supersession included, as they stood."""
    seen = occurrences.where(X.instant("ingested_at") <= X.instant(F.lit(moment))).select(F.col("identity_id").alias("id"))
    return lines.join(seen, "id", "left_semi")


REST = 1 << 18  # open facts that one task ranks at once
STEPS = 3  # rounds of contraction per written table


def _coin(c: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(2)) == 1


def _contract(rows: DataFrame, step: int, salt: int) -> DataFrame:
    """One round on (id, up, w, end, gone): a fact whose coin is 1 goes if it stands over a root or over a fact whose coin is 0; what
    looked at it looks past it. No two neighbours go."""
    goes = (F.col("gone") == 0) & (F.col("up") != F.col("id")) & _coin("id", salt) & (F.col("end") | ~_coin("up", salt))
    rows = rows.withColumn("gone", F.when(goes, F.lit(step)).otherwise(F.col("gone")))
    hop = rows.where(F.col("gone") == step).select(F.col("id").alias("up"), F.col("up").alias("past"), F.col("w").alias("more"), F.col("end").alias("ended"))
    near = rows.where("gone = 0").join(hop, "up", "left").select(
        "id", F.coalesce("past", "up").alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.coalesce("ended", "end").alias("end"), "gone")
    return near.unionByName(rows.where("gone > 0"))


def _rank(batches):
    """(id, root, depth) of all open facts that are left: each looks back twice as far per step. Both are null on a cycle, and behind one."""
    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    n = len(t)
    to = pc.fill_null(pc.index_in(t["up"], value_set=t["id"]), n).to_numpy().astype(np.int64)
    # place n stands for every root, place n + 1 for what has been found to be cyclic
    to = np.append(np.where(t["end"].to_numpy(), n, np.where(to == n, n + 1, to)), [n, n + 1])
    depth, last = np.append(t["w"].to_numpy(), [0, 0]), np.arange(n + 2)
    for _ in range(n.bit_length() + 1):
        last = np.where(to < n, last[np.minimum(to, n - 1)] if n else last, last)
        depth, to = depth + np.where(to < n, depth[to], 0), to[to]
    sound = to[:n] == n
    yield pa.RecordBatch.from_arrays([
        t["id"].combine_chunks(), pc.if_else(pa.array(sound), t["up"].take(pa.array(last[:n])), pa.scalar(None, pa.string())).combine_chunks(),
        pa.array(depth[:n], pa.int64(), mask=~sound)], names=["id", "root", "depth"])


def revision_chains(revisions: DataFrame, rest: int = REST) -> DataFrame:
    """(id, root, depth, head, length, cyclic) from (id, revises), by contraction.

    Per round a quarter of the facts that revise another one leaves in expectation, and keeps its place at the fact that it looks at.
    When no more than ``rest`` are left, one task ranks them; those that left are then placed over the facts they stayed at, last
    first. The work is linear in all, however long a single chain is. A cycle shrinks to one fact that looks at itself."""
    nodes = revisions.select("id", F.when(F.coalesce("revises", F.lit("")) != "", F.col("revises")).alias("up"))
    nodes = cut(nodes.groupBy("id").agg(F.max("up").alias("up")))
    # a target that was never written ends the chain at the fact that names it
    written = nodes.select(F.col("id").alias("up"))
    open_ = cut(nodes.where(F.col("up").isNotNull()).join(written, "up", "left_semi").select("id", "up"))
    inner = open_.select(F.col("id").alias("up"), F.lit(True).alias("inner"))
    state = open_.join(inner, "up", "left").select("id", "up", F.lit(1).cast("long").alias("w"), F.col("inner").isNull().alias("end"))
    left, parts, n, salt = [], [], open_.count(), 0
    while n > rest:
        rows = state.withColumn("gone", F.lit(0))
        for step in range(1, STEPS + 1):
            rows = _contract(rows, step, salt + step)
        rows, salt = cut(rows), salt + STEPS
        left.append(rows)
        stays, cyclic = rows.where("gone = 0").drop("gone"), (F.col("up") == F.col("id"))
        parts.append(stays.where(cyclic).select("id", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth")))
        state = stays.where(~cyclic)
        n = state.count()
    parts.append(cut(state.coalesce(1).mapInArrow(_rank, "id string, root string, depth long")))
    for rows in reversed(left):
        known, mine = union_all(parts), []
        for step in range(STEPS, 0, -1):
            over = union_all([known, *mine]).select(F.col("id").alias("up"), "root", F.col("depth").alias("more"))
            mine.append(rows.where(F.col("gone") == step).join(over, "up", "left").select(
                "id", F.when(F.col("end"), F.col("up")).otherwise(F.col("root")).alias("root"),
                F.when(F.col("end"), F.col("w")).otherwise(F.col("w") + F.col("more")).alias("depth")))
        parts.append(cut(union_all(mine)))
    ranked = union_all(parts)
    ends = cut(ranked.where(F.col("root").isNotNull()).groupBy("root").agg(F.max_by("id", F.struct("depth", "id")).alias("head"), F.max("depth").alias("length")))
    cyclic = F.col("root").isNull()
    rows = ranked.join(ends, "root", "left").select("id", "root", "depth", "head", "length", cyclic.alias("cyclic"))
    roots = nodes.join(open_.select("id"), "id", "left_anti").join(ends, F.col("id") == F.col("root"), "left").select(
        "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.coalesce("head", "id").alias("head"), F.coalesce("length", F.lit(0)).alias("length"), F.lit(False).alias("cyclic"))
    return rows.unionByName(roots)


def conflicting_observations(facts: DataFrame, occurrences: DataFrame, predicates=("published_at", "published_by")) -> DataFrame:
    """(subject, predicate, objects, logs) where logs recorded different current objects of a
    single-valued predicate. Conflicts are reported, not resolved."""
    rows = facts.where(F.col("predicate").isin(*predicates) & F.col("superseded_by").isNull())
    # one row per (fact, log) is enough, so the copies of an event are folded before the join
    seen = occurrences.select("identity_id", "log_id").distinct()
    groups = rows.join(seen, "identity_id").groupBy("subject", "predicate").agg(
        F.count_distinct("object").alias("objects"), F.count_distinct("log_id").alias("logs")
    )
    return groups.where((F.col("objects") > 1) & (F.col("logs") > 1))


def anchor_coverage(checkpoints: DataFrame, anchors: DataFrame, heads: DataFrame) -> DataFrame:
    """(log_id, head_seq, checkpoints, unanchored, anchored_seq, behind) per log. ``checkpoints``: (iri,
    log_id, seq); ``anchors``: facts whose subject is a checkpoint."""
    known = anchors.select(F.col("subject").alias("iri")).distinct().withColumn("anchored", F.lit(True))
    rows = checkpoints.join(known, "iri", "left").groupBy("log_id").agg(
        F.count(F.lit(1)).alias("checkpoints"),
        F.count_if(F.col("anchored").isNull()).alias("unanchored"),
        F.max(F.when(F.col("anchored"), F.col("seq"))).alias("anchored_seq"),
    )
    both = heads.select("log_id", F.col("seq").alias("head_seq")).join(rows, "log_id", "left")
    return both.select(
        "log_id", "head_seq", F.coalesce("checkpoints", F.lit(0)).alias("checkpoints"),
        F.coalesce("unanchored", F.lit(0)).alias("unanchored"), "anchored_seq",
        (F.col("head_seq") - F.coalesce("anchored_seq", F.lit(0))).alias("behind"),
    )
