"""The jobs a user runs, put together from sources, operators and sinks. What a job adds to a store, it adds in one commit."""

from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from factwright import schemas
from factwright.functions import envelopes as E
from factwright.operators import append, audit as A, claims as C, federation as FED, lineage as L, normalize as N
from factwright.operators import policy as G, projection as P
from factwright.session import cut, union_all
from factwright.sources import config, evidence, logs, sinks
from factwright.sources.commits import committed


class Store(NamedTuple):
    """A data folder as tables. ``occurrences`` are the records a chain names, ``records`` all of them."""
    identities: DataFrame
    occurrences: DataFrame
    missing_records: DataFrame
    records: DataFrame
    chain: DataFrame
    raw: DataFrame
    payloads: DataFrame
    root: str | None = None
    commits: list = []


def open_store(spark: SparkSession, root: str, local_log_id: str) -> Store:
    commits = committed(spark, root)
    occurrences, missing = logs.read_occurrences(spark, root, local_log_id, commits)
    return Store(
        logs.read_identities(spark, f"{root}/assertions/identities", commits),
        occurrences,
        missing,
        logs.read_occurrences_file_order(spark, root, local_log_id, commits),
        logs.read_chain(spark, root, local_log_id, commits),
        evidence.read_raw_metadata(spark, root, commits=commits),
        evidence.read_payloads(spark, root, content=True, commits=commits),
        root,
        commits,
    )


class Ingested(NamedTuple):
    facts: DataFrame
    rejects: DataFrame  # (name, version, error)
    evidence: DataFrame | None  # bundles and failure records that facts rest on, for :func:`record`
    bundles: DataFrame  # what a verifier is asked about, ``bundle_id`` and the repository it should name included


def _landed(store: Store, source: str) -> DataFrame:
    """Landed responses of one source. Of a folder only that source's files are opened."""
    if not store.root:
        return evidence.landed(store.raw, store.payloads, source)
    spark = store.payloads.sparkSession
    return evidence.landed(
        evidence.read_raw_metadata(spark, store.root, source, commits=store.commits),
        evidence.read_payloads(spark, store.root, content=True, source=source, commits=store.commits), source)


def landed_coordinates(store: Store) -> tuple[DataFrame, DataFrame]:
    """((name, version), rejects) of landed package.json files."""
    files = _landed(store, "github.api").where(F.col("request_params")["path"] == "package.json")
    found = evidence.repository_packages(files)
    good = F.col("error").isNull()
    return found.where(good).select("name", "version").distinct(), found.where(~good).select("name", "version", "error")


def landed_bundles(store: Store) -> tuple[DataFrame, DataFrame]:
    """(bundles, rejects): the provenance bundle of each landed attestation response with the repository that its package names. A bundle of
    a package without one can't be held against it."""
    answers = evidence.attestation_responses(_landed(store, "npm.attestations"))
    packages = evidence.npm_packages(_landed(store, "npm.registry")).select(
        F.col("name").alias("package"), F.col("repository").alias("expected_repository"), "fetched_at", "evidence_id")
    newest = packages.groupBy("package").agg(F.max_by("expected_repository", F.struct("fetched_at", "evidence_id")).alias("expected_repository"))
    rows = N.provenance(answers).withColumn("bundle_id", F.sha2("bundle", 256)).join(newest, "package", "left")
    named = F.coalesce("expected_repository", F.lit("")) != ""
    rejects = rows.where(~named).select(F.col("package").alias("name"), "version", F.lit("package has no repository").alias("error"))
    return rows.where(named), rejects


def ingest_landed(store: Store, coordinates: DataFrame | None = None, results: DataFrame | None = None, outcomes: DataFrame | None = None) -> Ingested:
    """Facts of all landed responses: package versions of ``coordinates`` (name, version), or of the package.json files that landed where
    none are given, and advisories. ``outcomes`` (bundle_id, verified, reason, oidc_issuer, oidc_subject, cert_fingerprint) are what a
    verifier found of ``bundles``; bundles without one give no fact yet. ``results`` are whole results (``schemas.VERIFICATION_RESULT``)
    of another source."""
    rejects = []
    if coordinates is None:
        coordinates, refused = landed_coordinates(store)
        rejects.append(refused)
    documents = N.version_documents(evidence.npm_packages(_landed(store, "npm.registry")), coordinates)
    rejects.append(documents.where(F.col("error").isNotNull()).select("name", "version", "error"))
    facts = [N.normalize_npm(documents), N.normalize_osv(evidence.osv_responses(_landed(store, "osv.dev")))]
    bundles, refused = landed_bundles(store)
    rejects.append(refused)
    tried = [] if results is None else [results.select(*schemas.VERIFICATION_RESULT.names)]
    if outcomes is not None:
        found = outcomes.dropDuplicates(["bundle_id"]).select("bundle_id", "verified", "reason", "oidc_issuer", "oidc_subject", "cert_fingerprint")
        tried.append(bundles.join(found, "bundle_id").select(*schemas.VERIFICATION_RESULT.names))
    if tried:
        tried = union_all(tried)
        facts += [N.verified_facts(tried), N.refutation_facts(tried)]
    return Ingested(union_all(facts), union_all(rejects), N.verification_evidence(tried) if isinstance(tried, DataFrame) else None, bundles)


def _new_evidence(rows: DataFrame | None, raw: DataFrame, fetcher: str) -> tuple[DataFrame, DataFrame] | None:
    if rows is None:
        return None
    rows = cut(rows if "fetcher" in rows.columns else rows.withColumn("fetcher", F.lit(fetcher)))
    sidecars, payloads = sinks.put_raw(rows, raw)
    return cut(sidecars), payloads


def _heads(chain: DataFrame, local_log_id: str) -> DataFrame:
    own = chain.where(F.col("is_local") & F.col("malformed").isNull())
    return append.heads(own.where(append.is_shard(F.col("log_id"), local_log_id)))


def _moved(spark: SparkSession, root: str, local_log_id: str, heads: DataFrame):
    """Asks whether another writer has extended the local log since ``heads`` were read."""
    def ask():
        now = _heads(logs.read_chain(spark, root, local_log_id), local_log_id).select("log_id", "seq", "chain_hash")
        return None if now.exceptAll(heads.select("log_id", "seq", "chain_hash")).isEmpty() else "the local log has been extended meanwhile"

    return ask


def record(facts: DataFrame, root: str, day: str, now: str, attestor: str, local_log_id: str, shards: int = 1,
           evidence_of: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Commits facts, the events that record them, in one log or in ``shards`` of it, and the evidence that they rest on (``evidence_of``, as
    :func:`factwright.sources.sinks.put_raw` takes it); gives back rejected facts. ``name`` names the commit; one that is there already
    is an error."""
    spark = facts.sparkSession
    commits = committed(spark, root)
    stored = logs.read_identities(spark, f"{root}/assertions/identities", commits).select("id")
    heads = cut(_heads(logs.read_chain(spark, root, local_log_id, commits), local_log_id))
    facts = cut(facts.withColumn("id", E.identity_id()))
    fresh, rejected = sinks.new_identities(facts, stored)
    fresh = cut(fresh)
    # an event records a fact that is stored already or about to be, never one that is rejected
    events, rejects = N.emit(facts.join(fresh.select("id").unionByName(stored).distinct(), "id", "left_semi"), attestor, local_log_id, now, heads, shards)
    raw = None if evidence_of is None else evidence.read_raw_metadata(spark, root, commits=commits)
    sinks.commit(spark, root, name or f"{now.replace(':', '')}-{day}-record", identities=fresh, local=cut(events),
                 evidence=_new_evidence(evidence_of, raw, attestor), unless=_moved(spark, root, local_log_id, heads))
    return cut(rejects.unionByName(rejected.select(F.lit(None).cast("string").alias("id"), "reason")))


def ingest(store: Store, now: str, attestor: str, local_log_id: str, outcomes: DataFrame | None = None, coordinates: DataFrame | None = None, shards: int = 1) -> DataFrame:
    """Lands in the store what :func:`ingest_landed` finds in it: facts, bundles and failure records, and events, in one commit. Gives back all rejects as (key, reason)."""
    found = ingest_landed(store, coordinates, outcomes=outcomes)
    refused = record(found.facts, store.root, now[:10], now, attestor, local_log_id, shards, found.evidence)
    return found.rejects.select(F.concat_ws("@", "name", "version").alias("key"), F.col("error").alias("reason")).unionByName(refused.select(F.col("id").alias("key"), "reason"))


def project(store: Store, path: str, built_at: str) -> dict:
    """Rebuilds the projection in a new folder; returns its manifest."""
    p = P.project(store.identities, store.occurrences, store.raw)
    counts = {r["name"]: r["n"] for r in P.counts(store.identities, store.occurrences).collect()}  # 2 rows
    return sinks.write_projection(p, path, counts, built_at)


def with_hashes(policies, folder: DataFrame) -> list:
    """The built-in rule tables under the hashes of the policy folder they were drawn from."""
    found = {(r["name"], r["version"]): r["policy_hash"] for r in folder.select("name", "version", "policy_hash").collect()}
    return [replace(p, policy_hash=found.get((p.id, p.version), p.policy_hash)) for p in policies]


def evaluate(p: P.Projection, policies=G.BUILT_IN, subjects: DataFrame | None = None, raw: DataFrame | None = None, **claim) -> C.Claims:
    """Claims about the named subjects, each on all evidence of its policies' sources, or, without ``subjects``, about every
    subject. That needs ``raw`` evidence that names its subject (as a store's does), and keeps each claim to its own."""
    if subjects is None:
        if raw is None or "subject" not in raw.columns:
            raise ValueError("claims about all subjects need raw evidence with a subject column")
        return C.claims(p.facts, raw, policies, None, subject_scoped=True, **claim)
    return C.claims(p.facts, p.raw_evidence, policies, subjects, **claim)


def audit(store: Store, *, keys: DataFrame | None = None, peer_keys: DataFrame | None = None, claims: C.Claims | None = None,
          projection: P.Projection | None = None, recorded: DataFrame | None = None, policies=G.BUILT_IN,
          evaluator: str = C.EVALUATOR, results: DataFrame | None = None, outcomes: DataFrame | None = None, subject_scoped: bool = False, signed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(violations, summary) of every check its inputs allow. Checks whose input is not given do not
    run and do not appear in the summary as passed. ``outcomes`` (id, valid) are a verifier's findings on events, ``signed``
    (digest, valid) those on sidecars and claims."""
    local = F.col("is_local")
    local_events, foreign_events = store.occurrences.where(local), store.occurrences.where(~local)
    resolved = evidence.resolved_evidence(store.raw, store.payloads)
    bodies = store.payloads.select("id", "body")
    chain = store.chain
    found = {
        1: A.identity_reproducibility(store.identities),
        3: A.chain_integrity(chain.where(local), 3),
        4: A.linkage(local_events, store.identities),
        5: A.evidence_resolvability(store.identities, resolved),
        8: A.reverification(store.identities, bodies, results),
        10: A.chain_integrity(chain.where(~local), 10),
        12: A.no_laundering(store.occurrences, store.identities),
        13: A.anchor_integrity(store.identities, bodies, chain),
        14: A.orphans(store.records.withColumn("log_id", F.col("stored_log_id")), chain.where(F.col("malformed").isNull())),
        16: A.anchor_equivocation(store.identities, bodies),
        17: A.role_class(store.occurrences, store.identities),
    }
    if outcomes is None:
        outcomes = local_events.sparkSession.createDataFrame([], "id string, valid boolean")
    if keys is not None:
        found[2] = A.occurrence_ids(local_events).unionByName(A.occurrence_signatures(local_events, keys, outcomes))
        if signed is not None:
            documents = A.evidence_digests(store.raw)
            documents = documents if claims is None else documents.unionByName(A.claim_digests(claims))
            found[14] = found[14].unionByName(A.document_signatures(documents, keys, signed))
    if peer_keys is not None:
        found[11] = A.foreign_signatures(foreign_events, peer_keys, outcomes)
    if claims is not None:
        found[7] = A.claim_envelopes(claims)
        if projection is not None:
            raw = store.raw if subject_scoped else projection.raw_evidence
            found[9] = A.claim_rederivation(claims, projection.facts, raw, policies, evaluator, subject_scoped)
    if recorded is not None:
        rebuilt = P.projection_digests(P.project(store.identities, store.occurrences, store.raw))
        found[6] = A.projection_determinism(recorded, rebuilt)
    violations = A.audit(found.values())
    return violations, A.summary(violations, sorted(found))


class Import(NamedTuple):
    identities: DataFrame
    foreign_occurrences: DataFrame
    reports: DataFrame
    local_occurrences: DataFrame
    evidence: DataFrame
    rejects: DataFrame
    summary: DataFrame


def import_peer(peer: Store, home: Store, peer_log_id: str, local_log_id: str, now: str, fetcher: str,
                peer_keys: DataFrame, outcomes: DataFrame, shards: int = 1) -> Import:
    """What importing a peer's store would add: its observations and events, our reports of its
    verifications with the events that record them, and its records as evidence. ``peer_keys`` (log_id, public_key) and
    ``outcomes`` (id, valid), a verifier's findings, decide on signatures: what does not verify, or was not tried, is
    in ``rejects``. Write the parts only if that is empty."""
    new = cut(FED.drop_known(peer.occurrences.where("is_local"), home.occurrences))
    known_heads = append.heads(home.chain.where(F.col("malformed").isNull()))
    rejects = FED.validate_foreign(peer.identities.drop("ordinal"), new, peer_log_id, local_log_id).unionByName(
        FED.foreign_continuity(new, known_heads.where(F.col("log_id") == peer_log_id))
        .select(F.lit("event").alias("kind"), F.col("id").alias("key"), "reason")
    )
    signatures = A.foreign_signatures(new, peer_keys, outcomes)
    rejects = rejects.unionByName(signatures.select(F.lit("event").alias("kind"), "key", "reason"))
    routed = FED.route_by_class(new, peer.identities)
    unrouted = routed.where("route = 'reject'").select(F.lit("event").alias("kind"), F.col("id").alias("key"), F.lit("unknown class").alias("reason"))
    kept = routed.where("route = 'store'").select("identity_id").distinct()
    identities = peer.identities.join(kept, peer.identities["id"] == kept["identity_id"], "left_semi").drop("ordinal")
    reports = FED.rewrite_peer_reports(routed)
    local_heads = known_heads.where(append.is_shard(F.col("log_id"), local_log_id))
    return Import(
        identities, new, reports, FED.importer_occurrences(reports, local_log_id, now, local_heads, shards),
        FED.foreign_as_evidence(new, fetcher, now), rejects.unionByName(unrouted), FED.import_summary(routed, peer.identities),
    )


def commit_import(spark: SparkSession, peer_root: str, home_root: str, peer_log_id: str, local_log_id: str, now: str, fetcher: str,
                  new_keys: DataFrame, outcomes: DataFrame, revocations: DataFrame | None = None, shards: int = 1) -> tuple[DataFrame, DataFrame, dict | None]:
    """(rejects, summary, manifest) of importing a peer's store into ours as one. ``new_keys`` (log_id, public_key) are registered first
    and take part in the checks; ``revocations`` (log_id, revoked_at) refuse what was recorded after them. Any reject, and the import
    leaves nothing, keys included; what is there already adds nothing. The manifest is None where nothing was committed."""
    home, peer = open_store(spark, home_root, local_log_id), open_store(spark, peer_root, peer_log_id)
    registered = config.read_peer_keys(spark, home_root, home.commits).where("error IS NULL").select("log_id", "public_key")
    keys = cut(FED.register_peers(registered, new_keys))
    fresh = keys.where("outcome = 'registered'").select("log_id", "public_key")
    heads = cut(_heads(home.chain, local_log_id))
    found = import_peer(peer, home, peer_log_id, local_log_id, now, fetcher, registered.unionByName(fresh), outcomes, shards)
    refused = [found.rejects, keys.where("outcome NOT IN ('registered', 'known')").select(F.lit("key").alias("kind"), F.col("log_id").alias("key"), F.col("outcome").alias("reason"))]
    if revocations is not None:
        late = FED.revoked_peer_occurrences(found.foreign_occurrences, revocations)
        refused.append(late.select(F.lit("event").alias("kind"), F.col("id").alias("key"), F.lit("recorded after its peer was revoked").alias("reason")))
    if found.foreign_occurrences.isEmpty() and fresh.isEmpty():
        refused = refused[1:]  # nothing is new, so there is nothing of the peer's to judge
    rejects = cut(union_all(refused))
    if found.foreign_occurrences.isEmpty() and fresh.isEmpty() or not rejects.isEmpty():
        return rejects, found.summary, None
    facts = found.identities.select(*schemas.IDENTITY.names).unionByName(found.reports.select(*schemas.IDENTITY.names))
    facts = cut(facts.dropDuplicates(["id"]).join(home.identities.select("id"), "id", "left_anti"))
    manifest = sinks.commit(
        spark, home_root, f"{now.replace(':', '')}-import-{peer_log_id.replace(':', '_')}", identities=facts, local=cut(found.local_occurrences), foreign=cut(found.foreign_occurrences),
        evidence=_new_evidence(found.evidence, home.raw, fetcher), keys=fresh.withColumn("error", F.lit(None).cast("string")), unless=_moved(spark, home_root, local_log_id, heads))
    return rejects, found.summary, manifest if manifest["parts"] else None


def export(store: Store, path: str) -> None:
    sinks.export_nquads(store.identities, path)


def checkpoint(store: Store, signed_at: str, signatures: DataFrame | None = None, fetcher: str | None = None) -> DataFrame:
    """Checkpoints of all logs at their heads. Signed ones (``signatures``: log_id, signature) are committed as raw evidence of a stored
    folder if ``fetcher`` says who does it, under the very text that their address hashes."""
    made = N.checkpoints(store.chain.where(F.col("malformed").isNull()), signed_at, signatures)
    if fetcher is not None:
        made = cut(made)
        sinks.commit(made.sparkSession, store.root, f"{signed_at.replace(':', '')}-checkpoint", evidence=_new_evidence(N.checkpoint_evidence(made, fetcher), store.raw, fetcher))
    return made


def record_anchors(store: Store, anchors: DataFrame, now: str, attestor: str, local_log_id: str, shards: int = 1) -> DataFrame:
    """Commits operator-supplied anchors (checkpoint_iri, provider_iri, response, recorded_at): facts, their events and the providers' responses.
    Gives back what was refused: (key, reason)."""
    facts, rejects = N.anchor_facts(anchors, store.raw)
    kept = anchors.join(rejects.select("checkpoint_iri", "provider_iri").distinct(), ["checkpoint_iri", "provider_iri"], "left_anti")
    refused = record(facts, store.root, now[:10], now, attestor, local_log_id, shards, N.anchor_evidence(kept, attestor), f"{now.replace(':', '')}-anchors")
    return rejects.select(F.col("checkpoint_iri").alias("key"), "reason").unionByName(refused.select(F.col("id").alias("key"), "reason"))


def lineage(store: Store, claims: C.Claims) -> DataFrame:
    return L.claim_lineage(claims, store.identities, store.raw, store.occurrences)


def dossiers(store: Store) -> tuple[DataFrame, DataFrame]:
    local = store.occurrences.where("is_local")
    return L.fact_dossier(store.identities, local, store.raw), L.occurrence_dossier(store.occurrences, store.identities)


def policies(spark: SparkSession, folder: str) -> DataFrame:
    return config.read_policies(spark, folder)
