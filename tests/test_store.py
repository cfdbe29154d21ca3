"""A data folder from end to end: write, read, project, evaluate, audit, tamper, federate, export."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from factwright import schemas
from factwright.functions import envelopes as E
from factwright.operators import append, audit as A, claims as C, federation as FED, lineage as L, normalize as N, policy as G, projection as P
from factwright.plans import jobs
from factwright.session import cut
from factwright.sources import commits, config, evidence, logs, sinks
from tests import fixtures as X

LOG = "log:home"


def body(i):
    return f"payload {i}\n".encode()


def write_folder(spark, root, log=LOG, n=6, where="local"):
    """A folder of ``n`` facts, each with evidence and an event; the first revises nothing, the last two
    share a subject and the last revises the one before."""
    rows, previous = [], None
    day = "2026-01-01"
    for i in range(n):
        payload = body(i)
        ev = hashlib.sha256(payload).hexdigest()
        folder = f"{root}/raw/osv.dev/{day}"
        os.makedirs(folder, exist_ok=True)
        open(f"{folder}/{ev}.bin", "wb").write(payload)
        meta = {"id": ev, "source": "osv.dev", "endpoint": "e", "request_params": {"name": "x", "version": "1"}, "fetched_at": f"{day}T00:00:00Z",
                "fetcher": "f", "response_status": 200, "payload_path": f"{folder}/{ev}.bin", "payload_hash": ev, "result_count": i}
        open(f"{folder}/{ev}.json", "w").write(json.dumps(meta, indent=2))
        verified = i == 2
        rows.append((f"pkg:npm/p{min(i, n - 2)}@1", "cryptographically_verified_signature_by" if verified else "affected_by",
                     ("iri", f"osv:{i}", None, None, None), ev, f"{day}T00:00:0{i}Z", "norm@v1", "v6", None))
    schema = [f for f in schemas.IDENTITY.fields if f.name != "id"]
    from pyspark.sql.types import StructType

    facts = spark.createDataFrame(rows, StructType(schema)).withColumn("id", E.identity_id()).orderBy("observed_at").collect()
    out = []
    for i, f in enumerate(facts):
        d = f.asDict(recursive=True)
        d["object"] = {k: v for k, v in d["object"].items() if v is not None}
        if i == n - 1:
            d["revises"] = previous
            one = spark.createDataFrame([tuple(f[:2]) + (f.object,) + tuple(f[3:7]) + (previous, None)], StructType(schema[:7] + [schemas.IDENTITY["revises"]] + [schemas.IDENTITY["id"]]))
            d["id"] = one.select(E.identity_id()).first()[0]
        previous = d["id"]
        out.append(d)
    os.makedirs(f"{root}/assertions/identities", exist_ok=True)
    for part, chunk in (("2026-01-01", out[:3]), ("2026-01-02", out[3:])):
        open(f"{root}/assertions/identities/{part}.jsonl", "w").write("".join(json.dumps(d) + "\n" for d in chunk))
    new = spark.createDataFrame(
        [(d["id"], "ingestor:t:f", "verifier" if d["predicate"].startswith("crypto") else "observer", f"2026-01-02T00:00:0{i}Z", log) for i, d in enumerate(out)],
        "identity_id string, attestor string, attestor_role string, ingested_at string, log_id string",
    )
    events = append.append_occurrences(new).orderBy("seq").collect()
    folder = f"{root}/assertions/occurrences/{where}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/2026-01-02.jsonl", "w") as f:
        for e in events:
            d = e.asDict()
            d.pop("seq")
            f.write(json.dumps({**d, "signature": "ed25519:f:AAAA"}) + "\n")
    with open(f"{folder}/chain.log", "w") as f:
        for e in events:
            f.write(f"{e.seq}\t{e.prev_chain_hash}\t{e.id}\t{e.chain_hash}\n")
    return out, events


@pytest.fixture()
def root(spark, tmp_path):
    folder = str(tmp_path / "data")
    write_folder(spark, folder)
    return folder


def test_readers(spark, root):
    s = jobs.open_store(spark, root, LOG)
    assert s.identities.count() == 6 and s.occurrences.count() == 6 and s.missing_records.count() == 0
    assert [r.seq for r in s.occurrences.orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6]
    order = [r.observed_at for r in s.identities.orderBy("ordinal").collect()]
    assert order == sorted(order)
    assert {(r.log_id, r.is_local) for r in logs.discover_logs(spark, root, LOG).collect()} == {(LOG, True)}
    meta = s.raw.first()
    assert (meta.path_source, meta.path_day) == ("osv.dev", "2026-01-01") and meta.id == meta.path_id
    assert logs.read_claims(spark, root).count() == 0


def test_bad_chain_lines_are_reported(spark, root):
    path = f"{root}/assertions/occurrences/local/chain.log"
    open(path, "a").write("x\ty\nseven\ta\tb\tc\n")
    found = logs.read_chain(spark, root, LOG).where("malformed IS NOT NULL").collect()
    assert sorted(r.malformed for r in found) == ["expected 4 fields, got 2", "seq is not a number"]
    assert A.chain_integrity(logs.read_chain(spark, root, LOG)).count() == 2


def test_bad_json_is_an_error(spark, root):
    open(f"{root}/assertions/identities/2026-01-03.jsonl", "w").write("{not json\n")
    with pytest.raises(Exception):
        jobs.open_store(spark, root, LOG).identities.select("id", "subject").collect()


def test_project_evaluate_audit(spark, root, tmp_path):
    s = jobs.open_store(spark, root, LOG)
    path = str(tmp_path / "projection")
    manifest = jobs.project(s, path, "2026-02-01T00:00:00Z")
    assert manifest["identities_count"] == 6 and manifest["occurrences_count"] == 6
    p = sinks.read_projection(spark, path)
    assert p.facts.where("superseded_by IS NOT NULL").count() == 1
    with pytest.raises(ValueError):
        jobs.evaluate(p)
    scoped = jobs.evaluate(p, raw=s.raw)
    named = scoped._replace(rows=scoped.rows.withColumn("file_id", F.col("id")))
    again, _ = jobs.audit(s, claims=named, projection=p, subject_scoped=True)
    assert scoped.rows.count() > 0 and again.where("check_no in (7, 9)").count() == 0
    claims = jobs.evaluate(p, subjects=p.facts.select("subject"), evaluated_at="2026-02-01T00:00:00Z")
    claims = claims._replace(rows=claims.rows.withColumn("file_id", F.col("id")))
    recorded = spark.createDataFrame(list(manifest["tables"].items()), "table string, digest string")
    violations, summary = jobs.audit(s, claims=claims, projection=p, recorded=recorded)
    rows = {r.check_no: r.violations for r in summary.collect()}
    # no verifier ran for the one verified fact
    assert rows.pop(8) == 1 and rows.pop(0) == 1
    assert set(rows.values()) == {0} and set(rows) == {1, 3, 4, 5, 6, 7, 9, 10, 12, 13, 14, 16, 17}
    assert {r.reason for r in violations.where("check_no = 8").collect()} <= {"evidence missing", "bundle has no payload"}


@pytest.mark.parametrize("what,check,reason", [
    ("fact", 1, "id mismatch"), ("payload", 5, "payload hash drift"), ("chain", 3, "chain_hash mismatch"),
    ("truncate", 14, "record not in chain"), ("drop_fact", 4, "names a missing fact"),
])
def test_tampering_is_found(spark, root, what, check, reason):
    if what == "fact":
        p = f"{root}/assertions/identities/2026-01-01.jsonl"
        open(p, "r+").write(open(p).read().replace("osv:0", "osv:9"))
    elif what == "payload":
        ev = hashlib.sha256(body(0)).hexdigest()
        open(f"{root}/raw/osv.dev/2026-01-01/{ev}.bin", "wb").write(b"changed")
    elif what == "drop_fact":
        p = f"{root}/assertions/identities/2026-01-02.jsonl"
        text = open(p).read().splitlines(True)
        open(p, "w").write("".join(text[:-1]))
    else:
        p = f"{root}/assertions/occurrences/local/chain.log"
        lines = open(p).read().splitlines()
        if what == "truncate":
            lines = lines[:-1]
        else:
            lines[-1] = lines[-1][:-64] + "0" * 64
        open(p, "w").write("\n".join(lines) + "\n")
    found = [r for r in jobs.audit(jobs.open_store(spark, root, LOG))[0].collect() if r.check_no != 8]
    assert (check, reason) in {(r.check_no, r.reason) for r in found}
    # one defect, one check; a changed chain line also differs from its record
    assert {r.check_no for r in found} - {check} <= {14}


def test_append_and_read_back(spark, root):
    s = jobs.open_store(spark, root, LOG)
    extra = s.identities.drop("ordinal").limit(2).withColumn("subject", F.concat("subject", F.lit("-new"))).withColumn("id", E.identity_id())
    both = extra.unionByName(s.identities.drop("ordinal"))
    rejects = jobs.record(both, root, "2026-03-01", "2026-03-01T00:00:00Z", "ingestor:t:f", LOG)
    assert rejects.count() == 0
    again = jobs.open_store(spark, root, LOG)
    assert again.identities.count() == 8
    assert again.occurrences.count() == 14  # facts are kept once, events each time
    assert A.chain_integrity(again.chain).count() == 0


def test_a_sharded_recorder_chains_each_shard(spark, root):
    s = jobs.open_store(spark, root, LOG)
    for i, day in enumerate(("2026-03-01", "2026-03-02")):
        extra = s.identities.drop("ordinal").withColumn("subject", F.concat("subject", F.lit(f"-{i}"))).withColumn("id", E.identity_id())
        assert jobs.record(extra, root, day, f"{day}T00:00:00Z", "ingestor:t:f", LOG, shards=3).count() == 0
    again = jobs.open_store(spark, root, LOG)
    made = again.chain.where("is_local").groupBy("log_id").count().collect()
    assert len(made) > 2 and sum(r["count"] for r in made) == 18 and LOG in {r.log_id for r in made}
    assert A.chain_integrity(again.chain).count() == 0
    assert again.occurrences.count() == 18 and again.missing_records.count() == 0


def test_federation(spark, tmp_path):
    peer, home = str(tmp_path / "peer"), str(tmp_path / "home")
    facts, events = write_folder(spark, peer, log="log:peer")
    write_folder(spark, home, n=3)
    a, b = jobs.open_store(spark, home, LOG), jobs.open_store(spark, peer, "log:peer")
    keys = spark.createDataFrame([("log:peer", bytearray(32))], "log_id string, public_key binary")
    valid = b.occurrences.select("id", F.lit(True).alias("valid"))
    i = jobs.import_peer(b, a, "log:peer", LOG, "2026-05-01T00:00:00Z", "me", keys, valid)
    assert i.rejects.count() == 0
    for outcomes, reason in ((valid.withColumn("valid", F.lit(False)), "signature does not verify"), (valid.limit(0), "not_run")):
        refused = jobs.import_peer(b, a, "log:peer", LOG, "2026-05-01T00:00:00Z", "me", keys, outcomes).rejects.collect()
        assert len(refused) == 6 and {r.reason for r in refused} == {reason}
    assert {r.predicate for r in i.identities.collect()} == {"affected_by"}
    report = i.reports.collect()
    assert len(report) == 1 and report[0].predicate == "peer_reports_cryptographic_verification_of"
    assert report[0].object.ref == facts[2]["id"]
    local = i.local_occurrences.collect()
    assert [r.seq for r in local] == [4] and local[0].attestor == "peer:log:peer" and local[0].attestor_role == "federated_importer"
    assert {r.name: r.n for r in i.summary.collect()} == {
        "identities_read": 6, "occurrences_read": 6, "observations_imported": 5, "verifications_rewritten": 1, "local_occurrences_emitted": 1, "rejected": 0}
    assert i.evidence.count() == 6
    # the foreign log is kept unchanged, and reading the archive again adds nothing
    bad = sinks.write_verbatim(i.foreign_occurrences, None, f"{home}/assertions/occurrences/foreign")
    assert bad.count() == 0
    again = jobs.open_store(spark, home, LOG)
    assert A.chain_integrity(again.chain.where("NOT is_local"), 10).count() == 0
    assert again.occurrences.where("NOT is_local").count() == 6
    assert FED.drop_known(b.occurrences, again.occurrences).count() == 0
    laundered = i.foreign_occurrences.withColumn("attestor_role", F.lit("federated_importer"))
    assert {r.reason for r in A.no_laundering(laundered, b.identities).collect()} == {"laundering: verification"}


def test_import_refuses(spark, tmp_path):
    peer = str(tmp_path / "peer")
    write_folder(spark, peer, log="log:peer")
    b = jobs.open_store(spark, peer, "log:peer")
    reasons = {r.reason for r in FED.validate_foreign(b.identities, b.occurrences, "log:peer", "log:peer").collect()}
    assert reasons == {"peer log is the local log"}
    broken = b.occurrences.withColumn("chain_hash", F.lit("0" * 64))
    out = str(tmp_path / "out")
    assert sinks.write_verbatim(broken, None, out).count() > 0 and not os.path.exists(out)


def test_a_commit_takes_effect_with_its_manifest(spark, tmp_path):
    root = str(tmp_path / "store")
    facts = spark.createDataFrame([r for r in X.IDENTITIES], schemas.IDENTITY)
    with pytest.raises(ValueError, match="moved"):
        sinks.commit(spark, root, "one", identities=facts, unless=lambda: "moved")
    assert commits.committed(spark, root) == [] and jobs.open_store(spark, root, LOG).identities.count() == 0
    assert sinks.commit(spark, root, "one", identities=facts, local=None)["parts"] == {"identities": len(X.IDENTITIES)}
    assert jobs.open_store(spark, root, LOG).identities.count() == len(X.IDENTITIES)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.commit(spark, root, "one", identities=facts)
    assert sinks.commit(spark, root, "none", identities=facts.limit(0))["parts"] == {} and len(commits.committed(spark, root)) == 1


def test_checkpoints_and_anchors_are_stored_with_their_evidence(spark, root):
    s = jobs.open_store(spark, root, LOG)
    signatures = spark.createDataFrame([(LOG, "ed25519:a:AAAA")], "log_id string, signature string")
    iri = jobs.checkpoint(s, "2026-04-01T00:00:00Z", signatures, "me").first().iri
    s = jobs.open_store(spark, root, LOG)
    anchors = spark.createDataFrame(
        [(iri, "rekor:x", '{"a":1}', "2026-04-02T00:00:00Z"), ("checkpoint:" + "0" * 64, "rekor:x", '{"b":1}', "2026-04-02T00:00:00Z")],
        "checkpoint_iri string, provider_iri string, response string, recorded_at string")
    refused = jobs.record_anchors(s, anchors, "2026-04-03T00:00:00Z", "ingestor:t:f", LOG).collect()
    assert [(r.key, r.reason) for r in refused] == [("checkpoint:" + "0" * 64, "checkpoint not in raw evidence")]
    again = jobs.open_store(spark, root, LOG)
    assert again.identities.where(F.col("subject") == iri).count() == 1
    # the anchor's facts resolve, and nothing but what no verifier has run for is wrong
    assert {(r.check_no, r.reason) for r in jobs.audit(again)[0].collect() if r.check_no != 8} == set()


def test_nquads_export(spark, root, tmp_path):
    s = jobs.open_store(spark, root, LOG)
    out = str(tmp_path / "nq")
    jobs.export(s, out)
    lines = spark.read.text(out)
    assert lines.count() == 30
    assert lines.where(F.col("value").contains('metadata> .')).count() == 24
    with pytest.raises(ValueError):
        sinks.nquads(s.identities, "ttl")


def test_put_raw_and_claims_sink(spark, tmp_path):
    new = spark.createDataFrame(
        [("s", "e", {"a": "b"}, "2026-01-01T23:30:00-01:00", "f", 200, None, bytearray(b"x"))] * 2
        + [("s", "e2", {}, "2026-01-01T00:00:00Z", "f", 200, 1, bytearray(b"y"))],
        "source string, endpoint string, request_params map<string,string>, fetched_at string, fetcher string, response_status int, result_count bigint, payload binary",
    )
    stored = spark.createDataFrame([("s", "2026-01-01T05:00:00Z", hashlib.sha256(b"y").hexdigest())], "source string, fetched_at string, id string")
    meta, payloads = sinks.put_raw(new, stored)
    assert [(r.day, r.id) for r in meta.collect()] == [("2026-01-02", hashlib.sha256(b"x").hexdigest())]
    assert payloads.count() == 1
    sinks.write_raw(meta, payloads, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw" / "metadata")).count() == 1
    claims = C.from_documents(spark.createDataFrame([X.CLAIM], schemas.CLAIM))
    sinks.write_claims(claims, None, str(tmp_path / "claims"))
    sinks.write_claims(claims, sinks.read_stored_claims(spark, str(tmp_path / "claims")), str(tmp_path / "claims"))
    stored = sinks.read_stored_claims(spark, str(tmp_path / "claims"))
    assert stored.rows.count() == 1 and stored.facts.count() == 1 and stored.evidence.count() == 1
    folder = tmp_path / "store" / "claims"
    folder.mkdir(parents=True)
    (folder / f"{X.CLAIM_ID}.json").write_text(sinks.claim_documents(stored, stored.rows).first().document)
    back = C.from_documents(logs.read_claims(spark, str(tmp_path / "store"), "pkg:npm/example@1.0.0"))
    assert A.claim_envelopes(back).count() == 0
    assert A.claim_envelopes(back._replace(rows=back.rows.withColumn("verdict", F.lit("rejected")))).first().reason == "id drift"


def test_large_claims_keep_all_their_ids(spark):
    """More ids than any list would be built for: no drift, and lineage and citations of every id."""
    n = 30_000
    facts = spark.range(n).selectExpr(
        "sha2(concat('f', id), 256) AS identity_id", "'published_by' AS predicate", "'big' AS subject", "concat('p', id) AS object", "'iri' AS object_kind",
        "cast(null as string) AS superseded_by", "sha2(concat('e', id), 256) AS evidence_id", "'n@v1' AS normalizer", "'2026-01-01T00:00:00Z' AS observed_at")
    raw = spark.createDataFrame([("raw0", "npm.registry", "e", 1, "big")], "id string, source string, endpoint string, result_count long, subject string")
    made = C.claims(facts, raw, G.BUILT_IN[:1], subject_scoped=True)
    rows = made.rows.withColumn("file_id", F.col("id"))
    assert rows.count() == 1 and made.facts.count() == n and made.evidence.count() >= n
    assert A.claim_envelopes(made._replace(rows=rows)).count() == 0
    short = made._replace(rows=rows, facts=made.facts.limit(n - 1))
    assert A.claim_envelopes(short).first().reason == "id drift"


def test_vocabularies_policies_and_peers(spark, tmp_path):
    vocab = tmp_path / "vocab"
    vocab.mkdir()
    for v in ("v2", "v9", "v10"):
        doc = {"version": v, "predicates": {"p": {"subject_kind": "s", "object_kind": "o", "verification_class": "observation", "description": ""}}}
        (vocab / f"{v}.json").write_text(json.dumps(doc))
    (vocab / "v3.json").write_text(json.dumps({"version": "v4", "predicates": {}}))
    latest = config.latest_vocabulary(spark, str(vocab)).collect()
    assert [(r.version, r.predicate) for r in latest] == [("v10", "p")]
    assert latest[0].hash == hashlib.sha256((vocab / "v10.json").read_bytes()).hexdigest()
    assert [tuple(r) for r in config.vocabulary_mismatch(spark, str(vocab)).collect()] == [("v3", "v4")]

    policies = tmp_path / "policies"
    for name, v in (("a", "v2"), ("a", "v10"), ("a", "draft")):
        d = policies / name / v
        d.mkdir(parents=True)
        (d / "manifest.json").write_text(json.dumps({"id": name, "version": v, "required_predicates": ["p"], "neighborhood_depth": 1, "allowed_verdicts": ["trusted"]}))
        (d / "policy.rego").write_text("rule " + v)
    read = config.read_policies(spark, str(policies))
    got = {r.version: r for r in read.collect()}
    manifest = (policies / "a" / "v2" / "manifest.json").read_bytes()
    assert got["v2"].policy_hash == hashlib.sha256(manifest + b"\0rule v2").hexdigest()
    specs = spark.createDataFrame([("a",), ("a@v2",), ("a@draft",), ("b",)], "spec string")
    assert {r.spec: r.version for r in config.resolve_policies(read, specs).collect()} == {"a": "v10", "a@v2": "v2", "a@draft": "draft", "b": None}

    peers = tmp_path / "peers"
    peers.mkdir()
    (peers / "log_ab_c.pub").write_bytes(b"k" * 32)
    (peers / "log_short.pub").write_bytes(b"k")
    keys = {r.log_id: r.error for r in config.read_peer_keys(spark, str(tmp_path)).collect()}
    assert keys == {"log:ab_c": None, "log:short": "key must be 32 bytes"}


def test_projection_traps(spark):
    """Revising before the target exists has no effect; the last reviser wins; copies re-apply."""
    obj = ("iri", "o", None, None, None)
    rows = [("a", None, 5), ("b", "a", 3), ("c", "a", 7), ("d", "a", 6), ("d", "a", 8)]
    lines = spark.createDataFrame(
        [(i, "s", "affected_by", obj, "e", "t", "n@v", "v6", r, o) for i, r, o in rows],
        schemas.IDENTITY.simpleString()[len("struct<"):-1] + ", ordinal long",
    )
    assert {r.identity_id: r.superseded_by for r in P.project_facts(lines).collect()} == {"a": "d", "b": None, "c": None, "d": None}


def test_revision_chain_cycles_and_length(spark):
    n = 300
    rows = [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(n)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("lost", "gone")]
    got = {r.id: r for r in L.revision_chains(spark.createDataFrame(rows, "id string, revises string")).collect()}
    assert got["n299"].depth == 299 and got["n299"].root == "n000" and got["n000"].head == "n299"
    assert all(got[i].cyclic for i in "xyzw") and not got["lost"].cyclic and got["lost"].root == "lost"


def _chains(rows):
    """(id, root, depth, head, length, cyclic) of every fact, one step at a time."""
    up = {}
    for i, r in rows:
        up[i] = max(up.get(i, ""), r or "")
    out, ends = {}, {}
    for i in up:
        at, depth = i, 0
        while up[at] in up and depth <= len(up):
            at, depth = up[at], depth + 1
        out[i] = (None, None) if depth > len(up) else (at, depth)
        if depth <= len(up):
            ends[at] = max(ends.get(at, (-1, "")), (depth, i))
    return {(i, root, depth, *((None, None, True) if root is None else (ends[root][1], ends[root][0], False))) for i, (root, depth) in out.items()}


@pytest.mark.parametrize("rest", [60, 10**6])
def test_revision_chains_by_contraction(spark, rest):
    """Long chains, wide trees, cycles with tails, repeated and conflicting rows and absent targets, at every share of rows left to one task."""
    rng = random.Random(rest)
    rows = [(f"c{k:04}", f"c{k - 1:04}" if k else None) for k in range(400)]
    rows += [(f"t{k}", f"t{rng.randrange(k)}" if k else "") for k in range(300)] + [(f"star{k}", "c0003") for k in range(60)]
    rows += [(f"o{k}", f"o{(k + 1) % 31}") for k in range(31)] + [("self", "self"), ("pa", "pb"), ("pb", "pa"), ("tail1", "o3"), ("tail2", "tail1"), ("hang", "self")]
    rows += [("lost", "gone"), ("behind", "lost"), ("solo", None), ("c0010", "c0009"), ("two", "c0001"), ("two", "t5")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, revises string")
    assert {tuple(r) for r in L.revision_chains(df, rest).collect()} == _chains(rows)


def test_contraction_writes_few_rows(spark, monkeypatch):
    n, written = 20_000, []

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(L, "cut", counted)
    df = spark.range(n).select(F.format_string("n%08d", "id").alias("id"), F.when(F.col("id") > 0, F.format_string("n%08d", F.col("id") - 1)).alias("revises"))
    got = L.revision_chains(df, 2000)
    assert got.agg(F.max("depth"), F.min("length"), F.count("*")).first() == (n - 1, n - 1, n)
    # nodes and open facts are written once each before the rounds, heads once after them
    assert sum(written[2:-1]) <= 3 * n


def test_emit_roles(spark):
    f = spark.createDataFrame([("1" * 64, "depends_on"), ("2" * 64, "cryptographic_verification_failed"), ("3" * 64, "made_up")], "id string, predicate string")
    events, rejects = N.emit(f, "a", LOG, "2026-01-01T00:00:00Z")
    assert {(r.identity_id[0], r.attestor_role) for r in events.collect()} == {("1", "observer"), ("2", "verifier")}
    assert [r.id[0] for r in rejects.collect()] == ["3"]


def test_landed_sources(spark):
    import base64 as b64

    def wrap(d):
        return json.dumps({"encoding": "base64", "content": b64.encodebytes(json.dumps(d).encode()).decode()})

    rows = [("1", wrap({"name": "n", "version": "1"})), ("2", wrap({"name": "n", "version": "1", "private": True})), ("3", json.dumps({"encoding": "utf-8", "content": ""}))]
    got = {r.evidence_id: r.error for r in evidence.repository_packages(spark.createDataFrame(rows, "evidence_id string, body string")).collect()}
    assert got == {"1": None, "2": "package is marked private", "3": "unexpected encoding"}
    answers = spark.createDataFrame(
        [("a", {"name": "n", "version": "1"}, 200, '{"attestations":[{"predicateType":"p","bundle":{"x":1}}]}'), ("b", {"name": "n", "version": "2"}, 404, '{"error":1}')],
        "evidence_id string, request_params map<string,string>, response_status int, body string",
    ).withColumn("endpoint", F.lit("e")).withColumn("fetched_at", F.lit("t"))
    assert {r.subject: r.result_count for r in evidence.attestation_responses(answers).collect()} == {"pkg:npm/n@1": 1, "pkg:npm/n@2": 0}


def test_policy_folder_hashes(spark):
    folder = spark.createDataFrame([("release_signing", "v2", "h2")], "name string, version string, policy_hash string")
    assert [p.policy_hash for p in jobs.with_hashes(G.BUILT_IN, folder)] == ["", "h2", ""]


def test_files_follow_the_rows_and_not_the_logs(spark, tmp_path):
    """Many logs of many days lie in a few files; folders of one log, as they were written before, are read beside them."""
    rows = spark.range(200).select(
        F.sha2(F.col("id").cast("string"), 256).alias("identity_id"), F.lit("a").alias("attestor"), F.lit("observer").alias("attestor_role"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("ingested_at"),
        F.concat(F.lit("log:a_b:\t%"), (F.col("id") % 40).cast("string")).alias("log_id"))
    built = cut(append.append_occurrences(rows))
    folder = str(tmp_path / "assertions" / "occurrences")
    sinks.append_occurrences(built, f"{folder}/foreign")
    assert sum(not n.startswith((".", "_")) for _, _, names in os.walk(folder) for n in names) < 40
    alone = f"{folder}/foreign/log=log_alone"
    os.makedirs(alone)
    line = "\t".join(("1", "0" * 64, "a" * 64, "b" * 64))
    open(f"{alone}/part-0.txt", "w").write(line + "\n")
    found = {(r.log_id, r.is_local) for r in logs.discover_logs(spark, str(tmp_path), LOG).collect()}
    assert found == {(r.log_id, False) for r in built.select("log_id").distinct().collect()} | {("log:alone", False)}
    events, missing = logs.read_occurrences(spark, str(tmp_path), LOG)
    names = ["log_id", "seq", "id", "identity_id", "prev_chain_hash", "chain_hash", "ingested_at", "attestor", "attestor_role"]
    assert sorted(map(tuple, events.select(names).collect())) == sorted(map(tuple, built.select(names).collect()))
    assert [(r.log_id, r.occurrence_id) for r in missing.collect()] == [("log:alone", "a" * 64)]
    chain = logs.read_chain(spark, str(tmp_path), LOG)
    assert chain.where("malformed IS NOT NULL").count() == 0 and A.chain_integrity(chain.where("log_id <> 'log:alone'"), 10).count() == 0
