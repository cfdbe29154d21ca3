"""Truth tables of the policies, and claims against a direct rendering on a small store."""

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from factwright.operators import claims as C, policy as G, snapshot as Q

FACTS = ("predicate string, identity_id string, subject string, object string, object_datatype string, observed_at string, "
         "evidence_id string, normalizer string, superseded_by string")
RAW = "id string, source string, endpoint string, result_count bigint, subject string"


def fact(predicate, subject, obj="o", superseded=None, n=0):
    ident = hashlib.sha256(f"{predicate}{subject}{obj}{n}".encode()).hexdigest()
    return (predicate, ident, subject, obj, None, "2026-01-01T00:00:00Z", f"ev-{predicate}-{subject}", "norm@v1", superseded)


PREDICATES = {
    "release_signing": ("registry_reports_signing_key", "cryptographically_verified_signature_by"),
    "dependency_hygiene": ("affected_by", "depends_on"),
}


def expected(policy, version, a, b, queried, hits):
    """Verdict from the published rules; None for a conflict."""
    if policy == "release_signing" and version == "v1":
        if a:
            return "conditional" if queried else "insufficient_evidence"
        return "insufficient_evidence"
    if policy == "release_signing":
        return "trusted" if b else "conditional" if a else "insufficient_evidence"
    if a and not queried:
        return None
    if a:
        return "rejected"
    if not queried:
        return "insufficient_evidence"
    return "trusted" if b else "conditional"


@pytest.mark.parametrize("queried,hits", [(False, False), (True, False), (True, True)])
def test_truth_tables(spark, queried, hits):
    rows, want = [], {}
    for name, (first, second) in PREDICATES.items():
        for i, (a, b, old) in enumerate(itertools.product([0, 1], [0, 1], [0, 1])):
            s = f"{name}-{i}"
            rows.append(fact("published_by", s))
            # a superseded fact counts as none
            if a:
                rows.append(fact(first, s, superseded="x" if old else None))
            if b:
                rows.append(fact(second, s))
            for p in G.BUILT_IN:
                if p.id == name:
                    want[(s, p.key)] = expected(p.id, p.version, a and not old, b, queried, hits)
    raw = [("r1", "npm.registry", "e", None, None)]
    if queried:
        raw += [("r2", "sigstore.rekor", "e", 3 if hits else None, None), ("r3", "osv.dev", "e", 0, None)]
    got = G.evaluate(spark.createDataFrame(rows, FACTS), spark.createDataFrame(raw, RAW)).collect()
    found = {(r.subject, f"{r.policy_id}@{r.policy_version}"): r for r in got}
    for key, verdict in want.items():
        assert found[key].verdict == verdict, key
        assert (found[key].error is not None) == (verdict is None)
    one = found[("release_signing-7", "release_signing@v2")]
    assert ("rekor_transparency_log_hit" in one.qualifiers) == hits
    assert ("rekor_was_queried" in one.rules_fired) == queried


def store(spark):
    """Three subjects that share dependencies, with superseded facts and copies of evidence."""
    rows = [
        fact("depends_on", "a", "b"), fact("depends_on", "a", "c"), fact("depends_on", "a", "a"), fact("depends_on", "b", "c"),
        fact("depends_on", "c", "x", superseded="y"), fact("affected_by", "b"), fact("affected_by", "c", "v1"), fact("affected_by", "c", "v2"),
        fact("registry_reports_signing_key", "a"), fact("published_at", "a", superseded="z"), fact("published_by", "b"),
    ]
    raw = [(f"raw{i}", s, "e", i, "abc"[i % 3]) for i, s in enumerate(["npm.registry", "sigstore.rekor", "osv.dev", "npm.attestations", "osv.dev", "other"])]
    return rows, raw, spark.createDataFrame(rows, FACTS), spark.createDataFrame(raw, RAW)


def brute_claim(rows, raw, subject, p, verdict, scoped):
    members = [subject]
    if p.neighborhood_depth:
        members += [r[3] for r in rows if r[0] == "depends_on" and r[2] == subject and r[8] is None]
    seen = [r for n in p.required_predicates for r in sorted(rows, key=lambda r: r[1]) if r[0] == n and r[2] in set(members)]
    evidence = [r for r in raw if r[1] in p.required_raw_sources and (not scoped or r[4] == subject)]
    current = {r[0] for r in seen if r[2] == subject and r[8] is None}
    doc = {
        "subject": subject, "policy_id": p.id, "policy_version": p.version, "policy_hash": p.policy_hash, "query": p.query,
        "verdict": verdict.verdict, "qualifiers": sorted(verdict.qualifiers), "evaluator_version": C.EVALUATOR, "vocab_version": p.vocab_required,
        "normalizer_versions": dict(r[7].split("@") for r in seen),
        "identity_ids_consumed": sorted({r[1] for r in seen}) or None,
        "raw_evidence_ids_consumed": sorted({r[6] for r in seen} | {r[0] for r in evidence}) or None,
        "derivation": {
            "rules_fired": sorted(verdict.rules_fired),
            "missing_predicates": sorted(set(p.required_predicates) - current) or None,
            "input_counts": {"raw_evidence": len(evidence), **{n: sum(r[0] == n for r in seen) for n in p.required_predicates}},
        },
    }
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("scoped", [False, True])
def test_claims_match_brute_force(spark, scoped):
    rows, raw, facts, evidence = store(spark)
    verdicts = {(r.subject, r.policy_id, r.policy_version): r for r in G.evaluate(facts, evidence, subject_scoped=scoped).collect()}
    made = C.claims(facts, evidence, G.BUILT_IN, subject_scoped=scoped)
    got = made.rows.collect()
    assert {(r.id, r.derived) for r in C.derived_ids(made).collect()} == {(r.id, r.id) for r in got}
    assert len(got) == sum(v.error is None for v in verdicts.values())
    by_key = {p.key: p for p in G.BUILT_IN}
    for r in got:
        p = by_key[f"{r.policy_id}@{r.policy_version}"]
        assert r.id == brute_claim(rows, raw, r.subject, p, verdicts[(r.subject, p.id, p.version)], scoped), (r.subject, p.key)


def test_subjects_without_facts_are_evaluated(spark):
    _, _, facts, evidence = store(spark)
    subjects = spark.createDataFrame([("a",), ("nobody",)], "subject string")
    got = {(r.subject, r.policy_id, r.policy_version): r for r in G.evaluate(facts, evidence, subjects=subjects).collect()}
    assert len(got) == 6
    assert got[("nobody", "release_signing", "v2")].verdict == "insufficient_evidence"
    assert got[("nobody", "dependency_hygiene", "v1")].missing_predicates == ["affected_by", "depends_on"]


def test_neighbourhood_keeps_to_one_hop(spark):
    _, _, facts, _ = store(spark)
    start = spark.createDataFrame([("a",)], "subject string")
    one = {(r.member, r.hops) for r in Q.neighbourhood(facts, start, 1).collect()}
    assert one == {("a", 0), ("b", 1), ("c", 1)}
    assert {(r.member, r.hops) for r in Q.neighbourhood(facts, start, 0).collect()} == {("a", 0)}


def test_policy_diff(spark):
    rows = [("s", "p", "v1", "trusted"), ("s", "p", "v2", "rejected"), ("t", "p", "v1", "trusted"), ("t", "p", "v2", "trusted")]
    df = spark.createDataFrame(rows, "subject string, policy_id string, policy_version string, verdict string")
    assert [r.subject for r in G.policy_diff(df, ["p@v1", "p@v2"]).collect()] == ["s"]


def test_consumed_counts_superseded_rows(spark):
    _, _, facts, _ = store(spark)
    rows = Q.consumed_facts(facts, [G.RELEASE_SIGNING_V1]).where("subject = 'a'")
    assert rows.where(F.col("position") == 1).count() == 1


def test_one_dependency_in_a_third_of_the_subjects(spark):
    """A heavy key is dealt over tasks of near equal size, and no pair is lost or doubled."""
    from factwright.operators import skew

    many = spark.range(90_000).select(F.concat(F.lit("s"), "id").alias("subject"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).alias("member"))
    few = spark.range(5001).select(F.col("id").alias("member"), F.concat(F.lit("d"), "id").alias("next")).unionByName(
        spark.range(3).select(F.lit(0).cast("long").alias("member"), F.concat(F.lit("more"), "id").alias("next")))
    assert [r.member for r in skew.heavy_keys(many, "member").collect()] == [0]
    got = skew.spread_join(many, few, "member", salts=64)
    assert got.count() == 60_000 + 30_000 * 4 and got.distinct().count() == got.count()
    assert got.columns == ["member", "subject", "next"]
    heavy = F.broadcast(skew.heavy_keys(many, "member"))
    dealt = many.join(heavy, "member", "left").withColumn("salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64("subject", "member"), F.lit(64))).otherwise(0))
    sizes = sorted(r["count"] for r in dealt.repartition(16, "member", "salt").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_long_tables_are_written_only_for_what_reads_them(spark, monkeypatch):
    """Claims of which only the rows are read leave no table of their facts or evidence."""
    from catalog import audits, lineage
    from factwright.plans import store

    monkeypatch.setattr(store, "_written", {})
    monkeypatch.setattr(store, "_named", lambda sf: "rows_alone")
    sf = "/root/testdata/sf0.001"
    for query in (lineage.subject_claims, audits.audit_claim_signatures):
        assert query(spark, sf).count() > 0
    assert {name for _, _, name in store._written if name.startswith("claims_")} == {"claims_rows"}
