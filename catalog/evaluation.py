from dataclasses import replace

from pyspark.sql import functions as F

from catalog import query
from catalog.sql import names, sql
from factwright.operators import claims as C, policy as G, snapshot as Q
from factwright.plans import store, tables

SIGNING = {
    "registry_reports_signing_key": "key",
    "no_cryptographic_verification_performed": "key AND NOT ver",
    "cryptographically_verified_signature_present": "ver",
    "rekor_transparency_log_hit": "rh",
    "rekor_returned_no_entries": "rq AND NOT rh",
    "npm_registry_consulted": "nq",
}
Q_V1 = names(**{**SIGNING, "no_cryptographic_verification_performed": "key", "no_signing_key_reported": "NOT key",
                "cryptographically_verified_signature_present": "false"})
Q_V2 = names(**SIGNING, no_signing_key_observed_anywhere="NOT key AND NOT ver", npm_attestations_consulted="af")
Q_DH = names(
    osv_was_queried="oq", subject_directly_vulnerable="vul", no_known_vulnerabilities_for_subject="oq AND NOT vul",
    no_runtime_dependencies="oq AND NOT dep", direct_dep_surface_observed="dep", transitive_resolution_not_implemented="dep",
)
T_V1 = names(registry_reports_key="key", rekor_was_queried="rq", rekor_returned_hits="rh", npm_was_queried="nq")
T_V2 = names(registry_reports_key="key", verified_signature_exists="ver", rekor_was_queried="rq", rekor_returned_hits="rh",
             npm_was_queried="nq", attestations_were_fetched="af")
T_DH = names(osv_was_queried="oq", subject_directly_vulnerable="vul", direct_deps_present="dep")
M_V1 = names(registry_reports_signing_key="NOT key", published_at="NOT pat", published_by="NOT pby")
M_V2 = names(registry_reports_signing_key="NOT key", cryptographically_verified_signature_by="NOT ver", published_at="NOT pat", published_by="NOT pby")
M_DH = names(depends_on="NOT dep", affected_by="NOT vul")
V_V1 = "CASE WHEN key AND rh THEN 'conditional' WHEN key AND rq AND NOT rh THEN 'conditional' ELSE 'insufficient_evidence' END"
V_V2 = "CASE WHEN ver THEN 'trusted' WHEN key THEN 'conditional' ELSE 'insufficient_evidence' END"
V_DH = """CASE WHEN vul AND NOT oq THEN NULL WHEN vul THEN 'rejected' WHEN oq AND dep THEN 'trusted' WHEN oq THEN 'conditional'
    ELSE 'insufficient_evidence' END"""
E_DH = "CASE WHEN vul AND NOT oq THEN 'conflicting verdicts' END"
RAW_V1, RAW_V2, RAW_DH = "n_nq+n_rq", "n_nq+n_rq+n_af", "n_oq"

ALL = f"""SELECT subject, 'release_signing' AS policy_id, 'v1' AS policy_version, {V_V1} AS verdict, CAST(NULL AS VARCHAR) AS error, {Q_V1} AS qualifiers, {T_V1} AS trace, {M_V1} AS missing,
    'published_at='||n_pat||',published_by='||n_pby||',raw_evidence='||({RAW_V1})||',registry_reports_signing_key='||n_key AS counts, 'v1' AS vocab FROM flags, rf
    UNION ALL SELECT subject, 'release_signing', 'v2', {V_V2}, NULL, {Q_V2}, {T_V2}, {M_V2},
    'cryptographically_verified_signature_by='||n_ver||',published_at='||n_pat||',published_by='||n_pby||',raw_evidence='||({RAW_V2})||',registry_reports_signing_key='||n_key, 'v2' FROM flags, rf
    UNION ALL SELECT flags.subject, 'dependency_hygiene', 'v1', {V_DH}, {E_DH}, {Q_DH}, {T_DH}, {M_DH},
    'affected_by='||(n_vul+coalesce(d_vul,0))||',depends_on='||(n_dep+coalesce(d_dep,0))||',raw_evidence='||({RAW_DH}), 'v1' FROM flags LEFT JOIN near ON near.subject=flags.subject, rf"""
NEEDS = ("flags", "rf", "near")
SCOPED = ALL.replace(", rf", "").replace("flags", "fs")
SCOPED_NEEDS = ("fs", "near")


def evaluate(spark, sf, policies=G.BUILT_IN, raw=None):
    return G.evaluate(store.relations(spark, sf), store.table(spark, sf, "raw_evidence") if raw is None else raw, policies)


@query("verdicts_scoped", sql("SELECT subject, policy_id, policy_version, verdict, error, qualifiers, counts FROM a", *SCOPED_NEEDS, a=SCOPED))
def verdicts_scoped(spark, sf):
    """Verdicts from the evidence that names each subject."""
    rows = G.evaluate(store.relations(spark, sf), store.table(spark, sf, "raw_lines"), subject_scoped=True)
    return rows.select("subject", "policy_id", "policy_version", "verdict", "error", F.array_join("qualifiers", ",").alias("qualifiers"), counts_text().alias("counts"))


def counts_text():
    entries = F.array_sort(F.map_entries("input_counts"))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query("verdicts", sql("SELECT subject, policy_id, policy_version, verdict FROM a", *NEEDS, a=ALL))
def verdicts(spark, sf):
    return evaluate(spark, sf).select("subject", "policy_id", "policy_version", "verdict")


def _one(name, policy, verdict, need):
    extra = " LEFT JOIN near ON near.subject=flags.subject" if need else ""

    @query(name, sql(f"SELECT flags.subject, {verdict} AS verdict FROM flags{extra}, rf", *NEEDS))
    def run(spark, sf):
        return evaluate(spark, sf, [policy]).select("subject", "verdict")


_one("verdict_release_signing_v1", G.RELEASE_SIGNING_V1, V_V1, False)
_one("verdict_release_signing_v2", G.RELEASE_SIGNING_V2, V_V2, False)
_one("verdict_dependency_hygiene", G.DEPENDENCY_HYGIENE_V1, V_DH, False)


@query("verdict_conflict", sql(f"SELECT subject, {V_DH} AS verdict, {E_DH} AS error FROM flags, (SELECT false AS oq)", "flags"))
def verdict_conflict(spark, sf):
    """No advisory source was ever asked: vulnerable subjects match two verdicts."""
    raw = store.table(spark, sf, "raw_evidence").where("source <> 'osv.dev'")
    return evaluate(spark, sf, [G.DEPENDENCY_HYGIENE_V1], raw).select("subject", "verdict", "error")


@query("qualifiers_trace", sql("SELECT subject, policy_id, policy_version, qualifiers, trace FROM a", *NEEDS, a=ALL))
def qualifiers_trace(spark, sf):
    return evaluate(spark, sf).select(
        "subject", "policy_id", "policy_version", F.array_join("qualifiers", ",").alias("qualifiers"), F.array_join("rules_fired", ",").alias("trace")
    )


@query("input_counts", sql("SELECT subject, policy_id, policy_version, counts FROM a", *NEEDS, a=ALL))
def input_counts(spark, sf):
    return evaluate(spark, sf).select("subject", "policy_id", "policy_version", counts_text().alias("counts"))


@query("missing_predicates", sql("SELECT subject, policy_id, policy_version, missing FROM a", *NEEDS, a=ALL))
def missing_predicates(spark, sf):
    none = F.array().cast("array<string>")
    return evaluate(spark, sf).select(
        "subject", "policy_id", "policy_version", F.array_join(F.coalesce("missing_predicates", none), ",").alias("missing")
    )


@query("policy_diff", sql(f"SELECT subject, v1, v2 FROM (SELECT subject, {V_V1} AS v1, {V_V2} AS v2 FROM flags, rf) WHERE v1<>v2", "flags", "rf"))
def policy_diff(spark, sf):
    keys = ["release_signing@v1", "release_signing@v2"]
    rows = G.policy_diff(evaluate(spark, sf, [G.RELEASE_SIGNING_V1, G.RELEASE_SIGNING_V2]), keys)
    return rows.select("subject", F.col(f"`{keys[0]}`").alias("v1"), F.col(f"`{keys[1]}`").alias("v2"))


# A policy of our own, as a user would write one.
RELEASED = G.Policy(
    id="released", version="v1", vocab_required="v6", required_predicates=("published_at", "depends_on"), required_raw_sources=(),
    neighborhood_depth=0,
    flags={"dated": G.Current("published_at"), "built_on_others": G.Current("depends_on"), "verified": G.Current("cryptographically_verified_signature_by")},
    verdicts=(("trusted", "dated and built_on_others"), ("conditional", "dated and not built_on_others"), ("insufficient_evidence", "not dated")),
    qualifiers=(("dated", "dated"), ("standalone", "not built_on_others"), ("seen_verified", "verified")),
)


@query("rule_table", sql("""SELECT subject, CASE WHEN pat AND dep THEN 'trusted' WHEN pat THEN 'conditional' ELSE 'insufficient_evidence' END AS verdict,
    concat_ws(',', CASE WHEN pat THEN 'dated' END, CASE WHEN NOT dep THEN 'standalone' END) AS qualifiers FROM flags""", "flags"))
def rule_table(spark, sf):
    rows = evaluate(spark, sf, [RELEASED])
    return rows.select("subject", "verdict", F.array_join("qualifiers", ",").alias("qualifiers"))


# Consumed facts in long form: own facts and, for dependency_hygiene, those of direct dependencies.
POSITIONS = """SELECT * FROM (VALUES ('release_signing','v1','registry_reports_signing_key',0),('release_signing','v1','published_at',1),('release_signing','v1','published_by',2),
    ('release_signing','v2','registry_reports_signing_key',0),('release_signing','v2','cryptographically_verified_signature_by',1),('release_signing','v2','published_at',2),('release_signing','v2','published_by',3),
    ('dependency_hygiene','v1','depends_on',0),('dependency_hygiene','v1','affected_by',1)) t(policy_id,policy_version,predicate,position)"""
CONSUMED = """SELECT f.subject, p.policy_id, p.policy_version, p.position, f.identity_id, f.evidence_id, f.normalizer FROM facts f JOIN pos p ON p.predicate=f.predicate
    UNION ALL SELECT e.subject, p.policy_id, p.policy_version, p.position, f.identity_id, f.evidence_id, f.normalizer FROM edges e JOIN facts f ON f.subject=e.object
    JOIN pos p ON p.predicate=f.predicate AND p.policy_id='dependency_hygiene'"""
SHARED = """SELECT DISTINCT s.policy_id, s.policy_version, raw.id AS evidence_id FROM raw JOIN (VALUES ('release_signing','v1','npm.registry'),('release_signing','v1','sigstore.rekor'),
    ('release_signing','v2','npm.registry'),('release_signing','v2','sigstore.rekor'),('release_signing','v2','npm.attestations'),('dependency_hygiene','v1','osv.dev')) s(policy_id,policy_version,source) ON s.source=raw.source"""


def consumed(spark, sf):
    edges = G.dependency_edges(store.relations(spark, sf))
    return Q.consumed_facts(store.facts_once(spark, sf), G.BUILT_IN, edges=edges, parts=tables.parts(spark, sf))


@query("consumed_ids", sql("SELECT subject, policy_id, policy_version, count(*) AS facts, min(identity_id) AS first_id, max(identity_id) AS last_id, count(DISTINCT evidence_id) AS evidence FROM c GROUP BY 1,2,3",
                           "facts", "edges", pos=POSITIONS, c=CONSUMED))
def consumed_ids(spark, sf):
    return consumed(spark, sf).groupBy(*C.KEYS).agg(
        F.count(F.lit(1)).alias("facts"), F.min("identity_id").alias("first_id"), F.max("identity_id").alias("last_id"),
        F.count_distinct(F.when(F.col("evidence_id") != "", F.col("evidence_id"))).alias("evidence"))


@query("consumed_raw_evidence", sql("SELECT * FROM sh", "raw", sh=SHARED))
def consumed_raw_evidence(spark, sf):
    return Q.policy_raw_evidence(store.table(spark, sf, "raw_evidence"), G.BUILT_IN)


_VERSIONS = """SELECT subject, policy_id, policy_version, split_part(normalizer,'@',1) AS name, arg_max(substr(normalizer,strpos(normalizer,'@')+1), position||identity_id) AS version FROM c GROUP BY 1,2,3,4"""


@query("normalizer_versions", sql(_VERSIONS, "facts", "edges", pos=POSITIONS, c=CONSUMED))
def normalizer_versions(spark, sf):
    return Q.normalizer_versions(consumed(spark, sf))


@query("policy_input", sql("""SELECT f.subject, f.predicate AS section, count(*) AS n, min(identity_id) AS first_key FROM (SELECT subject, identity_id, predicate FROM facts
    UNION ALL SELECT e.subject, f.identity_id, f.predicate FROM edges e JOIN facts f ON f.subject=e.object) f WHERE predicate IN ('depends_on','affected_by') GROUP BY 1,2
    UNION ALL SELECT NULL, 'raw_evidence', count(*), min(id) FROM raw WHERE source='osv.dev'""", "facts", "edges", "raw"))
def policy_input(spark, sf):
    known = store.relations(spark, sf)
    rows = Q.policy_input(store.facts_once(spark, sf), store.table(spark, sf, "raw_evidence"), G.DEPENDENCY_HYGIENE_V1, known.select("subject"), known)
    return rows.groupBy("subject", "section").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


POLICY_HASH = "0" * 64
HASHED = [replace(p, policy_hash=POLICY_HASH) for p in G.BUILT_IN]


def _list(expr):
    """A comma-joined list of names as a JSON list."""
    return f"CASE WHEN {expr}='' THEN '[]' ELSE '[\"'||replace({expr},',','\",\"')||'\"]' END"


def _pairs(expr):
    return f"'{{\"'||replace(replace({expr},'=','\":'),',',',\"')||'}}'"


# Canonical text of each claim, as in ``envelopes.claim_json_parts``.
CLAIM_CTES = {
    "pos": POSITIONS,
    "c": CONSUMED,
    "sh": SHARED.replace("s.policy_id, s.policy_version, raw.id", "raw.subject, s.policy_id, s.policy_version, raw.id").replace("FROM raw JOIN", "FROM rawl raw JOIN"),
    "a": SCOPED,
    "nv": _VERSIONS,
    "nvj": "SELECT subject, policy_id, policy_version, '{'||string_agg('\"'||name||'\":\"'||version||'\"', ',' ORDER BY name)||'}' AS j FROM nv GROUP BY 1,2,3",
    "idj": "SELECT subject, policy_id, policy_version, string_agg('\"'||identity_id||'\"', ',' ORDER BY identity_id) AS j FROM c GROUP BY 1,2,3",
    "evj": """SELECT subject, policy_id, policy_version, string_agg('"'||evidence_id||'"', ',' ORDER BY evidence_id) AS j FROM (
        SELECT subject, policy_id, policy_version, evidence_id FROM c UNION SELECT subject, policy_id, policy_version, evidence_id FROM sh) GROUP BY 1,2,3""",
    "cl": f"""SELECT a.subject, a.policy_id, a.policy_version, a.verdict, sha256('{{"derivation":{{"input_counts":'||{_pairs("counts")}||',"missing_predicates":'||CASE WHEN missing='' THEN 'null' ELSE {_list("missing")} END
        ||',"rules_fired":'||{_list("trace")}||'}},"evaluator_version":"{C.EVALUATOR}","identity_ids_consumed":'||coalesce('['||idj.j||']','null')||',"normalizer_versions":'||coalesce(nvj.j,'{{}}')
        ||',"policy_hash":"{POLICY_HASH}","policy_id":"'||a.policy_id||'","policy_version":"'||a.policy_version||'","qualifiers":'||{_list("qualifiers")}||',"query":"data.'||a.policy_id||'.verdict","raw_evidence_ids_consumed":'
        ||coalesce('['||evj.j||']','null')||',"subject":"'||a.subject||'","verdict":"'||a.verdict||'","vocab_version":"'||a.vocab||'"}}') AS id FROM a
        LEFT JOIN idj USING (subject, policy_id, policy_version) LEFT JOIN nvj USING (subject, policy_id, policy_version) LEFT JOIN evj USING (subject, policy_id, policy_version)
        WHERE a.error IS NULL""",
}
CLAIM_NEEDS = ("facts", "edges", "raw", "rawl", *SCOPED_NEEDS)
_CLAIMS = sql("SELECT subject, policy_id, policy_version, verdict, id FROM cl", *CLAIM_NEEDS, **CLAIM_CTES)


def claims(spark, sf, **options):
    return C.claims(store.facts(spark, sf), store.table(spark, sf, "raw_lines"), HASHED, subject_scoped=True, **options)


def stored_rows(spark, sf):
    """Claims of which only the rows are read: their long tables, most of a store of claims, are then not made and not written."""
    return C.Claims(store.derived(spark, sf, "claims_rows", lambda: claims(spark, sf).rows), None, None)


def stored_claims(spark, sf):
    """Claims written once, as a store of claims would hold them."""
    made = []

    def part(name):
        def build():
            if not made:
                made.append(claims(spark, sf))
            return getattr(made[0], name)

        return store.derived(spark, sf, f"claims_{name}", build)

    return C.Claims(*map(part, C.Claims._fields))


@query("claim_ids", _CLAIMS)
def claim_ids(spark, sf):
    return claims(spark, sf).rows.select("subject", "policy_id", "policy_version", "verdict", "id")


@query("claim_ids_streamed", _CLAIMS)
def claim_ids_streamed(spark, sf):
    """The ids that the stored rows and long tables give again."""
    stored = stored_claims(spark, sf)
    again = stored.rows.drop("id").join(C.derived_ids(stored, "own").join(stored.rows.select(F.col("id").alias("own"), *C.KEYS), "own"), C.KEYS)
    return again.select(*C.KEYS, "verdict", F.col("derived").alias("id"))


@query("claim_lists", sql("""SELECT a.subject, a.policy_id, a.policy_version, len(string_split(idj.j,',')) AS facts, len(string_split(evj.j,',')) AS evidence FROM a
    JOIN idj USING (subject, policy_id, policy_version) JOIN evj USING (subject, policy_id, policy_version) WHERE a.error IS NULL""", *CLAIM_NEEDS, **CLAIM_CTES))
def claim_lists(spark, sf):
    stored = stored_claims(spark, sf)
    rows = C.documents(stored, stored.rows).where(F.size("identity_ids_consumed") > 0)
    return rows.select(*C.KEYS, F.size("identity_ids_consumed").alias("facts"), F.size("raw_evidence_ids_consumed").alias("evidence"))


@query("claim_citations", sql("""SELECT cl.id AS claim_id, count(*) AS events, min(occ.id) AS first_event FROM cl JOIN c USING (subject, policy_id, policy_version)
    JOIN occ ON occ.identity_id=c.identity_id GROUP BY 1""", *CLAIM_NEEDS, "occ", **CLAIM_CTES))
def claim_citations(spark, sf):
    rows = C.with_citations(stored_claims(spark, sf), store.table(spark, sf, "occurrences"))
    return rows.groupBy("claim_id").agg(F.count(F.lit(1)).alias("events"), F.min("occurrence_id").alias("first_event"))
