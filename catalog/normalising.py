from pyspark.sql import functions as F

from catalog import query
from catalog.sql import ident, sql
from factwright.operators import normalize as N, validation as V
from factwright.plans import store, tables

FETCHED = "2024-02-02T00:00:00Z"

# Each part is a package of two versions; the second has no release time.
_BODY = """'{"name":"part-'||k||'","repository":"git+https://github.com/owner-'||p_size||'/part-'||k||'.git","time":{"1.0.0":"2023-01-0'||(1+k%9)||'T00:00:00.000Z"},"versions":{"1.0.0":'||v1||',"2.0.0":'||v2||'}}'"""


def _version(number):
    return f"""'{{"name":"part-'||k||'","version":"{number}","_npmUser":{{"name":"'||CASE WHEN k%4=0 THEN '' ELSE p_brand END||'"}},"dist":{{"tarball":"https://r/'||k||'.tgz","signatures":[{{"keyid":"key-'||p_size||'","sig":"s"}},{{"keyid":"","sig":"t"}}]}},"dependencies":{{"size":"^'||p_size||'","brand":"~1"}}}}'"""


PACKAGES = f"SELECT *, sha256(body) AS evidence_id FROM (SELECT k, p_size, p_brand, {_BODY} AS body FROM (SELECT p_partkey AS k, p_size, p_brand, {_version('1.0.0')} AS v1, {_version('2.0.0')} AS v2 FROM part))"


def packages(spark, sf):
    """(name, body, evidence_id, fetched_at) of the parts' package documents."""
    k, size = F.col("p_partkey"), F.col("p_size")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def version(number):
        user = F.when(k % 4 == 0, F.lit("")).otherwise(F.col("p_brand"))
        return text('{"name":"part-', k, f'","version":"{number}","_npmUser":{{"name":"', user, '"},"dist":{"tarball":"https://r/', k,
                    '.tgz","signatures":[{"keyid":"key-', size, '","sig":"s"},{"keyid":"","sig":"t"}]},"dependencies":{"size":"^', size, '","brand":"~1"}}')

    body = text('{"name":"part-', k, '","repository":"git+https://github.com/owner-', size, "/part-", k, '.git","time":{"1.0.0":"2023-01-0',
                k % 9 + 1, 'T00:00:00.000Z"},"versions":{"1.0.0":', version("1.0.0"), ',"2.0.0":', version("2.0.0"), "}}")
    rows = tables.table(spark, sf, "part").select(text("part-", k).alias("name"), body.alias("body"))
    return rows.withColumn("evidence_id", F.sha2("body", 256)).withColumn("fetched_at", F.lit(FETCHED))


def documents(spark, sf):
    wanted = packages(spark, sf).select("name", F.explode(F.array(*[F.lit(v) for v in ("1.0.0", "2.0.0", "3.0.0")])).alias("version"))
    return N.version_documents(packages(spark, sf), wanted)


_NPM = """SELECT *, """ + ident() + f""" AS id FROM (SELECT 'pkg:npm/part-'||k||'@'||v AS subject, f.predicate, f.kind, f.object, f.datatype, evidence_id, obs AS observed_at, 'npm-registry-record@v0.1.0' AS normalizer, CAST(NULL AS VARCHAR) AS revises FROM (
    SELECT *, unnest([{{'predicate':'published_at','kind':'literal','object':obs,'datatype':'xsd:dateTime'}},
    {{'predicate':CASE WHEN k%4=0 THEN NULL ELSE 'published_by' END,'kind':'iri','object':'npm:user:'||p_brand,'datatype':NULL}},
    {{'predicate':'registry_reports_signing_key','kind':'iri','object':'npm:key:key-'||p_size,'datatype':NULL}},
    {{'predicate':'depends_on','kind':'iri','object':'pkg:npm/size@^'||p_size,'datatype':NULL}},{{'predicate':'depends_on','kind':'iri','object':'pkg:npm/brand@~1','datatype':NULL}}]) AS f FROM (
    SELECT *, '1.0.0' AS v, '2023-01-0'||(1+k%9)||'T00:00:00.000Z' AS obs FROM pk UNION ALL SELECT *, '2.0.0', '{FETCHED}' FROM pk)) WHERE f.predicate IS NOT NULL)"""


@query("npm_facts", sql("SELECT id, subject, predicate, object, observed_at, evidence_id FROM n", pk=PACKAGES, n=_NPM))
def npm_facts(spark, sf):
    rows = N.normalize_npm(documents(spark, sf))
    return rows.select("id", "subject", "predicate", F.coalesce("object.iri", "object.literal").alias("object"), "observed_at", "evidence_id")


@query("npm_rejects", sql("SELECT 'part-'||p_partkey AS name, '3.0.0' AS version, 'version missing' AS error FROM part"))
def npm_rejects(spark, sf):
    return documents(spark, sf).where(F.col("error").isNotNull()).select("name", "version", "error")


_OSV = """SELECT *, """ + ident() + f""" AS id FROM (SELECT 'pkg:npm/event@'||event_id AS subject, 'affected_by' AS predicate, 'iri' AS kind, 'osv:'||v AS object, CAST(NULL AS VARCHAR) AS datatype,
    sha256('{{"vulns":[{{"id":"V'||(event_id%50)||'"}},{{"id":""}},{{"id":"W'||user_id||'","modified":"x"}}]}}') AS evidence_id, '{FETCHED}' AS observed_at, 'osv-vuln-query@v0.1.0' AS normalizer, CAST(NULL AS VARCHAR) AS revises
    FROM (SELECT event_id, user_id, unnest(['V'||(event_id%50), 'W'||user_id]) AS v FROM events WHERE event_id%10<>0))"""


@query("advisory_facts", sql("SELECT id, subject, object, evidence_id FROM o", o=_OSV))
def advisory_facts(spark, sf):
    """Responses with advisories, one entry of each without an id; every tenth response is empty."""
    k = F.col("event_id")
    body = F.concat(F.lit('{"vulns":[{"id":"V'), (k % 50).cast("string"), F.lit('"},{"id":""},{"id":"W'), F.col("user_id").cast("string"), F.lit('","modified":"x"}]}'))
    rows = tables.table(spark, sf, "events").select(
        F.concat(F.lit("pkg:npm/event@"), k).alias("subject"), F.when(k % 10 == 0, F.lit("{}")).otherwise(body).alias("body"), F.lit(FETCHED).alias("fetched_at"),
    ).withColumn("evidence_id", F.sha2("body", 256))
    return N.normalize_osv(rows).select("id", "subject", F.col("object.iri").alias("object"), "evidence_id")


@query("provenance", sql("""SELECT 'order-'||o_orderkey AS subject, '{"n":'||o_orderkey||'}' AS bundle FROM orders WHERE o_orderkey%3<>0"""))
def provenance(spark, sf):
    """Attestation responses: a publish entry first, then, for two orders in three, provenance."""
    k = F.col("o_orderkey").cast("string")
    entry = F.concat(F.lit(',{"predicateType":"https://slsa.dev/provenance/v1","bundle":{"n":'), k, F.lit("}}"))
    more = F.when(F.col("o_orderkey") % 3 != 0, F.concat(entry, entry)).otherwise(F.lit(""))
    body = F.concat(F.lit('{"attestations":[{"predicateType":"publish","bundle":{"n":-1}}'), more, F.lit("]}"))
    rows = tables.table(spark, sf, "orders").select(F.concat(F.lit("order-"), k).alias("subject"), body.alias("body"))
    return N.provenance(rows)


# Verification results of orders: finished ones passed, the others failed for one of three reasons.
_BUNDLE = """'{"verificationMaterial":{"tlogEntries":['||CASE WHEN o_orderkey%4=0 THEN '' ELSE '{"integratedTime":"'||(1700000000+o_orderkey)||'"}' END||']}}'"""
_WHY = "CASE o_orderkey%3 WHEN 0 THEN 'signature verification failed' WHEN 1 THEN 'bundle parse: unexpected end of input' ELSE 'something new' END"


def results(spark, sf):
    k = F.col("o_orderkey")
    entry = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit('{"integratedTime":"'), (k + 1700000000).cast("string"), F.lit('"}')))
    why = F.when(k % 3 == 0, F.lit("signature verification failed")).when(k % 3 == 1, F.lit("bundle parse: unexpected end of input")).otherwise(F.lit("something new"))
    return tables.table(spark, sf, "orders").select(
        tables.order_subject("o_orderkey").alias("subject"), F.lit("p").alias("package"), k.cast("string").alias("version"), F.lit("e").alias("endpoint"),
        F.concat(F.lit('{"verificationMaterial":{"tlogEntries":['), entry, F.lit("]}}")).alias("bundle"), F.lit(FETCHED).alias("fetched_at"),
        F.lit("https://github.com/a/b").alias("expected_repository"), (F.col("o_orderstatus") == "F").alias("verified"), why.alias("reason"),
        F.lit("issuer").alias("oidc_issuer"), F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("sub-"), F.col("o_custkey"))).alias("oidc_subject"), F.lit(None).cast("string").alias("cert_fingerprint"),
    )


_VERIFIED = f"""SELECT *, {ident()} AS id FROM (SELECT 'pkg:tpch/order-'||o_orderkey AS subject, 'cryptographically_verified_signature_by' AS predicate, 'iri' AS kind,
    'sigstore:fulcio:'||substr(sha256('issuer'||chr(10)||CASE WHEN o_orderkey%5=0 THEN '' ELSE 'sub-'||o_custkey END),1,32) AS object, CAST(NULL AS VARCHAR) AS datatype, sha256({_BUNDLE}) AS evidence_id,
    CASE WHEN o_orderkey%4=0 THEN '{FETCHED}' ELSE strftime(epoch_ms((1700000000+o_orderkey)*1000),'%Y-%m-%dT%H:%M:%SZ') END AS observed_at, 'sigstore-attestation-verifier@v0.1.0' AS normalizer, CAST(NULL AS VARCHAR) AS revises
    FROM orders WHERE o_orderstatus='F')"""


@query("verified_facts", sql("SELECT id, subject, object, observed_at FROM v", v=_VERIFIED))
def verified_facts(spark, sf):
    return N.verified_facts(results(spark, sf)).select("id", "subject", F.col("object.iri").alias("object"), "observed_at")


_RECORD = f"""'{{'||chr(10)||'  "reason_code": "'||CASE o_orderkey%3 WHEN 0 THEN 'signature_invalid' WHEN 1 THEN 'bundle_parse_failed' ELSE 'unknown' END||'",'||chr(10)||'  "reason": "'||{_WHY}||'",'||chr(10)
    ||CASE WHEN o_orderkey%5=0 THEN '' ELSE '  "oidc_subject": "sub-'||o_custkey||'",'||chr(10) END||'  "oidc_issuer": "issuer",'||chr(10)||'  "bundle_evidence_id": "'||sha256({_BUNDLE})||'",'||chr(10)
    ||'  "expected_repository": "https://github.com/a/b",'||chr(10)||'  "verifier": "sigstore-attestation-verifier@v0.1.0"'||chr(10)||'}}'"""
_REFUTED = f"""SELECT *, {ident()} AS id FROM (SELECT 'pkg:tpch/order-'||o_orderkey AS subject, 'cryptographic_verification_failed' AS predicate, 'iri' AS kind,
    CASE WHEN o_orderkey%5=0 THEN 'sigstore:unparseable_bundle:'||substr(sha256({_BUNDLE}),1,32) ELSE 'sigstore:fulcio:'||substr(sha256('issuer'||chr(10)||'sub-'||o_custkey),1,32) END AS object,
    CAST(NULL AS VARCHAR) AS datatype, sha256({_RECORD}) AS evidence_id, '{FETCHED}' AS observed_at, 'sigstore-attestation-verifier@v0.1.0' AS normalizer, CAST(NULL AS VARCHAR) AS revises FROM orders WHERE o_orderstatus<>'F')"""


@query("refutation_facts", sql("SELECT id, subject, object, evidence_id FROM v", v=_REFUTED))
def refutation_facts(spark, sf):
    return N.refutation_facts(results(spark, sf)).select("id", "subject", F.col("object.iri").alias("object"), "evidence_id")


@query("verification_evidence", sql(f"""SELECT 'sigstore.bundle' AS source, sha256({_BUNDLE}) AS id, 'pkg:tpch/order-'||o_orderkey AS subject FROM orders
    UNION ALL SELECT 'sigstore.verification_failure', sha256({_RECORD}), 'pkg:tpch/order-'||o_orderkey FROM orders WHERE o_orderstatus<>'F'"""))
def verification_evidence(spark, sf):
    rows = N.verification_evidence(results(spark, sf))
    return rows.select("source", F.sha2("payload", 256).alias("id"), F.concat(F.lit("pkg:tpch/order-"), F.col("request_params")["version"]).alias("subject"))


def _anchors(spark, sf):
    k = F.col("doc_id")
    rid = F.sha2("text", 256)
    iri = F.when(k % 7 == 0, F.concat(F.lit("point:"), rid)).when(k % 5 == 0, F.concat(F.lit("checkpoint:"), F.substring(rid, 1, 40))).when(
        k % 3 == 0, F.concat(F.lit("checkpoint:"), F.reverse(rid))).otherwise(F.concat(F.lit("checkpoint:"), rid))
    return tables.table(spark, sf, "documents").select(
        iri.alias("checkpoint_iri"), F.concat(F.lit("fakelog:"), k).alias("provider_iri"), F.concat(F.lit("response "), k).alias("response"), F.lit(FETCHED).alias("recorded_at")
    )


_ANCHOR = f"""SELECT *, {ident()} AS id FROM (SELECT 'checkpoint:'||sha256(text) AS subject, 'transparency_log_records_checkpoint' AS predicate, 'iri' AS kind, 'fakelog:'||doc_id AS object, CAST(NULL AS VARCHAR) AS datatype,
    sha256('response '||doc_id) AS evidence_id, '{FETCHED}' AS observed_at, 'transparency-anchor-recorder@v0.1.0' AS normalizer, CAST(NULL AS VARCHAR) AS revises FROM documents WHERE doc_id%7<>0 AND doc_id%5<>0 AND doc_id%3<>0)"""


@query("anchor_facts", sql("SELECT id, subject, object, evidence_id FROM v", v=_ANCHOR))
def anchor_facts(spark, sf):
    good, _ = N.anchor_facts(_anchors(spark, sf), store.table(spark, sf, "raw_evidence"))
    return good.select("id", "subject", F.col("object.iri").alias("object"), "evidence_id")


@query("anchor_rejects", sql("""SELECT 'fakelog:'||doc_id AS provider_iri, CASE WHEN doc_id%7=0 THEN 'checkpoint IRI must start with checkpoint:' WHEN doc_id%5=0 THEN 'checkpoint hash must be 64 characters'
    ELSE 'checkpoint not in raw evidence' END AS reason FROM documents WHERE doc_id%7=0 OR doc_id%5=0 OR doc_id%3=0"""))
def anchor_rejects(spark, sf):
    return N.anchor_facts(_anchors(spark, sf), store.table(spark, sf, "raw_evidence"))[1].select("provider_iri", "reason")


_SIGNED = """'{"checkpoint":{"chain_hash":"'||chain_hash||'","log_id":"'||log_id||'","seq":'||seq||',"signed_at":"2024-06-01T00:00:00Z"},"signature":"ed25519:f:'||log_id||'"}'"""


@query("checkpoints", sql(f"SELECT log_id, seq, chain_hash, 'checkpoint:'||sha256({_SIGNED}) AS iri FROM (SELECT log_id, max(seq) AS seq, arg_max(chain_hash, seq) AS chain_hash FROM chained GROUP BY 1)", "chained"))
def checkpoints(spark, sf):
    chain = tables.chain(store.table(spark, sf, "chained"))
    signatures = chain.select("log_id").distinct().withColumn("signature", F.concat(F.lit("ed25519:f:"), "log_id"))
    return N.checkpoints(chain, "2024-06-01T00:00:00Z", signatures).select("log_id", "seq", "chain_hash", "iri")


@query("undeclared_predicate", sql("SELECT id, predicate FROM lines WHERE predicate NOT IN ('depends_on','published_at','published_by','affected_by')", "lines"))
def undeclared_predicate(spark, sf):
    """A vocabulary with only the predicates that parts and suppliers need."""
    names = spark.createDataFrame([(n,) for n in ("depends_on", "published_at", "published_by", "affected_by")], "predicate string")
    return V.undeclared_predicate(store.lines_once(spark, sf), names).select("id", "predicate")


@query("vocabulary_not_superset", sql("""SELECT 'v'||(n+1) AS version, predicate, reason FROM (SELECT a.n, a.predicate, CASE WHEN b.predicate IS NULL THEN 'dropped' WHEN a.kind<>b.kind THEN 'changed' END AS reason
    FROM v a LEFT JOIN v b ON b.predicate=a.predicate AND b.n=a.n+1 WHERE a.n<(SELECT max(n) FROM v)) WHERE reason IS NOT NULL""",
    v="SELECT DISTINCT n_regionkey+1 AS n, 'size_'||(p_partkey%40) AS predicate, CASE WHEN (p_partkey%40+n_regionkey)%9=0 THEN 'literal' ELSE 'iri' END AS kind FROM part, nation WHERE (p_partkey%40)%(n_regionkey+2)<>0"))
def vocabulary_not_superset(spark, sf):
    """Vocabularies numbered by region, with predicates named after parts."""
    p, r = F.col("p_partkey") % 40, F.col("n_regionkey")
    parts = tables.table(spark, sf, "part").select(p.alias("p")).distinct()
    versions = tables.table(spark, sf, "nation").agg(F.collect_set("n_regionkey").alias("rs"))  # one row of five regions
    rows = parts.select("p", F.explode(versions.scalar()).alias("n_regionkey")).where(F.col("p") % (r + 2) != 0)
    vocabulary = rows.select(
        F.concat(F.lit("v"), (r + 1).cast("string")).alias("version"), F.concat(F.lit("size_"), F.col("p")).alias("predicate"), F.lit("artifact").alias("subject_kind"),
        F.when((F.col("p") + r) % 9 == 0, F.lit("literal")).otherwise(F.lit("iri")).alias("object_kind"), F.lit(None).cast("string").alias("object_datatype"),
        F.lit("observation").alias("verification_class"),
    )
    return V.vocabulary_not_superset(vocabulary)


@query("manifest_problems", sql("""SELECT name, version, CASE WHEN k%3=0 THEN 'id differs from folder' WHEN k%5=0 THEN 'version differs from folder' END AS reason FROM (SELECT p_partkey AS k, 'policy-'||p_partkey AS name, 'v'||p_size AS version FROM part) WHERE k%3=0 OR k%5=0
    UNION ALL SELECT 'policy-'||p_partkey, 'v'||p_size, 'disallowed verdict' FROM part WHERE p_partkey%11=0"""))
def manifest_problems(spark, sf):
    k = F.col("p_partkey")
    name, version = F.concat(F.lit("policy-"), k), F.concat(F.lit("v"), F.col("p_size"))
    policies = tables.table(spark, sf, "part").select(
        name.alias("name"), version.alias("version"), F.when(k % 3 == 0, F.lit("other")).otherwise(name).alias("id"),
        F.when(k % 5 == 0, F.lit("v0")).otherwise(version).alias("declared_version"),
        F.array(F.lit("trusted"), F.when(k % 11 == 0, F.lit("maybe")).otherwise(F.lit("rejected"))).alias("allowed_verdicts"),
    )
    return V.manifest_mismatch(policies).select("name", "version", "reason").unionByName(V.disallowed_verdicts(policies).select("name", "version", "reason"))
