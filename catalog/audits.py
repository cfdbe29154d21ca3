from pyspark.sql import functions as F

from catalog import query
from catalog.evaluation import CLAIM_CTES, CLAIM_NEEDS, HASHED, stored_claims, stored_rows
from catalog.sql import link, sql
from factwright.functions import envelopes as E
from factwright.operators import audit as A, digest, projection as P
from factwright.plans import store, tables

COLS = ("check_no", "log_id", "key", "reason")


def rows(df):
    return df.select(*COLS)


def lines(spark, sf):
    return store.table(spark, sf, "lines")


def occurrences(spark, sf):
    return store.table(spark, sf, "occurrences")


def tampered_lines(spark, sf):
    """Facts in which every 97th has another time and every 89th no subject."""
    k = F.col("ordinal")
    return lines(spark, sf).withColumn("observed_at", F.when(k % 97 == 0, F.lit("2000-01-01T00:00:00Z")).otherwise(F.col("observed_at"))).withColumn(
        "subject", F.when(k % 89 == 0, F.lit("")).otherwise(F.col("subject"))
    )


@query("audit_identity", sql("""SELECT 1 AS check_no, CAST(NULL AS VARCHAR) AS log_id, id AS key, CASE WHEN ordinal%89=0 THEN 'subject is required' ELSE 'id mismatch' END AS reason
    FROM lines WHERE ordinal%89=0 OR (ordinal%97=0 AND observed_at<>'2000-01-01T00:00:00Z')""", "lines"))
def audit_identity(spark, sf):
    return rows(A.identity_reproducibility(tampered_lines(spark, sf)))


@query("audit_occurrence_ids", sql("""SELECT 2 AS check_no, log_id, id AS key, CASE WHEN attestor_role='error' THEN 'unknown attestor_role' ELSE 'id mismatch' END AS reason
    FROM occ WHERE attestor_role='error' OR event_id%97=0""", "occ"))
def audit_occurrence_ids(spark, sf):
    changed = F.when(F.col("event_id") % 97 == 0, F.lit("someone else")).otherwise(F.col("attestor"))
    return rows(A.occurrence_ids(occurrences(spark, sf).withColumn("attestor", changed)))


_B64 = "A" * 86 + "=="


@query("audit_signatures", sql("""SELECT 2 AS check_no, log_id, id AS key, CASE event_id%7 WHEN 0 THEN 'signature does not verify' WHEN 1 THEN 'unknown key' WHEN 2 THEN 'signature is not base64'
    WHEN 3 THEN 'unsupported signature algorithm' WHEN 4 THEN 'not_run' WHEN 5 THEN 'malformed signature' END AS reason FROM occ WHERE event_id%7<6""", "occ"))
def audit_signatures(spark, sf):
    """Signature headers of every kind; of those that can be verified some are valid, some are not, some were not tried."""
    m = F.col("event_id") % 7
    sig = (
        F.when(m == 1, F.lit("ed25519:other:" + _B64)).when(m == 2, F.lit("ed25519:known:???"))
        .when(m == 3, F.lit("rsa:known:" + _B64)).when(m == 5, F.lit("none")).otherwise(F.lit("ed25519:known:" + _B64))
    )
    outcomes = occurrences(spark, sf).where(m.isin(0, 6)).select("id", (m == 6).alias("valid"))
    keys = spark.createDataFrame([("known", bytearray(b"\x01" + b"\x00" * 31))], "fingerprint string, public_key binary")
    return rows(A.occurrence_signatures(occurrences(spark, sf).withColumn("signature", sig), keys, outcomes))


# Chains with lines taken out, changed and doubled.
def tampered_chain(spark, sf):
    chained = store.table(spark, sf, "chained")
    k = F.col("event_id")
    kept = chained.where(k % 89 != 0).withColumn("chain_hash", F.when(k % 97 == 0, F.sha2("chain_hash", 256)).otherwise(F.col("chain_hash")))
    return tables.chain(kept.unionByName(kept.where(k % 101 == 0)))


_CHAIN = sql(f"""SELECT 3 AS check_no, log_id, log_id||':'||seq AS key, CASE WHEN copies>1 THEN 'seq repeated' WHEN seq<>1 AND before IS NULL THEN 'seq gap'
    WHEN prev_chain_hash<>CASE WHEN seq=1 THEN repeat('0',64) ELSE before END THEN 'prev_chain_hash mismatch' WHEN chain_hash<>{link("prev_chain_hash", "id")} THEN 'chain_hash mismatch' END AS reason
    FROM (SELECT d.*, p.before, count(*) OVER (PARTITION BY d.log_id, d.seq) AS copies FROM d LEFT JOIN (SELECT log_id, seq+1 AS seq, max(chain_hash) AS before FROM d GROUP BY 1,2) p ON p.log_id=d.log_id AND p.seq=d.seq)
    WHERE reason IS NOT NULL""", "chained", t="SELECT * REPLACE (CASE WHEN event_id%97=0 THEN sha256(chain_hash) ELSE chain_hash END AS chain_hash) FROM chained WHERE event_id%89<>0",
    d="SELECT * FROM t UNION ALL SELECT * FROM t WHERE event_id%101=0")


@query("audit_chain", _CHAIN)
def audit_chain(spark, sf):
    return rows(A.chain_integrity(tampered_chain(spark, sf)))


@query("audit_chain_windowed", _CHAIN)
def audit_chain_windowed(spark, sf):
    return rows(A.chain_integrity_windowed(tampered_chain(spark, sf), block=16))


@query("audit_chain_clean", sql("SELECT log_id, 0 AS violations FROM chained GROUP BY 1", "chained"))
def audit_chain_clean(spark, sf):
    """Chains as they were built: no violation in any log."""
    chain = tables.chain(store.table(spark, sf, "chained"))
    found = A.chain_integrity(chain, 10).groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    return chain.select("log_id").distinct().join(found, "log_id", "left").select("log_id", F.coalesce("n", F.lit(0)).alias("violations"))


@query("audit_chain_gaps", sql("""SELECT 3 AS check_no, 'conv:'||conv_id AS log_id, 'conv:'||conv_id||':'||(turn+1) AS key,
    CASE WHEN turn>0 AND (conv_id+turn-1)%11=0 THEN 'seq gap' ELSE 'prev_chain_hash mismatch' END AS reason FROM conversations WHERE (conv_id+turn)%11<>0"""))
def audit_chain_gaps(spark, sf):
    """Turns of conversations as lines that were never chained, some of them missing."""
    turns = tables.table(spark, sf, "conversations").where((F.col("conv_id") + F.col("turn")) % 11 != 0)
    text = F.sha2(F.concat_ws(":", "conv_id", "turn", "text"), 256)
    chain = turns.select(
        F.concat(F.lit("conv:"), F.col("conv_id")).alias("log_id"), (F.col("turn") + 1).alias("seq"),
        F.sha2(F.col("turn").cast("string"), 256).alias("prev_chain_hash"), text.alias("occurrence_id"), F.sha2(text, 256).alias("chain_hash"),
    )
    return rows(A.chain_integrity(chain))


@query("audit_linkage", sql("""SELECT 4 AS check_no, log_id, id AS key, 'names a missing fact' AS reason FROM occ WHERE is_local AND identity_id NOT IN (SELECT id FROM lines)""", "occ", "lines"))
def audit_linkage(spark, sf):
    return rows(A.linkage(occurrences(spark, sf).where("is_local"), lines(spark, sf)))


_PAY = "SELECT sha256(text) AS id, max(CAST(doc_id%13<>0 AS INT)) AS sound FROM documents GROUP BY 1"


@query("audit_evidence", sql("""SELECT 5 AS check_no, CAST(NULL AS VARCHAR) AS log_id, l.id AS key, CASE WHEN p.id IS NULL THEN 'evidence missing' ELSE 'payload hash drift' END AS reason
    FROM lines l LEFT JOIN p ON p.id=l.evidence_id WHERE p.id IS NULL OR p.sound=0""", "lines", p=_PAY))
def audit_evidence(spark, sf):
    docs = tables.table(spark, sf, "documents")
    hashed = F.sha2("text", 256)
    drifted = F.when(F.col("doc_id") % 13 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(hashed)
    return rows(A.evidence_resolvability(store.lines_once(spark, sf), docs.select(hashed.alias("id"), drifted.alias("payload_hash"))))


@query("audit_projection", sql("SELECT 6 AS check_no, CAST(NULL AS VARCHAR) AS log_id, predicate AS key, 'projection drift' AS reason FROM facts WHERE predicate IN ('affected_by','published_by') GROUP BY predicate", "facts"))
def audit_projection(spark, sf):
    """The stored projection against one rebuilt from the facts as they are written, of which an advisory and a publisher were changed."""
    recorded = store.facts(spark, sf).select(*P.FACT_COLUMNS)
    text = F.when(F.col("predicate").isin("affected_by", "published_by"), F.concat("object.iri", F.lit("!"))).otherwise(F.col("object.iri"))
    rebuilt = P.facts_within(tables.identities(spark, sf).withColumn("object", F.col("object").withField("iri", text)), ("subject",))
    return rows(A.projection_determinism(*[digest.tables_digest(digest.named("predicate", facts)) for facts in (recorded, rebuilt)]))


@query("audit_claims", sql("""SELECT 7 AS check_no, CAST(NULL AS VARCHAR) AS log_id, id AS key, 'id drift' AS reason FROM cl WHERE verdict='conditional'""", *CLAIM_NEEDS, **CLAIM_CTES))
def audit_claims(spark, sf):
    """Stored claims in which every conditional verdict was turned into a trusted one."""
    claims = stored_claims(spark, sf)
    better = F.when(F.col("verdict") == "conditional", F.lit("trusted")).otherwise(F.col("verdict"))
    return rows(A.claim_envelopes(claims._replace(rows=claims.rows.withColumn("file_id", F.col("id")).withColumn("verdict", better))))


@query("audit_rederive", sql("""SELECT 9 AS check_no, CAST(NULL AS VARCHAR) AS log_id, reverse(id) AS key, 'claim id drift' AS reason FROM cl WHERE id<'2' AND reverse(id)<>id""", *CLAIM_NEEDS, **CLAIM_CTES))
def audit_rederive(spark, sf):
    """Stored claims, an eighth of them under a wrong id, evaluated again."""
    wrong = F.when(F.col("id") < "2", F.reverse("id")).otherwise(F.col("id"))
    stored = stored_rows(spark, sf)
    claims = stored._replace(rows=stored.rows.withColumn("id", wrong))
    return rows(A.claim_rederivation(claims, store.facts(spark, sf), store.table(spark, sf, "raw_lines"), HASHED, subject_scoped=True))


@query("audit_laundering", sql("""SELECT 12 AS check_no, o.log_id, o.id AS key, CASE WHEN l.id IS NULL THEN 'names an unknown fact' ELSE 'laundering: verification' END AS reason FROM
    (SELECT * REPLACE (CASE WHEN attestor_role='verifier' THEN 'federated_importer' ELSE attestor_role END AS attestor_role) FROM occ) o LEFT JOIN (SELECT DISTINCT id, predicate FROM lines) l ON l.id=o.identity_id
    WHERE attestor_role='federated_importer' AND (l.id IS NULL OR l.predicate='cryptographically_verified_signature_by')""", "occ", "lines"))
def audit_laundering(spark, sf):
    """Purchases recorded as if they had been imported."""
    role = F.when(F.col("attestor_role") == "verifier", F.lit("federated_importer")).otherwise(F.col("attestor_role"))
    return rows(A.no_laundering(occurrences(spark, sf).withColumn("attestor_role", role), lines(spark, sf)))


@query("audit_roles", sql("""SELECT 17 AS check_no, log_id, id AS key, 'verification fact under another role' AS reason FROM occ WHERE event_id%4=0 AND attestor_role='verifier'
    AND identity_id IN (SELECT id FROM lines WHERE predicate='cryptographically_verified_signature_by')""", "occ", "lines"))
def audit_roles(spark, sf):
    role = F.when(F.col("event_id") % 4 == 0, F.lit("observer")).otherwise(F.col("attestor_role"))
    return rows(A.role_class(occurrences(spark, sf).withColumn("attestor_role", role), lines(spark, sf)))


@query("audit_orphans", sql("""SELECT 14 AS check_no, log_id, id AS key, CASE WHEN event_id%7=0 THEN 'record not in chain' WHEN event_id%11=0 THEN 'chain line without record'
    WHEN event_id%13=0 THEN 'prev_chain_hash differs from chain' ELSE 'chain_hash differs from chain' END AS reason FROM chained
    WHERE (event_id%7=0 AND event_id%11<>0) OR (event_id%11=0 AND event_id%7<>0) OR (event_id%7<>0 AND event_id%11<>0 AND (event_id%13=0 OR event_id%17=0))""", "chained"))
def audit_orphans(spark, sf):
    records = store.table(spark, sf, "chained")
    k = F.col("event_id")
    chain = tables.chain(records.where(k % 7 != 0))
    other = F.sha2(F.lit("other"), 256)
    records = records.where(k % 11 != 0).withColumn("prev_chain_hash", F.when(k % 13 == 0, other).otherwise(F.col("prev_chain_hash")))
    return rows(A.orphans(records.withColumn("chain_hash", F.when(k % 17 == 0, other).otherwise(F.col("chain_hash"))), chain))


# Bundles made of orders: some evidence points to another document, some bundles lack parts.
def _bundles(spark, sf):
    k = F.col("o_orderkey")
    text = k.cast("string")
    statement = F.concat(F.lit('{"subject":['), F.when(k % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit('{"name":"order-'), text, F.lit('","digest":{"sha256":"'), F.sha2(text, 256), F.lit('"}}'))), F.lit("]}"))
    payload = F.when(k % 7 == 0, F.lit("")).otherwise(F.replace(F.base64(statement.cast("binary")), F.lit("\r\n"), F.lit("")))
    bundle = F.concat(F.lit('{"dsseEnvelope":{"payload":"'), payload, F.lit('"},"n":'), text, F.lit("}"))
    return tables.table(spark, sf, "orders").select("o_orderkey", bundle.alias("bundle"))


@query("audit_reverification", sql("""SELECT 8 AS check_no, CAST(NULL AS VARCHAR) AS log_id, 'fact-'||k AS key, CASE WHEN k%11=0 THEN 'evidence missing' WHEN k%3=0 AND k%13=0 THEN 'bundle missing' WHEN k%7=0 THEN 'bundle has no payload'
    WHEN k%5=0 THEN 'statement has no subjects' WHEN k%2=0 THEN 'not_run' WHEN k%17=0 THEN 'no repository in certificate' ELSE 're-verification failed: expired' END AS reason FROM (SELECT o_orderkey AS k FROM orders)
    WHERE k%11=0 OR (k%3=0 AND k%13=0) OR k%7=0 OR k%5=0 OR k%2=0 OR k%17=0 OR k%19=0"""))
def audit_reverification(spark, sf):
    k = F.col("o_orderkey")
    rows_ = _bundles(spark, sf).withColumn("bid", F.sha2("bundle", 256))
    pointer = F.concat(F.lit('{"bundle_evidence_id":"'), F.col("bid"), F.lit('"}'))
    evidence = F.when(k % 3 == 0, F.sha2(pointer, 256)).otherwise(F.col("bid"))
    facts = rows_.select(F.concat(F.lit("fact-"), k).alias("id"), evidence.alias("evidence_id"),
                         F.lit("cryptographically_verified_signature_by").alias("predicate"))
    bundles = rows_.where((k % 11 != 0) | (k % 3 == 0)).where(~((k % 3 == 0) & (k % 13 == 0))).select(F.col("bid").alias("id"), F.col("bundle").alias("body"))
    pointers = rows_.where((k % 3 == 0) & (k % 11 != 0)).select(evidence.alias("id"), pointer.alias("body"))
    results = rows_.where(k % 2 != 0).select(
        F.col("bid").alias("bundle_id"), (k % 19 != 0).alias("verified"), F.lit("expired").alias("reason"),
        F.when(k % 17 == 0, F.lit("nobody")).otherwise(F.lit("https://github.com/a/b/.github/workflows/x@refs/y")).alias("oidc_subject"),
    )
    return rows(A.reverification(facts, bundles.unionByName(pointers), results))


# Checkpoints of chain positions, anchored; some name a log or position that is not there.
ANCHORS = f"""SELECT event_id, CASE WHEN event_id%31=0 THEN 'log:gone' ELSE log_id END AS log_id, CASE WHEN event_id%29=0 THEN seq+100000 ELSE seq END AS seq,
    CASE WHEN event_id%23=0 THEN sha256(chain_hash) ELSE chain_hash END AS chain_hash FROM chained"""
ANCHOR_BODY = "'{\"checkpoint\":{\"chain_hash\":\"'||chain_hash||'\",\"log_id\":\"'||log_id||'\",\"seq\":'||seq||',\"signed_at\":\"2024-06-01T00:00:00Z\"},\"signature\":\"s\"}'"


def anchors(spark, sf):
    k = F.col("event_id")
    rows_ = store.table(spark, sf, "chained").select(
        "event_id", F.when(k % 31 == 0, F.lit("log:gone")).otherwise(F.col("log_id")).alias("log_id"),
        F.when(k % 29 == 0, F.col("seq") + 100000).otherwise(F.col("seq")).alias("seq"),
        F.when(k % 23 == 0, F.sha2("chain_hash", 256)).otherwise(F.col("chain_hash")).alias("chain_hash"),
        F.lit("2024-06-01T00:00:00Z").alias("signed_at"), F.lit("s").alias("signature"),
    )
    return rows_.withColumn("body", E.signed_checkpoint_json()).withColumn("iri", E.checkpoint_iri())


def anchor_tables(spark, sf):
    k = F.col("event_id")
    rows_ = anchors(spark, sf)
    subject = F.when(k % 19 == 0, F.concat(F.lit("point:"), F.col("iri"))).otherwise(F.col("iri"))
    facts = rows_.select(F.concat(F.lit("anchor-"), k).alias("id"), subject.alias("subject"), F.lit(A.ANCHOR).alias("predicate"))
    body = F.when(k % 13 == 0, F.lit("no json")).otherwise(F.col("body"))
    payloads = rows_.where(k % 17 != 0).select(F.substr("iri", F.lit(12)).alias("id"), body.alias("body"))
    return facts, payloads


@query("audit_anchor", sql("""SELECT 13 AS check_no, CASE WHEN event_id%19=0 OR event_id%17=0 OR event_id%13=0 THEN NULL ELSE log_id END AS log_id, 'anchor-'||event_id AS key, CASE WHEN event_id%19=0 THEN 'malformed subject' WHEN event_id%17=0 THEN 'checkpoint missing' WHEN event_id%13=0 THEN 'checkpoint unparseable'
    WHEN event_id%31=0 THEN 'MISSING_LOG' WHEN event_id%29=0 THEN 'TRUNCATED' WHEN event_id%23=0 THEN 'TAMPER' END AS reason FROM an WHERE reason IS NOT NULL""", "chained", an=ANCHORS))
def audit_anchor(spark, sf):
    facts, payloads = anchor_tables(spark, sf)
    return rows(A.anchor_integrity(facts, payloads, tables.chain(store.table(spark, sf, "chained"))))


@query("audit_equivocation", sql("""SELECT 16 AS check_no, log_id, log_id||':'||seq AS key, count(DISTINCT chain_hash)||' chain hashes' AS reason FROM
    (SELECT log_id, seq//3 AS seq, chain_hash FROM chained) GROUP BY log_id, seq HAVING count(DISTINCT chain_hash)>1""", "chained"))
def audit_equivocation(spark, sf):
    """Checkpoints that give three chain hashes for one position."""
    rows_ = store.table(spark, sf, "chained").select(
        "log_id", F.floor(F.col("seq") / 3).cast("long").alias("seq"), "chain_hash", F.lit("2024-06-01T00:00:00Z").alias("signed_at"), F.lit("s").alias("signature"), "event_id",
    ).withColumn("body", E.signed_checkpoint_json()).withColumn("iri", E.checkpoint_iri())
    facts = rows_.select(F.concat(F.lit("anchor-"), F.col("event_id")).alias("id"), F.col("iri").alias("subject"), F.lit(A.ANCHOR).alias("predicate"))
    return rows(A.anchor_equivocation(facts, rows_.select(F.substr("iri", F.lit(12)).alias("id"), "body")))


@query("audit_summary", sql("""SELECT * FROM (SELECT 4 AS check_no, 'identity occurrence linkage' AS "check", (SELECT count(*) FROM occ WHERE is_local AND identity_id NOT IN (SELECT id FROM lines)) AS violations
    UNION ALL SELECT 10, 'foreign chain integrity', 0 UNION ALL SELECT 17, 'role and class', 0 UNION ALL SELECT 0, 'audit', (SELECT count(*) FROM occ WHERE is_local AND identity_id NOT IN (SELECT id FROM lines)))""", "occ", "lines"))
def audit_summary(spark, sf):
    found = A.audit([
        A.linkage(occurrences(spark, sf).where("is_local"), lines(spark, sf)),
        A.role_class(occurrences(spark, sf), lines(spark, sf)),
        A.chain_integrity(tables.chain(store.table(spark, sf, "chained")), 10),
    ])
    return A.summary(found, (4, 10, 17)).select("check_no", "check", "violations")


# What a sidecar's signature covers, and signatures of every kind: by a known key or not, of another algorithm, not base64, absent.
_SIDECAR = """'{"endpoint":"'||endpoint||'","fetched_at":"'||fetched_at||'","fetcher":"ingestor:tables@v1:0000000000000000","id":"'||id||'","payload_hash":"'||id||'","payload_path":"'||payload_path
    ||'","request_params":{"name":"order-'||k||'","version":"1"},"response_status":200'||coalesce(',"result_count":'||result_count, '')||',"source":"'||source||'"}'"""
_SIGNED = f"SELECT id AS key, sha256({_SIDECAR}) AS digest, k%7 AS s FROM (SELECT *, doc_id AS k FROM rawl)"
_KINDS = ["", "none", "rsa:a:AAAA", "ed25519:other:AAAA", "ed25519:mine:%", "ed25519:mine:AAAA", "ed25519:mine:AAAA"]


def _signature(k):
    out = F.lit(_KINDS[-1])
    for i, text in enumerate(_KINDS[:-1]):
        out = F.when(k % 7 == i, F.lit(text)).otherwise(out)
    return out


def _keys(spark):
    return spark.createDataFrame([("mine", bytearray(32))], "fingerprint string, public_key binary")


@query("evidence_digests", sql("SELECT DISTINCT key, digest FROM x", "rawl", x=_SIGNED))
def evidence_digests(spark, sf):
    return A.evidence_digests(store.table(spark, sf, "raw_lines")).select("key", "digest")


_REASON = "CASE s WHEN 0 THEN 'unsigned' WHEN 1 THEN 'malformed signature' WHEN 2 THEN 'unsupported signature algorithm' WHEN 3 THEN 'unknown key' WHEN 4 THEN 'signature is not base64'"


@query("audit_evidence_signatures", sql(f"""SELECT 14 AS check_no, key, {_REASON} ELSE CASE substr(digest,1,1) WHEN '0' THEN 'not_run' WHEN '1' THEN 'signature does not verify' END END AS reason FROM x
    WHERE s<5 OR substr(digest,1,1) IN ('0','1')""", "rawl", x=_SIGNED))
def audit_evidence_signatures(spark, sf):
    """A verifier tried all sidecars but those whose digest begins with 0, and refused those that begin with 1."""
    k = F.substr("endpoint", F.lit(5)).cast("long")
    signed = A.evidence_digests(store.table(spark, sf, "raw_lines").withColumn("signature", _signature(k)))
    first = F.substring("digest", 1, 1)
    outcomes = signed.where(first != "0").select("digest", (first != "1").alias("valid"))
    return A.document_signatures(signed, _keys(spark), outcomes).select("check_no", "key", "reason")


@query("audit_claim_signatures", sql(f"""SELECT 14 AS check_no, id AS key, {_REASON} ELSE CASE WHEN id<'2' THEN 'not_run' WHEN id<'4' THEN 'signature does not verify' END END AS reason FROM (
    SELECT id, ('0x'||substr(id,60,5))::BIGINT%7 AS s FROM cl) WHERE s<5 OR id<'4'""", *CLAIM_NEEDS, **CLAIM_CTES))
def audit_claim_signatures(spark, sf):
    claims = stored_rows(spark, sf)
    k = F.conv(F.substring("id", 60, 5), 16, 10).cast("long")
    signed = A.claim_digests(claims._replace(rows=claims.rows.withColumn("signature", _signature(k))))
    outcomes = signed.where("digest >= '2'").select("digest", (F.col("digest") >= "4").alias("valid"))
    return A.document_signatures(signed, _keys(spark), outcomes).select("check_no", "key", "reason")
