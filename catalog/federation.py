from pyspark.sql import functions as F

from catalog import query
from catalog.sql import ident, link, occ_id, sql
from factwright.functions import envelopes as E
from factwright.operators import append, federation as FED
from factwright.plans import store, tables


def foreign(spark, sf, read=lambda spark, sf: store.table(spark, sf, "occurrences")):
    return read(spark, sf).where("NOT is_local").withColumn("signature", F.lit(""))


def lines(spark, sf):
    return store.table(spark, sf, "lines")


def routed(spark, sf):
    return FED.route_by_class(foreign(spark, sf), lines(spark, sf))


def reports(spark, sf):
    return FED.peer_reports(foreign(spark, sf), store.lines_once(spark, sf))


_ROUTE = """SELECT occ.*, l.subject, CASE WHEN l.predicate IS NULL THEN 'reject' WHEN l.predicate='cryptographically_verified_signature_by' THEN 'rewrite' ELSE 'store' END AS route
    FROM occ LEFT JOIN (SELECT DISTINCT id, predicate, subject FROM lines) l ON l.id=occ.identity_id WHERE NOT occ.is_local"""


@query("import_route", sql("SELECT id, identity_id, log_id, route FROM r", "occ", "lines", r=_ROUTE))
def import_route(spark, sf):
    return routed(spark, sf).select("id", "identity_id", "log_id", "route")


_RECORD = """'{"id":"'||id||'","identity_id":"'||identity_id||'","attestor":"'||attestor||'","attestor_role":"'||attestor_role||'","ingested_at":"'||ingested_at||'","log_id":"'||log_id||'","prev_chain_hash":"'||prev_chain_hash||'","chain_hash":"'||chain_hash||'","signature":""}'"""
_REPORTS = """SELECT *, """ + ident() + """ AS rid FROM (SELECT id AS foreign_occurrence_id, log_id AS peer_log_id, subject, 'peer_reports_cryptographic_verification_of' AS predicate, 'ref' AS kind, identity_id AS object,
    CAST(NULL AS VARCHAR) AS datatype, sha256(""" + _RECORD + """) AS evidence_id, ingested_at AS observed_at, 'federation-import@v0.1.0' AS normalizer, CAST(NULL AS VARCHAR) AS revises FROM r WHERE route='rewrite')"""


@query("import_rewrite", sql("SELECT rid AS id, subject, predicate, object AS ref, evidence_id, observed_at FROM rep", "occ", "lines", r=_ROUTE, rep=_REPORTS))
def import_rewrite(spark, sf):
    return reports(spark, sf).select("id", "subject", "predicate", F.col("object.ref").alias("ref"), "evidence_id", "observed_at")


@query("import_summary", sql("""SELECT 'occurrences_read' AS name, count(*) AS n FROM r UNION ALL SELECT 'observations_imported', count(*) FILTER (route='store') FROM r
    UNION ALL SELECT 'verifications_rewritten', count(*) FILTER (route='rewrite') FROM r UNION ALL SELECT 'local_occurrences_emitted', count(*) FILTER (route='rewrite') FROM r
    UNION ALL SELECT 'rejected', count(*) FILTER (route='reject') FROM r UNION ALL SELECT 'identities_read', count(*) FROM lines""", "occ", "lines", r=_ROUTE))
def import_summary(spark, sf):
    return FED.import_summary(routed(spark, sf), lines(spark, sf))


NOW = "2025-01-01T00:00:00Z"


_SHARDS = 16
# CRC-32 of a report's id deals it to a shard of the local log.
_DEALT = f"""SELECT rep.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(rid,''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c>>8, t[(xor(c,b)&255)+1])), 4294967295)%{_SHARDS} AS shard FROM rep,
    (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c>>1, (c&1)*3988292384)) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def _chained(log, key):
    """SQL for the events of reports chained in one log per ``key``."""
    first, following = (occ_id("s.").replace("s.prev_chain_hash", p) for p in ("repeat('0',64)", "q.chain_hash"))
    return f"""WITH RECURSIVE s AS (SELECT rid AS identity_id, 'peer:'||peer_log_id AS attestor, 'federated_importer' AS attestor_role, '{NOW}' AS ingested_at,
    {log} AS log_id, row_number() OVER (PARTITION BY {key} ORDER BY rid, foreign_occurrence_id) AS seq FROM rep),
    q AS (SELECT s.*, repeat('0',64) AS prev_chain_hash, {first} AS id, {link("repeat('0',64)", first)} AS chain_hash FROM s WHERE seq=1
    UNION ALL SELECT s.*, q.chain_hash, {following}, {link("q.chain_hash", following)} FROM s JOIN q ON s.log_id=q.log_id AND s.seq=q.seq+1) SELECT * FROM q"""


@query("importer_occurrences", sql(f"""SELECT log_id, seq, identity_id, attestor, attestor_role, id, chain_hash FROM ({_chained("'log:home-'||shard", "shard").replace("FROM rep)", f"FROM ({_DEALT}) rep)")})""", "occ", "lines", r=_ROUTE, rep=_REPORTS))
def importer_occurrences(spark, sf):
    """All reports appended to the shards of the local log, with every hash."""
    rows = FED.importer_occurrences(reports(spark, sf), "log:home", NOW, shards=_SHARDS)
    return rows.select("log_id", "seq", "identity_id", "attestor", "attestor_role", "id", "chain_hash")


@query("importer_chain", sql(f"""SELECT seq, identity_id, prev_chain_hash, id, chain_hash FROM (WITH RECURSIVE s AS (SELECT rid AS identity_id, 'peer:'||peer_log_id AS attestor, 'federated_importer' AS attestor_role, '{NOW}' AS ingested_at,
    'log:home:'||peer_log_id AS log_id, row_number() OVER (PARTITION BY peer_log_id ORDER BY rid, foreign_occurrence_id) AS seq FROM rep),
    q AS (SELECT s.*, repeat('0',64) AS prev_chain_hash, {occ_id("s.").replace("s.prev_chain_hash", "repeat('0',64)")} AS id, {link("repeat('0',64)", occ_id("s.").replace("s.prev_chain_hash", "repeat('0',64)"))} AS chain_hash FROM s WHERE seq=1
    UNION ALL SELECT s.*, q.chain_hash, {occ_id("s.").replace("s.prev_chain_hash", "q.chain_hash")}, {link("q.chain_hash", occ_id("s.").replace("s.prev_chain_hash", "q.chain_hash"))} FROM s JOIN q ON s.log_id=q.log_id AND s.seq=q.seq+1) SELECT * FROM q)""",
    "occ", "lines", r=_ROUTE, rep=_REPORTS))
def importer_chain(spark, sf):
    """The same reports in one local log per peer, with every hash."""
    new = reports(spark, sf).select(
        F.col("id").alias("identity_id"), F.concat(F.lit("peer:"), "peer_log_id").alias("attestor"), F.lit("federated_importer").alias("attestor_role"),
        F.lit(NOW).alias("ingested_at"), F.concat(F.lit("log:home:"), "peer_log_id").alias("log_id"), "foreign_occurrence_id",
    )
    rows = append.append_occurrences(new, order=("identity_id", "foreign_occurrence_id"))
    return rows.select("seq", "identity_id", "prev_chain_hash", "id", "chain_hash")


@query("foreign_evidence", sql(f"SELECT sha256({_RECORD}) AS id, 'import:'||log_id||'/'||id AS endpoint, 'foreign.occurrence' AS source FROM occ WHERE NOT is_local", "occ"))
def foreign_evidence(spark, sf):
    rows = FED.foreign_as_evidence(foreign(spark, sf), "me", NOW)
    return rows.select(F.sha2("payload", 256).alias("id"), "endpoint", "source")


@query("import_validation", sql("""SELECT 'event' AS kind, id AS key, CASE WHEN user_id=4 THEN 'peer log is the local log' WHEN event_id%37=0 THEN 'log_id is not the declared peer' WHEN attestor_role='error' THEN 'unknown attestor_role' WHEN event_id%41=0 THEN 'id mismatch' END AS reason FROM occ
    WHERE NOT is_local AND (user_id=4 OR event_id%37=0 OR attestor_role='error' OR event_id%41=0) UNION ALL SELECT 'event', occ.id, 'names an unknown fact' FROM occ LEFT JOIN (SELECT DISTINCT id FROM lines) l ON l.id=occ.identity_id WHERE NOT is_local AND l.id IS NULL
    UNION ALL SELECT 'fact', id, 'id mismatch' FROM lines WHERE ordinal%83=0""", "occ", "lines"))
def import_validation(spark, sf):
    k = F.col("event_id")
    events = foreign(spark, sf, store.occurrences_once).withColumn("peer_log_id", F.when(k % 37 == 0, F.lit("log:other")).otherwise(F.col("log_id")))
    events = events.withColumn("peer_log_id", F.when(F.col("log_id") == "log:4", F.col("log_id")).otherwise(F.col("peer_log_id")))
    events = events.withColumn("attestor", F.when(k % 41 == 0, F.lit("other")).otherwise(F.col("attestor")))
    vocab = F.when(F.col("ordinal") % 83 == 0, F.lit("v5")).otherwise(F.col("vocab"))
    return FED.validate_foreign(store.lines_once(spark, sf).withColumn("vocab", vocab), events, None, "log:4")


@query("import_continuity", sql(f"""SELECT log_id, seq, reason FROM (SELECT c.log_id, c.seq, CASE WHEN c.before IS NULL THEN 'line before is missing' WHEN prev_chain_hash<>before THEN 'prev_chain_hash mismatch' WHEN chain_hash<>{link("prev_chain_hash", "id")} THEN 'chain_hash mismatch' END AS reason
    FROM (SELECT n.*, coalesce(st.chain_hash, b.chain_hash) AS before FROM n LEFT JOIN n b ON b.log_id=n.log_id AND b.seq=n.seq-1 LEFT JOIN (SELECT log_id, seq, chain_hash FROM chained WHERE seq=3) st ON st.log_id=n.log_id AND st.seq=n.seq-1) c) WHERE reason IS NOT NULL""",
    "chained", n="SELECT * REPLACE (CASE WHEN event_id%53=0 THEN sha256(chain_hash) ELSE chain_hash END AS chain_hash) FROM chained WHERE seq>3 AND event_id%47<>0"))
def import_continuity(spark, sf):
    """Later parts of logs whose first three events are held, with lines missing and changed."""
    chained = store.table(spark, sf, "chained")
    held = append.heads(chained.where("seq <= 3"))
    held = held.where("seq = 3")
    k = F.col("event_id")
    new = chained.where((F.col("seq") > 3) & (k % 47 != 0)).withColumn(
        "chain_hash", F.when(k % 53 == 0, F.sha2("chain_hash", 256)).otherwise(F.col("chain_hash"))
    )
    return FED.foreign_continuity(new, held).select("log_id", "seq", "reason")


@query("incremental_import", sql("SELECT id FROM chained WHERE seq>3", "chained"))
def incremental_import(spark, sf):
    chained = store.table(spark, sf, "chained")
    return FED.drop_known(chained, chained.where("seq <= 3")).select("id")


@query("register_peers", sql("""SELECT log_id, CASE WHEN k%11=0 THEN 'peer log id must start with log:' WHEN k%7=0 THEN 'public key must be 32 bytes' WHEN k%3=0 AND k%2=0 THEN 'known' WHEN k%3=0 THEN 'different key already registered' ELSE 'registered' END AS outcome
    FROM (SELECT c_custkey AS k, CASE WHEN c_custkey%11=0 THEN 'peer:' ELSE 'log:' END||c_custkey AS log_id FROM customer)"""))
def register_peers(spark, sf):
    k = F.col("c_custkey")
    customers = tables.table(spark, sf, "customer")
    name = F.concat(F.when(k % 11 == 0, F.lit("peer:")).otherwise(F.lit("log:")), k)

    def key(salt):
        return F.unhex(F.sha2(F.concat(k.cast("string"), F.lit(salt)), 256))

    new = customers.select(name.alias("log_id"), F.when(k % 7 == 0, F.lit(b"short")).otherwise(key("a")).alias("public_key"))
    old = customers.where(k % 3 == 0).select(name.alias("log_id"), F.when(k % 2 == 0, key("a")).otherwise(key("b")).alias("public_key"))
    return FED.register_peers(old, new).select("log_id", "outcome")


@query("revoked_peers", sql("SELECT id, log_id FROM occ WHERE NOT is_local AND user_id%5=0 AND ingested_at>'2024-01-15T00:00:00Z'", "occ"))
def revoked_peers(spark, sf):
    users = tables.table(spark, sf, "events").where("user_id % 5 = 0").select("user_id").distinct()
    revoked = users.select(F.concat(F.lit("log:"), F.col("user_id")).alias("log_id"), F.lit("2024-01-15T02:00:00+02:00").alias("revoked_at"))
    return FED.revoked_peer_occurrences(foreign(spark, sf), revoked).select("id", "log_id")


@query("signature_text", sql("SELECT id, " + occ_id() + " AS digest FROM occ", "occ"))
def signature_text(spark, sf):
    """What an event's signature covers is the text its id is taken from."""
    return store.table(spark, sf, "occurrences").select("id", F.sha2(E.occurrence_json(), 256).alias("digest"))
