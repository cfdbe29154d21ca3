"""The test tables as evidence, in SQL: common table expressions that mirror ``factwright.plans.tables``."""


def ident(a="", vocab="v6"):
    """SHA-256 of a fact's canonical text; the columns hold no character to escape."""
    c = lambda n: f"{a}{n}"
    return (
        "sha256('{\"evidence_id\":\"'||" + c("evidence_id") + "||'\",\"normalizer\":\"'||" + c("normalizer")
        + "||'\",\"object\":{'||CASE " + c("kind")
        + " WHEN 'iri' THEN '\"iri\":\"'||" + c("object") + "||'\",\"kind\":\"iri\"'"
        + " WHEN 'literal' THEN '\"datatype\":\"'||" + c("datatype") + "||'\",\"kind\":\"literal\",\"literal\":\"'||" + c("object") + "||'\"'"
        + " ELSE '\"kind\":\"ref\",\"ref\":\"'||" + c("object") + "||'\"' END"
        + "||'},\"observed_at\":\"'||" + c("observed_at") + "||'\",\"predicate\":\"'||" + c("predicate")
        + "||'\",\"revises\":'||coalesce('\"'||" + c("revises") + "||'\"','null')||',\"subject\":\"'||" + c("subject")
        + "||'\",\"vocab\":\"" + vocab + "\"}')"
    )


def occ_id(a=""):
    c = lambda n: f"{a}{n}"
    return (
        "sha256('{\"attestor\":\"'||" + c("attestor") + "||'\",\"attestor_role\":\"'||" + c("attestor_role")
        + "||'\",\"identity_id\":\"'||" + c("identity_id") + "||'\",\"ingested_at\":\"'||" + c("ingested_at")
        + "||'\",\"log_id\":\"'||" + c("log_id") + "||'\",\"prev_chain_hash\":\"'||" + c("prev_chain_hash") + "||'\"}')"
    )


def link(prev, occurrence):
    return f"sha256(unhex({prev})||unhex({occurrence}))"


ZERO = "repeat('0',64)"
PRINCIPAL = "'sigstore:fulcio:'||substr(sha256('tpch'||chr(10)||'cust:'||o_custkey),1,32)"

_FACTCOLS = "ordinal, subject, predicate, kind, object, datatype, evidence_id, observed_at, normalizer, revises"

# name: (needs, body)
CTES = {
    "ev": ((), "SELECT doc_id AS k, sha256(text) AS rid FROM documents"),
    "ord": (("ev",), "SELECT o.*, coalesce(ev.rid, sha256('none:'||o_orderkey)) AS evidence_id, 'pkg:tpch/order-'||o_orderkey AS subject, "
            "strftime(o_orderdate,'%Y-%m-%dT%H:%M:%SZ') AS day FROM orders o LEFT JOIN ev ON ev.k=o_orderkey"),
    "li": (("ev",), "SELECT l.*, coalesce(ev.rid, sha256('none:'||l_orderkey)) AS evidence_id, 'pkg:tpch/order-'||l_orderkey AS subject "
           "FROM lineitem l LEFT JOIN ev ON ev.k=l_orderkey"),
    "pub": (("ord",), "SELECT *, " + ident() + " AS id FROM (SELECT o_orderkey AS ordinal, subject, 'published_at' AS predicate, 'literal' AS kind, "
            "day AS object, 'xsd:dateTime' AS datatype, evidence_id, day AS observed_at, 'orders@v1' AS normalizer, CAST(NULL AS VARCHAR) AS revises, o_orderstatus FROM ord)"),
    "f0": (("ord", "li", "pub"), f"""
        SELECT {_FACTCOLS} FROM pub
        UNION ALL SELECT 1000000000000000+o_orderkey, subject, 'published_by', 'iri', 'cust:'||o_custkey, NULL, evidence_id, day, 'orders@v1', NULL FROM ord
        UNION ALL SELECT 2000000000000000+o_orderkey, subject, 'cryptographically_verified_signature_by', 'iri', {PRINCIPAL}, NULL, evidence_id, day, 'verifier@v1', NULL FROM ord WHERE o_orderstatus='F'
        UNION ALL SELECT 3000000000000000+ordinal, subject, predicate, kind, object, datatype, evidence_id, observed_at, 'orders@v2', id FROM pub WHERE o_orderstatus='F'
        UNION ALL SELECT 4000000000000000+l_orderkey, subject, 'depends_on', 'iri', 'pkg:tpch/part-'||l_partkey, NULL, evidence_id, '2024-01-01T00:00:00Z', 'lineitem@v1', NULL FROM li
        UNION ALL SELECT 5000000000000000+l_orderkey, subject, 'affected_by', 'iri', 'osv:part-'||l_partkey, NULL, evidence_id, '2024-01-01T00:00:00Z', 'osv@v1', NULL FROM li WHERE l_returnflag='R' AND l_quantity>45
        UNION ALL SELECT 6000000000000000+l_orderkey, subject, 'registry_reports_signing_key', 'iri', 'npm:key:supplier-'||l_suppkey, NULL, evidence_id, '2024-01-01T00:00:00Z', 'lineitem@v1', NULL FROM li JOIN supplier ON s_suppkey=l_suppkey
        UNION ALL SELECT 7000000000000000+p_partkey, 'pkg:tpch/part-'||p_partkey, 'depends_on', 'iri', 'pkg:tpch/size-'||p_size, NULL, sha256('part:'||p_partkey), '2024-01-01T00:00:00Z', 'part@v1', NULL FROM part"""),
    "lines": (("f0",), "SELECT *, " + ident() + " AS id FROM f0"),
    "sup": (("lines",), "SELECT revises AS target, arg_max(id, ordinal) AS superseded_by, max(ordinal) AS by_ordinal FROM lines WHERE revises IS NOT NULL GROUP BY 1"),
    "facts": (("lines", "sup"), """SELECT g.predicate, g.identity_id, g.subject, g.object, g.object_datatype, g.observed_at, g.evidence_id, g.normalizer, sup.superseded_by
        FROM (SELECT predicate, id AS identity_id, subject, object, datatype AS object_datatype, observed_at, evidence_id, normalizer, min(ordinal) AS fo FROM lines GROUP BY ALL) g
        LEFT JOIN sup ON sup.target=g.identity_id AND sup.by_ordinal>g.fo"""),
    "rawl": ((), """SELECT sha256(text) AS id, src AS source, 'doc:'||d.doc_id AS endpoint, day||'T00:00:00Z' AS fetched_at,
        'raw/'||src||'/'||day||'/'||sha256(text)||'.bin' AS payload_path, CAST(l.quality AS BIGINT) AS result_count, d.doc_id, 'pkg:tpch/order-'||d.doc_id AS subject
        FROM (SELECT *, CASE source WHEN 'src0' THEN 'npm.registry' WHEN 'src1' THEN 'sigstore.rekor' WHEN 'src2' THEN 'npm.attestations' WHEN 'src3' THEN 'osv.dev' ELSE source END AS src,
        '2024-01-'||lpad(CAST(doc_id%28+1 AS VARCHAR),2,'0') AS day FROM documents) d LEFT JOIN labels l ON l.doc_id=d.doc_id"""),
    "raw": (("rawl",), "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY payload_path, endpoint) AS rn FROM rawl) WHERE rn=1"),
    "evs": (("ord",), "SELECT event_id, user_id, ingested_at, attestor, attestor_role, log_id, is_local, predicate, " + ident() + """ AS identity_id FROM (
        SELECT e.event_id, e.user_id, strftime(e.ts,'%Y-%m-%dT%H:%M:%SZ') AS ingested_at, 'ingestor:tables@v1:'||e.user_id AS attestor,
        CASE e.event_type WHEN 'view' THEN 'observer' WHEN 'click' THEN 'observer' WHEN 'purchase' THEN 'verifier' WHEN 'signup' THEN 'federated_importer' ELSE e.event_type END AS attestor_role,
        'log:'||e.user_id AS log_id, e.user_id%3=0 AS is_local, o.subject, o.evidence_id, 'iri' AS kind, CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS revises, o.day AS observed_at,
        CASE WHEN e.event_type='purchase' THEN 'cryptographically_verified_signature_by' ELSE 'published_by' END AS predicate,
        CASE WHEN e.event_type='purchase' THEN 'verifier@v1' ELSE 'orders@v1' END AS normalizer,
        CASE WHEN e.event_type='purchase' THEN """ + PRINCIPAL + """ ELSE 'cust:'||o_custkey END AS object
        FROM events e JOIN ord o ON o.o_orderkey=e.event_id-e.event_id%3)"""),
    "occ": (("evs",), "SELECT *, " + link("prev_chain_hash", "id") + " AS chain_hash FROM (SELECT *, " + occ_id() + f""" AS id FROM (
        SELECT *, CASE WHEN seq=1 THEN {ZERO} ELSE sha256('link:'||log_id||':'||(seq-1)) END AS prev_chain_hash FROM (
        SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ingested_at, event_id) AS seq FROM evs)))"""),
    "chained": (("evs",), f"""SELECT * FROM (WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ingested_at, event_id) AS seq FROM evs),
        r AS (SELECT s.*, {ZERO} AS prev_chain_hash, {occ_id("s.").replace("s.prev_chain_hash", ZERO)} AS id, {link(ZERO, occ_id("s.").replace("s.prev_chain_hash", ZERO))} AS chain_hash FROM s WHERE seq=1
        UNION ALL SELECT s.*, r.chain_hash, {occ_id("s.").replace("s.prev_chain_hash", "r.chain_hash")}, {link("r.chain_hash", occ_id("s.").replace("s.prev_chain_hash", "r.chain_hash"))} FROM s JOIN r ON s.log_id=r.log_id AND s.seq=r.seq+1)
        SELECT * FROM r)"""),
    "flags": (("facts",), """SELECT subject, bool_or(predicate='registry_reports_signing_key' AND superseded_by IS NULL) AS key,
        bool_or(predicate='cryptographically_verified_signature_by' AND superseded_by IS NULL) AS ver,
        bool_or(predicate='affected_by' AND superseded_by IS NULL) AS vul, bool_or(predicate='depends_on' AND superseded_by IS NULL) AS dep,
        bool_or(predicate='published_at' AND superseded_by IS NULL) AS pat, bool_or(predicate='published_by' AND superseded_by IS NULL) AS pby,
        count(*) FILTER (predicate='registry_reports_signing_key') AS n_key, count(*) FILTER (predicate='cryptographically_verified_signature_by') AS n_ver,
        count(*) FILTER (predicate='published_at') AS n_pat, count(*) FILTER (predicate='published_by') AS n_pby,
        count(*) FILTER (predicate='affected_by') AS n_vul, count(*) FILTER (predicate='depends_on') AS n_dep FROM facts GROUP BY subject"""),
    "rf": (("raw",), """SELECT coalesce(bool_or(source='sigstore.rekor'),false) AS rq, coalesce(bool_or(source='sigstore.rekor' AND coalesce(result_count,-1)>0),false) AS rh,
        coalesce(bool_or(source='npm.registry'),false) AS nq, coalesce(bool_or(source='npm.attestations'),false) AS af, coalesce(bool_or(source='osv.dev' AND endpoint<>''),false) AS oq,
        count(*) FILTER (source='sigstore.rekor') AS n_rq, count(*) FILTER (source='npm.registry') AS n_nq, count(*) FILTER (source='npm.attestations') AS n_af, count(*) FILTER (source='osv.dev') AS n_oq FROM raw"""),
    # the same per subject, for evidence that names its subject
    "rs": (("rawl",), """SELECT subject, bool_or(source='sigstore.rekor') AS rq, bool_or(source='sigstore.rekor' AND coalesce(result_count,-1)>0) AS rh,
        bool_or(source='npm.registry') AS nq, bool_or(source='npm.attestations') AS af, bool_or(source='osv.dev' AND endpoint<>'') AS oq,
        count(*) FILTER (source='sigstore.rekor') AS n_rq, count(*) FILTER (source='npm.registry') AS n_nq, count(*) FILTER (source='npm.attestations') AS n_af, count(*) FILTER (source='osv.dev') AS n_oq FROM rawl GROUP BY 1"""),
    "fs": (("flags", "rs"), """SELECT flags.*, coalesce(rq,false) AS rq, coalesce(rh,false) AS rh, coalesce(nq,false) AS nq, coalesce(af,false) AS af, coalesce(oq,false) AS oq,
        coalesce(n_rq,0) AS n_rq, coalesce(n_nq,0) AS n_nq, coalesce(n_af,0) AS n_af, coalesce(n_oq,0) AS n_oq FROM flags LEFT JOIN rs ON rs.subject=flags.subject"""),
    "edges": (("facts",), "SELECT DISTINCT subject, object FROM facts WHERE predicate='depends_on' AND superseded_by IS NULL AND subject<>object"),
    "near": (("edges", "flags"), "SELECT e.subject, CAST(sum(f.n_dep) AS BIGINT) AS d_dep, CAST(sum(f.n_vul) AS BIGINT) AS d_vul FROM edges e JOIN flags f ON f.subject=e.object GROUP BY 1"),
}


def names(**conditions):
    """Sorted, comma-separated names of the conditions that hold."""
    parts = ",".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sorted(conditions.items()))
    return f"concat_ws(',',{parts})"


def sql(select, *needs, **extra):
    """A statement with the expressions it needs, and what they need, in order."""
    order = []

    def visit(n):
        if n in extra or n in order:
            return
        for m in CTES[n][0]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    # each is worked out once, however often it is named
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order] + [f"{n} AS MATERIALIZED ({b})" for n, b in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select
