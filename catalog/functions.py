from pyspark.sql import functions as F

from catalog import query
from catalog.sql import sql
from factwright.constants import IRI_ESCAPES, REASON_RULES
from factwright.functions import checks, envelopes as E, text as X
from factwright.plans import store, tables


def orders(spark, sf):
    return tables.table(spark, sf, "orders")


K = "o_orderkey"


def choose(k, options):
    """The option at ``k`` modulo their number."""
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(F.col(k) % len(options) == i, options[i]).otherwise(out)
    return out


def _k():
    return F.col(K).cast("string")


@query("purl_parse", sql("""SELECT o_orderkey, CASE o_orderkey%6 WHEN 0 THEN 'name-'||o_orderkey WHEN 1 THEN '@scope/n'||o_orderkey WHEN 2 THEN 'a@b' END AS name, CASE o_orderkey%6 WHEN 0 THEN '1.'||o_custkey WHEN 1 THEN '2.0.0' WHEN 2 THEN 'c'||o_orderkey END AS version FROM orders"""))
def purl_parse(spark, sf):
    purl = choose(K, [
        F.concat(F.lit("pkg:npm/name-"), _k(), F.lit("@1."), F.col("o_custkey")), F.concat(F.lit("pkg:npm/@scope/n"), _k(), F.lit("@2.0.0")),
        F.concat(F.lit("pkg:npm/a@b@c"), _k()), F.concat(F.lit("pkg:pypi/x@"), _k()), F.concat(F.lit("pkg:npm/@"), _k()), F.concat(F.lit("pkg:npm/x"), _k(), F.lit("@")),
    ])
    p = X.parse_npm_purl(purl)
    return orders(spark, sf).select(K, p["name"].alias("name"), p["version"].alias("version"))


@query("url_parse", sql(r"""SELECT page_id, CASE WHEN page_id%4 IN (2,3) THEN NULL ELSE seg1 END AS owner, CASE WHEN page_id%4 IN (2,3) THEN NULL ELSE seg2 END AS repo,
    CASE page_id%4 WHEN 2 THEN 'unsupported host' WHEN 3 THEN 'missing owner or repo' END AS error FROM (SELECT page_id, string_split(regexp_extract(url,'^https?://[^/]+/([^?#]*)',1),'/')[1] AS seg1,
    regexp_replace(string_split(regexp_extract(url,'^https?://[^/]+/([^?#]*)',1),'/')[2],'\.git$','') AS seg2 FROM pages)"""))
def url_parse(spark, sf):
    """The pages' addresses, half of them moved to the repository host."""
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    page = F.col("page_id") % 4
    url = (
        F.when(page == 0, F.concat(F.lit("https://github.com"), path, F.lit("?tab=readme"))).when(page == 1, F.concat(F.lit("http://WWW.GitHub.com"), path))
        .when(page == 2, F.col("url")).otherwise(F.lit("https://github.com/alone/"))
    )
    p = X.parse_repo_url(url)
    return tables.table(spark, sf, "pages").select("page_id", p["owner"].alias("owner"), p["repo"].alias("repo"), p["error"].alias("error"))


@query("repository_url", sql("""SELECT o_orderkey, CASE o_orderkey%6 WHEN 5 THEN '' WHEN 4 THEN 'http://h/'||o_orderkey ELSE 'https://github.com/o/r'||o_orderkey END AS repository FROM orders"""))
def repository_url(spark, sf):
    def field(v):
        return F.concat(F.lit('{"repository":'), v, F.lit("}"))

    def quoted(a, b):
        return F.concat(F.lit('"' + a), _k(), F.lit(b + '"'))

    doc = choose(K, [
        field(quoted("git+https://github.com/o/r", ".git")), field(quoted("git@github.com:o/r", ".git")),
        field(F.concat(F.lit('{"type":"git","url":'), quoted("git+ssh://git@github.com/o/r", ".git"), F.lit("}"))),
        field(quoted("  git://github.com/o/r", " ")), field(quoted("http://h/", "")), F.lit('{"name":"x"}'),
    ])
    return orders(spark, sf).select(K, X.repository_url(doc).alias("repository"))


@query("owner_repo", sql("""SELECT o_orderkey, CASE o_orderkey%7 WHEN 6 THEN '' ELSE 'own' END AS owner, CASE o_orderkey%7 WHEN 6 THEN '' ELSE 'r'||o_orderkey END AS repo,
    CASE WHEN o_orderkey%7=6 THEN '' ELSE '^https://github.com/own/r'||o_orderkey||'/\\.github/workflows/.+@refs/.+$' END AS pattern, CASE WHEN o_orderkey%7=6 OR o_orderkey%2=1 THEN 'false' ELSE 'true' END AS coherent FROM orders"""))
def owner_repo(spark, sf):
    def at(prefix, suffix=""):
        return F.concat(F.lit(prefix + "own/r"), _k(), F.lit(suffix))

    repo = choose(K, [
        at("https://github.com/", ".git"), at("http://github.com/", "/"), at("git+https://github.com/", "/tree/x"), at("git@github.com:"),
        at("github:"), at("github.com/"), F.lit("alone"),
    ])
    subject = F.when(F.col(K) % 2 == 0, at("https://github.com/", "/.github/workflows/ci.yml@refs/tags/v1")).otherwise(at("https://github.com/", "x/.github/workflows/ci.yml@refs/tags/v1"))
    o = X.owner_repo(repo)
    return orders(spark, sf).select(
        K, o["owner"].alias("owner"), o["repo"].alias("repo"), X.workflow_subject_pattern(repo).alias("pattern"), X.subject_is_coherent(subject, repo).cast("string").alias("coherent")
    )


_TIMES = [("", "Z"), ("", ".5Z"), ("", "+02:00"), ("", "-23:30"), (" ", "Z"), ("", ""), ("", "+2:00"), ("day", ""), ("feb", "Z"), ("hour", "Z")]


@query("rfc3339", sql("""SELECT o_orderkey, CASE WHEN o_orderkey%10<4 THEN 'true' ELSE 'false' END AS valid,
    CASE o_orderkey%10 WHEN 0 THEN strftime(o_orderdate,'%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate,'%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate - INTERVAL 2 HOUR,'%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate + INTERVAL 1410 MINUTE,'%Y-%m-%d') END AS day FROM orders"""))
def rfc3339(spark, sf):
    stamp = F.substring(F.col("o_orderdate").cast("string"), 1, 19)
    date, time = F.substring(stamp, 1, 10), F.substring(stamp, 12, 8)

    def form(kind, suffix):
        if kind == "day":
            return date
        if kind == "feb":
            return F.concat(F.substring(stamp, 1, 4), F.lit("-02-30T00:00:00Z"))
        if kind == "hour":
            return F.concat(date, F.lit("T24:00:00Z"))
        return F.concat(date, F.lit(kind or "T"), time, F.lit(suffix))

    text = choose(K, [form(*f) for f in _TIMES])
    return orders(spark, sf).select(K, X.is_rfc3339(text).cast("string").alias("valid"), X.day_bucket(text).alias("day"))


_REASONS = "CASE WHEN t='' THEN 'unknown' " + " ".join(
    "WHEN " + " OR ".join(f"contains(m,'{n}')" for n in needles) + f" THEN '{code}'" for code, needles in REASON_RULES
) + " ELSE 'unknown' END"
_MESSAGES = [n for _, needles in REASON_RULES for n in needles] + ["brand new wording"]


@query("reason_codes", sql(f"SELECT k, {_REASONS} AS code FROM (SELECT k, t, lower(t) AS m FROM (SELECT 'd'||doc_id AS k, text AS t FROM documents UNION ALL SELECT 'e'||event_id, 'Failed: '||upper(list_extract({_MESSAGES}, CAST(1+event_id%{len(_MESSAGES)} AS INT)))||' here' FROM events))"))
def reason_codes(spark, sf):
    """Whole documents and messages that hold each known wording."""
    docs = tables.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("k"), F.col("text").alias("t"))
    words = F.array(*[F.lit(m) for m in _MESSAGES])
    wording = F.element_at(words, (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    events = tables.table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id")).alias("k"), F.concat(F.lit("Failed: "), F.upper(wording), F.lit(" here")).alias("t"))
    return docs.unionByName(events).select("k", X.classify_reason("t").alias("code"))


_ESC = "url"
for _raw, _esc in IRI_ESCAPES:
    _ESC = f"replace({_ESC}, chr({ord(_raw)}), '{_esc}')"


@query("text_escapes", sql(f"""SELECT k, sha256({_ESC}) AS iri, sha256(replace(replace(replace(replace(replace(url,'\\','\\\\'),'"','\\"'),chr(10),'\\n'),chr(13),'\\r'),chr(9),'\\t')) AS quad FROM
    (SELECT 'p'||page_id AS k, html AS url FROM pages UNION ALL SELECT 'd'||doc_id, text FROM documents)"""))
def text_escapes(spark, sf):
    rows = tables.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("k"), F.col("html").alias("t")).unionByName(
        tables.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("k"), F.col("text").alias("t"))
    )
    return rows.select("k", F.sha2(X.iri_escape("t"), 256).alias("iri"), F.sha2(X.nquads_escape("t"), 256).alias("quad"))


@query("names_and_splits", sql("""SELECT id, substr(id,1,12)||'…' AS short, 'ed25519:fp:'||substr(id,1,12)||'…' AS short_signature, 'ed25519' AS algorithm, 'fp' AS fingerprint, id||':x' AS signature,
    'tables' AS tool, 'v1' AS version, replace(log_id,':','_') AS file, log_id AS log, 'sigstore.rekor.anchor' AS provider, 'ingestor:t:'||substr(sha256(id),1,16) AS attestor FROM occ""", "occ"))
def names_and_splits(spark, sf):
    sig = F.concat(F.lit("ed25519:fp:"), "id", F.lit(":x"))
    s, n = E.split_signature(sig), E.split_normalizer(F.lit("tables@v1"))
    return store.table(spark, sf, "occurrences").select(
        "id", X.short_hash("id").alias("short"), X.short_hash(sig, signatures=True).alias("short_signature"), s["algorithm"].alias("algorithm"),
        s["fingerprint"].alias("fingerprint"), s["signature"].alias("signature"), n["name"].alias("tool"), n["version"].alias("version"),
        X.filename_safe("log_id").alias("file"), X.from_filename(X.filename_safe("log_id")).alias("log"),
        X.provider_source(F.concat(F.lit("rekor:42:"), "id")).alias("provider"), E.attestor(F.lit("t"), E.key_fingerprint("id")).alias("attestor"),
    )


@query("landed_documents", sql("""SELECT event_id, CASE WHEN event_id%5=0 THEN 0 ELSE 2 END AS vulns, CASE WHEN event_id%5=0 THEN 0 ELSE 3 END AS entries, CASE WHEN event_id%3=0 THEN '' ELSE 'https://t/'||event_id END AS tarball,
    CASE WHEN event_id%3=0 THEN '' ELSE strftime(epoch_ms(1600000000000+event_id*86461000),'%Y-%m-%dT%H:%M:%SZ') END AS included, CASE WHEN event_id%4=0 THEN 'b'||event_id END AS pointer FROM events"""))
def landed_documents(spark, sf):
    k = F.col("event_id").cast("string")
    m5, m3, m4 = F.col("event_id") % 5 == 0, F.col("event_id") % 3 == 0, F.col("event_id") % 4 == 0
    vulns = F.when(m5, F.lit("not json")).otherwise(F.concat(F.lit('{"vulns":[{"id":"'), k, F.lit('"},{"id":"b"}]}')))
    entries = F.when(m5, F.lit("{")).otherwise(F.concat(F.lit('["a","b","'), k, F.lit('"]')))
    doc = F.when(m3, F.lit("{}")).otherwise(F.concat(F.lit('{"dist":{"tarball":"https://t/'), k, F.lit('"}}')))
    seconds = (F.col("event_id") * 86461 + 1600000000).cast("string")
    bundle = F.concat(F.lit('{"verificationMaterial":{"tlogEntries":[{"integratedTime":"'), F.when(m3, F.lit("12x")).otherwise(seconds), F.lit('"},{"integratedTime":"1"}]}}'))
    pointer = F.when(m4, F.concat(F.lit('{"bundle_evidence_id":"b'), k, F.lit('"}'))).otherwise(F.lit('{"bundle":1}'))
    return tables.table(spark, sf, "events").select(
        "event_id", X.vuln_count(vulns).alias("vulns"), X.entry_count(entries).alias("entries"), X.tarball_url(doc).alias("tarball"),
        X.integrated_time(bundle).alias("included"), X.bundle_pointer(pointer).alias("pointer"),
    )


def _object(kind, iri=None, literal=None, datatype=None, ref=None):
    def c(v):
        return F.lit(v).cast("string") if v is None or isinstance(v, str) else v.cast("string")

    return F.struct(F.lit(kind).alias("kind"), c(iri).alias("iri"), c(literal).alias("literal"), c(datatype).alias("datatype"), c(ref).alias("ref"))


_OBJECTS = [
    ("iri", dict(iri="x"), None, "iri:x", "x"), ("iri", dict(iri=""), "iri object has empty iri", "iri:", ""),
    ("iri", dict(iri="x", ref="y"), "iri object has stray fields", "iri:x", "x"), ("literal", dict(literal='a"b', datatype="t"), None, 'lit:t:a"b', '"a\\"b"^^t'),
    ("literal", dict(literal="", datatype="t"), "literal object has empty literal", "lit:t:", '""^^t'), ("literal", dict(literal="a", datatype=""), "literal object has empty datatype", "lit::a", '"a"^^'),
    ("literal", dict(literal="a", datatype="t", iri="z"), "literal object has stray fields", "lit:t:a", '"a"^^t'), ("ref", dict(ref="r"), None, "ref:r", "→r"),
    ("ref", dict(ref=""), "ref object has empty ref", "ref:", "→"), ("ref", dict(ref="r", literal="l"), "ref object has stray fields", "ref:r", "→r"), ("thing", dict(), "unknown object kind", "unknown:thing", "?"),
]


def _case(values):
    def text(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    return f"CASE o_orderkey%{len(values)} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


@query("object_rules", sql(f"SELECT o_orderkey, {_case([o[2] for o in _OBJECTS])} AS reason, {_case([o[3] for o in _OBJECTS])} AS key, {_case([o[4] for o in _OBJECTS])} AS shown FROM orders"))
def object_rules(spark, sf):
    o = choose(K, [_object(kind, **fields) for kind, fields, *_ in _OBJECTS])
    rows = orders(spark, sf).select(K, o.alias("o"))
    return rows.select(K, checks.object_violation("o").alias("reason"), E.object_key("o").alias("key"), X.render_object("o").alias("shown"))


@query("identity_violations", sql("""SELECT ordinal, id, CASE WHEN ordinal%7=0 THEN 'evidence_id is required' WHEN ordinal%5=0 THEN 'observed_at is not RFC 3339' WHEN ordinal%3=0 THEN 'normalizer is required' END AS reason FROM lines""", "lines"))
def identity_violations(spark, sf):
    k = F.col("ordinal")
    rows = store.lines_once(spark, sf).withColumn("evidence_id", F.when(k % 7 != 0, F.col("evidence_id"))).withColumn(
        "observed_at", F.when(k % 5 == 0, F.substring("observed_at", 1, 10)).otherwise(F.col("observed_at"))).withColumn(
        "normalizer", F.when(k % 3 == 0, F.lit("")).otherwise(F.col("normalizer")))
    return rows.select("ordinal", "id", checks.identity_violation().alias("reason"))


@query("occurrence_violations", sql("""SELECT id, CASE WHEN event_id%7=0 THEN 'identity_id must be 64 characters' WHEN event_id%5=0 THEN 'attestor is required' WHEN attestor_role='error' THEN 'unknown attestor_role'
    WHEN event_id%3=0 THEN 'log_id is required' WHEN event_id%2=0 THEN 'prev_chain_hash is required' END AS reason FROM occ""", "occ"))
def occurrence_violations(spark, sf):
    k = F.col("event_id")
    rows = store.occurrences_once(spark, sf).withColumn("identity_id", F.when(k % 7 == 0, F.lit("abc")).otherwise(F.col("identity_id"))).withColumn(
        "attestor", F.when(k % 5 == 0, F.lit("")).otherwise(F.col("attestor"))).withColumn("log_id", F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("log_id"))).withColumn(
        "prev_chain_hash", F.when(k % 2 == 0, F.lit("")).otherwise(F.col("prev_chain_hash")))
    return rows.select("id", checks.occurrence_violation().alias("reason"))


@query("checkpoint_violations", sql("""SELECT id, CASE WHEN event_id%5=0 THEN 'log_id is required' WHEN seq=1 THEN 'seq must be above 0' WHEN event_id%3=0 THEN 'chain_hash must be 64 characters' WHEN event_id%2=0 THEN 'signed_at is not RFC 3339'
    WHEN event_id%7=0 THEN 'signature is required' END AS reason FROM occ""", "occ"))
def checkpoint_violations(spark, sf):
    k = F.col("event_id")
    rows = store.table(spark, sf, "occurrences").select(
        "id", F.when(k % 5 != 0, F.col("log_id")).alias("log_id"), (F.col("seq") - 1).alias("seq"), F.when(k % 3 == 0, F.lit("ab")).otherwise(F.col("chain_hash")).alias("chain_hash"),
        F.when(k % 2 == 0, F.lit("yesterday")).otherwise(F.col("ingested_at")).alias("signed_at"), F.when(k % 7 != 0, F.lit("s")).alias("signature"),
    )
    return rows.select("id", checks.checkpoint_violation().alias("reason"))


@query("non_integer_numbers", sql("""SELECT event_id, CASE event_id%5 WHEN 1 THEN 'non-integer number '||event_id||'.5' WHEN 2 THEN 'non-integer number 1e'||event_id WHEN 3 THEN 'non-integer number 99999999999999999999' END AS reason FROM events"""))
def non_integer_numbers(spark, sf):
    k = F.col("event_id").cast("string")
    m = F.col("event_id") % 5
    number = F.when(m == 1, F.concat(k, F.lit(".5"))).when(m == 2, F.concat(F.lit("1e"), k)).when(m == 3, F.lit("99999999999999999999")).when(m == 4, F.concat(F.lit('"'), k, F.lit('.5 \\" 2.5"'))).otherwise(k)
    text = F.concat(F.lit('{"seq":'), number, F.lit(',"props":'), F.col("props"), F.lit("}"))
    return tables.table(spark, sf, "events").select("event_id", checks.non_integer_number(text).alias("reason"))
