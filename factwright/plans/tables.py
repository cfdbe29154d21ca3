"""The star-schema test tables read as evidence, so that every operator runs on given data."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factwright.functions.envelopes import identity_id, occurrence_id, chain_hash, principal_iri
from factwright.constants import GENESIS
from factwright.operators import append, ordering

FIXED_TIME = "2024-01-01T00:00:00Z"
SOURCES = {"src0": "npm.registry", "src1": "sigstore.rekor", "src2": "npm.attestations", "src3": "osv.dev"}
_FAMILY = 10**15


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PART_ROWS = 150_000  # some 330,000 facts, whose sorts fit a task's share of 3 GB for two cores


def parts(spark, sf) -> int:
    """The number of parts that facts are dealt into: it grows with the orders and their lines, by whole waves of tasks."""
    rows = sum(table(spark, sf, name).count() for name in ("orders", "lineitem"))
    wave = spark.sparkContext.defaultParallelism
    return wave * max(1, -(-rows // (PART_ROWS * wave)))


def _text(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def utc_text(c) -> Column:
    """RFC 3339 text, to the second, of a timestamp column."""
    return F.concat(F.replace(F.substring(_text(c), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def payload_ids(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("rid"))


def raw_evidence(spark, sf) -> DataFrame:
    """One sidecar per document; copies of a text share an id."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("id"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("result_count"))
    source = F.col("source")
    for raw, name in SOURCES.items():
        source = F.when(F.col("source") == raw, F.lit(name)).otherwise(source)
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    return docs.join(labels, "doc_id", "left").select(
        "id",
        source.alias("source"),
        F.concat(F.lit("doc:"), _text("doc_id")).alias("endpoint"),
        F.create_map(F.lit("name"), F.concat(F.lit("order-"), _text("doc_id")), F.lit("version"), F.lit("1")).alias("request_params"),
        F.concat(day, F.lit("T00:00:00Z")).alias("fetched_at"),
        F.lit("ingestor:tables@v1:0000000000000000").alias("fetcher"),
        F.lit(200).alias("response_status"),
        F.concat_ws("/", F.lit("raw"), source, day, F.concat("id", F.lit(".bin"))).alias("payload_path"),
        F.col("id").alias("payload_hash"),
        "result_count",
        F.lit(None).cast("string").alias("signature"),
        order_subject("doc_id").alias("subject"),
    )


def _iri(c) -> Column:
    n = F.lit(None).cast("string")
    return F.struct(F.lit("iri").alias("kind"), c.alias("iri"), n.alias("literal"), n.alias("datatype"), n.alias("ref"))


def _date(c) -> Column:
    n = F.lit(None).cast("string")
    return F.struct(
        F.lit("literal").alias("kind"), n.alias("iri"), c.alias("literal"), F.lit("xsd:dateTime").alias("datatype"), n.alias("ref")
    )


def _fact(family: int, key, subject, predicate, obj, observed_at, normalizer) -> Column:
    return F.struct(
        (F.lit(family * _FAMILY) + key).alias("ordinal"),
        subject.alias("subject"),
        F.lit(predicate).alias("predicate"),
        obj.alias("object"),
        F.col("evidence_id"),
        observed_at.alias("observed_at"),
        F.lit(normalizer).alias("normalizer"),
        F.lit("v6").alias("vocab"),
        F.lit(None).cast("string").alias("revises"),
    )


def _with_payload(df: DataFrame, spark, sf, key: str) -> DataFrame:
    ids = payload_ids(spark, sf)
    return df.join(ids, df[key] == ids["k"], "left").drop("k")


def _with_evidence(df: DataFrame, key: str) -> DataFrame:
    absent = F.sha2(F.concat(F.lit("none:"), _text(key)), 256)
    return df.withColumn("evidence_id", F.coalesce("rid", absent)).drop("rid")


def order_subject(key) -> Column:
    return F.concat(F.lit("pkg:tpch/order-"), _text(key))


def part_subject(key) -> Column:
    return F.concat(F.lit("pkg:tpch/part-"), _text(key))


def published_by_fact() -> Column:
    k = F.col("o_orderkey")
    return _fact(1, k, order_subject(k), "published_by", _iri(F.concat(F.lit("cust:"), _text("o_custkey"))),
                 utc_text("o_orderdate"), "orders@v1")


def verified_fact() -> Column:
    k = F.col("o_orderkey")
    who = principal_iri(F.lit("tpch"), F.concat(F.lit("cust:"), _text("o_custkey")))
    return _fact(2, k, order_subject(k), "cryptographically_verified_signature_by", _iri(who),
                 utc_text("o_orderdate"), "verifier@v1")


def published_at_fact() -> Column:
    k = F.col("o_orderkey")
    day = utc_text("o_orderdate")
    return _fact(0, k, order_subject(k), "published_at", _date(day), day, "orders@v1")


def _dealt(spark, sf) -> DataFrame:
    """Orders, their lines and parts as narrow rows dealt by subject, in its order, with ``subject`` and ``evidence_id``. Payloads are dealt
    alike, so that their join moves nothing, and neither does what is made of the rows and asked per subject; facts of a subject are
    written side by side, and the evidence they share takes room once."""
    n = parts(spark, sf)
    near = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("known"))
    affected = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", affected.alias("affected"))
    lines = lines.join(near, lines["l_suppkey"] == near["known"], "left").withColumn("known", F.col("known").isNotNull())
    orders = table(spark, sf, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), "o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("finished"))
    lines = lines.withColumn("kind", F.lit("line")).withColumn("key", F.col("l_orderkey"))
    items = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), "p_partkey", "p_size")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (orders, lines, items))
    is_part = F.col("kind") == "part"
    subject = F.concat(F.when(is_part, part_subject(F.lit(""))).otherwise(order_subject(F.lit(""))), _text("key"))
    ids = payload_ids(spark, sf).select(order_subject("k").alias("of"), "rid").repartition(n, "of")
    rows = rows.repartition(n, subject).withColumn("subject", subject)
    rows = rows.join(ids, rows["subject"] == ids["of"], "left").drop("of").sortWithinPartitions("subject")
    absent = F.sha2(F.concat(F.when(is_part, F.lit("part:")).otherwise(F.lit("none:")), _text("key")), 256)
    return rows.withColumn("evidence_id", F.coalesce("rid", absent)).drop("rid")


def identities(spark, sf) -> DataFrame:
    """All facts as they were written: ``ordinal``, the eight envelope columns and ``id``. Order lines
    of equal content give copies of a fact; finished orders revise their publication date. Ids are those of the content, and
    all facts of a subject are in one part."""
    order, line, item, finished = *[F.col("kind") == k for k in ("order", "line", "part")], F.col("finished")
    dealt = _dealt(spark, sf).withColumn("first", F.when(order, published_at_fact()))
    dealt = dealt.withColumn("revised", F.when(finished, identity_id("first.")))
    day, at = utc_text("o_orderdate"), F.lit(FIXED_TIME)
    k, subject, owner = F.col("l_orderkey"), order_subject("l_orderkey"), F.col("o_orderkey")
    again = _fact(3, owner, order_subject(owner), "published_at", _date(day), day, "orders@v2")
    facts = F.array(
        F.col("first"), F.when(order, published_by_fact()), F.when(finished, verified_fact()), F.when(finished, again.withField("revises", F.col("revised"))),
        F.when(line, _fact(4, k, subject, "depends_on", _iri(part_subject("l_partkey")), at, "lineitem@v1")),
        F.when(F.col("affected"), _fact(5, k, subject, "affected_by", _iri(F.concat(F.lit("osv:part-"), _text("l_partkey"))), at, "osv@v1")),
        F.when(F.col("known"), _fact(
            6, k, subject, "registry_reports_signing_key",
            _iri(F.concat(F.lit("npm:key:supplier-"), _text("l_suppkey"))), at, "lineitem@v1")),
        F.when(item, _fact(
            7, F.col("p_partkey"), part_subject("p_partkey"), "depends_on",
            _iri(F.concat(F.lit("pkg:tpch/size-"), _text("p_size"))), at, "part@v1")),
    )
    # the subject stays the column that rows are dealt by
    rows = dealt.select("subject", F.explode(facts).alias("f")).where("f IS NOT NULL")
    names = ("ordinal", "subject", "predicate", "object", "evidence_id", "observed_at", "normalizer", "vocab", "revises")
    return rows.select(*[F.col("subject") if n == "subject" else F.col(f"f.{n}") for n in names]).withColumn("id", identity_id())


ROLES = {"view": "observer", "click": "observer", "purchase": "verifier", "signup": "federated_importer"}


def _citing(spark, sf) -> DataFrame:
    """Events with the order they cite, as narrow rows: their texts and ids are made of them by :func:`_records`, after the rows have moved."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    order_of = F.col("event_id") - F.col("event_id") % 3
    wanted = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cited = _with_payload(wanted, spark, sf, "o_orderkey")
    return ev.join(cited, order_of == cited["o_orderkey"]).withColumn("day", F.col("ts").cast("date"))


def _records(citing: DataFrame, *more) -> DataFrame:
    """Records of facts from events with their order: purchases cite the verified fact, other events its publisher; ``error`` is no role."""
    purchase = F.col("event_type") == "purchase"
    fact = F.when(purchase, verified_fact()).otherwise(published_by_fact())
    role = F.col("event_type")
    for kind, name in ROLES.items():
        role = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(role)
    flat = _with_evidence(citing, "o_orderkey").select(
        "event_id", "user_id", "day", utc_text("ts").alias("ingested_at"), role.alias("attestor_role"), fact.alias("f"), *more
    ).select("*", "f.*")
    return flat.select(
        "event_id",
        "day",
        identity_id().alias("identity_id"),
        F.concat(F.lit("ingestor:tables@v1:"), _text("user_id")).alias("attestor"),
        "attestor_role",
        "ingested_at",
        F.concat(F.lit("log:"), _text("user_id")).alias("log_id"),
        (F.col("user_id") % 3 == 0).alias("is_local"),
        *more,
    )


def events(spark, sf) -> DataFrame:
    """Events as records of facts, before they are chained."""
    return _records(_citing(spark, sf))


def occurrences(spark, sf) -> DataFrame:
    """Events with a position and ids, each linked to a previous hash made from its position alone.
    They are complete records; for real chains see :func:`chained`. A user's events are a log, and are numbered while they are narrow."""
    citing = _citing(spark, sf).withColumn("second", F.date_trunc("second", "ts"))
    rows = _records(ordering.row_numbers(citing, ["user_id"], ["second", "event_id"], F.col("day")), "seq")
    link = F.sha2(F.concat_ws(":", F.lit("link"), "log_id", (F.col("seq") - 1).cast("string")), 256)
    rows = rows.withColumn("prev_chain_hash", F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(link))
    rows = rows.withColumn("id", occurrence_id())
    return rows.withColumn("chain_hash", chain_hash("prev_chain_hash", "id")).withColumn(
        "signature", F.lit(None).cast("string")
    )


def chained(spark, sf) -> DataFrame:
    """Events appended to one hash chain per log."""
    return append.append_occurrences(events(spark, sf), order=("ingested_at", "event_id"))


def chain(rows: DataFrame) -> DataFrame:
    return rows.select("log_id", "seq", "prev_chain_hash", F.col("id").alias("occurrence_id"), "chain_hash")
