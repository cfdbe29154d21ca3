"""What a policy sees of a subject, in long form: one row per fact or evidence id.

Long rows stay complete for a subject that holds a third of all facts. The list form for documents is
built from them in :mod:`factwright.operators.claims`.
"""

from pyspark.sql import DataFrame, functions as F

from factwright.functions.envelopes import id_key, id_text, split_normalizer
from factwright.operators.policy import dependency_edges
from factwright.operators.skew import spread_join
from factwright.session import cut


def neighbourhood(facts: DataFrame, subjects: DataFrame, depth: int = 1) -> DataFrame:
    """(subject, member, hops): the subject itself and, for depth >= 1, its current dependencies.
    Evaluation uses one hop; a larger ``depth`` follows further hops, each member with its fewest. Every hop is written
    to the shared folder, so that the plan does not grow with their number."""
    start = subjects.select("subject").distinct()
    found = start.select("subject", F.col("subject").alias("member"), F.lit(0).alias("hops"))
    if depth < 1:
        return found
    direct = dependency_edges(facts)
    # the first hop stays where the facts lie: edges are distinct and none leads back to its subject
    frontier = start.join(direct, "subject").select("subject", F.col("object").alias("member"), F.lit(1).alias("hops"))
    if depth > 1:
        frontier = cut(frontier)
    found = found.unionByName(frontier)
    edges = direct.select(F.col("subject").alias("member"), F.col("object").alias("next"))
    for hop in range(2, depth + 1):
        if frontier.isEmpty():
            break
        # a popular dependency is the member of many subjects
        reached = spread_join(frontier, edges, "member").select("subject", F.col("next").alias("member")).distinct()
        frontier = cut(reached.join(found, ["subject", "member"], "left_anti").withColumn("hops", F.lit(hop)))
        found = found.unionByName(frontier)
    return found


def snapshot_predicate(facts: DataFrame, predicate: str, members: DataFrame) -> DataFrame:
    """Rows of a predicate whose subject is a member, superseded ones included."""
    rows = facts.where(F.col("predicate") == predicate).withColumnRenamed("subject", "member")
    return rows.join(members.select("subject", "member"), "member")


def snapshot_raw(raw: DataFrame, sources) -> DataFrame:
    """All evidence of the sources. It is not tied to a subject."""
    return raw.where(F.col("source").isin(*sources))


def current(facts: DataFrame, predicate: str | None = None) -> DataFrame:
    rows = facts.where(F.col("superseded_by").isNull())
    return rows if predicate is None else rows.where(F.col("predicate") == predicate)


def _policy_names(policies, depth_from: int) -> list:
    rows = []
    for p in policies:
        if p.neighborhood_depth >= depth_from:
            rows += [(p.id, p.version, n, i) for i, n in enumerate(p.required_predicates)]
    return rows


def consumed_facts(facts: DataFrame, policies, subjects: DataFrame | None = None, edges: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(subject, policy_id, policy_version, position, identity_id, evidence_id, normalizer): the facts
    each policy sees of each subject, its neighbourhood's included. Distinct by construction.

    ``edges``: the subjects' dependencies as :func:`dependency_edges` gives them, where they are at hand. ``parts``: facts lie by subject in
    so many parts; those of a neighbourhood are then dealt alike, and what is grouped by subject moves no facts of its own."""
    spark = facts.sparkSession
    schema = "policy_id string, policy_version string, predicate string, position int"
    cols = ["subject", "policy_id", "policy_version", "position", "identity_id", "evidence_id", "normalizer"]
    own = facts
    if subjects is not None:
        own = facts.join(subjects.select("subject").distinct(), "subject", "left_semi")
    out = own.join(F.broadcast(spark.createDataFrame(_policy_names(policies, 0), schema)), "predicate").select(*cols)
    deep = _policy_names(policies, 1)
    if deep:
        edges = (dependency_edges(own) if edges is None else edges).select(F.col("subject").alias("root"), F.col("object").alias("subject"))
        # of all facts only those of some dependency move, their ids as bytes
        named = facts.join(edges.select("subject").distinct(), "subject", "left_semi")
        named = named.join(F.broadcast(spark.createDataFrame(deep, schema)), "predicate").select(*cols)
        named = named.withColumns({c: id_key(c) for c in ("identity_id", "evidence_id")})
        near = spread_join(edges, named, "subject").drop("subject").withColumnRenamed("root", "subject").select(*cols)
        near = near.repartition(parts, "subject") if parts else near
        out = out.unionByName(near.withColumns({c: id_text(c) for c in ("identity_id", "evidence_id")}))
    return out


def policy_raw_evidence(raw: DataFrame, policies) -> DataFrame:
    """(policy_id, policy_version, evidence_id): the evidence every evaluation of a policy consumes.
    It is the same for all subjects and so is kept once per policy."""
    return _wanted_evidence(raw, policies).select("policy_id", "policy_version", F.col("id").alias("evidence_id")).distinct()


def subject_raw_evidence(raw: DataFrame, policies) -> DataFrame:
    """(subject, policy_id, policy_version, evidence_id): the same for evidence that names its subject."""
    keys = ["subject", "policy_id", "policy_version"]
    return _wanted_evidence(raw, policies).select(*keys, F.col("id").alias("evidence_id")).distinct()


def _wanted_evidence(raw: DataFrame, policies) -> DataFrame:
    rows = [(p.id, p.version, s) for p in policies for s in p.required_raw_sources]
    wanted = raw.sparkSession.createDataFrame(rows, "policy_id string, policy_version string, source string")
    return raw.join(wanted, "source")


def consumed_evidence(consumed: DataFrame) -> DataFrame:
    """Distinct evidence ids of the consumed facts, per subject and policy."""
    rows = consumed.where(F.coalesce("evidence_id", F.lit("")) != "")
    return rows.select("subject", "policy_id", "policy_version", "evidence_id").distinct()


def normalizer_versions(consumed: DataFrame, keys=("subject", "policy_id", "policy_version")) -> DataFrame:
    """(subject, policy, name, version), or so by other ``keys`` of a claim: the version of the last row in (predicate position, fact id)
    order."""
    named = consumed.withColumn("n", split_normalizer("normalizer")).where(F.col("n.name") != "")
    return named.groupBy(*keys, F.col("n.name").alias("name")).agg(
        F.max_by("n.version", F.struct("position", "identity_id")).alias("version")
    )


def occurrences_by_identity(occurrences: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """(identity_id, ingested_at, occurrence_id), the order being (ingested_at, occurrence_id)."""
    rows = occurrences if identities is None else occurrences.join(identities.select("identity_id"), "identity_id", "left_semi")
    return rows.select("identity_id", "ingested_at", F.col("id").alias("occurrence_id")).distinct()


def policy_input(facts: DataFrame, raw: DataFrame, policy, subjects: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(subject, section, key, row): the rows of a policy's input document, as JSON text per row.
    Sections are the required predicates; ``raw_evidence`` rows carry no subject, as all share them. ``relations``: the facts without
    their ids, from which neighbourhoods are found, where they are at hand."""
    member = neighbourhood(facts if relations is None else relations, subjects, min(policy.neighborhood_depth, 1))
    rows = facts.where(F.col("predicate").isin(*policy.required_predicates)).withColumnRenamed("subject", "member")
    rows = rows.join(member.select("subject", "member"), "member")
    is_date = F.col("predicate") == "published_at"
    doc = F.to_json(F.struct(
        "identity_id", F.col("member").alias("subject"), F.when(~is_date, F.col("object")).alias("object"),
        F.when(is_date, F.col("object")).alias("object_literal"),
        F.when(is_date, F.col("object_datatype")).alias("object_datatype"),
        "observed_at", "evidence_id", "normalizer", "superseded_by",
    ))
    a = rows.select("subject", F.col("predicate").alias("section"), F.col("identity_id").alias("key"), doc.alias("row"))
    r = snapshot_raw(raw, policy.required_raw_sources)
    b = r.select(
        F.lit(None).cast("string").alias("subject"), F.lit("raw_evidence").alias("section"), F.col("id").alias("key"),
        F.to_json(F.struct(*r.columns)).alias("row"),
    )
    return a.unionByName(b)
