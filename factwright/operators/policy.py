"""Policies as rule tables, evaluated over all subjects at once.

A policy names the predicates and sources it may see, flags over them, and ordered lists of
(name, condition) rules on the flags. One pass over the facts gives the flags and row counts of every
subject for every policy; source flags are one row for the whole evidence table.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from factwright.constants import VERDICTS


@dataclass(frozen=True)
class Current:
    """The subject has a fact of this predicate that is not superseded."""
    predicate: str


@dataclass(frozen=True)
class Source:
    """Some evidence came from this source, optionally with a positive result count or an endpoint."""
    source: str
    positive: bool = False
    endpoint: bool = False


@dataclass(frozen=True)
class Policy:
    id: str
    version: str
    vocab_required: str
    required_predicates: tuple
    required_raw_sources: tuple
    neighborhood_depth: int
    flags: dict
    verdicts: tuple
    qualifiers: tuple
    queries: dict = field(default_factory=dict)
    allowed_verdicts: tuple = VERDICTS
    policy_hash: str = ""

    @property
    def key(self):
        return f"{self.id}@{self.version}"

    @property
    def query(self):
        return self.queries.get("verdict", f"data.{self.id}.verdict")


# The rules of the published policies.
_SIGNING_FLAGS = {
    "registry_reports_key": Current("registry_reports_signing_key"),
    "verified_signature_exists": Current("cryptographically_verified_signature_by"),
    "rekor_was_queried": Source("sigstore.rekor"),
    "rekor_returned_hits": Source("sigstore.rekor", positive=True),
    "npm_was_queried": Source("npm.registry"),
}
_SIGNING_QUALIFIERS = (
    ("registry_reports_signing_key", "registry_reports_key"),
    ("no_cryptographic_verification_performed", "registry_reports_key and not verified_signature_exists"),
    ("cryptographically_verified_signature_present", "verified_signature_exists"),
    ("rekor_transparency_log_hit", "rekor_returned_hits"),
    ("rekor_returned_no_entries", "rekor_was_queried and not rekor_returned_hits"),
    ("npm_registry_consulted", "npm_was_queried"),
)

RELEASE_SIGNING_V1 = Policy(
    id="release_signing",
    version="v1",
    vocab_required="v1",
    required_predicates=("registry_reports_signing_key", "published_at", "published_by"),
    required_raw_sources=("npm.registry", "sigstore.rekor"),
    neighborhood_depth=0,
    flags=_SIGNING_FLAGS,
    verdicts=(
        ("trusted", "verified_signature_exists and rekor_returned_hits"),
        ("conditional", "registry_reports_key and rekor_returned_hits"),
        ("conditional", "registry_reports_key and rekor_was_queried and not rekor_returned_hits"),
        ("insufficient_evidence", "not registry_reports_key and not verified_signature_exists"),
    ),
    qualifiers=_SIGNING_QUALIFIERS + (("no_signing_key_reported", "not registry_reports_key"),),
)

RELEASE_SIGNING_V2 = Policy(
    id="release_signing",
    version="v2",
    vocab_required="v2",
    required_predicates=(
        "registry_reports_signing_key",
        "cryptographically_verified_signature_by",
        "published_at",
        "published_by",
    ),
    required_raw_sources=("npm.registry", "sigstore.rekor", "npm.attestations"),
    neighborhood_depth=0,
    flags={**_SIGNING_FLAGS, "attestations_were_fetched": Source("npm.attestations")},
    verdicts=(
        ("trusted", "verified_signature_exists"),
        ("conditional", "registry_reports_key and not verified_signature_exists"),
        ("insufficient_evidence", "not registry_reports_key and not verified_signature_exists"),
    ),
    qualifiers=_SIGNING_QUALIFIERS
    + (
        ("no_signing_key_observed_anywhere", "not registry_reports_key and not verified_signature_exists"),
        ("npm_attestations_consulted", "attestations_were_fetched"),
    ),
)

DEPENDENCY_HYGIENE_V1 = Policy(
    id="dependency_hygiene",
    version="v1",
    vocab_required="v1",
    required_predicates=("depends_on", "affected_by"),
    required_raw_sources=("osv.dev",),
    neighborhood_depth=1,
    flags={
        "osv_was_queried": Source("osv.dev", endpoint=True),
        "subject_directly_vulnerable": Current("affected_by"),
        "direct_deps_present": Current("depends_on"),
    },
    verdicts=(
        ("rejected", "subject_directly_vulnerable"),
        ("trusted", "osv_was_queried and not subject_directly_vulnerable and direct_deps_present"),
        ("conditional", "osv_was_queried and not subject_directly_vulnerable and not direct_deps_present"),
        ("insufficient_evidence", "not osv_was_queried"),
    ),
    qualifiers=(
        ("osv_was_queried", "osv_was_queried"),
        ("subject_directly_vulnerable", "subject_directly_vulnerable"),
        ("no_known_vulnerabilities_for_subject", "osv_was_queried and not subject_directly_vulnerable"),
        ("no_runtime_dependencies", "osv_was_queried and not direct_deps_present"),
        ("direct_dep_surface_observed", "direct_deps_present"),
        ("transitive_resolution_not_implemented", "direct_deps_present"),
    ),
)

BUILT_IN = (RELEASE_SIGNING_V1, RELEASE_SIGNING_V2, DEPENDENCY_HYGIENE_V1)


def visible(policy: Policy, flag) -> bool:
    """A flag over a predicate or source the policy does not require is never true."""
    if isinstance(flag, Current):
        return flag.predicate in policy.required_predicates
    return flag.source in policy.required_raw_sources


def source_flags(raw: DataFrame, policies, by=()) -> DataFrame:
    """One row (per subject with ``by=("subject",)``): per source flag whether it holds, and per source
    how many rows there are."""
    flags = {f for p in policies for f in p.flags.values() if isinstance(f, Source)}
    sources = sorted({s for p in policies for s in p.required_raw_sources})
    aggs = [F.count(F.lit(1)).alias("n_")]
    aggs += [F.count_if(F.col("source") == s).alias(f"n_{s}") for s in sources]
    for f in sorted(flags, key=repr):
        hit = F.col("source") == f.source
        if f.positive:
            hit = hit & (F.coalesce("result_count", F.lit(-1)) > 0)
        if f.endpoint:
            hit = hit & (F.coalesce("endpoint", F.lit("")) != "")
        aggs.append(F.coalesce(F.max(hit), F.lit(False)).alias(_source_name(f)))
    return raw.where(F.col("source").isin(sources)).groupBy(*by).agg(*aggs)


def _source_name(f: Source) -> str:
    return f"s_{f.source}_{int(f.positive)}{int(f.endpoint)}"


def subject_flags(facts: DataFrame, policies) -> DataFrame:
    """Per subject: for every required predicate whether a current fact exists (``c_``) and how many
    rows there are, superseded ones included (``n_``). One aggregate with map-side combine."""
    predicates = sorted({p for policy in policies for p in policy.required_predicates})
    current = F.col("superseded_by").isNull()
    aggs = []
    for p in predicates:
        is_p = F.col("predicate") == p
        aggs += [F.max(is_p & current).alias(f"c_{p}"), F.count_if(is_p).alias(f"n_{p}")]
    return facts.groupBy("subject").agg(*aggs)


def neighbour_counts(facts: DataFrame, per_subject: DataFrame, predicates) -> DataFrame:
    """Per subject the rows its current direct dependencies add, by predicate (``d_``). The counts of
    a dependency are one row, so a dependency many subjects share is joined as one row."""
    names = [f"n_{p}" for p in predicates]
    per_dependency = per_subject.select(F.col("subject").alias("object"), *names)
    sums = [F.sum(n).alias("d" + n[1:]) for n in names]
    return dependency_edges(facts).join(per_dependency, "object").groupBy("subject").agg(*sums)


def dependency_edges(facts: DataFrame) -> DataFrame:
    """Distinct current direct dependencies, the subject itself left out."""
    current = (F.col("predicate") == "depends_on") & F.col("superseded_by").isNull()
    return facts.where(current & (F.col("subject") != F.col("object"))).select("subject", "object").distinct()


def _flag_columns(policy: Policy, raw_row: Column) -> dict[str, Column]:
    out = {}
    for name, f in policy.flags.items():
        if not visible(policy, f):
            out[name] = F.lit(False)
        elif isinstance(f, Current):
            out[name] = F.coalesce(F.col(f"c_{f.predicate}"), F.lit(False))
        else:
            out[name] = F.coalesce(raw_row.getField(_source_name(f)), F.lit(False))
    return out


def _condition(text: str, flags: dict[str, Column]) -> Column:
    """A rule's condition: flag names joined by ``and``, each with an optional ``not``."""
    out = None
    for term in text.split(" and "):
        negated = term.startswith("not ")
        c = flags[term.removeprefix("not ").strip()]
        c = ~c if negated else c
        out = c if out is None else out & c
    return out


def _names(rules, flags) -> Column:
    hits = F.array(*[F.when(_condition(cond, flags), F.lit(name)) for name, cond in sorted(rules)])
    return F.array_compact(hits)


def verdict(policy: Policy, flags: dict[str, Column]) -> Column:
    """struct(verdict, error). All rules that hold must agree; none holding gives
    ``insufficient_evidence``."""
    by_value: dict[str, Column] = {}
    for value, cond in policy.verdicts:
        c = _condition(cond, flags)
        by_value[value] = by_value[value] | c if value in by_value else c
    held = sum((c.cast("int") for c in by_value.values()), F.lit(0))
    value = None
    for v, c in by_value.items():
        value = F.when(c, F.lit(v)) if value is None else value.when(c, F.lit(v))
    value = value.otherwise(F.lit("insufficient_evidence"))
    conflict = held > 1
    return F.struct(
        F.when(~conflict, value).alias("verdict"),
        F.when(conflict, F.lit("conflicting verdicts"))
        .when(~value.isin(*VERDICTS), F.lit("disallowed verdict")).alias("error"),
    )


def _map_column(names, values) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values))


def evaluate(facts: DataFrame, raw: DataFrame, policies=BUILT_IN, subjects: DataFrame | None = None,
             subject_scoped: bool = False) -> DataFrame:
    """One row per (subject, policy): verdict or error, qualifiers, rules fired, missing predicates
    and input counts. ``subjects`` (a ``subject`` column) restricts or extends the subjects; all
    subjects with facts otherwise. Every list is bounded by the policy's own text.

    Evidence counts for every subject, whichever it was fetched for. With ``subject_scoped``, evidence
    counts only for the subject in its ``subject`` column."""
    policies = list(policies)
    base = subject_flags(facts, policies)
    deep = sorted({p for policy in policies if policy.neighborhood_depth >= 1 for p in policy.required_predicates})
    wide = base
    if subjects is not None:
        wide = subjects.select("subject").distinct().join(base, "subject", "left")
    if deep:
        wide = wide.join(neighbour_counts(facts, base, deep), "subject", "left")
    raw_row = source_flags(raw, policies, by=("subject",) if subject_scoped else ())
    raw_struct = F.struct(*[F.col(f"`{c}`") for c in raw_row.columns if c != "subject"])
    if subject_scoped:
        wide = wide.join(raw_row.select("subject", raw_struct.alias("__raw")), "subject", "left")
    else:
        wide = wide.withColumn("__raw", raw_row.select(raw_struct).scalar())

    rows = []
    for p in policies:
        flags = _flag_columns(p, F.col("__raw"))
        v = verdict(p, flags)
        missing = F.array_compact(
            F.array(*[F.when(~F.coalesce(F.col(f"c_{n}"), F.lit(False)), F.lit(n)) for n in sorted(p.required_predicates)])
        )
        zero = F.lit(0).cast("long")
        counts = []
        for n in p.required_predicates:
            c = F.coalesce(F.col(f"n_{n}"), zero)
            if p.neighborhood_depth >= 1:
                c = c + F.coalesce(F.col(f"d_{n}"), zero)
            counts.append(c)
        raw_count = sum((F.coalesce(F.col("__raw").getField(f"n_{s}"), zero) for s in p.required_raw_sources), zero)
        rows.append(
            F.struct(
                F.lit(p.id).alias("policy_id"),
                F.lit(p.version).alias("policy_version"),
                F.lit(p.policy_hash).alias("policy_hash"),
                F.lit(p.query).alias("query"),
                F.lit(p.vocab_required).alias("vocab_version"),
                v["verdict"].alias("verdict"),
                v["error"].alias("error"),
                _names(p.qualifiers, flags).alias("qualifiers"),
                _names([(n, n) for n in p.flags], flags).alias("rules_fired"),
                F.when(F.size(missing) > 0, missing).alias("missing_predicates"),
                _map_column(list(p.required_predicates) + ["raw_evidence"], counts + [raw_count]).alias("input_counts"),
            )
        )
    return wide.select("subject", F.inline(F.array(*rows)))


def policy_diff(verdicts: DataFrame, keys) -> DataFrame:
    """One row per subject with the verdict of each policy ``id@version`` in ``keys``, where they
    differ."""
    policy = F.concat_ws("@", "policy_id", "policy_version")
    wide = verdicts.withColumn("policy", policy).groupBy("subject").pivot("policy", list(keys)).agg(F.first("verdict"))
    distinct = F.array_distinct(F.array(*[F.col(f"`{k}`") for k in keys]))
    return wide.where(F.size(distinct) > 1)
