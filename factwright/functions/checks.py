"""Validation rules: each gives the first reason a row breaks, or null."""

from pyspark.sql import Column, functions as F

from factwright.constants import LITERAL_PREDICATES, REF_PREDICATES, ROLES, STRUCTURAL_PREDICATES, VERDICTS
from factwright.constants import IRI_PREDICATES
from factwright.functions.envelopes import _col
from factwright.functions.text import is_rfc3339


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def object_violation(o) -> Column:
    o = _col(o)
    kind, iri, literal, datatype, ref = (o[n] for n in ("kind", "iri", "literal", "datatype", "ref"))
    return (
        F.when(kind == "iri",
               F.when(_empty(iri), F.lit("iri object has empty iri"))
               .when(~_empty(literal) | ~_empty(datatype) | ~_empty(ref), F.lit("iri object has stray fields")))
        .when(kind == "literal",
              F.when(_empty(literal), F.lit("literal object has empty literal"))
              .when(_empty(datatype), F.lit("literal object has empty datatype"))
              .when(~_empty(iri) | ~_empty(ref), F.lit("literal object has stray fields")))
        .when(kind == "ref",
              F.when(_empty(ref), F.lit("ref object has empty ref"))
              .when(~_empty(iri) | ~_empty(literal) | ~_empty(datatype), F.lit("ref object has stray fields")))
        .otherwise(F.lit("unknown object kind"))
    )


def identity_violation(prefix: str = "") -> Column:
    def c(n):
        return F.col(prefix + n)

    return F.coalesce(
        F.when(_empty(c("subject")), F.lit("subject is required")),
        F.when(_empty(c("predicate")), F.lit("predicate is required")),
        object_violation(c("object")),
        F.when(_empty(c("evidence_id")), F.lit("evidence_id is required")),
        F.when(~is_rfc3339(c("observed_at")), F.lit("observed_at is not RFC 3339")),
        F.when(_empty(c("normalizer")), F.lit("normalizer is required")),
        F.when(_empty(c("vocab")), F.lit("vocab is required")),
    )


def occurrence_violation(prefix: str = "") -> Column:
    def c(n):
        return F.col(prefix + n)

    return F.coalesce(
        F.when(_empty(c("identity_id")), F.lit("identity_id is required")),
        F.when(F.octet_length(c("identity_id")) != 64, F.lit("identity_id must be 64 characters")),
        F.when(_empty(c("attestor")), F.lit("attestor is required")),
        F.when(~F.coalesce(c("attestor_role").isin(*ROLES), F.lit(False)), F.lit("unknown attestor_role")),
        F.when(~is_rfc3339(c("ingested_at")), F.lit("ingested_at is not RFC 3339")),
        F.when(_empty(c("log_id")), F.lit("log_id is required")),
        F.when(_empty(c("prev_chain_hash")), F.lit("prev_chain_hash is required")),
    )


def checkpoint_violation(prefix: str = "", signed: bool = True) -> Column:
    def c(n):
        return F.col(prefix + n)

    rules = [
        F.when(_empty(c("log_id")), F.lit("log_id is required")),
        F.when(F.coalesce(c("seq"), F.lit(0)) <= 0, F.lit("seq must be above 0")),
        F.when(F.octet_length(F.coalesce(c("chain_hash"), F.lit(""))) != 64,
               F.lit("chain_hash must be 64 characters")),
        F.when(~is_rfc3339(c("signed_at")), F.lit("signed_at is not RFC 3339")),
    ]
    if signed:
        rules.append(F.when(_empty(c("signature")), F.lit("signature is required")))
    return F.coalesce(*rules)


def role_for(cls) -> Column:
    """The role that may record a fact of this class; null for any other class."""
    cls = _col(cls)
    return F.when(cls.isin("observation", "structural"), F.lit("observer")).when(
        cls.isin("verification", "refutation"), F.lit("verifier")
    )


def disallowed_verdict(c) -> Column:
    c = _col(c)
    return F.when(~F.coalesce(c.isin(*VERDICTS), F.lit(False)), F.lit("disallowed verdict"))


def object_kind_violation(predicate, kind) -> Column:
    """A predicate that has no projected table, or an object of the wrong kind for it."""
    predicate, kind = _col(predicate), _col(kind)

    def wrong(want):
        return F.when(~F.coalesce(kind == want, F.lit(False)), F.lit(f"requires {want} object"))

    return (
        F.when(predicate.isin(*IRI_PREDICATES), wrong("iri"))
        .when(predicate.isin(*REF_PREDICATES), wrong("ref"))
        .when(predicate.isin(*LITERAL_PREDICATES), wrong("literal"))
        .when(predicate.isin(*STRUCTURAL_PREDICATES), F.lit(None).cast("string"))
        .otherwise(F.lit("unknown predicate"))
    )


def non_integer_number(raw_json) -> Column:
    """A number in raw envelope text that is no 64-bit integer. Strings are blanked out first, so
    digits inside them do not count."""
    bare = F.regexp_replace(_col(raw_json), r'"(?:[^"\\]|\\.)*"', '""')
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    bad = F.filter(
        F.regexp_extract_all(bare, F.lit(f"({number})"), 1),
        lambda n: ~n.rlike("^-?[0-9]+$") | n.try_cast("bigint").isNull(),
    )
    return F.when(F.size(bad) > 0, F.concat(F.lit("non-integer number "), F.get(bad, F.lit(0))))
