"""Explicit schemas. Nothing is inferred from data: a missing optional field reads as null."""

from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names):
    return [T.StructField(n, _S) for n in names]


OBJECT = T.StructType(_strings("kind", "iri", "literal", "datatype", "ref"))

IDENTITY = T.StructType(
    _strings("id", "subject", "predicate")
    + [T.StructField("object", OBJECT)]
    + _strings("evidence_id", "observed_at", "normalizer", "vocab", "revises")
)

OCCURRENCE = T.StructType(
    _strings(
        "id", "identity_id", "attestor", "attestor_role", "ingested_at",
        "log_id", "prev_chain_hash", "chain_hash", "signature",
    )
)

CHAIN = T.StructType(
    [T.StructField("log_id", _S), T.StructField("seq", T.LongType())]
    + _strings("prev_chain_hash", "occurrence_id", "chain_hash")
)

RAW_METADATA = T.StructType(
    _strings("id", "source", "endpoint")
    + [T.StructField("request_params", T.MapType(_S, _S))]
    + _strings("fetched_at", "fetcher")
    + [T.StructField("response_status", T.IntegerType())]
    + _strings("payload_path", "payload_hash")
    + [T.StructField("result_count", T.LongType()), T.StructField("signature", _S)]
)

DERIVATION = T.StructType(
    [
        T.StructField("rules_fired", T.ArrayType(_S)),
        T.StructField("missing_predicates", T.ArrayType(_S)),
        T.StructField("input_counts", T.MapType(_S, T.LongType())),
        T.StructField("occurrences_cited", T.MapType(_S, T.ArrayType(_S))),
    ]
)

CLAIM = T.StructType(
    _strings("id", "subject", "policy_id", "policy_version", "policy_hash", "query", "verdict")
    + [T.StructField("qualifiers", T.ArrayType(_S))]
    + _strings(
        "evaluated_at", "evaluator_version", "identities_hash",
        "projection_manifest_hash", "vocab_version",
    )
    + [
        T.StructField("normalizer_versions", T.MapType(_S, _S)),
        T.StructField("identity_ids_consumed", T.ArrayType(_S)),
        T.StructField("raw_evidence_ids_consumed", T.ArrayType(_S)),
        T.StructField("derivation", DERIVATION),
        T.StructField("signature", _S),
    ]
)

VOCABULARY_FILE = T.StructType(
    _strings("version", "supersedes")
    + [
        T.StructField(
            "predicates",
            T.MapType(
                _S,
                T.StructType(
                    _strings(
                        "subject_kind", "object_kind", "object_datatype",
                        "verification_class", "description",
                    )
                ),
            ),
        )
    ]
)

POLICY_MANIFEST = T.StructType(
    _strings("id", "version", "vocab_required")
    + [
        T.StructField("required_predicates", T.ArrayType(_S)),
        T.StructField("required_raw_sources", T.ArrayType(_S)),
        T.StructField("neighborhood_depth", T.IntegerType()),
        T.StructField("allowed_verdicts", T.ArrayType(_S)),
        T.StructField("queries", T.MapType(_S, _S)),
    ]
)

CHECKPOINT = T.StructType(
    [
        T.StructField("log_id", _S),
        T.StructField("seq", T.LongType()),
        T.StructField("chain_hash", _S),
        T.StructField("signed_at", _S),
    ]
)
SIGNED_CHECKPOINT = T.StructType(
    [T.StructField("checkpoint", CHECKPOINT), T.StructField("signature", _S)]
)

FAILURE_RECORD = T.StructType(
    _strings(
        "reason_code", "reason", "oidc_subject", "oidc_issuer", "cert_fingerprint",
        "bundle_evidence_id", "expected_repository", "verifier",
    )
)

VERIFICATION_RESULT = T.StructType(
    _strings("subject", "package", "version", "endpoint", "bundle", "fetched_at", "expected_repository")
    + [T.StructField("verified", T.BooleanType())]
    + _strings("reason", "oidc_issuer", "oidc_subject", "cert_fingerprint")
)

VIOLATION = T.StructType(
    [T.StructField("check_no", T.IntegerType())] + _strings("check", "log_id", "key", "reason")
)

# Landed service responses.
NPM_VERSION = T.StructType(
    _strings("name", "version", "time")
    + [
        T.StructField("_npmUser", T.StructType(_strings("name"))),
        T.StructField(
            "dist",
            T.StructType(
                [T.StructField("signatures", T.ArrayType(T.StructType(_strings("keyid", "sig"))))]
                + _strings("integrity", "shasum", "tarball")
            ),
        ),
        T.StructField("dependencies", T.MapType(_S, _S)),
    ]
)
NPM_PACKAGE = T.StructType(
    [
        T.StructField("versions", T.MapType(_S, NPM_VERSION)),
        T.StructField("time", T.MapType(_S, _S)),
    ]
)
OSV_RESPONSE = T.StructType(
    [T.StructField("vulns", T.ArrayType(T.StructType(_strings("id", "modified"))))]
)
ATTESTATIONS = T.StructType(
    [T.StructField("attestations", T.ArrayType(T.StructType(_strings("predicateType", "bundle"))))]
)
REPOSITORY_FILE = T.StructType(_strings("encoding", "content"))
PACKAGE_JSON = T.StructType(_strings("name", "version") + [T.StructField("private", T.BooleanType())])
BUNDLE = T.StructType(
    [
        T.StructField("dsseEnvelope", T.StructType(_strings("payload"))),
        T.StructField(
            "verificationMaterial",
            T.StructType(
                [
                    T.StructField(
                        "tlogEntries", T.ArrayType(T.StructType(_strings("integratedTime")))
                    )
                ]
            ),
        ),
    ]
)
STATEMENT = T.StructType(
    [
        T.StructField(
            "subject",
            T.ArrayType(
                T.StructType(
                    [T.StructField("name", _S), T.StructField("digest", T.MapType(_S, _S))]
                )
            ),
        )
    ]
)
