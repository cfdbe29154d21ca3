"""Fixed values of the evidence formats. They decide content ids, so they are stated as they are."""

GENESIS = "0" * 64

ROLES = ("observer", "verifier", "federated_importer")
VERDICTS = ("trusted", "conditional", "rejected", "insufficient_evidence")
OBJECT_KINDS = ("iri", "literal", "ref")

# Predicates by the kind of object their projected table holds.
IRI_PREDICATES = (
    "depends_on",
    "registry_reports_signing_key",
    "cryptographically_verified_signature_by",
    "cryptographic_verification_failed",
    "published_by",
    "affected_by",
    "attests_to",
    "transparency_log_records_checkpoint",
)
REF_PREDICATES = (
    "peer_reports_cryptographic_verification_of",
    "peer_reports_cryptographic_verification_failed_of",
    "peer_reports_transparency_log_records_checkpoint_of",
)
LITERAL_PREDICATES = ("published_at",)
STRUCTURAL_PREDICATES = ("revises", "derived_from")
PROJECTED_PREDICATES = IRI_PREDICATES + REF_PREDICATES + LITERAL_PREDICATES

# predicate: (subject kind, object kind, object datatype, class) of vocabulary v6
VOCABULARY_V6 = {
    "depends_on": ("artifact", "artifact", None, "observation"),
    "registry_reports_signing_key": ("artifact", "identity", None, "observation"),
    "cryptographically_verified_signature_by": ("artifact", "identity", None, "verification"),
    "cryptographic_verification_failed": ("artifact", "identity", None, "refutation"),
    "published_by": ("artifact", "identity", None, "observation"),
    "published_at": ("artifact", "literal", "xsd:dateTime", "observation"),
    "affected_by": ("artifact", "vulnerability_iri", None, "observation"),
    "attests_to": ("attestation", "any", None, "observation"),
    "revises": ("assertion", "assertion", None, "structural"),
    "derived_from": ("assertion", "assertion_or_claim", None, "structural"),
    "peer_reports_cryptographic_verification_of": ("artifact", "ref", None, "observation"),
    "peer_reports_cryptographic_verification_failed_of": ("artifact", "ref", None, "observation"),
    "transparency_log_records_checkpoint": ("checkpoint", "iri", None, "observation"),
    "peer_reports_transparency_log_records_checkpoint_of": ("checkpoint", "ref", None, "observation"),
}

# What a verification-class fact of a peer becomes when it is imported, by its class.
PEER_REPORT_PREDICATE = {
    "verification": "peer_reports_cryptographic_verification_of",
    "refutation": "peer_reports_cryptographic_verification_failed_of",
}

# Failure messages to reason codes: the first row with a substring in the lower-cased message wins.
REASON_RULES = (
    (
        "input_invalid",
        (
            "artifact sha256 must be",
            "sha256 digest must be",
            "sha512 digest must be",
            "digest must be hex",
            "no artifact digests supplied",
            "unsupported digest algorithm",
            "not hex",
            "could not derive an oidc subject regex",
        ),
    ),
    (
        "bundle_parse_failed",
        (
            "bundle parse",
            "failed to unmarshal",
            "unmarshal bundle",
            "invalid bundle",
            "no envelope",
            "missing envelope",
            "missing dsse",
            "missing verification material",
            "missing certificate",
        ),
    ),
    (
        "subject_digest_mismatch",
        (
            "provided artifact digest",
            "artifact digest does not match",
            "artifact digests does not match",
            "any digest in statement",
            "digest mismatch",
            "subject digest",
        ),
    ),
    (
        "oidc_subject_coherence_failed",
        (
            "no matching certificateidentity",
            "matching certificate identity",
            "san",
            "subject alternative name",
            "issuer",
            "oidc",
        ),
    ),
    (
        "transparency_log_proof_invalid",
        ("transparency log", "tlog", "inclusion proof", "inclusion promise", "rekor"),
    ),
    ("signature_invalid", ("signature", "verifying signature")),
    ("certificate_chain_invalid", ("certificate", "x509", "fulcio", "cert chain", "chain")),
)
REASON_UNKNOWN = "unknown"

PROVENANCE_PREDICATE_TYPE = "https://slsa.dev/provenance/v1"

# Who produced a fact. The versions are part of the fact id.
NORMALIZER_NPM = "npm-registry-record@v0.1.0"
NORMALIZER_OSV = "osv-vuln-query@v0.1.0"
NORMALIZER_REKOR = "rekor-search@v0.1.0"
NORMALIZER_GITHUB = "github-repo-meta@v0.1.0"
NORMALIZER_VERIFIER = "sigstore-attestation-verifier@v0.1.0"
NORMALIZER_FEDERATION = "federation-import@v0.1.0"
NORMALIZER_ANCHOR = "transparency-anchor-recorder@v0.1.0"
ACTIVE_VOCAB = "v6"

# First part of the names in the N-Quads export.
NAMESPACE = "factwright"

# Characters percent-escaped in an exported IRI, with what stands for them.
IRI_ESCAPES = (
    (" ", "%20"), ("<", "%3C"), (">", "%3E"), ('"', "%22"), ("{", "%7B"), ("}", "%7D"),
    ("|", "%7C"), ("\\", "%5C"), ("^", "%5E"), ("`", "%60"),
)

# Accepted spellings of a repository address, tried in this order.
REPOSITORY_PREFIXES = (
    "https://github.com/",
    "http://github.com/",
    "git+https://github.com/",
    "git@github.com:",
    "github:",
    "github.com/",
)
# Stripped one after the other from a package's repository field.
REPOSITORY_SCHEMES = ("git+ssh://git@", "git+https://", "git+http://", "git://", "git@")
