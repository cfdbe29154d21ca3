"""Published example records of the formats, with the ids they must get."""

EVIDENCE = "0" * 63 + "1"
SIGNER = "b3a90737fcb17248"

F1 = "f785e5fc8324c68bb186e4f3247279186dc6d882c49385ce3862731b4c29a459"
F2 = "72fbdb786e3b9e7b278482b6c9d18b961e261413e6079c6156c887c3439b92d7"
F3 = "e4e3ab1e254dc70a90ec507c378d81f8ffe171b96a09c417278721ca66fda451"
F4 = "4680a6381067f49ff38aa71cc75deb13a0252ef16079d733787a6790a3ad2c14"
CHECKPOINT_IRI = "checkpoint:eebb5ce423600327d6eab473f57a5f818b7eaf79b1bab3f9fbaba490e24c081c"


def fact(id, subject, predicate, object, evidence=EVIDENCE, normalizer="n@v1", vocab="v5",
         observed_at="2026-01-01T00:00:00Z", revises=None):
    o = {"kind": None, "iri": None, "literal": None, "datatype": None, "ref": None, **object}
    o = (o["kind"], o["iri"], o["literal"], o["datatype"], o["ref"])
    return (id, subject, predicate, o, evidence, observed_at, normalizer, vocab, revises)


IDENTITIES = [
    fact(F1, "pkg:npm/example@1.0.0", "registry_reports_signing_key",
         {"kind": "iri", "iri": "npm:key:fixture-key"}, normalizer="fixture-normalizer@v0.1.0"),
    fact(F2, "pkg:npm/example@1.0.0", "cryptographically_verified_signature_by",
         {"kind": "iri", "iri": "sigstore:fulcio:fixture-identity"}, normalizer="fixture-verifier@v0.1.0"),
    fact(F3, "pkg:npm/example@1.0.0", "peer_reports_cryptographic_verification_of",
         {"kind": "ref", "ref": F2}, normalizer="federation-import@v0.1.0"),
    fact(F4, CHECKPOINT_IRI, "transparency_log_records_checkpoint",
         {"kind": "iri", "iri": "fakelog:fixture:1"},
         evidence="a531599b879f6de0362288f1799867bf6ffd9b5b8c5400c6b4942414334ed765",
         normalizer="transparency-anchor-recorder@v0.1.0", vocab="v6"),
]

OCCURRENCES = [
    ("f7fc12d4f2eb44c71a1f068ddbcb2f5520b4eaadef5cb89c2654abd8f6b35d4b", F1,
     "ingestor:fixture@v0.1.0:" + SIGNER, "observer", "2026-01-01T00:00:00Z", "log:" + SIGNER, "0" * 64,
     "adf74c4a297f4a89977eeeb935d71e6b9c97bf1fc9101643bf43adff049a9f1d",
     "ed25519:" + SIGNER + ":UQG2OGPvgkkkWzFO6SZJkIUkjpeq5ZdqWdOISGHzbOjaa/djGTu6BkEw1GwsHSxREkkNSZ7S6ez95gs8Z3miAQ=="),
    ("3ebfab0f53f88e23833c8d12d2a48e4fc669c2c1aacf6b0a1c709974ce761eba", F3,
     "peer:log:fixture-peer", "federated_importer", "2026-01-02T00:00:00Z", "log:" + SIGNER, "0" * 64,
     "38e26f1b8a1bdae6eae107fc9a87b9d9bf1f938ea7b77691037252daf0c2069c",
     "ed25519:" + SIGNER + ":1cn2EjFSwM/cV1aYjKvP2Y8OPBEkHShs8N+QIDRYziNNinBHwt7O0lCMw9m1LDWJURJbeMnS0ZdDPX1j0RpeCw=="),
]

CLAIM_ID = "f246782d48043aacf9a62da6fa3905806a67f85f9db869535ffac4996baa1f51"
CLAIM = (
    CLAIM_ID, "pkg:npm/example@1.0.0", "fixture-policy", "v1", "1" * 64, "data.fixture.verdict", "trusted",
    ["a_qualifier", "another_qualifier"], "2026-01-01T00:00:01Z", "fixture-evaluator@v0.1.0", "def456", "abc123",
    "v5", {"fixture-normalizer": "v0.1.0"}, [F1],
    ["d645008cafdc2b664d272b4016898ad3c73200d7ad8b16486e77288cbf5cc3ed"],
    (["a_rule"], None, {"registry_reports_signing_key": 1}, None), None,
)

CHECKPOINT = (
    "log:" + SIGNER, 1, "1" * 64, "2026-01-01T00:00:00Z",
    "ed25519:" + SIGNER + ":CqusdGNPB1HIF8WMjet6UABpqoqSf6Yqe2x/Posn3L7YxQ7H7x6+k32q6LBZqM0PS/n1xAlYyW51V0hDz02TCA==",
)
CHECKPOINT_SCHEMA = "log_id string, seq long, chain_hash string, signed_at string, signature string"
