"""Content addresses as Column expressions: canonical JSON text and its sha256.

Everything stays in the JVM. One scan of a row's fields finds out whether any character needs an
escape; the text of all other rows is a plain concatenation.
"""

from pyspark.sql import Column, functions as F

from factwright.constants import GENESIS

# Characters with a short escape; the backslash comes first.
_SHORT = (
    ("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"),
    ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
)
_ANY = r'[\\"\x00-\x1f\x{10000}-\x{10FFFF}]'
_LONG = r"[\x00-\x07\x0b\x0e-\x1f\x{10000}-\x{10FFFF}]"
# While a text is put together, _Q stands for a structural quote. A field's own _M is followed by
# _N, so the two cannot be mixed up, and escaping runs once over the whole text.
_M = "\x1e"
_Q, _N = _M + "\x1d", _M + "\x1c"
HEX64 = "^[0-9a-fA-F]{64}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _long_escape(text: Column) -> Column:
    """Writes control characters and surrogate halves as ``\\uxxxx``. The text is taken apart into
    UTF-16 units in hex, the units to escape are spelled out, and all is put together again; only rows
    that hold such a character get here."""
    units = F.regexp_replace(F.lower(F.hex(F.encode(text, "UTF-16BE"))), "(.{4})", "$1 ")
    digit = "([0-9a-f])"
    wanted = f"(?:(d)([89a-f]){digit}{digit}|(0)(0)([01]){digit}) "
    spelled = F.regexp_replace(units, wanted, "005c0075<$1$5><$2$6><$3$7><$4$8>")
    for d in "0123456789abcdef":
        spelled = F.replace(spelled, F.lit(f"<{d}>"), F.lit("%04x" % ord(d)))
    escaped = F.decode(F.unhex(F.replace(spelled, F.lit(" "), F.lit(""))), "UTF-16BE")
    return F.when(text.rlike(_LONG), escaped).otherwise(text)


def _marked(c) -> Column:
    """A quoted field, still unescaped; see :func:`_escape`."""
    return F.concat(F.lit(_Q), F.replace(c, F.lit(_M), F.lit(_N)), F.lit(_Q))


def _plain(c) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _escape(marked: Column) -> Column:
    """Canonical JSON from a text put together with :func:`_marked`."""
    for ch, esc in _SHORT:
        marked = F.replace(marked, F.lit(ch), F.lit(esc))
    marked = F.replace(marked, F.lit(_Q), F.lit('"'))
    return _long_escape(F.replace(marked, F.lit(_N), F.lit("\\u001e")))


def _json(fields, make) -> Column:
    """``make(s, t)`` puts the text together: ``s`` quotes a field and ``t`` is fixed JSON. ``fields``
    are the values that may hold a character to escape."""
    special = F.concat_ws("", *fields).rlike(_ANY)
    marked = make(_marked, lambda t: F.lit(t.replace('"', _Q)))
    # A lambda is interpreted. That keeps the code of this rare branch out of the generated method,
    # which would otherwise grow too long for the JIT compiler: measured, rows cost half as much.
    escaped = F.get(F.transform(F.array(marked), _escape), F.lit(0))
    return F.when(special, escaped).otherwise(make(_plain, F.lit))


def jcs_string(c) -> Column:
    """The string as canonical JSON, quotes included."""
    c = _col(c)
    return _json([c], lambda s, t: s(c))


def _columns(prefix, names):
    return {n: F.col(prefix + n) for n in names}


def _object(o, s, t) -> Column:
    """The object union; absent members are left out."""
    def member(name, before="", after=""):
        c = o[name]
        return F.when(
            F.coalesce(c, F.lit("")) != "", F.concat(t(f'{before}"{name}":'), s(c), F.lit(after))
        ).otherwise(F.lit(""))

    return F.concat(
        F.lit("{"), member("datatype", after=","), member("iri", after=","), t('"kind":'),
        s(F.coalesce(o["kind"], F.lit(""))), member("literal", before=","), member("ref", before=","), F.lit("}"),
    )


def identity_json(prefix: str = "") -> Column:
    """Canonical text of a fact from the columns of the fact table."""
    c = _columns(prefix, ("evidence_id", "normalizer", "observed_at", "predicate", "revises", "subject", "vocab"))
    o = F.col(prefix + "object")

    def make(s, t):
        return F.concat(
            t('{"evidence_id":'), s(c["evidence_id"]),
            t(',"normalizer":'), s(c["normalizer"]),
            t(',"object":'), _object(o, s, t),
            t(',"observed_at":'), s(c["observed_at"]),
            t(',"predicate":'), s(c["predicate"]),
            t(',"revises":'), F.coalesce(s(c["revises"]), F.lit("null")),
            t(',"subject":'), s(c["subject"]),
            t(',"vocab":'), s(c["vocab"]),
            F.lit("}"),
        )

    members = [o[n] for n in ("kind", "iri", "literal", "datatype", "ref")]
    return _json([*c.values(), *members], make)


def identity_id(prefix: str = "") -> Column:
    return F.sha2(identity_json(prefix), 256)


def id_key(c) -> Column:
    """What to join ids on: the 32 bytes of an id in lower-case hex, half as wide to shuffle; any other text, behind as many spaces as no
    id has bytes, is a key of its own. Null for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^[0-9a-f]{64}\\z"), F.unhex(c)).otherwise(F.concat(F.lit(" " * 33), c).cast("binary"))


def id_text(c) -> Column:
    """The id of which :func:`id_key` made a key."""
    c = _col(c)
    return F.when(F.octet_length(c) == 32, F.lower(F.hex(c))).otherwise(F.substring(c, 34, (1 << 31) - 34).cast("string"))


def occurrence_json_head(prefix: str = "") -> Column:
    """Canonical text of an event up to the previous chain hash, which comes last."""
    c = _columns(prefix, ("attestor", "attestor_role", "identity_id", "ingested_at", "log_id"))

    def make(s, t):
        return F.concat(
            t('{"attestor":'), s(c["attestor"]),
            t(',"attestor_role":'), s(c["attestor_role"]),
            t(',"identity_id":'), s(c["identity_id"]),
            t(',"ingested_at":'), s(c["ingested_at"]),
            t(',"log_id":'), s(c["log_id"]),
            t(',"prev_chain_hash":'),
        )

    return _json(c.values(), make)


def occurrence_json(prefix: str = "") -> Column:
    return F.concat(
        occurrence_json_head(prefix), jcs_string(F.col(prefix + "prev_chain_hash")), F.lit("}")
    )


def occurrence_id(prefix: str = "") -> Column:
    return F.sha2(occurrence_json(prefix), 256)


def occurrence_record_json(prefix: str = "") -> Column:
    """The record of an event as it is kept as evidence: declared field order, and ``< > &`` and the
    two line separators escaped."""
    def s(name):
        t = jcs_like_record(F.coalesce(F.col(prefix + name), F.lit("")))
        return F.concat(F.lit(f'"{name}":'), t)

    names = ("id", "identity_id", "attestor", "attestor_role", "ingested_at",
             "log_id", "prev_chain_hash", "chain_hash", "signature")
    return F.concat(F.lit("{"), F.concat_ws(",", *[s(n) for n in names]), F.lit("}"))


def jcs_like_record(c: Column) -> Column:
    """A JSON string in the record form: characters above U+FFFF stay as they are."""
    out = c
    for raw, esc in _SHORT:
        out = F.replace(out, F.lit(raw), F.lit(esc))
    control = [chr(i) for i in range(0x20) if chr(i) not in "\b\f\n\r\t"]
    rare = out
    for ch in control + ["<", ">", "&", "\u2028", "\u2029"]:
        rare = F.replace(rare, F.lit(ch), F.lit("\\u%04x" % ord(ch)))
    pattern = r"[\x00-\x07\x0b\x0e-\x1f<>&\x{2028}\x{2029}]"
    return F.concat(F.lit('"'), F.when(c.rlike(pattern), rare).otherwise(out), F.lit('"'))


def chain_hash(prev, occurrence) -> Column:
    """sha256 of the two hashes' 64 raw bytes; null when either is not a 32-byte hex hash."""
    prev, occurrence = _col(prev), _col(occurrence)
    return F.when(
        prev.rlike(HEX64) & occurrence.rlike(HEX64),
        F.sha2(F.concat(F.unhex(prev), F.unhex(occurrence)), 256),
    )


def _list(c: Column, s) -> Column:
    """A sorted list of strings; an undefined list stays ``null``."""
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(c), s), ","), F.lit("]"))
    return F.coalesce(body, F.lit("null"))


def _map(c: Column, s, value) -> Column:
    entries = F.transform(
        F.array_sort(F.map_entries(c)),
        lambda e: F.concat(s(e["key"]), F.lit(":"), value(e["value"])),
    )
    return F.coalesce(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")), F.lit("null"))


def _joined(c: Column) -> Column:
    return F.array_join(c, "")


def id_list_json(prefix: str, name: str) -> Column:
    c = F.col(prefix + name)
    return _json([_joined(c)], lambda s, t: _list(c, s))


def claim_json_parts(prefix: str = "") -> tuple[Column, Column, Column]:
    """Canonical text of a claim around its two lists of consumed ids: before the fact ids, between
    the lists, and after the evidence ids."""
    c = _columns(prefix, (
        "evaluator_version", "normalizer_versions", "policy_hash", "policy_id", "policy_version",
        "qualifiers", "query", "subject", "verdict", "vocab_version",
    ))
    d = F.col(prefix + "derivation")
    versions = c["normalizer_versions"]

    def head(s, t):
        return F.concat(
            t('{"derivation":{"input_counts":'), _map(d["input_counts"], s, lambda v: v.cast("string")),
            t(',"missing_predicates":'), _list(d["missing_predicates"], s),
            t(',"rules_fired":'), _list(d["rules_fired"], s),
            t('},"evaluator_version":'), s(c["evaluator_version"]),
            t(',"identity_ids_consumed":'),
        )

    def middle(s, t):
        return F.concat(
            t(',"normalizer_versions":'), _map(versions, s, s),
            t(',"policy_hash":'), s(c["policy_hash"]),
            t(',"policy_id":'), s(c["policy_id"]),
            t(',"policy_version":'), s(c["policy_version"]),
            t(',"qualifiers":'), _list(c["qualifiers"], s),
            t(',"query":'), s(c["query"]),
            t(',"raw_evidence_ids_consumed":'),
        )

    def tail(s, t):
        return F.concat(
            t(',"subject":'), s(c["subject"]),
            t(',"verdict":'), s(c["verdict"]),
            t(',"vocab_version":'), s(c["vocab_version"]),
            F.lit("}"),
        )

    return (
        _json([_joined(F.map_keys(d["input_counts"])), _joined(d["missing_predicates"]),
               _joined(d["rules_fired"]), c["evaluator_version"]], head),
        _json([_joined(F.map_keys(versions)), _joined(F.map_values(versions)), c["policy_hash"], c["policy_id"],
               c["policy_version"], _joined(c["qualifiers"]), c["query"]], middle),
        _json([c["subject"], c["verdict"], c["vocab_version"]], tail),
    )


def claim_id(prefix: str = "") -> Column:
    """Content id of a claim; id, signature, times, projection hashes and the cited events are
    outside it."""
    head, middle, tail = claim_json_parts(prefix)
    ids, evidence = (id_list_json(prefix, n) for n in ("identity_ids_consumed", "raw_evidence_ids_consumed"))
    return F.sha2(F.concat(head, ids, middle, evidence, tail), 256)


def checkpoint_json(prefix: str = "") -> Column:
    c = _columns(prefix, ("chain_hash", "log_id", "signed_at"))

    def make(s, t):
        return F.concat(
            t('{"chain_hash":'), s(c["chain_hash"]),
            t(',"log_id":'), s(c["log_id"]),
            t(',"seq":'), F.col(prefix + "seq").cast("string"),
            t(',"signed_at":'), s(c["signed_at"]),
            F.lit("}"),
        )

    return _json(c.values(), make)


def signed_checkpoint_json(prefix: str = "") -> Column:
    return F.concat(
        F.lit('{"checkpoint":'), checkpoint_json(prefix),
        F.lit(',"signature":'), jcs_string(F.col(prefix + "signature")), F.lit("}"),
    )


def checkpoint_iri(prefix: str = "") -> Column:
    return F.concat(F.lit("checkpoint:"), F.sha2(signed_checkpoint_json(prefix), 256))


def raw_metadata_json(prefix: str = "") -> Column:
    """Canonical text of a sidecar without its signature, which is what the signature covers."""
    names = ("endpoint", "fetched_at", "fetcher", "id", "payload_hash", "payload_path", "source")
    c = {n: F.coalesce(v, F.lit("")) for n, v in _columns(prefix, names).items()}
    params, count = F.col(prefix + "request_params"), F.col(prefix + "result_count").cast("string")

    def make(s, t):
        parts = []
        for n in names[:-1]:
            parts += [t(("{" if n == "endpoint" else ",") + f'"{n}":'), s(c[n])]
        return F.concat(
            *parts,
            t(',"request_params":'), _map(params, s, s),
            t(',"response_status":'), F.col(prefix + "response_status").cast("string"),
            F.coalesce(F.concat(t(',"result_count":'), count), F.lit("")),
            t(',"source":'), s(c["source"]), F.lit("}"),
        )

    return _json([*c.values(), _joined(F.map_keys(params)), _joined(F.map_values(params))], make)


def content_hash(c, bits: int = 256) -> Column:
    return F.sha2(_col(c), bits)


def key_fingerprint(public_key) -> Column:
    return F.substring(F.sha2(_col(public_key), 256), 1, 16)


def default_log_id(fingerprint) -> Column:
    return F.concat(F.lit("log:"), _col(fingerprint))


def attestor(tool, fingerprint) -> Column:
    return F.concat(F.lit("ingestor:"), _col(tool), F.lit(":"), _col(fingerprint))


def principal_iri(issuer, subject) -> Column:
    digest = F.sha2(F.concat(_col(issuer), F.lit("\n"), _col(subject)), 256)
    return F.concat(F.lit("sigstore:fulcio:"), F.substring(digest, 1, 32))


def object_key(o) -> Column:
    o = _col(o)
    return (
        F.when(o["kind"] == "iri", F.concat(F.lit("iri:"), o["iri"]))
        .when(o["kind"] == "literal", F.concat(F.lit("lit:"), o["datatype"], F.lit(":"), o["literal"]))
        .when(o["kind"] == "ref", F.concat(F.lit("ref:"), o["ref"]))
        .otherwise(F.concat(F.lit("unknown:"), F.coalesce(o["kind"], F.lit(""))))
    )


def split_signature(c) -> Column:
    """struct(algorithm, fingerprint, signature); all null when there are not two colons."""
    c = _col(c)
    pattern = r"(?s)^([^:]*):([^:]*):(.*)$"
    ok = F.coalesce(c.rlike(pattern), F.lit(False))

    def part(i):
        return F.when(ok, F.regexp_extract(c, pattern, i))

    return F.struct(
        part(1).alias("algorithm"), part(2).alias("fingerprint"), part(3).alias("signature")
    )


def split_normalizer(c) -> Column:
    """struct(name, version) at the first ``@``; no ``@`` leaves the version empty."""
    c = _col(c)
    return F.struct(
        F.substring_index(c, "@", 1).alias("name"),
        F.regexp_extract(c, r"(?s)^[^@]*@(.*)$", 1).alias("version"),
    )


def parse_policy_spec(c) -> Column:
    c = _col(c)
    return F.struct(
        F.substring_index(c, "@", 1).alias("name"),
        F.regexp_extract(c, r"(?s)^[^@]*@(.*)$", 1).alias("version"),
    )


def parse_vn(c) -> Column:
    """The number of a ``vN`` tag, null for anything else."""
    c = _col(c)
    return F.when(c.rlike(r"^v[0-9]+$"), F.substr(c, F.lit(2)).try_cast("decimal(38,0)"))
