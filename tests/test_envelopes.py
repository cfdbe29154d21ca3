import hashlib
import json

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from factwright import schemas
from factwright.functions import envelopes as E
from tests import fixtures as X


def test_published_fact_ids(spark):
    df = spark.createDataFrame(X.IDENTITIES, schemas.IDENTITY)
    for r in df.select("id", E.identity_id().alias("got")).collect():
        assert r.id == r.got


def test_published_event_ids_and_chain_hashes(spark):
    df = spark.createDataFrame(X.OCCURRENCES, schemas.OCCURRENCE)
    got = df.select(
        "id", E.occurrence_id().alias("got"), "chain_hash",
        E.chain_hash("prev_chain_hash", "id").alias("link"),
    ).collect()
    assert len(got) == 2
    for r in got:
        assert r.id == r.got and r.chain_hash == r.link


def test_chain_hash_needs_hashes(spark):
    df = spark.createDataFrame([("00", "0" * 64), ("0" * 64, "g" * 64)], "a string, b string")
    assert [r[0] for r in df.select(E.chain_hash("a", "b")).collect()] == [None, None]


def test_published_claim_id(spark):
    df = spark.createDataFrame([X.CLAIM], schemas.CLAIM)
    assert df.select(E.claim_id()).first()[0] == X.CLAIM_ID


def test_claim_id_keeps_empty_and_undefined_lists_apart(spark):
    row = list(X.CLAIM)
    a, b = list(row), list(row)
    a[14], b[14] = None, []
    ids = [r[0] for r in spark.createDataFrame([tuple(a), tuple(b)], schemas.CLAIM).select(E.claim_id()).collect()]
    assert ids[0] != ids[1]


def test_published_checkpoint_iri(spark):
    df = spark.createDataFrame([X.CHECKPOINT], X.CHECKPOINT_SCHEMA)
    assert df.select(E.checkpoint_iri()).first()[0] == X.CHECKPOINT_IRI


def canonical(s: str) -> str:
    named = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    out = []
    for ch in s:
        if ch in named:
            out.append(named[ch])
        elif ord(ch) < 0x20:
            out.append("\\u%04x" % ord(ch))
        elif ord(ch) > 0xFFFF:
            u = ch.encode("utf-16-be")
            out.append("\\u%04x\\u%04x" % (u[0] << 8 | u[1], u[2] << 8 | u[3]))
        else:
            out.append(ch)
    return '"' + "".join(out) + '"'


TEXTS = st.lists(
    st.text(alphabet=st.characters(codec="utf-8") | st.sampled_from('\x00\x01\x0b\x1f\\"\b\f\n\r\t<>&é😀\U0010ffff '), max_size=12),
    min_size=1, max_size=30,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_string_escape(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    for r in df.select("i", E.jcs_string("s").alias("j")).collect():
        assert r.j == canonical(texts[r.i])
        assert json.loads(r.j) == texts[r.i]


def test_event_record_escapes_markup(spark):
    row = list(X.OCCURRENCES[0])
    row[2] = "a<b>&\u2028\u2029é😀\x01"
    df = spark.createDataFrame([tuple(row)], schemas.OCCURRENCE)
    got = df.select(E.occurrence_record_json()).first()[0]
    want = json.dumps(dict(zip(schemas.OCCURRENCE.names, row)), separators=(",", ":"), ensure_ascii=False)
    want = want.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    want = want.replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    assert got == want


def test_names_and_splits(spark):
    long = "v" + "1" * 20
    df = spark.createDataFrame([("ed25519:ab:c:d", "n@v@1", "v12"), ("x", "n", "vx"), ("a:b:", "@", long)],
                               "s string, n string, v string")
    got = df.select(E.split_signature("s").alias("s"), E.split_normalizer("n").alias("n"), E.parse_vn("v").alias("v")).collect()
    assert tuple(got[0].s) == ("ed25519", "ab", "c:d")
    assert tuple(got[1].s) == (None, None, None)
    assert tuple(got[2].s) == ("a", "b", "")
    assert [tuple(r.n) for r in got] == [("n", "v@1"), ("n", ""), ("", "")]
    assert [r.v for r in got] == [12, None, int("1" * 20)]
    one = spark.range(1).select(
        E.principal_iri(F.lit("i"), F.lit("s")).alias("p"), E.key_fingerprint(F.lit("k")).alias("k"),
        E.attestor(F.lit("t"), F.lit("f")).alias("a"), E.default_log_id(F.lit("f")).alias("l"),
        E.content_hash(F.lit("x"), 512).alias("h"),
    ).first()
    assert one.p == "sigstore:fulcio:" + hashlib.sha256(b"i\ns").hexdigest()[:32]
    assert one.k == hashlib.sha256(b"k").hexdigest()[:16]
    assert (one.a, one.l) == ("ingestor:t:f", "log:f")
    assert one.h == hashlib.sha512(b"x").hexdigest()
