"""Packed token files: exact round trips of ids, against the library's whole-text encoding."""

import random
import struct
import zlib

import numpy as np
import pytest

from factwright.llm import packed, queries
from tests.llm import edge

QUERIES, _ = queries.load()


@pytest.fixture(scope="module")
def model():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def whole(model, text):
    return [*packed._model(model).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 600_000])
@pytest.mark.parametrize("most", [0, 1, 300, 65_535, 2**32 - 1])
def test_blocks_give_their_ids_back(n, most):
    ids = np.random.default_rng(n).integers(0, most, n, np.uint32, endpoint=True)
    ids[::17] //= 3
    f = packed.File(packed.build(1, 2, [5, None], [ids.astype("<u4").tobytes(), b""]) + b"\n")
    assert (f.ids(0, n) == ids).all() and f.no_id.tolist() == [0, 1] and f.length.tolist() == [n, 0]
    for a, b in ((0, min(n, 1)), (n // 3, n // 2), (n, n)):
        assert (f.ids(a, b) == ids[a:b]).all()


def test_outliers_become_exceptions_and_widths_follow_the_rest():
    ids = np.full(1280, 1000, np.uint32)
    ids[::2] += 3
    ids[[5, 700]] = 4_000_000_000
    start, first, least, width, data, places, highs = packed.pack(ids)
    assert set(width.tolist()) == {2} and len(highs) == 2 and len(data) == 10 * 32 and least.tolist() == [1000] * 10
    assert start.tolist() == [32 * i for i in range(10)] and first.tolist() == [0] + [1] * 5 + [2] * 4


def test_a_cut_or_foreign_file_is_an_error():
    raw = packed.build(0, 0, [1], [b"\1\0\0\0"]) + b"\n"
    with pytest.raises((ValueError, struct.error)):
        packed.File(raw[:-2])
    with pytest.raises(ValueError):
        packed.File(b"X" + raw[1:])


def test_words_give_the_ids_of_whole_texts(model):
    rng = random.Random(1)
    assert all(packed.Encoder(model)(w.encode()) == packed._encode(model, w) for w in ("Éa,", "a—,", "«a»", "I\u0307.", "x!?", "(don't)", "a1b", "<|EndOfText|>", "İ;", "ß=", "Ω."))
    alphabet = "ab Z9'’. \n\t\x0b\x1f\x85\xa0é\u0301ſΣς<|endoftext|>中😀s\u2003\x00"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(500)] + ["<|endoftext|> a<|startoftext|>b", " \u0301x", "it's 's 'LL"]
    encode = packed.Encoder(model)
    got = [encode(t.encode()) for t in texts]
    assert [list(struct.unpack(f"<{len(g) // 4}I", g)) for g in got] == [whole(model, t)[:-1] for t in texts]


def test_a_model_that_merges_over_spaces_is_refused(tmp_path):
    from tokenizers import Tokenizer, models

    t = Tokenizer(models.BPE({"a": 0, " ": 1, "b": 2, "a ": 3, "a b": 4}, [("a", " "), ("a ", "b")]))
    t.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        packed.Encoder(str(tmp_path / "t.json"))(b"a b")


def test_files_hold_documents_in_order(spark, tmp_path, model):
    path = edge.write(spark, str(tmp_path / "t"), edge.ODD)
    got = sorted(QUERIES["op11_patched_frames"](spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(edge.ODD) and [r.doc_id for r in got] == sorted((r[0] for r in edge.ODD), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(d), len(ids), crc(ids)) for d, t, *_ in edge.ODD for ids in [whole(model, t)])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_small_files_are_numbered_and_slices_cross_them(spark, tmp_path, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed.write(docs, model, str(tmp_path / "ids"), file_ids=3000)
    rows = {r.doc_id: r for r in packed.read(spark, str(tmp_path / "ids"), with_ids=True).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(list(r.ids) == whole(model, texts[d]) for d, r in rows.items())
    every = [i for d in sorted(rows) for i in rows[d].ids]
    assert packed.files(spark, str(tmp_path / "ids")).count() > 20
    for a, b in ((0, 10), (2_900, 9_100), (len(every) - 5, len(every))):
        got = sorted(map(tuple, packed.slice_ids(spark, str(tmp_path / "ids"), a, b).collect()))
        assert got == list(zip(range(a, b), every[a:b]))
