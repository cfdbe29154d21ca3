"""The pipeline on odd rows, on an empty table, and against plain versions of its stages on a given one."""

import collections
import re

import pytest

import corpus_pipeline
from tests.llm import edge

SMALL = "/root/testdata/sf0.001"


def stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(f(spark, docs, path))
        out.append(docs)
    return out


def test_stages_agree_with_plain_versions(spark):
    first, good, near, clean, mixed, sharded = stages(spark, SMALL)
    assert all(x.columns == first.columns for x in (good, near, clean, mixed))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {i for i, _ in rows}
    fine = [i for i, x in labels.items() if x == (1, 0)]
    assert sum(i in kept for i in fine) >= 0.95 * len(fine)
    assert {r.doc_id for r in near.collect()} == {w[0] for w in edge.near_groups(rows, 5, 80) if w[0] == w[2]}
    letters = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(edge.LOW))
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = letters(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    want = set()
    for r in near.collect():
        w = letters(r.text)
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            want.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == want
    n = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(n) <= want and max(n.values()) <= 3
    assert collections.Counter(r.doc_id for r in sharded.collect()) == n
    by = collections.defaultdict(list)
    for r in sharded.collect():
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharded.columns == [*first.columns, "shard", "slot"]
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, sharded.collect()))


@pytest.mark.parametrize("docs", [edge.ODD, []])
def test_odd_rows_pass_through(spark, tmp_path, docs):
    labels = [(1, 1, 0), (8, 0, 0), (None, None, None)] if docs else []
    path = edge.write(spark, str(tmp_path / "t"), docs, labels, [(1, None), (2, "old stones near")] if docs else [])
    first, *others, last = stages(spark, path)
    assert all(x.columns == first.columns for x in others)
    assert last.columns == [c for c in first.columns if c != "shard"] + ["shard", "slot"]
    assert {r.doc_id for r in last.collect()} <= {r[0] for r in docs}
    if docs:
        assert 1 not in {r.doc_id for r in others[2].collect()}
