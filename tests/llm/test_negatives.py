"""Hard negatives against a plain search, over odd rows, several groups and scores beyond floats."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factwright.llm import negatives as N
from tests.llm import edge


def plain(rows):
    """All rows of the result for (id, label, whole numbers)."""
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63))
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i is None or i % 100:
            continue
        other = sorted(((-dot(v, w), last(j), j, m) for n, (j, m, w) in enumerate(rows) if n != k), key=lambda r: r[:2])
        for s, _, j, _ in [r for r in other if r[3] == label][:5]:
            band = [r for r in other if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s]
            out += [(i, j, n + 1, r[2], -s, -r[0]) for n, r in enumerate(band[:5])]
    return sorted(out, key=str)


def frame(spark, rows):
    return N.keyed(spark.createDataFrame([(i, lab, [float(x) for x in v]) for i, lab, v in rows], "id long, label long, v array<double>")).repartition(3)


def mined(spark, rows):
    df = frame(spark, rows)
    return sorted((tuple(r) for r in N.mine(df, df.where("id % 100 = 0")).collect()), key=str)


def numbered(vectors):
    fine = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in vectors if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, int(math.fmod(lab + 1, 10)) if i is not None and i % 7 == 0 else lab, v) for i, lab, v in fine]


def test_odd_rows(spark, tmp_path):
    path = edge.write(spark, str(tmp_path / "t"), [], embeddings=edge.VECTORS)
    rows = N.usable(spark.read.parquet(f"{path}/embeddings.parquet")).withColumn("label", N.label_noise(F.col("label"), F.col("id")))
    rows = N.keyed(N.scaled(rows))
    want = numbered(edge.VECTORS)
    assert sorted(map(str, ((r.id, r.label, [int(x) for x in r.v]) for r in rows.collect()))) == sorted(map(str, want))
    got = sorted((tuple(r) for r in N.mine(rows, rows.where("id % 100 = 0")).collect()), key=str)
    assert got == plain(want) and got


def test_groups_and_small_lists_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(4)), [int(x) for x in rng.integers(-90, 91, 6)]) for i in range(0, 3000, 2)]
    rows += [(100 * i, 1, [50] * 6) for i in range(40)] + [(i, 2, [49] * 6) for i in range(50)]
    want = plain(rows)
    assert mined(spark, rows) == want
    monkeypatch.setattr(N, "GROUP", 6 * 20)
    assert mined(spark, rows) == want


def test_lists_end_early_where_clusters_are_tight():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    make = lambda n: np.round(400 * (centres[np.arange(n) % 20] + rng.normal(size=(n, 16)) * 0.02))

    def vectors(m, first):
        n = len(m)
        return N.Vectors(np.arange(first, first + n), np.arange(n) % 20, np.arange(n) + first, np.arange(n + 1) * 16, m.reshape(-1), 16)

    a, x = vectors(make(400), 0), vectors(make(20_000), 10_000)
    kept = N.Kept([[(None, None)]] * 400, 6)
    steps = N.walk(a, N.Clusters(a), x, True, kept)
    assert steps < 0.2 * 400 * 20_000
    score = a.m @ x.m.T
    for i in range(0, 400, 7):
        own = [j for j in range(20_000) if x.label[j] == a.label[i]]
        assert [r[:2] for r in kept.rows[i, 0]] == sorted((-int(score[i, j]), int(x.id[j])) for j in own)[:6]


def test_bounds_hold_for_every_member():
    rng = np.random.default_rng(6)
    m = np.round(rng.normal(size=(600, 12)) * 200)
    v = N.Vectors(np.arange(600), np.zeros(600), np.arange(600), np.arange(601) * 12, m.reshape(-1), 12)
    clusters, unit = N.Clusters(v), N.unit_rows(v)
    for k, members in enumerate(clusters.members):
        bound = clusters.bounds(k, unit) * v.length
        assert (v.m[members] @ v.m.T <= bound[None, :] * v.length[members][:, None] + 1e-6).all()
    assert sum(map(len, clusters.members)) == 600


def test_scores_beyond_floats_are_exact_up_to_the_range_of_a_long(spark):
    big = 2**30
    rows = [(0, 1, [big, 1, 0]), (1, 1, [big, 3, 0]), (2, 2, [big, 2, 0]), (3, 2, [big, 3, 0]), (4, 2, [big, 4, 0]), (100, 1, [big, 0, 2**40]), (5, 1, [0, 0, 2**45]), (6, 3, [1, 2, 2**44])]
    assert mined(spark, rows) == plain(rows)


def test_vectors_of_other_lengths_and_empty_tables(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3]), (2, 2, [2, 1, 9]), (3, 2, []), (4, 1, [])]
    padded = [(i, lab, (v + [0, 0, 0])[:3]) for i, lab, v in rows]
    assert mined(spark, rows) == plain(padded)
    assert mined(spark, [(1, 1, [1])]) == [] and N.mine(frame(spark, rows).where("false"), frame(spark, rows).where("false")).count() == 0


def test_a_group_over_its_bound_is_an_error(spark):
    df = frame(spark, [(100, 1, [1])])
    with pytest.raises(ValueError):
        N._mine_group(df, df.withColumn("copies", F.lit(1)).toArrow(), 0, 5, 5, 80)
