"""Embedding near-duplicates and components against brute force."""

import math

import numpy as np
import pytest

from splitclock.llm import embed
from splitclock.llm.common import local_components, table
from splitclock.llm.components import components


def near_plainly(rows, least=0.98):
    """(vec_id, n_links, component) of rows (vec_id, vector, label)."""
    usable = [v is not None and label is not None and i is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, label in rows]
    units = [embed.unit(np.array([v], np.float64))[0] if ok else None for (_, v, _), ok in zip(rows, usable, strict=True)]
    a, b = [], []
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                a.append(i)
                b.append(j)
    order = np.argsort([-1 if r[0] is None else r[0] for r in rows], kind="stable")
    place = np.argsort(order)
    root = order[local_components(len(rows), place[np.array(a, int)], place[np.array(b, int)])][place]
    return sorted((str(r[0]), a.count(k), str(rows[root[k]][0])) for k, r in enumerate(rows))


@pytest.mark.parametrize("block", [4096, 7])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 24))
    rows = []
    for k in range(260):
        c = centres[k % 12]
        noise = rng.normal(size=24) * rng.choice([0.0, 0.05, 0.1, 0.14, 0.2])
        rows.append((k, [float(np.float32(x)) for x in c + noise], k % 2))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 24, 0), (304, [float("nan")] * 24, 0), (305, rows[0][1][:23], 0), (306, [], 0), (307, [None, 1.0], 0), (308, [float("inf"), 1.0], 0), (None, rows[0][1], 0), (309, [1e-30] * 24, 5), (310, [1e30] * 24, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'own' as rep", "1 as n", "2 as bucket", "3 as links")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embed.near_vectors(df, block=block).collect())
    want = near_plainly([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    missed = sum(w[1] for w in want) - sum(g[1] for g in got)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and missed <= 0.01 * sum(w[1] for w in want)
    assert [g for g in got if g[0] in ("301", "302", "303", "304", "305", "306", "307", "308")] == [w for w in want if w[0] in ("301", "302", "303", "304", "305", "306", "307", "308")]
    assert [g for g in got if g[0] in ("309", "310")] == [("309", 1, "309"), ("310", 1, "309")]
    assert embed.near_vectors(df.limit(0)).count() == 0


def test_recall_on_the_tables(spark):
    """Pairs just above the threshold, from the real vectors: at least 0.99 are found."""
    base = np.stack([np.array(r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").limit(600).collect()])
    x = embed.unit(base)
    rng = np.random.default_rng(2)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = 0.981 * x + math.sqrt(1 - 0.981**2) * embed.unit(noise)
    cx, cy = embed.bucket_codes(x), embed.bucket_codes(embed.unit(y))
    shared = [bool(set(a) & set(b)) for a, b in zip(cx.tolist(), cy.tolist(), strict=True)]
    assert np.mean(shared) >= 0.99


def test_hadamard_is_orthogonal():
    h = embed.hadamard(np.eye(16))
    assert (h @ h.T == 16 * np.eye(16)).all()


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 5000 + k) for k in range(1, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*links, (None, 1), (7, None), (9, 9)], "a long, b long")).collect()}
    a, b = np.array(links).T
    root = local_components(6000, a, b)
    assert got == {i: int(root[i]) for x in links if x[0] != x[1] for i in x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
