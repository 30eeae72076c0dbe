"""NN-descent against all pairs: recall, exact counts within components, and rows that compare with nothing."""

from __future__ import annotations

import numpy as np

from rollcall.llm.neighbours import near_duplicates


def _vectors() -> list[tuple[int, list[float] | None, int | None]]:
    rng = np.random.default_rng(9)
    rows: list[tuple[int, list[float] | None, int | None]] = []
    for k in range(400):
        rows.append((k, rng.standard_normal(16).tolist(), k % 3))
    for k in range(400, 520):  # near copies of a few
        base = np.array(rows[k % 7][1])
        rows.append((k, (base + rng.standard_normal(16) * 0.03 * np.linalg.norm(base) / 4).tolist(), (k % 7) % 3))
    rows += [(600, rows[0][1], 0), (601, rows[0][1], 0), (602, rows[0][1], 1), (603, rows[0][1], None)]
    rows += [(610, None, 0), (611, [], 0), (612, [0.0] * 16, 0), (613, [1.0] * 15 + [float("nan")], 0), (614, [float("inf")] + [1.0] * 15, 0)]
    rows += [(615, [1e30 * x for x in rows[1][1]], 1), (616, [1.0, 2.0], 0), (617, [1.0, 2.0], 0)]
    return rows


def test_equals_all_pairs(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(i, np.array(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max(), g) for i, v, g in rows if v and g is not None and np.isfinite(v).all() and any(v)]
    n, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a, g) in enumerate(good):
        for j, b, h in good[:x]:
            if g == h and len(a) == len(b) and float(a @ b) >= 0.98:
                n[i] += 1
                n[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i][0] <= n[i] for i in n)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(n.values()) > 1000
    assert sum(got[i][1] == find(i) for i in n) >= 0.97 * len(n)
    for i in (603, 610, 611, 612, 613, 614):
        assert got[i] == (0, i, True)
    assert got[617] == (1, 616, False)


def test_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert near_duplicates(df.where("false")).collect() == []


def test_dense_groups_find_their_links_with_each_other(spark):
    rng = np.random.default_rng(3)
    u = rng.standard_normal(24)
    u /= np.linalg.norm(u)
    w = rng.standard_normal(24)
    w -= (w @ u) * u
    v = 0.984 * u + np.sqrt(1 - 0.984**2) * w / np.linalg.norm(w)
    rows = []
    for k in range(600):
        x = (u if k < 300 else v) + rng.standard_normal(24) * 0.02 / np.sqrt(24)
        rows.append((k, x.tolist(), 1))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    assert near[:300, 300:].mean() > 0.9
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (int(near[k].sum()) - 1, 0) for k in range(600)}


def test_ties_repeated_rows_and_a_hub_label(spark):
    rows = [(k, [1.0, float(k % 3)], 1) for k in range(60)] + [(6, [1.0, 0.0], 1)] * 5 + [(100, [1.0, 0.0], 2)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 66
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 60 and r.vec_id % 3 == 1} == {(19, 1)}
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 60 and r.vec_id % 3 == 0} == {(24, 0)} and [tuple(r) for r in got if r.vec_id == 100] == [(100, 0, 100, True)]
