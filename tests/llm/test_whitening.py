import math

import numpy as np
import pytest

from dirloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, row int, key int"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 5, 6) for k, v in enumerate(vectors)], SCHEMA)


def plain(vectors, components=16):
    """id -> (deviation, whitened up to sign, explained), by whole numbers and numpy."""
    keep = {k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for k, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = [list(x) for x in {tuple(v) for v in keep.values()}]
    n, dims = len(fit), len(fit[0])
    s = [sum(v[d] for v in fit) for d in range(dims)]
    centred = np.array([[(n * v[d] - s[d]) / n for d in range(dims)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = {}
    for k, v in keep.items():
        row = np.array([(n * v[d] - s[d]) / n for d in range(dims)])
        out[k] = (sum((n * v[d] - s[d]) ** 2 for d in range(dims)), row @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n))
    return n, out


def held(df, dims):
    got = {}
    for r in df.collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert all(sorted(v) == list(range(1, min(16, dims) + 1)) for v in got.values())
    return got


@pytest.mark.parametrize(("dims", "cols", "blocks"), [(24, 1024, 256), (24, 7, 5), (3, 1024, 3)])
def test_equals_plain_computation(spark, monkeypatch, dims, cols, blocks):
    monkeypatch.setattr(whitening, "BLOCK_COLS", cols)
    monkeypatch.setattr(whitening, "BLOCKS", blocks)
    rng = np.random.default_rng(dims)
    vectors = [list(map(float, v)) for v in rng.normal(0, 1, (150, dims)) @ np.diag(np.linspace(3, 0.5, dims))]
    vectors += [vectors[0]] * 90 + [[c + 1e-9 for c in vectors[1]]]  # a hot copy; equal after rounding
    vectors += [None, [None] + vectors[2][1:], [float("nan")] + vectors[2][1:], vectors[2][:-1] + [float("inf")], [], vectors[3][:-1]]
    n, want = plain(vectors[:-2])
    got = held(whitening.whitening_report(spark, table(spark, vectors)), dims)
    assert set(got) == set(want) and n < 152
    sign = None
    for k, (deviation, white, explained) in want.items():
        mine = np.array([got[k][c]["whitened"] for c in sorted(got[k])])
        sign = np.sign(mine * white) if sign is None else sign
        assert np.allclose(mine, sign * white, rtol=1e-8, atol=1e-8)
        for c, r in got[k].items():
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert math.isclose(r["explained"], explained[c - 1], rel_tol=1e-9) and r["identity_error"] < 1e-9


def test_large_offsets_lose_nothing(spark):
    """A spread of a few steps on top of entries a million steps up."""
    rng = np.random.default_rng(2)
    vectors = [[30000 + int(c) / 64 for c in v] for v in rng.integers(-4, 5, (60, 4))]
    n, want = plain(vectors)
    got = held(whitening.whitening_report(spark, table(spark, vectors)), 4)
    white = np.array([[got[k][c]["whitened"] for c in range(1, 5)] for k in sorted(got)])
    true = np.array([want[k][1] for k in sorted(want)])
    assert np.allclose(np.abs(white), np.abs(true), atol=1e-8) and all(got[k][1]["deviation"] == want[k][0] for k in got)


def test_tables_without_variance_or_rows(spark):
    empty = whitening.whitening_report(spark, table(spark, [None, [], [float("nan")]]))
    assert empty.count() == 0 and empty.columns[:2] == ["vec_id", "component"]
    assert whitening.whitening_report(spark, table(spark, []).limit(0)).count() == 0
    one = whitening.whitening_report(spark, table(spark, [[0.5, 1.0], [0.5, 1.0]])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, 0.0, 0.0, 0.0)] * 4
    flat = held(whitening.whitening_report(spark, table(spark, [[1.0, 2.0, k] for k in range(9)])), 3)
    assert all(r[2]["whitened"] == r[3]["whitened"] == 0 and r[1]["identity_error"] < 1e-9 for r in flat.values())


def test_deviation_beyond_a_long(spark):
    vectors = [[k * 2.0**40, 0.0] for k in range(3)]
    _, want = plain(vectors)
    got = held(whitening.whitening_report(spark, table(spark, vectors)), 2)
    assert [got[k][1]["deviation"] for k in range(3)] == [want[k][0] if want[k][0] < 2**63 else None for k in range(3)]
    assert got[0][1]["deviation"] is None and got[1][1]["deviation"] == 0
