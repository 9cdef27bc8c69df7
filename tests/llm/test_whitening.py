"""Whitened embeddings against numpy over the distinct vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from repoloom.llm.common import table
from repoloom.llm.whitening import whitened

SF = "/root/testdata/sf0.01"


def check(df, got, weights="one"):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    fine = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(k, tuple(math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v)) for k, v in fine]
    fit = sorted({x for _, x in xs}) if weights == "one" else [x for _, x in xs]
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dims)]
    exact = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], np.float64) / n
    cov = exact.T @ exact / n
    values = np.linalg.eigvalsh(cov)[::-1]
    by: dict = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-6
    assert sorted(by) == list(range(1, min(16, dims) + 1))
    deviation = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in xs}
    for component, held in by.items():
        e = values[component - 1]
        assert sorted((repr(r.vec_id), r.deviation) for r in held) == sorted((repr(k), deviation[x]) for k, x in xs)
        assert held[0].explained == pytest.approx(e / np.trace(cov), rel=1e-6, abs=1e-12)
    # the axis behind a component comes back from its values over the fit list
    first = {}
    for r in got:
        first.setdefault(r.vec_id, {})[r.component] = r.whitened
    if weights == "one" and len(first) == len(xs):
        live = [c for c in by if by[c][0].whitened is not None]
        y = np.array([[first[k][c] for c in live] for k, _ in xs])
        mean = np.array(sums) / n
        x = np.array([v for _, v in xs], np.float64) - mean
        for at, c in enumerate(live):
            axis = np.linalg.lstsq(x, y[:, at] * math.sqrt(values[c - 1]), rcond=None)[0]
            assert np.linalg.norm(cov @ axis - values[c - 1] * axis) < 1e-6 * values[0] and abs(np.linalg.norm(axis) - 1) < 1e-6


def test_given_embeddings(spark):
    df = table(spark, SF, "embeddings")
    check(df, whitened(df).collect())


def test_odd_rows_and_weights(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(40)] + [(100 + i, [0.5, 0.25, -1.0, 2.0, 0.0]) for i in range(30)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [math.inf] * 5), (204, []), (None, [0.1] * 5), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, x long, id string, w double")
    for weights in ("one", "counts"):
        check(df, whitened(df, weights=weights).collect(), weights)
    ragged = df.union(spark.createDataFrame([(999, [1.0, 2.0], 1, "x", 2.0)], df.schema))
    assert whitened(ragged).where("vec_id = 999").count() == 0


def test_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitened(spark.createDataFrame([(1, None)], kind)).count() == 0
    one = whitened(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], kind)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 1 for r in one)
    line = whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], kind)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    assert all(r.identity_error < 1e-9 for r in line)


def test_large_entries(spark):
    rows = [(0, [1e30, -1e30]), (1, [3.0, 1e12]), (2, [0.0, 0.0])]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got)


def test_string_ids(spark):
    got = whitened(spark.createDataFrame([("a", [0.0]), ("b", [1.0])], "vec_id string, embedding array<double>")).collect()
    assert sorted((r.vec_id, abs(r.whitened)) for r in got) == [("a", 1.0), ("b", 1.0)]
