"""Whitening and vector codes against plain numpy, and their odd rows."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from callscope.llm import exact, vectorcodes, whiten
from callscope.llm.queries import QUERIES

EMBEDDINGS = "vec_id long, embedding array<float>, label int, n long, code string, error long"


def given(spark, sf):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]


def brute_covariance(x):
    """Exact covariances of whole numbers as fractions."""
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    return [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(d)] for i in range(d)], centred


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """vec_id -> (code, error), and the digest of the codebooks."""
    cut = {i: [[math.floor(4096 * float(x)) for x in v[p * (len(v) // parts) : (p + 1) * (len(v) // parts)]] for p in range(parts)] for i, v in rows}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for i in cut:
                mine.setdefault(nearest(cut[i][p], books[p])[1], []).append(cut[i][p])
            books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e])] if e in mine else entry for e, entry in enumerate(books[p])]
    out = {}
    for i, v in cut.items():
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out[i] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_whitening_matches_numpy(spark, sf):
    rows = given(spark, sf)
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v, _ in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    want = centred @ vectors[:, order] / np.sqrt(values[order])
    place = {i: k for k, (i, _, _) in enumerate(rows)}
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    got = QUERIES["op11_embedding_whitening"](spark, sf).collect()
    assert len(got) == 8 * n
    signs = {}
    for r in got:
        k, c = place[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[k])
        assert abs(abs(r["whitened"]) - abs(want[k, c])) < 1e-9
        if abs(want[k, c]) > 1e-6:
            signs.setdefault(c, set()).add(r["whitened"] * want[k, c] > 0)
        assert abs(r["explained"] - values[order[c]] / values.sum()) < 1e-9
        assert 0 <= r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_covariances_from_variances_are_exact(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(40, 5)) * [1, 1e3, 1e-3, 10, 1e8]
    frame = spark.createDataFrame([(v.tolist(),) for v in values], "vector array<double>").repartition(3)
    model = whiten.fit(frame, 5, 5)
    exact_cov, centred = brute_covariance([[math.floor(1024 * Fraction(c)) + whiten.SHIFT for c in v] for v in values.tolist()])
    assert model.trace == pytest.approx(float(sum(exact_cov[i][i] for i in range(5))), rel=1e-15)
    found = (model.vectors * model.values) @ model.vectors.T
    assert np.allclose(found, np.array([[float(c) for c in r] for r in exact_cov]), rtol=1e-9, atol=1e-13 * model.values[0])
    rows = whiten.whiten(frame.selectExpr("monotonically_increasing_id() as vec_id", "vector as embedding")).where("component = 1").collect()
    assert sorted(int(r["deviation"]) for r in rows) == sorted(sum(c * c for c in r) for r in centred)


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (2, None, 1), (3, [1.0, None, 1.0], 1), (4, [nan, 0.0, 1.0], 1), (5, [inf, 0.0, 1.0], 1),
        (6, [], 1), (7, [1.0], None), (8, [0.0, 0.0, 0.0], None), (None, [2.0, -1.0, 0.5], 2), (9, [-3.0, 1.0, 4.0], None), (10, [0.5, 0.25, 9.0], 2),
    ]
    return spark.createDataFrame([(*r, 0, "x", 0) for r in rows], EMBEDDINGS)


def test_whitening_of_odd_rows(spark):
    rows = whiten.whiten(odd_vectors(spark)).collect()
    assert {r["n"] for r in rows} == {6} and {r["component"] for r in rows} == {1, 2, 3}
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in rows if r["component"] == 1) == [(False, 1), (False, 1), (False, 8), (False, 9), (False, 10), (True, 0)]
    assert max(r["identity_error"] for r in rows) < 1e-9
    assert whiten.whiten(odd_vectors(spark).where("vec_id = 1")).count() == 0
    assert whiten.whiten(odd_vectors(spark).where("vec_id = 6")).count() == 0
    assert whiten.whiten(spark.createDataFrame([], EMBEDDINGS)).count() == 0


def test_codes_match_brute_force(spark, sf):
    rows = given(spark, sf)
    want, digest = brute_codes([(i, v) for i, v, _ in rows])
    got = QUERIES["op12_vector_codes"](spark, sf).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and len(got) == len(rows)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    label = {i: x for i, _, x in rows}
    sums = {}
    for i, (_, error) in want.items():
        sums[label[i]] = sums.get(label[i], 0) + error
    assert all(r["label_error"] == sums[label[r["vec_id"]]] for r in got)


@pytest.mark.parametrize(("entries", "kind", "spread"), [(16, np.int64, 50), (150, np.int64, 3), (40, object, 10**12)])
def test_box_holds_the_nearest_entry(entries, kind, spread):
    """Ties, more entries than a mask word has bits, and numbers beyond 64 bits."""
    rng = np.random.default_rng(entries)
    book = rng.integers(-spread, spread, (entries, 4)).astype(kind)
    parts = rng.integers(-2 * spread, 2 * spread, (300, 4)).astype(kind)
    number, square = vectorcodes.Codebook(book).nearest(parts)
    for part, n, s in zip(parts.tolist(), number, square, strict=True):
        assert min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book.tolist())) == (s, n)


def test_codes_of_odd_rows(spark):
    rows = vectorcodes.compress(odd_vectors(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append(r)
    assert sorted(by, key=lambda x: (x is None, x)) == [1, 8, 9, 10, None] and len(by[1]) == 2
    assert len({r["code"] for r in by[1]}) == 1 and all(len(r["code"]) == 16 for r in rows)
    assert by[8][0]["label_error"] == by[8][0]["error"] + by[9][0]["error"]
    assert vectorcodes.compress(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert vectorcodes.compress(odd_vectors(spark).where("vec_id is null")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [1e12 * (i % 3), 2.0**40 * i, -0.5, 7.0], 0) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, digest = brute_codes([(i, v) for i, v, _ in rows], parts=2, entries=4, rounds=2)
    got = vectorcodes.compress(frame, parts=2, entries=4, rounds=2).collect()
    assert {r["vec_id"]: (r["code"], int(r["error"])) for r in got} == want and {r["codebooks_sha256"] for r in got} == {digest}
    assert exact.floors(np.array([[0.5, -(2.0**70)]]), 1024).tolist() == [[512, -(2**80)]]
