"""Hard negatives against a plain sort of all scores; Strassen's product; odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsieve.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row int, q string"


def plain(rows):
    """Results by the definition, with Python's integers. `rows`: (vec_id, vector, label)."""
    sound = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or not all(x is not None and math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in vector]
        if all(abs(x) <= H.LARGEST for x in q):
            sound.append((key, (label + 1) % 10 if key % 7 == 0 else label, q))
    out = []
    for i, (anchor, label, q) in enumerate(sound):
        if anchor % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, o[2])), o[0], j, o[1]) for j, o in enumerate(sound)
                        if j != i and len(o[2]) == len(q))
        for p, positive, _, _ in [s for s in scored if s[3] == label][:5]:
            window = [s for s in scored if s[3] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(anchor, positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(window)]
    return sorted(out)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in H.embedding_negatives(df).collect())


def vectors(n, dim, seed, low=-0.5):
    return np.random.default_rng(seed).uniform(low, 0.5, (n, dim)).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize("sides", [(100, 64, 130), (33, 65, 70), (1, 5, 3), (7, 0, 2), (257, 129, 90)])
def test_strassen(sides):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 20), 1 << 20, sides[:2]), rng.integers(-(1 << 20), 1 << 20, sides[1:])
    assert (H.strassen(a, b, 4) == a @ b).all()


def test_strassen_wraps_around_without_harm():
    a = np.full((64, 64), 1 << 25, np.int64)
    a[::2] *= -1
    assert (H.strassen(a, np.ascontiguousarray(a.T), 2) == a @ a.T).all()


def test_against_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS", 4)    # many cells, whose heaps merge
    monkeypatch.setattr(H, "ROWS", 64)
    rows = [(i, v, i % 4) for i, v in enumerate(vectors(500, 12, 2, -0.2))]
    got = mined(spark, rows, 5)
    assert got == plain(rows) and len(got) > 50


def test_ties_and_one_label_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 32)
    base = vectors(6, 8, 3, 0.1)
    rows = [(i, base[i % 6], 1 if i % 3 else i % 10) for i in range(300)]
    rows += rows[40:60]                      # repeated rows, an anchor among them
    got = mined(spark, rows)
    assert got == plain(rows) and got


def test_odd_rows(spark):
    good = [(i, v, i % 3) for i, v in enumerate(vectors(120, 4, 4, 0.0))]
    odd = [(None, [0.1] * 4, 1), (200, None, 1), (250, [0.1, None, 0.2, 0.1], 2), (300, [math.nan] * 4, 0),
           (350, [math.inf, 0.0, 0.0, 0.0], 0), (400, [0.2] * 4, None), (450, [3e38, 0.0, 0.0, 0.0], 1), (500, [], 1),
           (501, [], 1), (502, [], 2), (550, [0.3, 0.4], 1), (551, [0.3, 0.4], 1), (552, [0.2, 0.3], 2), (600, [0.0] * 4, 1)]
    got = mined(spark, good + odd)
    assert got == plain(good + odd)
    assert {r[0] for r in got} >= {0, 500, 550} and not {r[0] for r in got} & {200, 250, 300, 350, 400, 450}


def test_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.1], 1)]) == [] and mined(spark, [(50, [0.1], 1)]) == []


def test_other_sizes(spark):
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(60, 4, 5, 0.0))]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)
    got = H.hard_negatives(df, F.col("vec_id") == 0, F.col("label"), positives=2, negatives=1, low=10, high=100)
    assert got.count() == 2 and {r["rank"] for r in got.collect()} == {1}
