"""Links, groups and counts against all pairs; recall at the least similarity; odd rows."""

import math

import numpy as np
import pytest

from jobsieve.llm import embedding_groups as G

SCHEMA = "vec_id long, embedding array<float>, label int, node string, weight int, filters string"


def plain(rows):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs. `rows`: (vec_id, vector, label)."""
    def usable(r):
        return r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    unit = [None] * n
    for i, r in enumerate(rows):
        if usable(r):
            v = np.array(r[1], np.float32).astype(np.float64)
            v /= abs(v).max()
            unit[i] = v / np.linalg.norm(v)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), component, rows[i][0] == component or None in (rows[i][0], component)))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in G.linked_vectors(df).collect()), key=str)


def close(v, cosine, rng):
    v = np.array(v) / np.linalg.norm(v)
    w = rng.normal(size=len(v))
    w -= (w @ v) * v
    return (cosine * v + math.sqrt(1 - cosine ** 2) * w / np.linalg.norm(w)).tolist()


def table(dim, seed, label=3):
    """Strangers, pairs on both sides of the threshold, a chain, a group of near copies, and equal rows."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist(), i % label) for i in range(120)]
    for i, cosine in enumerate((0.90, 0.925, 0.935, 0.94, 0.96, 0.99) * 3):
        rows.append((200 + i, close(rows[i][1], cosine, rng), rows[i][2] if i % 6 else 1))
    chain = rows[30][1]
    for i in range(6):
        chain = close(chain, 0.95, rng)
        rows.append((300 + i, chain, rows[30][2]))
    centre = rng.normal(size=dim)
    rows += [(400 + i, close(centre, 0.975, rng), 1) for i in range(80)]
    rows += [(600 + i, rows[140][1], rows[140][2]) for i in range(40)]
    return rows


@pytest.mark.parametrize("dim", [64, 20])
def test_against_all_pairs(spark, monkeypatch, dim):
    monkeypatch.setattr(G, "BLOCK", 24)     # many blocks
    rows = table(dim, dim)
    found = got(spark, rows)
    assert found == plain(rows)
    assert max(r[1] for r in found) >= 40 and sum(not r[3] for r in found) > 100


@pytest.mark.parametrize("dim", [64, 256])
def test_recall_at_the_least_similarity(dim):
    rng = np.random.default_rng(5)
    size, height = G.tuned(dim, 3000)
    a = rng.normal(size=(1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([close(v, 0.93, rng) for v in a])
    (ra, ka, _), (rb, kb, _) = (G.decoded(x, size, height) for x in (a, b))
    shared = set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))
    assert len({r for r, _ in shared}) >= 0.995 * len(a)


def test_list_decoding_finds_all_directions():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(5, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    row, key, total = G.decoded(v, 9, 0.3)
    found = set(zip(row.tolist(), key.tolist()))
    for number in range(G.ROTATIONS):
        rotation, parts, words = G.code(12, 9, number)
        for i in range(9):
            for j in range(9):
                direction = np.zeros(12)
                direction[parts[0]], direction[parts[1]] = words[0][i], words[1][j]
                assert abs(np.linalg.norm(direction) - 1) < 1e-12
                for r, p in enumerate(v @ rotation @ direction):
                    assert ((r, number * 81 + i * 9 + j) in found) == (p >= 0.3)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (None, [3.0, 0.0], 1),
            (5, None, 1), (6, [0.0, 0.0], 1), (7, [-0.0, 0.0], 1), (8, [math.nan, 1.0], 1), (9, [math.inf, 1.0], 1),
            (10, [None, 1.0], 1), (11, [], 1), (12, [], 1), (13, [1.0, 0.0, 0.0], 1), (14, [1.0, 0.0], 1), (14, [1.0, 0.0], 1),
            (1, [0.0, 1.0], 1), (15, [0.0, 5.0], 1), (16, [3e38, 3e38], 7), (17, [1e-38, 1e-38], 7), (18, [5.0], 1),
            (19, [0.5], 1), (20, [-1.0], 1), (None, [1.0, 1.0], 9), (None, [1.0, 1.0], 9)]
    assert got(spark, rows) == plain(rows)


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 1), (2, [0.0], 1)]) == [(1, 0, 1, True), (2, 0, 2, True)]
