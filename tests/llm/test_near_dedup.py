"""Groups against all pairs by brute force; components against union-find; odd rows."""

import random

import numpy as np
import pytest

from jobsieve.llm import near_dedup as N
from jobsieve.llm.components import components


def shingles(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(docs, size):
    parent = {d: d for d, _ in docs if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, size)) for d, t in docs]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted(((d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in sets), key=str)


def make():
    pick = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, at = [], 0
    for group in range(12):
        text = pick.choices(vocabulary, k=60)
        for _ in range(pick.choice([1, 2, 5, 25])):
            own = list(text)
            for _ in range(pick.choice([0, 1, 3, 6, 12])):
                own[pick.randrange(len(own))] = pick.choice(vocabulary)
            at += 1
            docs.append((at * 7 % 1009, " ".join(own)))
    shared = pick.choices(vocabulary, k=40)  # a passage that many documents share
    docs += [(2000 + i, " ".join(shared + pick.choices(vocabulary, k=pick.randrange(3, 30)))) for i in range(40)]
    docs += [(1500, None), (1501, ""), (1502, " \n"), (1503, "One"), (1504, "one"), (1505, "É one"), (1506, "é one"),
             (None, docs[0][1]), (None, None), (3000, docs[0][1].upper()), (3001, "x y " * 40_000), (3002, "x  y\n" * 39_999),
             (docs[3][0], docs[3][1])]
    return docs


@pytest.mark.parametrize("size", [2, 5])
def test_against_all_pairs(spark, size, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "COLUMNS", 50)
    monkeypatch.setattr(N, "CELL", 5)
    docs = make()
    df = spark.createDataFrame([(*d, "x", True) for d in docs], "doc_id long, text string, id string, kept boolean").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, size).collect()), key=str)
    assert got == brute(docs, size)
    kept = N.kept_documents(df, size)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if N.word_list(r.text)) == kept_by_row(docs, size)
    assert sum(not N.word_list(r.text) for r in kept.collect()) == sum(not N.word_list(d[1]) for d in docs)


def kept_by_row(docs, size):
    """(id, text) that stay, with rows told apart by both: the smallest id of every group."""
    rows = sorted({d for d in docs if N.word_list(d[1])}, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    sets = [set(N.shingle_hashes(N.word_list(t), size).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= N.PERCENT * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for g in set(group):
        members = [r for r, x in zip(rows, group) if x == g]
        ids = [r for r in members if (r[0] is None, r[0]) == (members[0][0] is None, members[0][0])]
        out.append(ids[0])
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_rows_of_one_id(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    df = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (2, b, "x"), (None, c, "x"), (None, c, "x"), (None, a, "y"),
                                (3, c, "x"), (3, c, "z"), (4, "", "x"), (4, "", "x")], "doc_id long, text string, _node string")
    kept = N.kept_documents(df)
    assert sorted((r.doc_id, r.text, r._node) for r in kept.collect()) == sorted(
        [(1, a, "x"), (2, b, "x"), (3, c, "x"), (4, "", "x"), (4, "", "x")])
    assert kept.columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0 and N.kept_documents(df).count() == 0


def test_half_keys():
    s = np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert np.array_equal(N.half_keys(s, 4, 3), N.half_keys(s, 4, 3, block=17))
    other = np.concatenate([s[500:], s[:500] + np.uint64(1)])  # similarity 0.905
    trials = [(N.half_keys(N._scrambled(s + np.uint64(i)), 50, 1) == N.half_keys(N._scrambled(other + np.uint64(i)), 50, 1)).mean()
              for i in range(20)]
    assert np.mean(trials) == pytest.approx(0.905, abs=0.03)


def test_components(spark):
    pick = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(pick.randrange(100, 300), pick.randrange(100, 300)) for _ in range(120)]
    links += [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows})
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in rows} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
