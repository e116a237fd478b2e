"""Shards against a plain Python walk of the same permutation."""

import math
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from jobsieve.llm import sharding

SCHEMA = "doc_id long, text string, shard string, row_no int"


def plain_hash(value, key):
    first = xxhash.xxh64_intdigest(struct.pack("<q", value), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=first)
    return h - (1 << 64) if h >> 63 else h


def place(x, n, seed):
    a = math.ceil(math.sqrt(n))
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(sharding.ROUNDS):
            key = seed * 1000 + r
            if r % 2 == 0:
                left = (left + plain_hash(right, key) % a) % a
            else:
                right = (right + plain_hash(left, key) % b) % b
        x = left * b + right
        if x < n:
            return x


def expected(docs, shards, seed):
    key = lambda v: tuple((x is not None, x) for x in v)
    rows = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs), key=key)
    at = [place(i, len(rows), seed) for i in range(len(rows))]
    return sorted(((*r, p % shards, p // shards) for r, p in zip(rows, at)), key=key)


def shards(spark, docs, n=7, seed=5):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)
    out = sharding.document_shards(df, n, seed)
    assert {r.law for r in out.select("law").distinct().collect()} <= {"rows"}
    rows = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out.collect()]
    return sorted(rows, key=lambda v: tuple((x is not None, x) for x in v))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 50, 257])
def test_against_plain_walk(spark, n):
    docs = [(i * 3, f"text {i} é" * (i % 5)) for i in range(n)]
    assert shards(spark, docs) == expected(docs, 7, 5)


def test_odd_rows(spark):
    docs = [(None, None), (None, ""), (4, None), (4, None), (4, None), (7, "a" * 200_000), (7, "b"), (7, "b")]
    assert shards(spark, docs) == expected(docs, 7, 5)
    assert shards(spark, []) == []


def test_law_and_slots(spark):
    docs = [(i % 3, "same") for i in range(500)]
    rows = shards(spark, docs, 40)
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r[4])
    sizes = [len(v) for v in by.values()]
    assert len(by) == 40 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_inverse(spark):
    n = 1000
    df = spark.range(n).select("id", sharding.permuted(F.col("id"), F.lit(n).cast("bigint")).alias("p"))
    df = df.select("id", "p", sharding.permuted(F.col("p"), F.lit(n).cast("bigint"), inverse=True).alias("back"))
    rows = df.collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.id == r.back for r in rows)
    assert sum(r.p == r.id for r in rows) < 20


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        sharding.shard_rows(spark.range(3), ["id"], 0)
