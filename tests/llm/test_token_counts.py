"""Counts of flat files against a plain split, for ranges and pieces that end at every place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsieve.llm import token_counts as T


def plain(raw):
    ids = np.frombuffer(raw, "<u2", len(raw) // 2).tolist()
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == T.SEPARATOR:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.fixture
def ranges(spark):
    """Sets how many bytes of a file Spark reads in one range."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {n: spark.conf.get(n) for n in names}

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
    yield put
    for n, v in kept.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size,piece", [(5, 3), (31, 1), (1 << 20, 5), (1 << 20, 1 << 22)])
def test_ranges(spark, tmp_path, ranges, size, piece):
    pick = random.Random(size)
    files = {"tail": [5, 6, 0, 7, 0], "open": [0, 0, 3, 0, 9, 9, 9], "none": [257] * 20, "all": [0] * 9, "one": [0],
             "shifted": [256, 1, 256, 1, 0, 256, 256, 1, 0, 0, 1], "high": [513, 256, 0, 256, 0],
             "long": [pick.choice([0, 1, 256, 257, 65_535, 300]) for _ in range(100)]}
    raw = {name: np.array(ids, "<u2").tobytes() + (b"\x01" if name in ("open", "high") else b"") for name, ids in files.items()}
    raw |= {"torn zero": b"\x05\x00\x00\x00\x00", "byte": b"\x07", "empty": b""}
    (tmp_path / "in").mkdir()
    for name, own in raw.items():
        (tmp_path / "in" / name).write_bytes(own)
    ranges(size)
    lines = T.read_token_lines(spark, str(tmp_path / "in")).cache()     # read in these ranges, the tables made of it are not
    lines.count()
    ranges(1 << 20)
    if size < 10:
        assert lines.where("file LIKE '%long'").select("block").distinct().count() > 5
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), "%20", " ")
    got = [tuple(r) for r in T.document_counts(lines, piece).withColumn("file", name).select(
        "file", "doc_no", "start_token", "n_tokens", "closed").collect()]
    assert sorted(got) == sorted((name, no, *d) for name, own in raw.items() for no, d in enumerate(plain(own)))


def test_documents(spark, ranges):
    texts = ["one two\nthree", None, "", " ", "x " * 70_000, "é \x0b ü\xa0k", "same", "same"] + [f"{'w ' * (k % 9)}{k}" for k in range(80)]
    ids = [None if i == 5 else 6 if i == 7 else i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in zip(ids, texts)], "doc_id long, text string, file int, id string").repartition(3)
    ranges(20_000)
    rows = T.counted_documents(docs).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=str) == sorted(
        ((i, len((t or "").encode().split())) for i, t in zip(ids, texts)), key=str)
    assert all(r.closed for r in rows) and len({(r.file, r.doc_no) for r in rows}) == len(texts)
    by = {}
    for r in sorted(rows, key=lambda r: (r.file, r.doc_no)):
        assert r.start_token == by.get(r.file, 0)
        by[r.file] = r.start_token + r.n_tokens + 1
    assert T.counted_documents(docs.limit(0)).count() == 0


def test_files_are_flat(spark, tmp_path):
    texts = ["a b", "", "c\nd e \x00 f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    T.write_token_files(T.placed(docs, 1), str(tmp_path / "t"), 1)
    (part,) = (tmp_path / "t").glob("file=0/part-*")
    assert part.read_bytes() == b"".join(T.word_ids(t) + b"\x00\x00" for t in texts)
    assert T.SEPARATOR not in np.frombuffer(T.word_ids("a b c d e"), "<u2")
