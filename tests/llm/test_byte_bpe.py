"""Encoding against the tokenizer library, and exact round trips."""

import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from jobsieve.llm import byte_bpe as B

V = B.vocabulary(B.VOCABULARY)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=V.ranks, special_tokens={})
PARTS = ["'s", "'ll", "'re", "'v", "ve", "'", " '", "''", " ", "  ", "\n", "\n ", "\t", "a", "Word", "é", "12", "٣", "!", "?!", " ",
         "　", "日本", "🙂", "é", "<|endoftext|>", "'t't", "don't", "\r\n", " ", "ll", "'LL", "ı", "\U00016d40"]


def same(texts):
    packed = V.encode(texts)
    for text, ids in zip(texts, packed):
        assert B.id_list(ids) == LIBRARY.encode_ordinary(text or ""), repr(text)
        assert V.decode(ids) == (text or "").encode()


def test_parts():
    pick = random.Random(3)
    same(PARTS + [a + b for a in PARTS for b in PARTS])
    same(["".join(pick.choices(PARTS, k=pick.randrange(1, 30))) for _ in range(3000)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text(texts):
    same(texts)


def test_all_code_points():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same([" ".join(chars[i:i + 5000]) for i in range(0, len(chars), 5000)][::7])
    table = B.code_classes()
    library = tiktoken.Encoding("x", pat_str=r"\p{L}", mergeable_ranks=V.ranks, special_tokens={})
    text = "".join(chars)
    assert library.decode(library.encode_ordinary(text)) == "".join(c for c in chars if table[ord(c)] == B._LETTER)


def test_documents():
    import duckdb

    rows = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    same([r[0] for r in rows])


def test_long_pieces_and_scan_borders():
    same(["ab" * 40_000, "x" * (B.BLOCK * 3 + 1), "9" * 5000, " " * 3000 + "a", "!?" * 700, "", None, "é" * 999])
    pick = random.Random(5)
    for n in (47, 48, 49, 50, 200, 1000):
        piece = bytes(pick.choices(b"abcdeTHE", k=n))
        assert V._merge_long(piece) == LIBRARY._core_bpe.encode_single_piece(piece)


def test_offsets():
    text = "Don't stop, é 日本 now"
    ids = V.encode([text])[0]
    ends = V.ends(ids).tolist()
    assert ends[-1] == len(text.encode())
    for i, token in enumerate(B.id_list(ids)):
        assert V.decode(struct.pack("<I", token)) == text.encode()[(ends[i - 1] if i else 0):ends[i]]


def test_documents_query(spark):
    docs = spark.createDataFrame(
        [(1, "Hello world's end", 0), (2, None, 0), (3, "", 1), (None, "x " * 100_000, 1), (1, "Hello world's end", 0)],
        "doc_id long, text string, ids int").repartition(3)
    rows = B.document_tokens(docs).collect()
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert B.document_tokens(docs.limit(0)).count() == 0


def test_rank_file():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        assert V.ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with pytest.raises(FileNotFoundError):
        B.Vocabulary("/nowhere")
