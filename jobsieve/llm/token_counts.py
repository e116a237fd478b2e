r"""Token counts of flat token files by a separator scan.

A flat file is a run of little-endian unsigned 16-bit ids without an index; every document ends with the id SEPARATOR.

* Spark's text source reads the files with the byte 0 as line end, so it cuts them into byte ranges wherever they lie and
  however large they are, and every piece of a range ends with a 0 byte. Within a piece numpy finds all separators at once,
  once as if the piece began at an even byte of the file and once at an odd one: in the second case the byte before it is the
  low byte of its first id, and that byte is known to be 0.
* A prefix scan over slim rows, one a piece (bytes, separators and the last one, for either case), gives where a piece starts,
  hence which case holds, how many documents lie before it and where the document begins that crosses into it. The
  separators themselves stay in their table and get these figures by a join.

Empty documents count 0 tokens. Tokens behind the last separator are an open document. A torn last byte is no token; empty
files have no documents. A stretch without any 0 byte is one row of the reader, so it has to fit a task.

`counted_documents` writes documents into such files, in an order that follows from id and text alone, so the same order gives the
sidecar (file, doc_no, doc_id). NULL texts are empty documents, ids may be NULL, equal rows count each, other columns are ignored.
Rows equal in id and text lie in one file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsieve.llm.common import saved
from jobsieve.session import scratch_path

SEPARATOR = 0
IDS = 65_535                # ids of words: 1 to IDS
PIECE_BYTES = 1 << 22       # of a file that are scanned at once, about


def word_ids(text: str | None) -> bytes:
    """Packed ids of the words of a text (split at ASCII white space), by CRC-32."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % IDS + 1).astype("<u2").tobytes()


def placed(docs: DataFrame, files: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`file` (from 0, below `files`), `id`, `mark` and `text` of every document; in a file they lie by `id`, then `mark`."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text", F.col("text").isNull()))
    return rows.select(F.pmod(F.xxhash64("id", "mark"), F.lit(files)).cast("int").alias("file"), "id", "mark", "text")


def write_token_files(rows: DataFrame, path: str, files: int) -> None:
    """The rows of `placed` as flat token files, one in each folder `file=n`.

    Written by the text sink, which adds one byte behind each row: the second byte of the separator.
    """
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([word_ids(t) + b"\0" for t in texts], dtype=object)

    made = rows.select("file", "id", "mark", packed("text").cast("string").alias("value"))
    made = made.repartition(files, "file").sortWithinPartitions("file", "id", "mark").select("value", "file")
    made.write.partitionBy("file").option("lineSep", "\0").text(path)


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file`, `block` (first byte of Spark's range), `size` (of the file) and `line`, the bytes between two 0 bytes, in order."""
    rows = spark.read.option("lineSep", "\0").option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))


def separators(lines: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per piece: file, block, piece (from 0 in its block), size, bytes, and the separators in ids from the piece's first:
    `even` and `odd`, for either place of its first byte.
    """
    def found(raw: bytes) -> list[int]:
        return np.flatnonzero(np.frombuffer(raw, "<u2", len(raw) // 2) == SEPARATOR)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece, held, n = None, 0, [], 0

        def made():
            raw = b"\0".join(held) + b"\0"
            values = [*at[:2], piece, at[2], len(raw), found(raw), found(b"\0" + raw)]
            return pa.RecordBatch.from_pydict({f.name: pa.array([v], f.type) for f, v in zip(schema, values)}, schema)

        for batch in batches:
            for key, rows in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[:3]):
                if key != at:
                    if held:
                        yield made()
                    at, piece, held, n = key, 0, [], 0
                own = [r[3] for r in rows]
                held += own
                n += len(own) + sum(map(len, own))
                if n >= piece_bytes:
                    yield made()
                    piece, held, n = piece + 1, [], 0
        if held:
            yield made()

    longs = pa.list_(pa.int64())
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("piece", pa.int64()), ("size", pa.int64()),
                        ("bytes", pa.int64()), ("even", longs), ("odd", longs)])
    return lines.select("file", "block", "size", "line").mapInArrow(
        scan, "file string, block long, piece long, size long, bytes long, even array<long>, odd array<long>")


def document_counts(lines: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per document of the files: file, doc_no (from 0 in its file), start_token, n_tokens, closed."""
    pieces = saved(separators(lines, piece_bytes), "separators")
    order = Window.partitionBy("file").orderBy("block", "piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    slim = pieces.select("file", "block", "piece", "bytes", *[
        c for k in ("even", "odd") for c in (F.size(k).alias(f"n_{k}"), F.get(k, F.size(k) - 1).alias(f"last_{k}"))])
    slim = slim.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0).cast("bigint")))
    half, odd = F.call_function("div", "start", F.lit(2)), F.col("start") % 2 == 1
    slim = slim.select("file", "block", "piece", half.alias("first"), odd.alias("is_odd"),
                       F.when(odd, F.col("n_odd")).otherwise(F.col("n_even")).alias("n"),
                       (half + F.when(odd, F.col("last_odd")).otherwise(F.col("last_even"))).alias("last"))
    slim = slim.select("file", "block", "piece", "first", "is_odd", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("docs"),
                       F.coalesce(F.max("last").over(before), F.lit(-1).cast("bigint")).alias("carried"),
                       F.lead("piece").over(order).isNull().alias("final"))
    rows = pieces.join(slim, ["file", "block", "piece"]).withColumn(
        "ends", F.when(F.col("is_odd"), F.col("odd")).otherwise(F.col("even")))

    def document(end, i):
        start = F.coalesce(F.get("ends", i - 1) + F.col("first"), F.col("carried")) + 1
        return F.struct((F.col("docs") + i).alias("doc_no"), start.alias("start_token"),
                        (end + F.col("first") - start).alias("n_tokens"), F.lit(True).alias("closed"))

    stop = F.call_function("div", "size", F.lit(2))
    start = F.coalesce(F.get("ends", F.size("ends") - 1) + F.col("first"), F.col("carried")) + 1
    rest = F.struct((F.col("docs") + F.size("ends")).alias("doc_no"), start.alias("start_token"),
                    (stop - start).alias("n_tokens"), F.lit(False).alias("closed"))
    opened = F.when(F.col("final") & (stop > start), F.array(rest)).otherwise(F.slice(F.array(rest), 1, 0))
    return rows.select("file", F.inline(F.concat(F.transform("ends", document), opened)))


def counted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents written as token files in the shared folder, and counted there.

    Per document: its id, file (from 0), doc_no, start_token, n_tokens, closed. There are as many files as the input has partitions.
    """
    spark = docs.sparkSession
    path, files = scratch_path(spark, "tokens"), max(1, docs.rdd.getNumPartitions())
    rows = placed(docs, files, id_col, text_col)
    write_token_files(rows, path, files)
    sidecar = rows.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("id", "mark")) - 1).cast("bigint").alias("doc_no"),
                          F.col("id").alias("own_id"))
    number = F.regexp_extract("file", r"/file=(\d+)/[^/]*$", 1).cast("int")
    counts = document_counts(read_token_lines(spark, path)).withColumn("file", number)
    return counts.join(sidecar, ["file", "doc_no"]).select(
        F.col("own_id").alias(id_col), "file", "doc_no", "start_token", "n_tokens", "closed")
