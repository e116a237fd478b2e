"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of the named columns. A Feistel network over the grid a x b
(a = ceil(sqrt n), b = ceil(n / a)) permutes the numbers; a value that leaves 0..n-1 is permuted again until it
is inside (cycle walking). Position p of the permutation is slot `p div shards` of shard `p mod shards`, so
shard sizes differ by one row at most, slots have no gaps, and both follow from the row number alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.session import checkpointed

ROUNDS = 6
# Fewer than a values of the grid lie outside 0..n-1, so a walk ends within a steps. With a > 16 each step
# ends it with a chance of 15/16 and more; a walk beyond WALK steps raises an error instead of a wrong place.
WALK = 16
SHARDS = 40
SEED = 20260101


def _rounds(x: Column, a: Column, b: Column, seed: int, inverse: bool) -> Column:
    left, right = F.call_function("div", x, b), x % b
    for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS)):
        key = F.lit(seed * 1000 + r).cast("bigint")
        own, other, size = (left, right, a) if r % 2 == 0 else (right, left, b)
        step = F.pmod(F.xxhash64(other, key), size)
        own = F.pmod(own - step, size) if inverse else (own + step) % size
        left, right = (own, right) if r % 2 == 0 else (left, own)
    return left * b + right


def permuted(row_no: Column, n: Column, seed: int = SEED, inverse: bool = False) -> Column:
    """The place of a row number in the permutation of 0..n-1; with `inverse` the row at a place."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.call_function("div", n + a - 1, a)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _rounds(row_no, a, b, seed, inverse),
                         lambda x, _: F.when(x < n, x).otherwise(_rounds(x, a, b, seed, inverse)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")))


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The columns `order` of every row with `row_no` (0..n-1 in that order, NULL first) and `n_rows`.

    Rows equal in all these columns are counted before the shuffle and unfolded after it, so a repeated row is
    no hot key. The sorted rows are checkpointed: their partitions must not change between numbering and use.
    One row per partition (its count) meets in one task.
    """
    cols = [f"c{i}" for i in range(len(order))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(cols, order)])
    rows = (rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
            .repartitionByRange(*[F.asc_nulls_first(c) for c in cols])
            .sortWithinPartitions(*[F.asc_nulls_first(c) for c in cols])
            .select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
            .select(*cols, F.monotonically_increasing_id().alias("at")))
    rows = checkpointed(rows)
    part = F.shiftrightunsigned("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    everything = Window.partitionBy()
    offsets = sizes.select(
        "part", F.sum("rows").over(everything).alias("n_rows"),
        (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    # One row per partition of the sorted table.
    rows = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return rows.select(*[F.col(k).alias(c) for k, c in zip(cols, order)],
                       (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("row_no"), "n_rows")


def shard_rows(df: DataFrame, order: Sequence[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The columns `order` of every row with `row_no`, `shard` (int) and `slot` (long).

    Law: `rows` (shard sizes differ by one at most). Columns not named in `order` are not carried; NULL in any
    column sorts first; repeated rows get places of their own; an empty table gives no rows.
    """
    if shards < 1 or not order:
        raise ValueError("shards must be positive and order must name a column")
    rows = numbered(df, order)
    place = permuted(F.col("row_no"), F.col("n_rows"), seed)
    rows = rows.withColumn("_place", place)
    return rows.select(*order, "row_no", (F.col("_place") % shards).cast("int").alias("shard"),
                       F.call_function("div", F.col("_place"), F.lit(shards).cast("bigint")).alias("slot"))


def document_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of all documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the UTF-8 length of the text plus 16; a NULL text counts as empty (size 16, checksum 0). Equal
    documents are told apart only by their places, since the law is on rows, not on groups of equal texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"),
                       F.crc32(text).cast("bigint").alias("text_crc32"))
    return shard_rows(rows, ["doc_id", "size", "text_crc32"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_no")
