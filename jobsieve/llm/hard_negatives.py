r"""Hard negatives: rows of another label that score close below an anchor's positives.

Vectors become integers, floor(scale * x) of every component, and a row's score is its inner product with the anchor.
Anchors and rows are dealt to cells, ANCHORS anchors and ROWS rows each on average. A task multiplies a cell's tiles
of int64 by Strassen's recursion (odd sides are padded with zeros; only additions and products of integers, so every
score is exact) and feeds the scores to heaps: one per anchor for its best rows of the same label, then one per
anchor and positive for the best rows of other labels inside the positive's window. Heaps of different cells merge by
rank in Spark, which cuts them before and after the shuffle.

Order: higher score first, ties by smaller id. The work is anchors * rows by its nature; what a task holds is one block
of anchors, their heaps and TILE rows at a time.

Defined results:
* Rows with a NULL id, label or vector, or with a NULL, non-finite or huge component (beyond 2**25 after scaling, whose
  products don't fit a long) take no part. Vectors are compared only with those of their length (8,192 at most).
* A repeated row is a row of its own: it may be positive or negative beside its copy, and anchors on several rows give
  their results once per row. Only the anchor's own row is left out of its positives.
* Fewer rows than asked for: all there are. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.llm.common import saved

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95      # per cent of the positive's score
LARGEST = 1 << 25
LONGEST = 8192
ANCHORS = 1024          # anchors in a cell
ROWS = 4096             # rows in a cell
TILE = 1024             # rows that are multiplied at once
LEAF = 32               # sides from which on matrices are multiplied directly
TASKS = 20_000


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of int64 matrices by seven products of quarters.

    Intermediate sums may wrap around, which does no harm: all steps are exact modulo 2**64.
    """
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
    if k % 2 or m % 2:
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    h, w, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b12, b21, b22 = b[:w, :c], b[:w, c:], b[w:, :c], b[w:, c:]
    out = np.zeros((2 * h, 2 * c), np.int64)
    top_left, top_right, low_left, low_right = out[:h, :c], out[:h, c:], out[h:, :c], out[h:, c:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    top_left += p
    low_right += p
    p = strassen(a21 + a22, b11, leaf)
    low_left += p
    low_right -= p
    p = strassen(a11, b12 - b22, leaf)
    top_right += p
    low_right += p
    p = strassen(a22, b21 - b11, leaf)
    top_left += p
    low_left += p
    p = strassen(a11 + a12, b22, leaf)
    top_left -= p
    top_right += p
    low_right += strassen(a21 - a11, b11 + b12, leaf)
    top_left += strassen(a12 - a22, b21 + b22, leaf)
    return out[:n, :m]


class Heaps:
    """The first `size` entries (score, id, row) of every slot, higher scores first, then smaller ids and rows."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.entries = np.empty((4, 0), np.int64)           # slot, score, id, row
        self.worst = np.full(slots, np.iinfo(np.int64).min)  # scores below it change nothing

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(slot):
            return
        e = np.concatenate([self.entries, np.stack([slot, score, ids, rows])], axis=1)
        e = e[:, np.lexsort((e[3], e[2], ~e[1], e[0]))]
        starts = np.flatnonzero(np.diff(e[0], prepend=-1))
        rank = np.arange(e.shape[1]) - np.repeat(starts, np.diff(starts, append=e.shape[1]))
        full = rank == self.size - 1
        self.worst[e[0, full]] = e[1, full]
        self.entries = e[:, rank < self.size]


def _positives(block: dict, rows: dict, scores: np.ndarray, heaps: Heaps) -> None:
    good = scores >= heaps.worst[:, None]
    good &= block["label"][:, None] == rows["label"][None, :]
    good &= block["row"][:, None] != rows["row"][None, :]
    at, of = np.nonzero(good)
    heaps.add(at, scores[at, of], rows["id"][of], rows["row"][of])


def _negatives(block: dict, rows: dict, scores: np.ndarray, heaps: Heaps) -> None:
    """Slot i * POSITIVES + k stands for positive k of anchor i."""
    other = block["label"][:, None] != rows["label"][None, :]
    width = block["low"].shape[1]
    for k in range(width):
        slots = np.arange(len(scores)) * width + k
        good = scores <= block["high"][:, k][:, None]
        good &= scores >= np.maximum(block["low"][:, k], heaps.worst[slots])[:, None]
        good &= other
        at, of = np.nonzero(good)
        heaps.add(slots[at], scores[at, of], rows["id"][of], rows["row"][of])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1).astype(np.int64, copy=False)


def _scan(feed, width: int, size: int):
    """A function over Arrow batches sorted by cell and dim, anchors (with `low` and `high`) before rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, block, heaps = None, [], None, None

        def result() -> Iterator[pa.RecordBatch]:
            if heaps is not None and heaps.entries.shape[1]:
                slot, score, ids, rows = heaps.entries
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["row"][slot // width]), pa.array((slot % width).astype(np.int32)), pa.array(score),
                     pa.array(ids), pa.array(rows)], ["anchor", "k", "score", "id", "row"])

        for batch in batches:
            head = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])  # cell, dim, side
            cuts = np.flatnonzero(np.any(np.diff(head, axis=1), axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if (here := tuple(head[:2, a].tolist())) != key:
                    yield from result()
                    key, blocks, block, heaps = here, [], None, None
                rows = {n: part.column(n).to_numpy() for n in ("row", "id", "label")}
                rows["q"] = _matrix(part.column("q"), b - a)
                if not head[2, a]:
                    rows |= {n: _matrix(part.column(n), b - a) for n in ("low", "high")}
                    blocks.append(rows)
                    continue
                if not blocks:
                    continue
                if block is None:
                    block = {n: np.concatenate([x[n] for x in blocks]) for n in blocks[0]}
                    heaps = Heaps(len(block["row"]) * width, size)
                for low in range(0, b - a, TILE):
                    tile = {n: v[low:low + TILE] for n, v in rows.items()}
                    feed(block, tile, strassen(block["q"], np.ascontiguousarray(tile["q"].T)), heaps)
        yield from result()

    return run


def scanned(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], feed, width: int, size: int) -> DataFrame:
    """anchor, k, score, id, row: heaps of `size` entries for the `width` slots of every anchor, merged over all rows.

    `anchors` has row, id, label, dim, q, low, high; `rows` the first five. `sizes`: how many of either there are.
    """
    groups, slices = max(1, math.ceil(sizes[0] / ANCHORS)), max(1, math.ceil(sizes[1] / ROWS))

    def dealt(df: DataFrame, side: int, own: int, other: int) -> DataFrame:
        here = F.pmod(F.xxhash64("row"), F.lit(own))
        away = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other - 1).cast("bigint"))).alias("away")
        df = df.select(here.alias("here"), away, "*")
        group, piece = (F.col("here"), F.col("away")) if side == 0 else (F.col("away"), F.col("here"))
        return df.select((group * slices + piece).alias("cell"), F.col("dim").cast("bigint").alias("dim"),
                         F.lit(side).alias("side"), "row", "id", "label", "q", "low", "high")

    none = F.lit(None).cast("array<bigint>")
    rows = rows.withColumn("low", none).withColumn("high", none)
    cells = dealt(anchors, 0, groups, slices).union(dealt(rows, 1, slices, groups))
    tasks = min(groups * slices, TASKS)
    found = (cells.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int"))
             .sortWithinPartitions("cell", "dim", "side")
             .mapInArrow(_scan(feed, width, size), "anchor long, k int, score long, id long, row long"))
    order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def hard_negatives(df: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` (boolean) and `label` (integer) are expressions over df. An anchor's positives are its first `positives`
    other rows of its label; for each of them the first `negatives` rows of other labels are returned whose score lies
    between `low` and `high` per cent of the positive's.
    """
    v = F.col(f"`{vector_col}`")
    x = F.col("v")
    fits = F.forall(x, lambda c: F.coalesce(F.abs(F.floor(c * scale)) <= LARGEST, F.lit(False)))
    rows = (df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                      F.coalesce(anchor, F.lit(False)).alias("anchor"), v.cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") <= LONGEST)
                   & F.forall(x, lambda c: F.coalesce(F.abs(c) < math.inf, F.lit(False))) & fits)
            .select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", F.size("v").alias("dim"),
                    F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("q")))
    rows = saved(rows, "rows")
    count = rows.agg(F.count(F.when(F.col("anchor"), 1)).alias("a"), F.count(F.lit(1)).alias("n")).first()
    picked, rows = rows.where("anchor").drop("anchor"), rows.drop("anchor")
    none = F.array().cast("array<bigint>")
    best = saved(scanned(picked.withColumn("low", none).withColumn("high", none), rows, (count["a"], count["n"]),
                         _positives, 1, positives), "positives")

    # The window of a slot without a positive holds nothing.
    score = F.col("score").cast("decimal(20,0)")
    window = F.struct(F.col("rank").alias("k"), F.ceil(score * low / 100).cast("bigint").alias("low"),
                      F.floor(score * high / 100).cast("bigint").alias("high"))
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("w"))

    def filled(name: str, empty: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(positives)),
                           lambda k: F.coalesce(F.get(F.col("w"), k - 1)[name], F.lit(empty))).alias(name)

    picked = picked.join(windows.withColumnRenamed("anchor", "row"), "row").select(
        "row", "id", "label", "dim", "q", filled("low", 1), filled("high", 0))
    mined = scanned(picked, rows, (count["a"], count["n"]), _negatives, positives, negatives)
    mined = mined.select("anchor", (F.col("k") + 1).alias("p"), F.col("rank").cast("int").alias("rank"),
                         F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = best.select("anchor", F.col("rank").alias("p"), F.col("id").alias("positive_id"),
                         F.col("score").alias("positive_score"))
    names = picked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return mined.join(chosen, ["anchor", "p"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def embedding_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 50; every seventh row first moves to the next label."""
    key, label = F.col("vec_id"), F.col("label")
    moved = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(embeddings, key % 50 == 0, moved)


EMBEDDING_NEGATIVES_SQL = """
WITH sound AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
           list_inner_product(a.q, b.q)::BIGINT AS score
    FROM sound a JOIN sound b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.vec_id, s.r)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.ar = s.ar AND NOT s.same
     AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3"""
