r"""Near-duplicate documents: MinHash with tensored banding, candidates verified on full shingle sets.

Lower-cased (A-Z) words `[^\x20\x09-\x0D]+` give a document's set of word shingles (one shingle of all words where
there are fewer words than a shingle has; none for an empty or NULL text, which is linked with nothing).

* Texts with the same words are collapsed first (SHA-256 of the words): one representative, with the smallest id.
* Two collections of TABLES half keys, each of HASHES MinHash values, are computed; every pair of half keys is one
  table key. TABLES ** 2 tables cost only 2 * TABLES * HASHES hash values. A pair of similarity s shares a key with
  probability (1 - (1 - s**HASHES)**TABLES)**2, that is 0.9997 at 0.8 and more above.
* In every bucket all members are compared with its smallest member. Most groups are whole then.
* Where a bucket still holds several components, its members are compared across components, in blocks. Pairs
  inside one component, which would grow with the square of a group, are never made, and no pair is a row.
* A pair is a link if 100 * |intersection| >= 80 * |union| on the full sets. Components of the links are the groups.

Texts may have any length; rows that repeat an id are one node; an empty table gives an empty result; columns other than
id and text are ignored, whatever their names (`kept_documents` keeps them as they are).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import fresh, saved, small_side
from jobsieve.llm.components import components

SHINGLE = 5
PERCENT = 80
TABLES = 12
HASHES = 3
SEED = 7
# Texts whose half keys a task remembers, for copies.
KNOWN = 20_000
# Pairs that a task compares with their texts in memory.
CELL = 1_000
# Nodes in a block, and shingles in a block's matrix.
BLOCK = 256
COLUMNS = 4096


def word_list(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case. `bytes` splits at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - size + 1, 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for j in range(min(size, len(words))):
        out = _scrambled(out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(out)


def _seeds(tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    shape = (2 * tables * hashes, 1)
    return rng.integers(0, 1 << 63, shape, np.uint64), rng.integers(0, 1 << 63, shape, np.uint64) | np.uint64(1)


def half_keys(shingles: np.ndarray, tables: int, hashes: int, block: int = 4096) -> np.ndarray:
    """2 * `tables` half keys of a set; long sets are taken in blocks."""
    add, times = _seeds(tables, hashes)
    low = np.full(len(add), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        x = (shingles[None, i:i + block] ^ add) * times
        np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=1), out=low)
    low = low.reshape(2 * tables, hashes)
    key = np.arange(2 * tables, dtype=np.uint64)
    for j in range(hashes):
        key = _scrambled(key * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
    return key


def profiles(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, SHA-256 of the words (NULL without words), number of shingles, half keys of both collections."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = word_list(text)
                if not words:
                    rows.append((None, 0, None))
                    continue
                digest = hashlib.sha256(b" ".join(words)).digest()
                if digest not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    found = shingle_hashes(words, size)
                    known[digest] = (digest, len(found), half_keys(found, TABLES, HASHES).view(np.int64))
                rows.append(known[digest])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["id", "digest", "n_shingles", "half"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, "id long, digest binary, n_shingles long, half array<long>")


def linked(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have a similarity of PERCENT and more.

    Pairs are dealt to the cells of a grid by hashes of both ids, CELL pairs to a cell on average, so that a text
    travels once per cell and not once per pair, and no id makes a large cell. A task holds the sets of one cell.
    """
    side = max(1, math.ceil(math.sqrt(pairs.count() / CELL)))

    def place(a: str, b: str) -> Column:
        return F.pmod(F.xxhash64(a), F.lit(side)) * side + F.pmod(F.xxhash64(b), F.lit(side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, last, own = None, {}, None, frozenset()
        for batch in batches:
            found = []
            for here, a, b, text in zip(*[c.to_pylist() for c in batch.columns]):
                if here != cell:
                    cell, sets, last = here, {}, None
                if b is None:  # texts of a cell come before its pairs
                    sets.setdefault(a, []).append(shingle_hashes(word_list(text), size))
                    continue
                if b != last:
                    last, own = b, [frozenset(x.tolist()) for x in sets[b]]
                if any(_similar(x, y) for x in own for y in sets[a]):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                              pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    pairs = pairs.select(place("a", "b").alias("cell"), "a", "b")
    wanted = pairs.select("cell", F.col("a").alias("id")).union(pairs.select("cell", F.col("b").alias("id"))).distinct()
    none = F.lit(None)
    rows = (wanted.join(texts, "id").select("cell", F.col("id").alias("a"), none.cast("bigint").alias("b"), "text")
            .union(pairs.select("cell", "a", "b", none.cast("string"))))
    return (rows.repartition("cell").sortWithinPartitions("cell", F.asc_nulls_first("b"))
            .mapInArrow(run, "a long, b long"))


def _similar(x: frozenset, y: np.ndarray) -> bool:
    small, large = sorted((len(x), len(y)))
    if 100 * small < PERCENT * large:
        return False
    shared = len(x.intersection(y.tolist()))
    return 100 * shared >= PERCENT * (small + large - shared)


def _crossing(x: list, y: list) -> list[tuple[int, int]]:
    """Links between two blocks of (id, component, shingle hashes), one for each id of x and component of y.

    Intersections are counted by products of 0/1 matrices over the shingles that both blocks have.
    """
    def entries(side):
        values = np.concatenate([r[2] for r in side])
        return values, np.repeat(np.arange(len(side)), [len(r[2]) for r in side])

    (vx, rx), (vy, ry) = entries(x), entries(y)
    words = np.intersect1d(vx, vy)
    shared = np.zeros((len(x), len(y)), np.float32)
    spots = []
    for values, rows in ((vx, rx), (vy, ry)):
        at = np.searchsorted(words, values)
        good = np.flatnonzero(at < len(words))
        good = good[words[at[good]] == values[good]]
        order = good[np.argsort(at[good], kind="stable")]
        spots.append((at[order], rows[order]))
    for low in range(0, len(words), COLUMNS):
        sides = []
        for (at, rows), n in zip(spots, (len(x), len(y))):
            a, b = np.searchsorted(at, [low, low + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(words) - low)), np.float32)
            m[rows[a:b], at[a:b] - low] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    sizes = np.array([len(r[2]) for r in x])[:, None] + np.array([len(r[2]) for r in y])[None, :]
    apart = np.array([r[1] for r in x])[:, None] != np.array([r[1] for r in y])[None, :]
    found = {}
    for i, j in np.argwhere((100 * shared >= PERCENT * (sizes - shared)) & apart).tolist():
        found.setdefault((x[i][0], y[j][1]), (x[i][0], y[j][0]))
    return list(found.values())


def crossing_links(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links between components that meet in a bucket. `members`: key, node, component.

    A bucket belongs to its largest component. All nodes of a component's buckets that lie outside it are compared
    with all nodes of these buckets, block by block; a task holds the texts of two blocks of BLOCK nodes.
    """
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed = (parts.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"),
                                      F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main"))
    nodes = saved(members.join(mixed, "key").select("main", "node", "component").distinct(), "nodes")
    outside = F.col("component") != F.col("main")
    blocks = nodes.groupBy("main").agg(F.ceil(F.count(F.when(outside, 1)) / BLOCK).alias("bx"),
                                       F.ceil(F.count(F.lit(1)) / BLOCK).alias("by"))
    # As a table of its own it joins by shuffles that Spark can split at a bucket owner with very many nodes.
    nodes = nodes.join(small_side(saved(blocks, "blocks")), "main")

    def side(rows: DataFrame, no: int, own: str, other: str) -> DataFrame:
        return rows.select("main", F.lit(no).alias("side"), "node", "component",
                           F.pmod(F.xxhash64("node"), F.col(own)).alias(f"{own}_"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"{other}_"))

    columns = ["main", "bx_", "by_", "side", "node", "component"]
    rows = (side(nodes.where(outside), 0, "bx", "by").select(*columns)
            .union(side(nodes, 1, "by", "bx").select(*columns))
            .join(texts.withColumnRenamed("id", "node"), "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            found = _crossing(*sides) if all(sides) else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                               pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for main, bx, by, no, node, component, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (main, bx, by) != cell:
                    yield links()
                    cell, sides = (main, bx, by), ([], [])
                sides[no].append((node, component, shingle_hashes(word_list(text), size)))
        yield links()

    return (rows.select(*columns, "text").repartition("main", "bx_", "by_").sortWithinPartitions("main", "bx_", "by_")
            .mapInArrow(run, "a long, b long"))


def representative_links(reps: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links (a, b) between texts that connect all that any shared table key can find.

    `reps` has `node` and `half`; `texts` has `id` and `text` of all nodes.
    """
    first, second = F.slice("half", 1, TABLES), F.slice("half", TABLES + 1, TABLES)
    tables = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x, y))))
    # Spread before unfolding: a row becomes TABLES ** 2 rows.
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = reps.repartition(tasks, "node").select("node", F.explode(tables).alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    members = saved(keys.join(hubs.select("key", "hub"), "key"), "buckets")

    # Every member with the smallest one of its bucket.
    pairs = saved(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = saved(texts.join(small_side(saved(wanted, "ids")), "id"), "texts")
    links = saved(linked(pairs, texts, size), "links")

    # What shares a bucket with another component.
    groups = components(links).select("node", "component")
    members = members.select("key", "node").join(groups, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    return links.union(saved(crossing_links(members, texts, size), "links"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id of its group), kept (doc_id = component_id).

    An id on several rows is one node, and links of any of its rows count for it. Rows with a NULL id take no part:
    their component is NULL and they are kept. Texts without words are linked with nothing.
    """
    rows = saved(profiles(docs, size, id_col, text_col), "profiles")
    sound = rows.where("id is not null and digest is not null")
    # Equal words have equal half keys: any row's will do, and copies are combined before the shuffle.
    reps = saved(sound.groupBy("digest").agg(F.min("id").alias("node"), F.max("id").alias("last"),
                                             F.first("half").alias("half")), "reps")
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Both sides are tables here, so Spark can split the rows of a text with very many copies.
    copies = (sound.join(reps.where("node < last").select("digest", "node"), "digest").where("id > node")
              .select(F.col("id").alias("a"), F.col("node").alias("b")).distinct())
    near = representative_links(reps.select("node", "half"), texts, size)
    groups = components(near.union(copies)).select(F.col("node").alias("id"), "component").distinct()
    own = F.coalesce("component", "id")
    return rows.join(groups, "id", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of the smallest id (rows without an id come last); the rows with their own columns.

    Rows are told apart by a hash of id and text, so an id that stands on several rows loses only those of its texts that
    resemble another row. Rows that repeat both id and text are one group. Rows without words all stay. Texts may have
    any length; an empty table gives an empty result; columns may have any names.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    node = fresh(docs, "_node")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(node, F.xxhash64(key, text))
    groups = near_duplicates(rows.select(F.col(node).alias("doc_id"), text.alias("text")), size)
    groups = groups.where("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id")
    ids = rows.select(F.col(node).alias("node"), key.cast("bigint").alias("id")).distinct()
    members = saved(groups.join(ids, "node"), "members")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))["node"]
    several = (members.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
               .where("n > 1").select("component_id", "first"))
    members = members.join(small_side(saved(several, "several")), "component_id")
    dropped = members.where("node <> first").select(F.col("node").alias(node)).distinct()
    again = members.where("node = first").groupBy("node").count().where("count > 1").select(F.col("node").alias(node))
    rows = rows.join(small_side(saved(dropped, "dropped")), node, "left_anti")
    again = small_side(saved(again, "repeated"))
    row = F.struct(*own)
    repeated = (rows.join(again, node, "left_semi").groupBy(node).agg(F.min_by(row, F.to_json(row)).alias("row"))
                .select("row.*"))
    return rows.join(again, node, "left_anti").select(*own).union(repeated)


# Exact groups in SQL. A pair of similarity 0.8 shares one of the rarest fifth (and one more) of either's shingles; such
# pairs are counted in full. `translate` lowers A-Z only.
DOCUMENT_GROUPS_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE len(words) WHEN 0 THEN [] WHEN 1 THEN words
               ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
often AS (SELECT g, count(*) AS f FROM s GROUP BY 1),
ranked AS (
    SELECT s.doc_id, s.g, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, s.g) AS no
    FROM s JOIN often USING (g) JOIN sizes USING (doc_id)),
rare AS (SELECT * FROM ranked WHERE no <= n // 5 + 1),
pairs AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM rare a JOIN rare b
    ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
    SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g
    GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
turned AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id, doc_id AS b FROM w
    UNION
    SELECT reach.doc_id, turned.b FROM reach JOIN turned ON turned.a = reach.b),
groups AS (SELECT doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN groups USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
