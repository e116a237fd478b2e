r"""Near-duplicate vectors: spherical-cap filters from structured random product codes, candidates verified.

A filter is a direction; a vector passes it when their inner product reaches the cap's height. Directions come from
product codes: a random rotation cuts a vector into BLOCKS parts, every part has a random code of `size` unit vectors,
and each combination of code words, one per part, is a direction. So `size ** BLOCKS` directions cost only
BLOCKS * size inner products, and all directions that a vector exceeds are list-decoded from the sorted products of its
parts, best sums first. ROTATIONS codes of their own make the length of a vector's list even. Similar vectors meet in
many filters, others hardly ever.

* `size` grows with the square root of the largest label (up to LARGEST_CODE), so that a filter holds few strangers; the
  cap's height is then the largest at which RECALL of synthetic pairs of exactly the least similarity share a filter.
  Both depend on the length of the vectors and their number only, not on the data, and closer pairs meet more often.
* Equal vectors of a label are one node with a weight. Lists are joined on (label, length, filter); filters with one node
  are left out before vectors are moved.
* Every node is compared with the smallest one of each of its filters. The smallest that it is linked with is its star.
* Nodes of one star are compared with each other, block by block, BLOCK nodes a side, by matrix products in double
  precision. Nodes of different stars are compared in the filters where they meet; such a link counts in the first
  filter that both lists hold. A task returns a count per node and one link per node to the smallest of its part of
  the block's graph; pairs inside groups are never rows. The comparisons inside a group of near copies (not equal
  ones) grow with the square of its size, as the number of their links does.

Defined results: NULL labels or vectors, zero vectors and vectors with a NULL or non-finite component link with
nothing; vectors are compared only with those of their length. Every row is a vector: copies under one id are counted,
and an id on several rows names each of them. Rows with a NULL id link like others but give no component their id; a
component without any id is NULL, and kept is true where vec_id or component is NULL. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import saved, small_side
from jobsieve.llm.components import components

LEAST = 0.93            # cosine of a link
BLOCKS = 2              # parts of a rotated vector
ROTATIONS = 4
RECALL = 0.999         # of synthetic pairs at LEAST
PAIRS = 2000            # synthetic pairs
STRANGERS = 0.02        # nodes of its label that a filter holds by chance, about
USUAL_LIST = 15         # directions of one code that a vector exceeds, about
LONGEST_LIST = 200      # on average over synthetic vectors; beyond it the code is made smaller
LARGEST_CODE = 4096
SEED = 11
BLOCK = 512             # nodes in a block
PAIRS_IN_CELL = 100_000
COLUMNS = 4096          # filters in a matrix
DECODED = 256           # vectors that are decoded at once


@lru_cache(16)
def code(dim: int, size: int, number: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rotation, components of the parts, and code words of each part (scaled so that a direction has length 1)."""
    rng = np.random.default_rng([SEED, dim, size, number])
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    parts = np.array_split(np.arange(dim), min(BLOCKS, dim))
    words = []
    for part in parts:
        w = rng.normal(size=(size, len(part)))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(len(parts)))
    return rotation, parts, words


def decoded(v: np.ndarray, size: int, height: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, filter number and inner product for every direction of all codes that a unit vector exceeds."""
    n, found = len(v), []
    for number in range(ROTATIONS):
        rotation, parts, words = code(v.shape[1], size, number)
        turned = v @ rotation
        products = [turned[:, p] @ w.T for p, w in zip(parts, words)]
        best = np.array([x.max(axis=1) for x in products])
        row, key, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        for k, x in enumerate(products):
            # Words that reach the height with the best of the other parts, by row and product. One sorted array holds
            # all rows, as products of parts lie within -1 and 1.
            of, word = np.nonzero(x >= (height - best.sum(axis=0) + best[k])[:, None])
            flat = x[of, word] + 4.0 * of
            order = np.argsort(flat)
            flat, of, word = flat[order], of[order], word[order]
            stop = np.searchsorted(of, np.arange(n), side="right")
            least = height - best[k + 1:, row].sum(axis=0) - total
            low = np.minimum(np.searchsorted(flat, 4.0 * row + np.maximum(least, -2)), stop[row])
            counts = stop[row] - low
            up = np.repeat(np.arange(len(row)), counts)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[up]
            row, key, total = row[up], key[up] * size + word[at], total[up] + x[row[up], word[at]]
        found.append((row, key + number * size ** len(parts), total))
    row, key, total = (np.concatenate([f[i] for f in found]) for i in range(3))
    return row, key, total


def _pairs(dim: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    a, b = rng.normal(size=(2, PAIRS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim == 1:
        return a, a
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, least * a + math.sqrt(1 - least * least) * b


@lru_cache(64)
def tuned(dim: int, nodes: int, least: float = LEAST) -> tuple[int, float]:
    """Size of the codes and height of the caps for vectors of `dim` components, `nodes` in the largest label."""
    size = int(min(math.sqrt(USUAL_LIST * max(nodes, 2) / STRANGERS), LARGEST_CODE, 4.0 ** max(1, dim // BLOCKS)))
    size = max(size, 2)
    a, b = _pairs(dim, least)
    while True:
        height = math.sqrt(1 - min(0.9, 2 * USUAL_LIST / size ** 2) ** (2 / max(dim - 1, 1)))
        while True:
            seen = np.full(PAIRS, -np.inf)      # the greatest height at which a pair still shares a filter
            lists = 0.0
            for low in range(0, PAIRS, DECODED):
                (ra, ka, ta), (rb, kb, tb) = (decoded(x[low:low + DECODED], size, height) for x in (a, b))
                lists += len(ra) / PAIRS
                span = ROTATIONS * size ** BLOCKS
                _, i, j = np.intersect1d(ra * span + ka, rb * span + kb, assume_unique=True, return_indices=True)
                np.maximum.at(seen, low + ra[i], np.minimum(ta[i], tb[j]))
            if (seen > -np.inf).mean() >= RECALL or height < -1:
                break
            if lists > 8 * LONGEST_LIST:
                break
            height -= 0.03
        found = float(np.sort(seen)[int((1 - RECALL) * PAIRS)]) - 1e-9
        if found > -np.inf:
            kept = sum((decoded(a[low:low + DECODED], size, found)[0].size for low in range(0, PAIRS, DECODED))) / PAIRS
            if kept <= LONGEST_LIST or size <= 4:
                return size, found
        size = max(2, size // 2)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Unit vectors in double precision; the largest component is divided out first, so nothing overflows."""
    v = column.flatten().to_numpy().reshape(rows, -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def filter_lists(nodes: DataFrame, settings: dict[int, tuple[int, float]]) -> DataFrame:
    """node, label, dim, weight, vector and the sorted filter numbers of every node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                for low in range(a, b, DECODED):
                    part = batch.slice(low, min(DECODED, b - low))
                    row, key, _ = decoded(_matrix(part.column("vector"), part.num_rows), *settings[int(dims[a])])
                    order = np.lexsort((key, row))
                    ends = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order]))],
                        [*part.schema.names, "filters"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, schema + ", filters array<long>")


def _lowest(near: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component in a graph given by a symmetric matrix."""
    lowest = np.arange(len(near))
    while True:
        new = np.minimum(lowest, np.where(near, lowest[None, :], len(near)).min(axis=1, initial=len(near)))
        new = new[new]
        if (new == lowest).all():
            return new
        lowest = new


def _shared_before(sides: list[tuple[np.ndarray, np.ndarray]], sizes: tuple[int, int]) -> np.ndarray:
    """Whether a row of each side share a filter, from (filter, row) of either side, sorted by filter."""
    out = np.zeros(sizes, bool)
    common = np.intersect1d(sides[0][0], sides[1][0])
    if not len(common):
        return out
    spots = []
    for keys, rows in sides:
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        good = common[at] == keys
        spots.append((at[good], rows[good]))
    for low in range(0, len(common), COLUMNS):
        parts = []
        for (at, rows), n in zip(spots, sizes):
            a, b = np.searchsorted(at, [low, low + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(common) - low)), np.float32)
            m[rows[a:b], at[a:b] - low] = 1
            parts.append(m)
        out |= (parts[0] @ parts[1].T) > 0
    return out


def _earlier(filters: list[np.ndarray], key: int) -> tuple[np.ndarray, np.ndarray]:
    """(filter, row) of the filters before `key`, sorted by filter."""
    parts = [f[:np.searchsorted(f, key)] for f in filters]
    keys, rows = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(keys, kind="stable")
    return keys[order], rows[order]


def _compared(key: int, x: dict, y: dict | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, smallest node of its part of the graph, weight of its links; linked nodes only.

    With y, the links between x and y; without, those inside x. Where filters are given, `key` is the filter in which
    the nodes met: only links between different stars count, and only where no earlier filter has both nodes.
    """
    other = x if y is None else y
    near = x["v"] @ other["v"].T >= least
    if y is None:
        np.fill_diagonal(near, False)
    if "filters" in x:
        near &= x["star"][:, None] != other["star"][None, :]
    if not near.any():
        return (np.empty(0, np.int64),) * 3
    px = np.flatnonzero(near.any(axis=1))
    py = px if y is None else np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(px, py)]
    first = near
    if "filters" in x:
        fx = _earlier([x["filters"][i] for i in px], key)
        fy = fx if y is None else _earlier([other["filters"][i] for i in py], key)
        first = near & ~_shared_before([fx, fy], near.shape)
    nx, ny = x["node"][px], other["node"][py]
    if y is None:
        nodes, whole, links = nx, near, first @ x["weight"][px]
    else:
        nodes = np.concatenate([nx, ny])
        whole = np.zeros((len(nodes), len(nodes)), bool)
        whole[:len(nx), len(nx):] = near
        whole[len(nx):, :len(nx)] = near.T
        links = np.concatenate([first @ other["weight"][py], first.T @ x["weight"][px]])
    order = np.argsort(nodes)
    lowest = np.empty(len(nodes), np.int64)
    lowest[order] = nodes[order][_lowest(whole[np.ix_(order, order)])]
    return nodes, lowest, links


def _in_blocks(members: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """The members of every key in all pairs (i, j) of its blocks, i <= j; `side` 1 are those of block j."""
    rows = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col(blocks))).select(
        *keys, "node", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)).alias("away"))
    return rows.select(*keys, F.least("own", "away").alias("i"), F.greatest("own", "away").alias("j"),
                       (F.col("own") > F.col("away")).cast("int").alias("side"), "node")


def compared_cells(rows: DataFrame, cell: list[str], least: float) -> DataFrame:
    """node, hub, links: what the comparison of every cell's blocks found for its nodes.

    `cell` ends with the key (a long) and the blocks i and j. `rows` has cell, side, node, weight, vector, and star and
    filters where stars are compared.
    """
    cell = [*cell, "i", "j"]
    names = [n for n in ("node", "weight", "star") if n in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []

        def side_of(no: int) -> dict | None:
            mine = [p for p in parts if p["side"] == no]
            if not mine:
                return None
            out = {n: np.concatenate([p[n] for p in mine]) for n in (*names, "v")}
            return out | ({"filters": [f for p in mine for f in p["filters"]]} if "star" in names else {})

        def close() -> tuple[np.ndarray, ...] | None:
            if here is None:
                return None
            x, y = side_of(0), side_of(1)
            if x is None or here[-1] == here[-2] and len(x["node"]) < 2 or here[-1] != here[-2] and y is None:
                return None
            return _compared(here[-3], x, y, least)

        def found_rows(found: list) -> pa.RecordBatch:
            found = [f for f in found if f is not None]
            columns = [np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["node", "hub", "links"])

        for batch in batches:
            places = list(zip(*[batch.column(n).to_pylist() for n in (*cell, "side")]))
            columns = {n: batch.column(n).to_numpy() for n in names}
            found, a = [], 0
            while a < len(places):
                b = a + 1
                while b < len(places) and places[b] == places[a]:
                    b += 1
                if places[a][:-1] != here:
                    found.append(close())
                    here, parts = places[a][:-1], []
                part = {n: c[a:b] for n, c in columns.items()} | {"side": places[a][-1]}
                part["v"] = _matrix(batch.column("vector").slice(a, b - a), b - a)
                if "star" in names:
                    own = batch.column("filters").slice(a, b - a)
                    part["filters"] = np.split(own.flatten().to_numpy(), np.cumsum(own.value_lengths().to_numpy())[:-1])
                parts.append(part)
                a = b
            yield found_rows(found)
        yield found_rows([close()])

    return rows.repartition(*cell).sortWithinPartitions(*cell, "side").mapInArrow(run, "node long, hub long, links long")


def near_pairs(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (dim, a, b) of similar vectors.

    Pairs are dealt to the cells of a grid by hashes of both nodes, PAIRS_IN_CELL to a cell on average: a vector travels
    once per cell, not once per pair, and no node makes a large cell.
    """
    side = max(1, math.ceil(math.sqrt(pairs.count() / PAIRS_IN_CELL)))
    place = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b"), F.lit(side))
    pairs = pairs.select("dim", place.alias("cell"), "a", "b")
    wanted = pairs.select("cell", F.col("a").alias("node")).union(pairs.select("cell", F.col("b").alias("node"))).distinct()
    none = F.lit(None)
    rows = (wanted.join(nodes.select("node", "dim", "vector"), "node")
            .select("dim", "cell", F.col("node").alias("a"), none.cast("bigint").alias("b"), "vector")
            .union(pairs.select("dim", "cell", "a", "b", none.cast(nodes.schema["vector"].dataType))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors = None, [], []
        for batch in batches:
            head = np.stack([batch.column(n).to_numpy() for n in ("dim", "cell")])
            known = np.asarray(batch.column("b").is_null())
            cuts = np.flatnonzero(np.any(np.diff(head, axis=1), axis=0) | (np.diff(known.astype(np.int8)) != 0)) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if (now := tuple(head[:, a].tolist())) != here:
                    here, ids, vectors = now, [], []
                part = batch.slice(a, b - a)
                first = part.column("a").to_numpy()
                if known[a]:
                    ids.append(first)
                    vectors.append(_matrix(part.column("vector"), b - a))
                    continue
                if len(ids) > 1 or len(vectors) == 1 and not np.all(np.diff(ids[0]) > 0):
                    all_ids = np.concatenate(ids)
                    order = np.argsort(all_ids)
                    ids, vectors = [all_ids[order]], [np.concatenate(vectors)[order]]
                second = part.column("b").to_numpy()
                x, y = (vectors[0][np.searchsorted(ids[0], side)] for side in (first, second))
                near = np.einsum("ij,ij->i", x, y) >= least
                out.append((np.full(near.sum(), now[0]), first[near], second[near]))
            columns = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["dim", "a", "b"])

    return (rows.select(F.col("dim").cast("bigint").alias("dim"), "cell", "a", "b", "vector").repartition("dim", "cell")
            .sortWithinPartitions("dim", "cell", F.asc_nulls_first("b")).mapInArrow(run, "dim long, a long, b long"))


def found_links(lists: DataFrame, least: float) -> DataFrame:
    """node, hub, links: parts of every node's links, each link in one of them, and a smaller linked node."""
    place = ["label", "dim", "key"]
    keys = lists.select("label", "dim", "node", F.explode("filters").alias("key"))
    filters = (keys.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"), F.max("node").alias("last"))
               .where("n > 1"))
    # A table of its own, so that Spark can split the rows of a filter with very many nodes.
    filters = saved(filters, "filters")
    members = saved(keys.join(small_side(filters.select(*place, "hub")), place), "members")

    # Every node with the smallest one of its filters; its star is the smallest that it is linked with.
    pairs = saved(members.where("node <> hub").select("dim", F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    links = saved(near_pairs(pairs, lists, least), "links")
    stars = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("star"))
    stars = saved(lists.select("node").join(stars, "node", "left").select("node", F.coalesce("star", "node").alias("star")), "stars")

    # Inside the stars: all pairs, block by block.
    sizes = saved(stars.groupBy("star").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1").drop("n"), "sizes")
    inside = _in_blocks(stars.join(sizes, "star"), ["star"], "blocks").withColumnRenamed("star", "key")
    inside = inside.join(lists.select("node", "weight", "vector"), "node")
    inside = saved(compared_cells(inside, ["key"], least), "found")

    # Between stars: filters in which several meet. Two nodes alone that are not linked are done.
    known = links.select("dim", F.col("a").alias("last"), F.col("b").alias("hub"))
    two = filters.where("n = 2").join(known, ["dim", "hub", "last"], "left_semi")
    open_ = saved(filters.where("n > 2").select(*place).union(two.select(*place)), "open")
    members = members.join(small_side(open_), place, "left_semi").join(stars, "node")
    mixed = (members.groupBy(*place).agg(F.min("star").alias("a"), F.max("star").alias("b"), F.ceil(
        F.count(F.lit(1)) / BLOCK).alias("blocks")).where("a < b").select(*place, "blocks"))
    members = saved(members.select(*place, "node"), "members")
    across = _in_blocks(members.join(small_side(saved(mixed, "mixed")), place), place, "blocks")
    across = across.join(stars, "node").join(lists.drop("label", "dim"), "node")
    return inside.union(saved(compared_cells(across, place, least), "found"))


def linked_vectors(df: DataFrame, least: float = LEAST, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    v = F.col("vector")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                     F.col(f"`{vector_col}`").alias("vector"))
    usable = (F.col("label").isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < math.inf, F.lit(False)))
              & F.exists(v, lambda x: x != 0))
    rows = rows.select("vec_id", "label", "vector", F.coalesce(usable, F.lit(False)).alias("usable"))
    copies = rows.where("usable").groupBy("label", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"))
    nodes = saved(copies.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vector").alias("dim"),
                                "weight", "least_id", "vector"), "nodes")
    # One row for each length of vectors.
    most = nodes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    settings = {r["dim"]: tuned(r["dim"], r["n"], least) for r in most}
    lists = saved(filter_lists(nodes.drop("least_id"), settings), "lists")
    found = found_links(lists, least)
    groups = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    ids = nodes.select("node", "least_id").join(groups, "node").groupBy("component").agg(F.min("least_id").alias("group_id"))
    ids = groups.join(ids, "component").select("node", "group_id")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.join(links, "node", "left").join(ids, "node", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("group_id", "least_id").alias("component_id"))
    per_node = saved(per_node, "results")
    same = F.col("usable") & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))
    zero = F.lit(0).cast("bigint")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.join(per_node, same, "left").select(
        "vec_id", F.coalesce("n_links", zero).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


LINKED_VECTORS_SQL = """
WITH RECURSIVE sound AS (
    SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (
    SELECT * FROM sound
    WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
    SELECT r, r AS b FROM sound
    UNION
    SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.b),
groups AS (
    SELECT reach.r, min(sound.vec_id) AS component_id FROM reach JOIN sound ON sound.r = reach.b GROUP BY reach.r),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT s.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, g.component_id, coalesce(s.vec_id = g.component_id, true) AS kept
FROM sound s JOIN groups g ON g.r = s.r LEFT JOIN counts c ON c.a = s.r"""
