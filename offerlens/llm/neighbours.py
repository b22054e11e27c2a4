"""Approximate nearest neighbours by a forest of random-projection trees.

A tree splits at the median of the projections on the line through two random sample vectors. A query goes down all
trees through one priority queue: a node's priority is the sum of the squared distances to the planes that were crossed
to reach it, so the leaves are opened in the order of promise over the whole forest, until they hold ``share`` times as
many rows as there are vectors (a row counts once per tree). The rows of these leaves are reranked by exact distance.

The forest is fitted on a bounded sample; every vector is indexed, in every tree. Equal vectors are one candidate that
stands for its smallest ids, so copies cannot crowd a leaf. A leaf is cut into blocks of bounded size; queries stream
past a block.

The share that a recall needs depends on the vectors: independent ones of 64 dimensions, as in the test tables, have no
near neighbours to speak of and need over half of the rows; clustered ones need few leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import op, table
from offerlens.session import staged

K, TREES, DEPTH, SHARE = 10, 8, 6, 1.4
#: Vectors that the forest is fitted on, sample vectors that a leaf keeps at least, rows of a block.
SAMPLE, LEAST_LEAF, BLOCK = 8192, 8, 4096
SEED = 11


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: planes (tree, node, dimension) and offsets (tree, node); leaves follow the inner nodes."""

    planes: np.ndarray
    offsets: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        trees, inner, _ = self.planes.shape
        node = np.zeros((len(x), trees), dtype=np.int64)
        if self.depth:
            side = (x @ self.planes.reshape(trees * inner, -1).T).reshape(len(x), trees, inner) > self.offsets
            for _ in range(self.depth):
                node = 2 * node + 1 + np.take_along_axis(side, node[:, :, None], axis=2)[:, :, 0]
        return node - inner

    def search(self, query: np.ndarray, rows: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) in order of promise until they hold ``enough`` rows; ``rows`` by tree and leaf."""
        trees, inner, _ = self.planes.shape
        margin = (self.planes @ query - self.offsets) if self.depth else self.offsets
        heap = [(0.0, t, 0) for t in range(trees)]
        found, total = [], 0
        while heap and total < enough:
            cost, t, node = heapq.heappop(heap)
            if node >= inner:
                if rows[t, node - inner]:
                    found.append((t, node - inner))
                    total += int(rows[t, node - inner])
                continue
            m = float(margin[t, node])
            heapq.heappush(heap, (cost + max(m, 0.0) ** 2, t, 2 * node + 1))
            heapq.heappush(heap, (cost + max(-m, 0.0) ** 2, t, 2 * node + 2))
        return found


def grow(sample: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Fit a forest on sample vectors (rows)."""
    rng = np.random.default_rng(SEED)
    while depth and len(sample) < LEAST_LEAF << depth:
        depth -= 1
    inner, dim = (1 << depth) - 1, sample.shape[1]
    planes, offsets = np.zeros((trees, inner, dim)), np.zeros((trees, inner))
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            at = members.pop(node)
            direction = rng.normal(size=dim)
            if len(at) > 1:
                a, b = rng.choice(at, 2, replace=False)
                if (sample[a] != sample[b]).any():
                    direction = sample[a] - sample[b]
            direction /= np.linalg.norm(direction)
            p = sample[at] @ direction
            planes[t, node], offsets[t, node] = direction, np.median(p) if len(p) else 0.0
            right = p > offsets[t, node]
            members[2 * node + 1], members[2 * node + 2] = at[~right], at[right]
    return Forest(planes, offsets, depth)


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat if kind is None else flat.astype(kind)).reshape(-1, dim)


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, k1, k2): non-null id, and a vector of finite components, not all zero."""
    ok = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").alias("vec")).filter(F.col("vec_id").isNotNull() & ok)
    return rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})


def _rerank(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Nearest rows of each query within each block; a block's rows come before its queries."""
    now, ids, rows = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "vec"}
        cols = {n: c.to_numpy(zero_copy_only=False) for n, c in cols.items()}
        x = _matrix(batch.column(batch.schema.get_field_index("vec")), dim)
        key = np.stack([cols["tree"], cols["leaf"], cols["block"], cols["kind"]])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        out: list[list[np.ndarray]] = []
        for a, b in zip(cuts, cuts[1:]):
            block = tuple(key[:3, a].tolist())
            if block != now:
                now, ids, rows = block, [], []
            who = np.stack([cols["k1"][a:b], cols["k2"][a:b], cols["least"][a:b]])
            if key[3, a] == 0:
                ids.append(who)
                rows.append(x[a:b])
                continue
            if not rows:
                continue
            if len(rows) > 1:
                ids, rows = [np.concatenate(ids, axis=1)], [np.concatenate(rows)]
            for at in range(a, b, 32):
                q = x[at : min(at + 32, b)]
                d = np.sqrt(((q[:, None, :] - rows[0][None]) ** 2).sum(axis=2))
                n = min(k, d.shape[1])
                worst = np.partition(d, n - 1, axis=1)[:, n - 1]
                for i in range(len(q)):
                    near = np.flatnonzero(d[i] <= worst[i])
                    near = near[np.lexsort((ids[0][2][near], d[i][near]))[:n]]
                    out.append([np.full(n, who[0, at - a + i]), np.full(n, who[1, at - a + i]), ids[0][0][near], ids[0][1][near], ids[0][2][near], d[i][near]])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["q1", "q2", "k1", "k2", "least", "distance"])


def search(vectors: DataFrame, queries: Column, k: int = K, trees: int = TREES, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) that ``queries`` selects its ``k`` nearest.

    ``score`` is the Euclidean distance; ties go to the smaller id; a query's own id is never its neighbour. Rows with a
    null id or a vector that is null, empty, zero or holds a null or non-finite component take no part. Each query is
    answered among the vectors of its own length, by a forest per length. Rows equal in id and vector are one.
    """
    usable = _usable(vectors)
    lengths = sorted(r["dim"] for r in usable.filter(queries).select(F.size("vec").alias("dim")).distinct().collect())
    if not lengths:
        return usable.select(F.col("vec_id").cast("bigint").alias("query_id"), F.lit(0).alias("rank"), F.col("vec_id").cast("bigint").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.union, [_search(usable, queries, dim, k, trees, depth, share) for dim in lengths])


def _search(usable: DataFrame, queries: Column, dim: int, k: int, trees: int, depth: int, share: float) -> DataFrame:
    """``search`` among the vectors of length ``dim``."""
    spark = usable.sparkSession
    usable = usable.filter(F.size("vec") == dim)
    places = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    distinct = usable.withColumn("n", places).filter(F.col("n") <= k + 1).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.any_value("vec").alias("vec"))
    distinct = staged(distinct, "vectors")
    total = distinct.count()
    part = min(1.0, SAMPLE / total)
    sample = distinct.filter(F.pmod("k1", F.lit(1 << 30)) < part * (1 << 30)).select("k1", "k2", "vec").collect()
    sample.sort(key=lambda r: (r["k1"], r["k2"]))
    forest = grow(np.array([r["vec"] for r in sample], dtype=np.float64).reshape(-1, dim), trees, depth)
    shipped = spark.sparkContext.broadcast(forest)  # trees * 2 ** depth planes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shipped.value.leaves(_matrix(batch.column(0), dim))
            tree = np.broadcast_to(np.arange(leaf.shape[1]), leaf.shape)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ravel().astype(np.int32)), pa.array(leaf.ravel().astype(np.int32))], names=["tree", "leaf"])

    rows = np.zeros((trees, 1 << forest.depth), dtype=np.int64)
    for r in distinct.select("vec").mapInArrow(place, "tree int, leaf int").groupBy("tree", "leaf").count().collect():
        rows[r["tree"], r["leaf"]] = r["count"]
    sizes = spark.sparkContext.broadcast((rows, -(-rows // BLOCK)))
    vec_type = distinct.schema["vec"].dataType.simpleString()  # vectors move as they are stored and are compared in double precision
    schema = f"tree int, leaf int, block int, kind int, k1 bigint, k2 bigint, least bigint, vec {vec_type}"
    names = ["tree", "leaf", "block", "kind", "k1", "k2", "least", "vec"]

    def spread(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, blocks = sizes.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, stored = _matrix(batch.column(3), dim), _matrix(batch.column(3), dim, None)
                k2 = batch.column(1).to_numpy()
                if kind == 0:
                    leaf = shipped.value.leaves(x)
                    row = np.repeat(np.arange(len(x)), trees)
                    tree, leaf = np.tile(np.arange(trees), len(x)), leaf.ravel()
                    block = k2[row] % np.maximum(blocks[tree, leaf], 1)
                else:
                    hits = [(i, t, f, b) for i in range(len(x)) for t, f in shipped.value.search(x[i], counts, share * total) for b in range(blocks[t, f])]
                    row, tree, leaf, block = np.array(hits, dtype=np.int64).reshape(-1, 4).T
                for a in range(0, len(row), 8192):
                    at = slice(a, a + 8192)
                    take = row[at]
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1) * dim, pa.int32()), pa.array(stored[take].ravel()))
                    small = [pa.array(c.astype(np.int32)) for c in (tree[at], leaf[at], block[at], np.full(len(take), kind))]
                    yield pa.RecordBatch.from_arrays([*small, *[batch.column(j).take(pa.array(take)) for j in (0, 1, 2)], vec], names=names)

        return run

    asked = usable.filter(queries).select("vec_id", F.col("k1").alias("q1"), F.col("k2").alias("q2")).distinct()
    wanted = distinct.join(asked.select(F.col("q1").alias("k1"), F.col("q2").alias("k2")).distinct(), ["k1", "k2"], "left_semi")
    least = F.element_at("ids", 1).cast("bigint").alias("least")
    both = distinct.select("k1", "k2", least, "vec").mapInArrow(spread(0), schema).union(wanted.select("k1", "k2", least, "vec").mapInArrow(spread(1), schema))
    group = ["tree", "leaf", "block"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, *group).sortWithinPartitions(*group, "kind")
    near = ordered.mapInArrow(lambda it: _rerank(it, dim, k + 1), "q1 bigint, q2 bigint, k1 bigint, k2 bigint, least bigint, distance double")
    near = near.groupBy("q1", "q2", "k1", "k2").agg(F.min("least").alias("least"), F.min("distance").alias("distance"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("distance", "least"))).filter(F.col("n") <= k + 1)
    near = near.join(distinct.select("k1", "k2", "ids"), ["k1", "k2"])
    found = near.groupBy("q1", "q2").agg(F.collect_list(F.struct("distance", "ids")).alias("near"))  # k + 1 rows
    out = asked.withColumnRenamed("vec_id", "query_id").join(found, ["q1", "q2"])
    pairs = F.flatten(F.transform("near", lambda g: F.transform(g["ids"], lambda i: F.struct(g["distance"].alias("score"), i.alias("vec_id")))))
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["vec_id"] != F.col("query_id"))), 1, k)
    out = out.withColumn("best", best).select("query_id", F.posexplode("best").alias("at", "p"))
    return out.select(F.col("query_id").cast("bigint").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("p.vec_id").cast("bigint").alias("vec_id"), F.col("p.score").alias("score"))


@op("op6_nearest_neighbours")
def op6_nearest_neighbours(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
