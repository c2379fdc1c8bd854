"""Nearest neighbours by a tree of k-means: the leaves that look closest are searched first.

The tree is fitted on a bounded sample; every vector is filed under a leaf. A query
walks the tree with a priority queue of nodes by the distance to their centres, and
visits as many leaves as a calibration says: for a bounded sample of the queries the
exact neighbours are found by going through all vectors, and the visits are widened
until the leaves visited hold the wanted part of them. Where these leaves hold too few
rows for a query's neighbours, it goes on to the next ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobvigil.llm.common import ready


@dataclass(frozen=True)
class Search:
    """``sample``: vectors the tree is fitted on. ``trials``: queries that the visits are calibrated by.

    ``block``: rows of a leaf, and queries at it, that meet in one task at most, on average.
    """

    k: int = 10
    sample: int = 16_384
    branching: int = 8
    per_leaf: int = 64
    trials: int = 64
    recall: float = 0.98
    block: int = 2048


@dataclass(frozen=True)
class Tree:
    """Node 0 is the root. ``centres[i]`` of node i; ``children[i]``, or none for a leaf."""

    centres: object
    children: list[list[int]]

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)


def fit_tree(vectors, search: Search) -> Tree:
    """Splits by k-means, with ``branching`` centres a node, while a node has more than ``per_leaf`` of the sample."""
    import numpy as np

    rng = np.random.default_rng(7)
    centres, children = [vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])], [[]]
    waiting = [(0, vectors)]
    while waiting:
        node, own = waiting.pop()
        distinct = np.unique(own, axis=0)
        if len(own) <= search.per_leaf or len(distinct) < 2:
            continue
        k = min(search.branching, len(distinct))
        means = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(10):
            near = _nearest(own, means)
            means = np.stack([own[near == j].mean(axis=0) if (near == j).any() else means[j] for j in range(len(means))])
        near = _nearest(own, means)
        used = [j for j in range(len(means)) if (near == j).any()]
        if len(used) < 2:
            continue
        for j in used:
            centres.append(means[j]), children.append([])
            children[node].append(len(centres) - 1)
            waiting.append((len(centres) - 1, own[near == j]))
    return Tree(np.stack(centres), children)


def _nearest(rows, means):
    import numpy as np

    out = np.empty(len(rows), dtype=np.int64)
    for at in range(0, len(rows), 4096):
        some = rows[at : at + 4096]
        out[at : at + 4096] = ((means**2).sum(axis=1)[None, :] - 2 * some @ means.T).argmin(axis=1)
    return out


def leaf_of(tree: Tree, vectors):
    """The leaf of each vector: down the tree by the nearest centre."""
    import numpy as np

    node = np.zeros(len(vectors), dtype=np.int64)
    waiting = [(0, np.arange(len(vectors)))]
    while waiting:
        at, rows = waiting.pop()
        below = tree.children[at]
        if not below or not len(rows):
            node[rows] = at
            continue
        near = _nearest(vectors[rows], tree.centres[below])
        waiting += [(child, rows[near == j]) for j, child in enumerate(below)]
    return node


def best_leaves(tree: Tree, vector, visits: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
    """The first ``visits`` leaves, taking always the closest node seen so far; more, until they hold ``least`` rows by ``held``."""
    import numpy as np

    queue, out, rows = [(0.0, 0)], [], 0
    while queue and (len(out) < visits or rows < least):
        _, node = heapq.heappop(queue)
        below = tree.children[node]
        if not below:
            out.append(node)
            rows += held.get(node, 0) if held else 0
            continue
        far = np.sqrt(((tree.centres[below] - vector) ** 2).sum(axis=1))
        for d, child in zip(far.tolist(), below, strict=True):
            heapq.heappush(queue, (d, child))
    return out


def usable(vector: Column) -> Column:
    """Not null, not empty, all components there and finite, not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column, width: int):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width)


def _top(ids, far, own: int, k: int):
    """Places of the k smallest distances, ties by id, without the query's own id."""
    import numpy as np

    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        edge = np.partition(far[keep], k - 1)[k - 1]
        keep = keep[far[keep] <= edge]
    return keep[np.lexsort((ids[keep], far[keep]))][:k]


def nearest_neighbours(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that ``queries`` is true of.

    The score is the Euclidean distance in double precision, smaller is nearer, ties by
    key. A query's own key is no candidate. Rows with a null key or an unusable vector
    (null, empty, zero, a component missing or not finite, or another length than most)
    take no part. Rows that repeat a key are candidates each. Fewer rows than k give
    fewer neighbours; an empty table gives none. Other columns are ignored.
    """
    import numpy as np

    spark = vectors.sparkSession
    parts = ready(spark)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], result)
    width, n = widths[0]["width"], widths[0]["n"]
    rows = rows.where(F.size("v") == width)
    draw = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < min(1.0, search.sample / n)).select("id", "v").toArrow().sort_by("id")
    tree = fit_tree(_matrix(sample["v"].combine_chunks(), width) if sample.num_rows else np.zeros((0, width)), search)

    def file(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                leaf = leaf_of(tree, _matrix(batch.column(1), width))
                yield pa.record_batch([*batch.columns, pa.array(leaf, pa.int32())], names=["id", "v", "asked", "leaf"])

    filed = rows.mapInArrow(file, "id long, v array<double>, asked boolean, leaf int").checkpoint()
    visits = calibrate(filed, tree, width, search)
    held = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                leaves = []
                for v, own in zip(_matrix(batch.column(1), width), batch.column(2).to_pylist(), strict=True):
                    # rows with the query's own key are no candidates; most queries have one, in the first leaf or near it
                    others = {**held, **{r["leaf"]: held[r["leaf"]] - r["n"] for r in own}} if own else held
                    leaves.append(best_leaves(tree, v, visits, others, search.k if own else search.k + 1))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(leaves, pa.list_(pa.int32()))], names=["id", "v", "leaves"])

    # leaves of the keys that are repeated; other queries leave out one row
    repeated = filed.groupBy("id", "leaf").agg(F.count("*").alias("n")).groupBy("id").agg(F.collect_list(F.struct("leaf", "n")).alias("own"), F.sum("n").alias("n")).where("n > 1").select("id", "own")
    asked = filed.where("asked").select("id", "v").join(repeated, "id", "left").select("id", "v", "own").mapInArrow(walk, "id long, v array<double>, leaves array<int>").select("id", "v", F.explode("leaves").alias("leaf"))
    # how many blocks a leaf's rows and queries are dealt to: one row per leaf
    blocks = lambda frame, name: frame.groupBy("leaf").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / search.block)).cast("int").alias(name))
    plan = F.broadcast(blocks(filed, "row_blocks").join(blocks(asked.select("leaf"), "query_blocks"), "leaf"))
    salt = lambda seed, of: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    meet = ["leaf", "rb", "qb"]
    side_rows = filed.select("id", "v", "leaf").join(plan, "leaf").withColumn("rb", salt(2, "row_blocks")).withColumn("qb", every("query_blocks")).select(*meet, "id", "v")
    side_asked = asked.join(plan, "leaf").withColumn("qb", salt(3, "query_blocks")).withColumn("rb", every("row_blocks")).select(*meet, "id", "v")

    def compare(ours, theirs):
        import pyarrow as pa

        out = ([], [], [])
        if ours.num_rows and theirs.num_rows:
            ids, m = ours["id"].to_numpy(), _matrix(ours["v"].combine_chunks(), width)
            for own, q in zip(theirs["id"].to_pylist(), _matrix(theirs["v"].combine_chunks(), width), strict=True):
                far = np.sqrt(((m - q) ** 2).sum(axis=1))
                for i in _top(ids, far, own, search.k).tolist():
                    out[0].append(own), out[1].append(int(ids[i])), out[2].append(float(far[i]))
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    near = side_rows.repartition(parts, *meet).groupBy(*meet).cogroup(side_asked.repartition(parts, *meet).groupBy(*meet)).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(filed: DataFrame, asked: list[tuple[int, list[float]]], width: int, k: int) -> DataFrame:
    """The k nearest of all rows for a bounded list of queries, each task going through its rows: query_id, vec_id, leaf, score."""
    import numpy as np

    keys, q = [a[0] for a in asked], np.array([a[1] for a in asked], dtype=np.float64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, leaf, m = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1), width)
            out = []
            for own, v in zip(keys, q, strict=True):
                far = np.sqrt(((m - v) ** 2).sum(axis=1))
                out += [(own, int(ids[i]), int(leaf[i]), float(far[i])) for i in _top(ids, far, own, k)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["query_id", "vec_id", "leaf", "score"])

    near = filed.select("id", "v", "leaf").mapInArrow(run, "query_id long, vec_id long, leaf int, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def calibrate(filed: DataFrame, tree: Tree, width: int, search: Search) -> int:
    """The fewest visits at which the leaves hold ``recall`` of the exact neighbours of the trial queries."""
    trials = filed.where("asked").select("id", "v").orderBy(F.xxhash64("id", F.lit(4)), "id").limit(search.trials).collect()
    if not trials:
        return 1
    asked = [(r["id"], list(r["v"])) for r in trials]
    true = exact_neighbours(filed, asked, width, search.k).select("query_id", "leaf").collect()
    place = {own: {leaf: i for i, leaf in enumerate(best_leaves(tree, v, tree.leaves))} for own, v in asked}
    needed = sorted(place[r["query_id"]][r["leaf"]] + 1 for r in true)
    if not needed:
        return 1
    return needed[min(len(needed), max(1, -int(-search.recall * len(needed) // 1))) - 1]
