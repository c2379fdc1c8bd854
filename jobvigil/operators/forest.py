"""Isolation forest: trees grown as independent tasks, the model a small table, scoring in Arrow batches.

Splits are random hyperplanes (extended isolation forest, Hariri et al.) or, with
``axis_parallel``, cuts of single features (Liu et al.). A model has at most
``trees * (2 * sample - 1)`` rows by construction, so it can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobvigil.config import DEFAULTS, FOREST, Settings
from jobvigil.functions.scores import forest_text, safe_ratio
from jobvigil.operators.metrics import with_rates
from jobvigil.schema import FOREST_MODEL
from jobvigil.session import ship_package

# The features in the order the model reads them.
FEATURES = ("duration_seconds", "error_rate", "row_count", "hour_of_day", "day_of_week")
EULER = 0.5772156649015329
# Nodes that any model may have; checked before a forest is grown. 2000 trees of 1024 rows are a few hundred MB at most.
MODEL_ROW_LIMIT = 2000 * (2 * 1024 - 1)


def training_matrix(df: DataFrame, source: str = "history") -> DataFrame:
    """``row_key`` and ``features``.

    From ``history`` (feature vectors of completed runs) all five are real; from
    ``state`` (metrics state) duration, error rate and row count are means and
    the two calendar features are 0.
    """
    if source == "history":
        return df.select(F.col("event_id").alias("row_key"), _vector([F.col(c) for c in FEATURES]).alias("features"))
    rated = with_rates(df)
    means = [
        F.col("mean_duration_seconds"), F.col("error_rate"),
        safe_ratio(F.col("sum_rows"), F.col("run_count")), F.lit(0.0), F.lit(0.0),
    ]
    return rated.select(F.col("job_type").alias("row_key"), _vector(means).alias("features"))


def last_days(history: DataFrame, days: int = 7) -> DataFrame:
    """Completed runs within ``days`` before the newest one: the window of a periodic re-fit."""
    newest = history.agg(F.max("ts")).scalar()
    return history.filter(F.col("ts") >= newest - F.expr(f"INTERVAL {days} DAYS"))


def enough_rows(matrix: DataFrame, min_rows: int = DEFAULTS.forest_min_rows) -> bool:
    """The fit gate: stops reading as soon as enough rows were seen."""
    return matrix.limit(min_rows).count() >= min_rows


def fit_or_none(matrix: DataFrame, settings: Settings = DEFAULTS, seed: int = 7) -> DataFrame | None:
    """The model, or None when there are too few rows to fit one."""
    if not enough_rows(matrix, settings.forest_min_rows):
        return None
    return fit_forest(matrix, settings.forest_trees, settings.forest_sample, seed)


def fit_forest(
    matrix: DataFrame,
    trees: int = 100,
    sample: int = 256,
    seed: int = 7,
    axis_parallel: bool = False,
) -> DataFrame:
    """Grow ``trees`` trees, each on its own ``sample`` rows, and return the model table."""
    if trees * (2 * sample - 1) > MODEL_ROW_LIMIT:
        raise ValueError(f"a forest may have {MODEL_ROW_LIMIT} nodes; {trees} trees of {sample} rows can have more")
    ship_package(matrix.sparkSession)
    drawn = draw_samples(matrix, trees, sample, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values("row_key")
        points = np.vstack(ordered["features"].to_numpy()).astype("float64")
        return grow_tree(points, tree, np.random.default_rng([seed, tree]), axis_parallel)

    return drawn.groupBy("tree").applyInPandas(grow, FOREST_MODEL)


def draw_samples(matrix: DataFrame, trees: int, sample: int, seed: int) -> DataFrame:
    """``tree``, ``row_key`` and ``features``: an independent draw without replacement per tree.

    A tree draws the ``sample`` rows with the lowest numbers, a row's number being a hash
    of its key, mixed for each tree; all rows if there are fewer. Each task keeps the lowest
    of its own rows in one pass, and the lowest of those are the lowest of all, so the
    rule is the same at every size and a draw can be repeated. A task hands on at most
    ``trees * sample`` rows.
    """
    ship_package(matrix.sparkSession)
    keyed = matrix.select("row_key", "features", F.xxhash64(F.lit(f"draw {seed}"), "row_key").alias("_hash"))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[pa.Table] = []  # rows that some tree may still draw
        bounds, size, limit = [None] * trees, 0, 2 * trees * sample

        def tighten() -> pa.Table:
            rows = pa.concat_tables(pool).combine_chunks()
            hashes, needed = rows.column("_hash").to_numpy(), np.zeros(rows.num_rows, dtype=bool)
            for tree, chosen in enumerate(_lowest(rows, trees, sample)):
                needed[chosen] = True
                if len(chosen) == sample:
                    bounds[tree] = turns(hashes[chosen], tree).max()
            return rows.filter(pa.array(needed))

        for batch in batches:
            hashes = batch.column("_hash").to_numpy(zero_copy_only=False)
            wanted = np.zeros(len(hashes), dtype=bool)
            for tree, bound in enumerate(bounds):
                if bound is None:
                    wanted[:] = True
                    break
                wanted |= turns(hashes, tree) <= bound
            pool.append(pa.Table.from_batches([batch]).filter(pa.array(wanted)))
            size += pool[-1].num_rows
            if size > limit:
                pool = [tighten()]
                size = pool[0].num_rows
        if size:
            held = tighten().combine_chunks()
            numbers = held.column("_hash").to_numpy()
            for tree, chosen in enumerate(_lowest(held, trees, sample)):
                turn = pa.array(turns(numbers[chosen], tree).view(np.int64))
                own = held.take(pa.array(chosen)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(chosen), tree, dtype=np.int32)), own.column("row_key"), own.column("features"), turn], ["tree", "row_key", "features", "_turn"])

    schema = T.StructType([T.StructField("tree", T.IntegerType()), matrix.schema["row_key"], matrix.schema["features"], T.StructField("_turn", T.LongType())])
    offered = keyed.mapInArrow(lowest, schema)
    ranked = offered.withColumn("_rank", F.row_number().over(Window.partitionBy("tree").orderBy("_turn", "row_key")))
    return ranked.filter(F.col("_rank") <= sample).drop("_rank", "_turn")


def turns(hashes: np.ndarray, tree: int) -> np.ndarray:
    """The numbers by which a tree draws, from hashes of the rows' keys: 63 bits, so that they sort alike with and without a sign."""
    mixed = hashes.astype(np.int64).view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(31))) >> np.uint64(1)


def _lowest(rows: pa.Table, trees: int, sample: int) -> Iterator[np.ndarray]:
    """For each tree, the places of its lowest rows; ties by key."""
    hashes = rows.column("_hash").to_numpy()
    keys = None
    for tree in range(trees):
        turn = turns(hashes, tree)
        if len(turn) <= sample:
            yield np.arange(len(turn))
            continue
        bound = np.partition(turn, sample - 1)[sample - 1]
        chosen = np.flatnonzero(turn <= bound)
        if len(chosen) > sample:  # equal numbers at the bound
            keys = rows.column("row_key").to_pylist() if keys is None else keys
            chosen = np.array(sorted(chosen.tolist(), key=lambda i: (turn[i], keys[i] is not None, keys[i] or "")))[:sample]  # noqa: B023
        yield chosen


def grow_tree(points: np.ndarray, tree: int, rng: np.random.Generator, axis_parallel: bool) -> pd.DataFrame:
    """One tree as rows of the model table. Bounded work: ``points`` is one draw."""
    size, width = points.shape
    limit = int(np.ceil(np.log2(max(size, 2))))
    nodes: list[dict | None] = [None]
    waiting = [(0, np.arange(size), 0)]
    while waiting:
        node, members, depth = waiting.pop()
        held = points[members]
        if depth >= limit or len(members) <= 1 or np.all(held == held[0]):
            nodes[node] = _leaf(tree, node, depth + float(expected_path(len(members))), size)
            continue
        low, high = held.min(axis=0), held.max(axis=0)
        if axis_parallel:
            normal = np.zeros(width)
            normal[rng.choice(np.flatnonzero(high > low))] = 1.0
        else:
            normal = rng.standard_normal(width)
        offset = float(rng.uniform(low, high) @ normal)
        below = held @ normal <= offset
        left, right = len(nodes), len(nodes) + 1
        nodes.extend((None, None))
        waiting.append((left, members[below], depth + 1))
        waiting.append((right, members[~below], depth + 1))
        nodes[node] = {
            "tree": tree, "node": node, "left": left, "right": right,
            "normal": normal.tolist(), "offset": offset, "path_length": None, "sample_size": size,
        }
    frame = pd.DataFrame(nodes, columns=FOREST_MODEL.names)
    return frame.astype({"left": "Int32", "right": "Int32"})


def _leaf(tree: int, node: int, path_length: float, size: int) -> dict:
    return {
        "tree": tree, "node": node, "left": None, "right": None, "normal": None, "offset": None,
        "path_length": path_length, "sample_size": size,
    }


def expected_path(n):
    """Mean depth of an unsuccessful search among n points: c(n) = 2 H(n-1) - 2 (n-1) / n."""
    n = np.asarray(n, dtype="float64")
    rest = np.maximum(n - 1.0, 1.0)
    harmonic = np.log(rest) + EULER
    long = 2.0 * harmonic - 2.0 * rest / np.maximum(n, 1.0)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


class PackedForest:
    """The model as arrays per tree. A leaf is its own child, so all rows walk the same number of levels."""

    def __init__(self, model: pd.DataFrame):
        self.trees = [self._pack(rows.sort_values("node")) for _, rows in model.groupby("tree")]
        self.norm = float(expected_path(model["sample_size"].max())) or 1.0

    @staticmethod
    def _pack(rows: pd.DataFrame) -> tuple:
        inner = rows["left"].notna().to_numpy()
        own = np.arange(len(rows))
        left = np.where(inner, rows["left"].fillna(0).to_numpy("int64"), own)
        right = np.where(inner, rows["right"].fillna(0).to_numpy("int64"), own)
        normal = np.zeros((len(rows), len(FEATURES)))
        if inner.any():
            normal[inner] = np.vstack(rows["normal"].to_numpy()[inner])
        depth = np.zeros(len(rows), dtype="int64")
        for node in np.flatnonzero(inner):  # parents come before their children
            depth[left[node]] = depth[right[node]] = depth[node] + 1
        offset = rows["offset"].fillna(0.0).to_numpy("float64")
        path = rows["path_length"].fillna(0.0).to_numpy("float64")
        return left, right, normal, offset, path, int(depth.max())

    def score(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        row = np.arange(len(points))
        for left, right, normal, offset, path, levels in self.trees:
            below = points @ normal.T <= offset
            at = np.zeros(len(points), dtype="int64")
            for _ in range(levels):
                at = np.where(below[row, at], left[at], right[at])
            total += path[at]
        return np.power(2.0, -(total / len(self.trees)) / self.norm)


def forest_score(df: DataFrame, model: DataFrame, score: str = "score") -> DataFrame:
    """Add the score 2^(-E[h]/c(n)) in (0, 1) from the five feature columns of ``df``.

    ``fit_forest`` makes no model of more than ``MODEL_ROW_LIMIT`` nodes; a table that is
    larger is no such model and is refused before it is collected whole.
    """
    ship_package(df.sparkSession)
    rows = model.limit(MODEL_ROW_LIMIT + 1).toPandas()
    if len(rows) > MODEL_ROW_LIMIT:
        raise ValueError("not a forest model: more nodes than any allowed forest can have")
    if rows.empty:
        raise ValueError("the forest model is empty")
    shared = df.sparkSession.sparkContext.broadcast(PackedForest(rows))

    @F.pandas_udf("double")
    def rate(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest = shared.value
        for features in batches:
            yield pd.Series(forest.score(np.column_stack([f.to_numpy("float64") for f in features])))

    return df.withColumn(score, rate(*[F.col(c).cast("double") for c in FEATURES]))


def forest_verdict(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``anomalous``, ``reason`` and ``detector_name`` to a forest score."""
    return df.withColumns({
        "anomalous": F.col("score") > settings.forest_threshold,
        "reason": forest_text(F.col("score"), settings.forest_threshold),
        "detector_name": F.lit(FOREST),
    })


def _vector(columns: list[Column]) -> Column:
    return F.array(*[c.cast("double") for c in columns])
