"""Ordered scans on few, large keys.

A window over ``partitionBy(job_type)`` would put a third of all rows into one
task. Running sums and exponential averages are linear recurrences, so they can
be computed in blocks instead:

1. ``arrange`` range-partitions on (key, order columns). The order columns make
   rows unique, so Spark's sampled bounds cut a hot key, a hot hour, and even one
   hot instant into even blocks. The sorted blocks are checkpointed: every later
   pass must see the same blocks, also after an executor is lost.
2. Each block reports the state of its last key, one small record per block, and
   these are folded in block order. The driver holds at most one record per
   shuffle partition, whatever the number of rows or keys.
3. A last narrow pass starts every block from the state before it.

No pass after ``arrange`` shuffles.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobvigil.session import ensure_checkpoint_dir, ship_package

BLOCK = "scan_block"
EPSILON = 1e-9
# A deviation this small against the value is rounding noise of the mean.
NOISE = 1e-14


@dataclass(frozen=True)
class ScanSpec:
    """What a scan computes per key, in order.

    ``sums`` are columns that get a running total ``running_<column>``, current
    row included. ``value`` is the column for the exponential mean and deviation
    with weight ``alpha``; rows where it is null are not observed.

    To resume from stored state, put one row per key in front of its events whose
    ``sums`` hold the stored totals, ``value`` the stored mean, ``start_sigma``
    the stored deviation and ``weight`` the number of observations behind it
    (both null on event rows).
    """

    key: str
    sums: tuple[str, ...] = ()
    value: str | None = None
    alpha: float = 0.2
    start_sigma: str | None = None
    weight: str | None = None

    def reads(self) -> list[str]:
        named = [BLOCK, self.key, *self.sums, self.value, self.start_sigma, self.weight]
        return list(dict.fromkeys(c for c in named if c))


@dataclass(frozen=True)
class KeyState:
    """Where a scan stands within one key."""

    key: object
    sums: tuple
    observations: int = 0
    mu: float | None = None
    sigma: float | None = None


@dataclass(frozen=True)
class BlockSummary:
    """The last key of a block, as seen from the block alone."""

    block: int
    first_key: object
    end: KeyState
    single_key: bool
    first_value: float | None
    observed: int


def arrange(df: DataFrame, key: str, order_by: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Sorted, range-partitioned and checkpointed rows: the input of ``scan``.

    Without ``blocks`` the number of partitions is Spark's own, and adaptive
    execution merges small ones.
    """
    ensure_checkpoint_dir(df.sparkSession)
    columns = [key, *order_by]
    placed = df.repartitionByRange(blocks, *columns) if blocks else df.repartitionByRange(*columns)
    return placed.sortWithinPartitions(*columns).withColumn(BLOCK, F.spark_partition_id()).checkpoint()


def scan(arranged: DataFrame, spec: ScanSpec, drop: Sequence[str] = ()) -> DataFrame:
    """Add the running columns of ``spec`` to an arranged table, without a shuffle.

    Columns in ``drop`` are read by the scan but not handed on.
    """
    ship_package(arranged.sparkSession)
    carries = _carry_sums_and_mean(_summaries(arranged, spec, {}), spec)
    if spec.value and any(carry.mu is not None for carry in carries.values()):
        carries = _carry_deviation(_summaries(arranged, spec, carries), carries, spec)

    kept = [c for c in arranged.columns if c != BLOCK and c not in drop]
    schema = T.StructType([arranged.schema[c] for c in kept] + _added_fields(arranged.schema, spec))
    shared = arranged.sparkSession.sparkContext.broadcast(carries)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, started = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not started:
                state, started = shared.value.get(batch.column(BLOCK)[0].as_py()), True
            result = _scan_batch(batch, spec, state)
            state = result.end
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + list(result.columns.values()), kept + list(result.columns)
            )

    return arranged.mapInArrow(extend, schema)


def last_seen(arranged: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the last ``value`` that is not null, up to and with each row, within the key; no shuffle."""
    ship_package(arranged.sparkSession)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, end, seen = None, None, None, None
        single = True
        for batch in batches:
            if not batch.num_rows:
                continue
            if block is None:
                block, first = batch.column(BLOCK)[0].as_py(), batch.column(key)[0].as_py()
                end = first
            filled, keys = _fill(batch, key, value, (end, seen)), batch.column(key)
            end, seen = keys[-1].as_py(), filled[-1].as_py()
            single = single and end == first
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((block, first, end, seen, single))], pa.binary())], ["summary"])

    found = arranged.select(BLOCK, key, value).mapInArrow(summarise, "summary binary").collect()
    carries, current = {}, (None, None)
    for block, first, end, seen, single in sorted((pickle.loads(bytes(row.summary)) for row in found), key=lambda s: s[0]):
        carries[block] = current
        # a block of one key that saw no value hands on what came before
        current = (end, current[1] if seen is None and single and current[0] == end else seen)
    shared = arranged.sparkSession.sparkContext.broadcast(carries)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            before = before or shared.value[batch.column(BLOCK)[0].as_py()]
            filled = _fill(batch, key, value, before)
            before = (batch.column(key)[-1].as_py(), filled[-1].as_py())
            columns = [c for c in batch.schema.names if c != BLOCK]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), filled], [*columns, name])

    kept = [f for f in arranged.schema if f.name != BLOCK]
    return arranged.mapInArrow(extend, T.StructType([*kept, T.StructField(name, arranged.schema[value].dataType)]))


def _fill(batch: pa.RecordBatch, key: str, value: str, before: tuple) -> pa.Array:
    """The last value so far of each row's key, which for the batch's first key starts from ``before``."""
    codes = pc.dictionary_encode(batch.column(key), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    values, places = batch.column(value), np.arange(batch.num_rows)
    starts = np.maximum.accumulate(np.where(np.append(True, codes[1:] != codes[:-1]), places, 0))
    last = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), places, -1))
    known = last >= starts
    filled = values.take(pa.array(np.where(known, last, 0), mask=~known))
    if before[1] is None or batch.column(key)[0].as_py() != before[0]:
        return filled
    return pc.if_else(pa.array(~known & (starts == 0)), pa.scalar(before[1], values.type), filled)


def _added_fields(schema: T.StructType, spec: ScanSpec) -> list[T.StructField]:
    added = [
        T.StructField(f"running_{c}", T.LongType() if _is_whole(schema[c].dataType) else T.DoubleType())
        for c in spec.sums
    ]
    if spec.value:
        added.append(T.StructField("observation", T.LongType()))
        added += [T.StructField(name, T.DoubleType()) for name in ("mu", "sigma", "z")]
    return added


def _is_whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def _summaries(arranged: DataFrame, spec: ScanSpec, carries: dict[int, KeyState]) -> list[BlockSummary]:
    """One record per block, in block order. Reads only the columns the scan needs."""
    shared = arranged.sparkSession.sparkContext.broadcast(carries)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first_key = first_value = state = None
        single_key, observed = True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            opening = block is None
            if opening:
                block = batch.column(BLOCK)[0].as_py()
                first_key = batch.column(spec.key)[0].as_py()
                state = shared.value.get(block)
            result = _scan_batch(batch, spec, state)
            same_key = result.one_key and (opening or result.end.key == state.key)
            single_key = single_key and same_key
            if same_key and observed:
                observed += result.tail_observed
            else:
                first_value, observed = result.tail_first_value, result.tail_observed
            state = result.end
        if block is not None:
            summary = BlockSummary(block, first_key, state, single_key, first_value, observed)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(summary)], pa.binary())], ["summary"])

    rows = arranged.select(*spec.reads()).mapInArrow(summarise, "summary binary").collect()
    return sorted((pickle.loads(bytes(row.summary)) for row in rows), key=lambda s: s.block)


def _carry_sums_and_mean(summaries: list[BlockSummary], spec: ScanSpec) -> dict[int, KeyState]:
    """State in front of each block that continues a key (deviation not known yet).

    A block alone takes its first value as the mean so far; a carried mean that
    lies d away from it moves the mean at the block's end by d * (1 - alpha)^n.
    """
    keep = 1.0 - spec.alpha
    carries: dict[int, KeyState] = {}
    current: KeyState | None = None
    for s in summaries:
        continues = current is not None and current.key == s.first_key
        if continues:
            carries[s.block] = replace(current, sigma=0.0)
        if not (continues and s.single_key):
            current = s.end
            continue
        mu = current.mu
        if s.observed:
            mu = s.end.mu if mu is None else s.end.mu + keep**s.observed * (mu - s.first_value)
        current = KeyState(
            s.end.key,
            tuple(a + b for a, b in zip(current.sums, s.end.sums)),
            current.observations + s.end.observations,
            mu,
        )
    return carries


def _carry_deviation(
    summaries: list[BlockSummary], carries: dict[int, KeyState], spec: ScanSpec
) -> dict[int, KeyState]:
    """Complete the carries: with exact means the deviation decays from its own carry."""
    keep = 1.0 - spec.alpha
    complete: dict[int, KeyState] = {}
    before: float | None = None
    for s in summaries:
        carry = carries.get(s.block)
        sigma = s.end.sigma
        if carry is not None:
            complete[s.block] = replace(carry, sigma=before)
            if s.single_key and carry.mu is not None:
                sigma = sigma + keep**s.observed * before if s.observed else before
        before = sigma
    return complete


@dataclass(frozen=True)
class _Scanned:
    columns: dict[str, pa.Array]
    end: KeyState
    one_key: bool
    tail_first_value: float | None
    tail_observed: int


def _scan_batch(batch: pa.RecordBatch, spec: ScanSpec, before: KeyState | None) -> _Scanned:
    """Vectorised scan of one Arrow batch that starts from ``before``."""
    keys = batch.column(spec.key)
    codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    segment = np.concatenate(([0], np.cumsum(codes[1:] != codes[:-1])))
    last = int(segment[-1])
    continues = before is not None and before.key == keys[0].as_py()
    opening = segment == 0

    columns: dict[str, pa.Array] = {}
    totals = []
    for i, name in enumerate(spec.sums):
        running = pd.Series(_numbers(batch, name, 0)).groupby(segment).cumsum().to_numpy()
        if continues:
            running = running + np.where(opening, before.sums[i], 0).astype(running.dtype)
        columns[f"running_{name}"] = pa.array(running)
        totals.append(running[-1].item())
    end = KeyState(keys[-1].as_py(), tuple(totals))
    if not spec.value:
        return _Scanned(columns, end, last == 0, None, 0)

    x = _numbers(batch, spec.value, np.nan).astype("float64")
    seen = ~np.isnan(x)
    values, groups = x[seen], segment[seen]
    carried = continues and before.mu is not None
    mean = _exponential(values, groups, spec.alpha, before.mu if carried else None)
    gap = values - mean
    gap[np.abs(gap) <= NOISE * np.abs(values)] = 0.0
    spread = np.abs(gap)
    if spec.start_sigma:
        stored = _numbers(batch, spec.start_sigma, np.nan).astype("float64")[seen]
        spread = np.where(np.isnan(stored), spread, stored)
    deviation = _exponential(spread, groups, spec.alpha, before.sigma if carried else None)
    weight = seen.astype("int64")
    if spec.weight:
        weight = np.where(seen, _numbers(batch, spec.weight, 1), 0).astype("int64")
    observation = pd.Series(weight).groupby(segment).cumsum().to_numpy()
    if continues:
        observation = observation + np.where(opening, before.observations, 0)

    columns["observation"] = pa.array(observation, mask=~seen)
    for name, result in (("mu", mean), ("sigma", deviation), ("z", gap / np.maximum(deviation, EPSILON))):
        full = np.zeros(len(x))
        full[seen] = result
        columns[name] = pa.array(full, mask=~seen)

    in_tail = groups == last
    tail_observed = int(in_tail.sum())
    if tail_observed:
        end = replace(end, mu=float(mean[-1]), sigma=float(deviation[-1]))
    elif last == 0 and continues:
        end = replace(end, mu=before.mu, sigma=before.sigma)
    end = replace(end, observations=int(observation[-1]))
    first_value = float(values[in_tail][0]) if tail_observed else None
    return _Scanned(columns, end, last == 0, first_value, tail_observed)


def _numbers(batch: pa.RecordBatch, name: str, missing) -> np.ndarray:
    column = batch.column(name)
    if missing is not np.nan:
        if column.null_count:
            column = pc.fill_null(column, pa.scalar(missing, column.type))
        return column.to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type):
        column = column.cast(pa.float64())
    return column.to_numpy(zero_copy_only=False)


def _exponential(values: np.ndarray, groups: np.ndarray, alpha: float, carried: float | None) -> np.ndarray:
    """y = alpha * x + (1 - alpha) * y, per group; a group starts at its first value.

    A carried state belongs to group 0 and is put in front of it.
    """
    if not len(values):
        return values
    lead = carried is not None and groups[0] == 0
    if lead:
        values, groups = np.concatenate(([carried], values)), np.concatenate(([0], groups))
    series = pd.Series(values)
    if groups[0] == groups[-1]:
        smooth = series.ewm(alpha=alpha, adjust=False).mean().to_numpy()
    else:
        smooth = series.groupby(groups).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return smooth[1:] if lead else smooth
