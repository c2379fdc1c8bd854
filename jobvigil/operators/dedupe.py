"""Duplicates: first row per id, first row per id and time-to-live, ids seen in earlier runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobvigil.operators.ordered import arrange, last_seen
from jobvigil.session import ensure_checkpoint_dir, ship_package

# Rows (id, time) that one task holds while it looks for distinct ones.
TASK_ROWS = 200_000
# So many ids go to every task; with more, their rows are dealt out by id.
BROADCAST_IDS = 100_000


def dedupe(df: DataFrame, id_column: str | Sequence[str] = "event_id", order_by: Sequence[str | Column] = ("ts",)) -> DataFrame:
    """The first row per id.

    The rank filter is applied on the map side too (window group limit), so an id
    with very many copies sends one row per map task to the shuffle, not all.
    """
    key = [id_column] if isinstance(id_column, str) else list(id_column)
    ranked = Window.partitionBy(*key).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") == 1).drop("_rank")


def dedupe_ttl(
    df: DataFrame, id_column: str = "event_id", ts: str = "ts", ttl: str = "24 hours", order_by: Sequence[str | Column] = (),
) -> DataFrame:
    """Rows accepted when an id is forgotten ``ttl`` after the last accepted one; of rows of one id and time the first in ``order_by``.

    An id's first time is accepted, and after an accepted time the first one at least
    ttl later, its successor. All successors are found in one ordered walk over
    ranges of (id, time). Then jumps are doubled: from the times accepted so far, jumps over
    1, 2, 4, ... successors reach all others, in log2(span / ttl) rounds. Nothing
    is gathered per id, whatever the number of its rows, and a task's share of the distinct
    times does not grow with the table. Ids whose rows lie within one ttl need no walk.
    Rows without an id or a time are left out.
    """
    ensure_checkpoint_dir(df.sparkSession)
    reach = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {ttl}"))
    rows = df.select(F.col(id_column).alias("_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")).filter("_id is not null and _at is not null")
    spans = rows.groupBy("_id").agg(F.min("_at").alias("_at"), F.max("_at").alias("_last"), F.count("*").alias("_rows")).checkpoint()
    again = spans.filter(F.col("_last") >= F.col("_at") + reach)
    accepted = spans.select("_id", "_at")
    # an id cannot be accepted again more often than its span has room for
    most, count, ids = again.agg(F.max(F.floor((F.col("_last") - F.col("_at")) / reach)), F.sum("_rows"), F.count("*")).first()
    if most:
        # the rows of a hot id are neither sorted by id nor aggregated in one task: they only pass the table of ids,
        # and are dealt out by time before the distinct ones are looked for
        walked = again.select("_id")
        walked = F.broadcast(walked) if ids <= BROADCAST_IDS else walked.hint("shuffle_hash")
        times = rows.join(walked, "_id", "left_semi").repartition(-(-count // TASK_ROWS), "_id", "_at").distinct()
        accepted = accepted.unionByName(_later_accepted(times, again.select("_id", "_at"), reach, int(most).bit_length()))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    whole = df.withColumns({"_id": F.col(id_column), "_at": at}).join(accepted, ["_id", "_at"], "left_semi")
    order = [*order_by] or [F.xxhash64(*df.columns)]
    return dedupe(whole, ("_id", "_at"), order).select(*df.columns)


def _later_accepted(times: DataFrame, first: DataFrame, reach: Column, rounds: int) -> DataFrame:
    """The times (id, at) that are accepted after the first ones, up to 2^rounds - 1 of them per id."""
    # backwards in time, a time comes after those that are at least ttl later, so the last one seen is its successor
    none = F.lit(None).cast("bigint")
    seen = times.select("_id", (-F.col("_at")).alias("_back"), F.lit(0).alias("_asks"), F.col("_at").alias("_seen"), none.alias("_from"))
    asked = times.select("_id", (-F.col("_at") - reach).alias("_back"), F.lit(1).alias("_asks"), none.alias("_seen"), F.col("_at").alias("_from"))
    walked = last_seen(arrange(seen.unionByName(asked), "_id", ["_back", "_asks"]), "_id", "_seen", "_next")
    jumps = walked.filter("_asks = 1 and _next is not null").select("_id", F.col("_from").alias("_at"), "_next")
    # one table: accepted times have no next, jumps have one; a round takes every accepted time and every jump one jump on
    state = first.select("_id", "_at", none.alias("_next")).unionByName(jumps).checkpoint()
    for _ in range(rounds):
        reached, jumps = state.filter("_next is null"), state.filter("_next is not null")
        ends = state.select("_id", F.coalesce("_next", "_at").alias("_to"), F.when(F.col("_next").isNotNull(), F.col("_at")).alias("_from"))
        on = ends.join(jumps.select("_id", F.col("_at").alias("_to"), F.col("_next").alias("_far")), ["_id", "_to"])
        jump = F.col("_from").isNotNull()
        moved = on.select("_id", F.coalesce("_from", "_far").alias("_at"), F.when(jump, F.col("_far")).alias("_next"))
        state = reached.unionByName(moved).checkpoint()
    return state.filter("_next is null").select("_id", "_at").join(first, ["_id", "_at"], "left_anti")


def only_new(df: DataFrame, seen: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Rows whose id no earlier run has processed."""
    return df.join(seen.select(id_column), id_column, "left_anti")


def dedupe_stats(df: DataFrame, id_column: str = "event_id", approximate: bool = False) -> DataFrame:
    """Deliveries, distinct ids and the difference, in one row."""
    distinct = F.approx_count_distinct(id_column) if approximate else F.count_distinct(id_column)
    counted = df.agg(F.count(F.lit(1)).alias("deliveries"), distinct.alias("unique_events"))
    return counted.withColumn("duplicates", F.col("deliveries") - F.col("unique_events"))


def dedupe_stream(df: DataFrame, id_column: str = "event_id", horizon: str = "24 hours") -> DataFrame:
    """Streaming form: an id is remembered for ``horizon`` after it arrived.

    Arrival is the time of the micro-batch, never a time in the data: an event from long ago
    or from far ahead is processed like any other and cannot make others late. All
    copies of an id meet in one task of the one stateful stage; each task that reads
    drops the repeats within its own batches of rows first.
    """
    ship_package(df.sparkSession)
    names = df.columns

    def once(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc

        for batch in batches:
            # the first row of each id; rows without an id are kept as they are
            ids = batch.column(names.index(id_column))
            codes = ids.dictionary_encode().indices
            seen: set = set()
            keep = [c is None or not (c in seen or seen.add(c)) for c in codes.to_pylist()]
            yield batch if all(keep) else pc.filter(batch, pa_bools(keep))

    arrived = df.mapInArrow(once, df.schema).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
    return arrived.dropDuplicatesWithinWatermark([id_column]).drop("_arrived")


def pa_bools(values: list[bool]):
    import pyarrow as pa

    return pa.array(values, pa.bool_())
