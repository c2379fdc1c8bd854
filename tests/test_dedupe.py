"""Duplicates, also with one id that holds most rows."""

import random
from datetime import datetime, timedelta

import pytest

from jobvigil.operators import dedupe as module
from jobvigil.operators.ordered import arrange, last_seen
from jobvigil.operators.dedupe import dedupe, dedupe_stats, dedupe_ttl, only_new

BASE = datetime(2024, 1, 1)


def times(spark, rows):
    return spark.createDataFrame([(k, BASE + timedelta(hours=h)) for k, h in rows], "event_id string, ts timestamp")


def brute(rows, ttl):
    kept, last = [], {}
    for key, hour in sorted(rows):
        if key not in last or hour >= last[key] + ttl:
            kept.append((key, BASE + timedelta(hours=hour)))
            last[key] = hour
    return sorted(kept)


@pytest.mark.parametrize("ttl, span", [(24, 200), (24, 2000), (1, 40), (500, 200)])
def test_ttl_equals_brute_force(spark, ttl, span):
    rng = random.Random(ttl + span)
    rows = [("hot", rng.randrange(0, span)) for _ in range(400)]
    rows += [(f"k{rng.randrange(60)}", rng.randrange(0, span)) for _ in range(500)]
    found = dedupe_ttl(times(spark, rows).repartition(5), ttl=f"{ttl} hours").collect()
    assert sorted((r.event_id, r.ts) for r in found) == brute(rows, ttl)


def test_ttl_takes_as_many_rounds_as_jumps_double(spark, monkeypatch):
    """One id over 400 hours: 17 acceptances, found by jumps of 1, 2, 4, 8 and 16."""
    frame = times(spark, [("hot", h % 400) for h in range(2000)])
    stored, checkpoint = [], type(frame).checkpoint
    monkeypatch.setattr(type(frame), "checkpoint", lambda self, *more: stored.append(self.columns) or checkpoint(self, *more))
    assert dedupe_ttl(frame, ttl="24 hours").count() == 17
    assert sum(columns == ["_id", "_at", "_next"] for columns in stored) == 1 + 5


@pytest.mark.parametrize("broadcast_ids, hint", [(10, "broadcast"), (0, "shuffle_hash")])
def test_ttl_deals_a_hot_id_out_before_it_looks_for_distinct_times(spark, monkeypatch, broadcast_ids, hint):
    """No task sorts or aggregates all times of an id: at most so many rows a task, whatever the size of the table."""
    rows = [("hot", h % 400) for h in range(2000)] + [("once", 3)]
    frame = times(spark, rows)
    monkeypatch.setattr(module, "TASK_ROWS", 100)
    monkeypatch.setattr(module, "BROADCAST_IDS", broadcast_ids)
    dealt, distinct = [], type(frame).distinct
    monkeypatch.setattr(type(frame), "distinct", lambda self: dealt.append((self.rdd.getNumPartitions(), self._jdf.queryExecution().logical().toString())) or distinct(self))
    found = dedupe_ttl(frame, ttl="24 hours").collect()
    assert sorted((r.event_id, r.ts) for r in found) == brute(rows, 24)
    assert [n for n, _ in dealt] == [20] and f"strategy={hint}" in dealt[0][1]


def test_ttl_gives_whole_rows_and_leaves_out_rows_without_id_or_time(spark):
    rows = [("a", 0, "first", 2), ("a", 0, "again", 1), ("a", 30, None, 3), ("b", 5, "b", 4)]
    frame = spark.createDataFrame([(k, BASE + timedelta(hours=h), x, n, n) for k, h, x, n in rows] + [(None, BASE, "x", 5, 5), ("c", None, "x", 6, 6)], "event_id string, ts timestamp, note string, n int, id int")
    found = dedupe_ttl(frame, ttl="24 hours", order_by=["n"])
    assert found.columns == frame.columns and sorted((r.event_id, r.n) for r in found.collect()) == [("a", 1), ("a", 3), ("b", 4)]
    assert dedupe_ttl(frame.limit(0)).count() == 0


def test_last_seen_over_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aabc"), i, rng.choice([None, None, None, i])) for i in range(400)]
    want, last = {}, {}
    for key, at, value in sorted(rows, key=lambda r: (r[0], r[1])):
        last[key] = value if value is not None else last.get(key)
        want[at] = last[key]
    for blocks in (1, 3, 50):
        placed = arrange(spark.createDataFrame(rows, "k string, at int, v int"), "k", ["at"], blocks)
        assert {r.at: r.last for r in last_seen(placed, "k", "v", "last").collect()} == want


def test_ttl_accepts_again_exactly_at_the_limit(spark):
    found = dedupe_ttl(times(spark, [("a", 0), ("a", 23), ("a", 24), ("a", 47), ("b", 5)]), ttl="24 hours").collect()
    assert sorted((r.event_id, (r.ts - BASE).total_seconds() / 3600) for r in found) == [("a", 0), ("a", 24), ("b", 5)]


def test_first_row_per_id_is_cut_on_the_map_side(spark):
    rows = [("hot", h) for h in range(500)] + [(f"k{i}", i) for i in range(50)]
    unique = dedupe(times(spark, rows))
    assert unique.count() == 51
    assert unique.filter("event_id = 'hot'").first().ts == BASE
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_only_new_and_stats(spark):
    rows = times(spark, [("a", 0), ("a", 1), ("b", 2), ("c", 3)])
    assert {r.event_id for r in only_new(rows, times(spark, [("b", 0), ("z", 0)])).collect()} == {"a", "c"}
    assert tuple(dedupe_stats(rows).first()) == (4, 3, 1)
