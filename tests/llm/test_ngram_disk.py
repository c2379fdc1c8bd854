"""What the n-gram join leaves on disk."""

import os
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from jobvigil.llm import ngram_join


def shuffle_files(spark):
    found = {}
    for top in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs():
        for folder, _, names in os.walk(str(top)):
            for name in names:
                if name.startswith("shuffle_"):
                    try:
                        found[name] = os.path.getsize(f"{folder}/{name}")
                    except FileNotFoundError:  # just cleaned up
                        pass
    return found


def test_lists_take_few_bytes_and_go_once_they_are_read(spark, monkeypatch):
    rng, like = np.random.default_rng(11), ngram_join.Likeness()
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 10**6, 1500))) for i in range(300)]
    made = sum(len(part) for _, t in rows for part in ngram_join.entries(ngram_join.shingles(t, like.words), like, np.zeros(0, np.uint64))[::2])
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    monkeypatch.setattr(ngram_join, "SAMPLE", 0)  # the shuffle of its elements would be as large as that of the lists here
    before, seen, checkpoint = set(shuffle_files(spark)), [], type(frame).checkpoint
    new = lambda: sum(size for name, size in shuffle_files(spark).items() if name not in before)
    monkeypatch.setattr(type(frame), "checkpoint", lambda self, *a, **b: (checkpoint(self, *a, **b), seen.append(new()))[0])
    groups = ngram_join.similar_groups(frame, like)
    assert made > 100_000 and 6 * made < max(seen) < 14 * made
    until = time.time() + 20
    while new() > 2 * made and time.time() < until:
        time.sleep(0.2)
    assert new() < 2 * made
    assert all(r["doc_id"] == r["component_id"] for r in groups.collect())


@pytest.mark.parametrize("exact", [False, True])
def test_packed_lists_are_read_as_they_were(exact):
    rng, bits = np.random.default_rng(12), 5
    cut, name_cut = (0, 0) if exact else (ngram_join.LIST_CUT, ngram_join.NAME_CUT)
    batches, want = [], []
    for n in (1, 3, 40_000):
        lists = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        lists[0] = (1 << 64) - 1
        names = rng.integers(-1 << 63, 1 << 63, n, dtype=np.int64) & ~np.int64(not exact)
        batches.append(ngram_join.packed(lists, names, exact, bits))
        want += zip((lists >> np.uint64(cut)).tolist(), (names >> name_cut << name_cut).tolist(), strict=True)
    table, got = pa.Table.from_batches(batches), []
    for bucket in set(table["bucket"].to_pylist()):
        lists, names = ngram_join.unpacked(table.filter(pa.compute.equal(table["bucket"], bucket)), exact)
        got += zip((lists + np.uint64(bucket << (64 - cut - bits))).tolist(), names.tolist(), strict=True)
    assert sorted(got) == sorted(want)


def test_sets_of_a_list_are_led_by_the_smallest_name_of_the_smaller_size():
    lists = np.array([7, 7, 7, 8, 8, 9, 9, 9], dtype=np.uint64)
    entries = np.array([4, -6, 4, 3, 5, 11, 10, 12], dtype=np.int64)
    assert ngram_join.led(lists, entries).tolist() == [[4, -6], [12, 10]]
