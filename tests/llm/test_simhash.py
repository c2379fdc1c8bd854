"""SimHash groups against fingerprints and links counted one by one."""

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from jobvigil.llm import queries, simhash

LONG = "far away " * 40_000


def plain_print(text):
    said = (text or "").encode().lower().split()
    grams = [b" ".join(said[i : i + 3]) for i in range(len(said) - 2)] or ([b" ".join(said)] if said else [])
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(rows, prints):
    """rows of (key, text); equal keys are one document, rows without a key only find an equal fingerprint."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    named = [i for i, (key, _) in enumerate(rows) if key is not None]
    for i in named:
        for j in named:
            if j < i and ((prints[i] ^ prints[j]).bit_count() <= 2 or rows[i][0] == rows[j][0]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i in named:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    known = {prints[i]: least[find(i)] for i in named}
    return [(rows[i][0], f"{prints[i]:016x}", least[find(i)] if rows[i][0] is not None else known.get(prints[i])) for i in range(len(rows))]


def texts(seed):
    rng = np.random.default_rng(seed)
    rows = [(900, None), (901, " \n\t"), (902, "one"), (903, "ONE"), (904, "Two words"), (905, "a b c"), (906, "A\x0bB\x1cC"), (907, "É é\x85É"), (908, LONG), (909, LONG), (910, "日本 語 " * 30)]
    for group in range(12):
        base = [f"w{i}" for i in rng.integers(0, 10**6, 60 + 30 * group)]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(0, len(words))] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(None, None), (None, rows[20][1]), (None, "nobody else says this"), (5000, rows[20][1]), (5000, "something else altogether here"), (5001, "something else altogether here"), rows[30]]


@pytest.mark.parametrize("crowd", [1024, 1])
def test_near_duplicates(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = texts(7)
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, id int, fp int, cell string").repartition(5)
    got = simhash.near_duplicates(frame)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    order = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(plain_groups(rows, [plain_print(t) for _, t in rows]), key=order)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_long_texts_are_counted_in_steps(monkeypatch):
    some = [(t or "").encode() for _, t in texts(3)]
    whole = simhash.prints_of(some).tolist()
    assert whole == [plain_print(t.decode()) for t in some]
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.prints_of(some).tolist() == whole


def test_any_two_within_two_bits_share_a_cell():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    base[:3] = [0, (1 << 64) - 1, 1 << 63]
    for flips in range(3):
        other = base.copy()
        for row in range(len(other)):
            for b in rng.choice(64, flips, replace=False):
                other[row] ^= np.uint64(1) << np.uint64(b)
        cells = []
        for prints in (base, other):
            places, numbers = simhash.cells(prints)
            cells.append([set(numbers[places == i].tolist()) for i in range(len(prints))])
        assert all(a & b for a, b in zip(*cells, strict=True))


def test_crowded_prints_meet_exactly(spark):
    rng = np.random.default_rng(6)
    prints = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 20)]
    for p in list(prints):
        for flips in (1, 2, 3):
            other = p
            for b in rng.choice(64, flips, replace=False).tolist():
                other ^= (1 << b) - (1 << 64 if b == 63 else 0)
            prints.append(other)
    prints = sorted(set(prints))
    found = {tuple(r) for r in simhash._balls(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    near = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert found <= near
    # every near pair is connected through the least of those at a value
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert all(find(a) == find(b) for a, b in near)


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted(plain_groups(rows, [plain_print(t) for _, t in rows]))
    assert sorted(tuple(r) for r in queries.op13_simhash(spark, sf_dir).collect()) == want
