"""The audit of sources against plain counting in whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobvigil.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least=3, top=200):
    said, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        said[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)

        def shares(counted):
            total = sum(counted[t] for t in kept) + len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (counted[t] + 1) // total for t in kept}  # noqa: B023

        p = {s: shares(said[lang, s]) for s in sources}
        everyone = shares(sum((said[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(-sum(f(p[s][x], p[t][x]) for x in kept), t) for t in sources if t != s]
            terms = [(-f(p[s][x], everyone[x]), x) for x in kept if said[lang, s][x] and p[s][x] > everyone[x]]
            for part, found in (("pair", sorted(pairs, key=lambda r: (r[0], r[1].encode()))), ("term", sorted(terms, key=lambda r: (r[0], r[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, term int, item string, p int").repartition(4)


def corpus(seed, sources):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = []
    for i in range(300):
        source = int(rng.integers(sources))
        chance = rng.dirichlet(np.ones(120) * 0.3) if source % 3 == 0 else np.full(120, 1 / 120)
        rows.append((["en", "de", None][i % 3], f"s{source}", " ".join(rng.choice(words, rng.integers(0, 40), p=chance))))
    return rows


ODD = [
    (None, None, None), ("en", "empty", ""), ("en", "empty", " 12 ?! "), ("xx", "a", "Only here"), ("xx", "b", "only here"), ("yy", "alone", "a a b"), ("yy", "alone", "A É b"), ("yy", "alone", "a É"),
    ("en", "s1", "wa " * 40_000 + "Ünïq"), ("en", "é", "ünïq wa日本wa KK"), ("en", "z", "Ünïq ünïq KK 日本"), ("en", "z", "kK"), ("en", "z", "kK"),
]


@pytest.mark.parametrize("seed, sources, least, top", [(1, 3, 3, 200), (2, 9, 2, 5), (3, 1, 1, 7)])
def test_audit(spark, seed, sources, least, top, monkeypatch):
    rows = corpus(seed, sources) + ODD
    rows += rows[:20]  # repeated rows count again
    got = divergence.audit(frame_of(spark, rows), least_documents=least, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, least, top)


def test_no_rows_and_no_kept_terms(spark):
    assert divergence.audit(frame_of(spark, ODD[:1]).limit(0)).count() == 0
    rows = [(None, None, None), (None, "b", "x"), ("l", "c", None), ("l", "d", "q q q")]
    assert sorted(tuple(r) for r in divergence.audit(frame_of(spark, rows)).collect()) == plain_audit(rows)


def test_a_task_sends_its_counters_on_and_blocks_hold_whole_terms(spark):
    rng = np.random.default_rng(4)
    n = 5000
    term, source = np.sort(rng.integers(0, 400, n)), rng.integers(0, 30, n).astype(np.int32)
    keep = np.unique(term * 30 + source, return_index=True)[1]
    term, source = term[keep], source[keep]
    order = np.lexsort((source, term))
    term, source = term[order], source[order]
    zero = 1000 + 7 * source.astype(np.int64)
    p = zero + rng.integers(1, 10**9 // 2, len(term))
    dense = np.tile((1000 + 7 * np.arange(30))[:, None], (1, 400))
    dense[source, term] = p
    f = lambda x, y: (x - y) ** 2 // y
    empty = dense.min(axis=1) * 0 + 1000 + 7 * np.arange(30)
    got = np.zeros((30, 30), np.int64)
    for s, t, value in divergence.accumulate(term, source, p, zero):
        got[s, t] += value
    for s in range(30):
        for t in range(30):
            if s != t:
                apart = f(dense[s], dense[t]) - f(dense[s], empty[t]) - f(empty[s], dense[t]) + f(empty[s], empty[t])
                shared = (dense[s] != empty[s]) & (dense[t] != empty[t])
                assert got[s, t] == apart[shared].sum()


def test_shares_are_exact_beyond_doubles(spark):
    from pyspark.sql import functions as F

    rows = [(0, 1), (6, 7), (10**12 + 7, 3 * 10**13 + 1), (4 * 10**15, 8 * 10**15 + 3), (8 * 10**15, 9 * 10**15 - 1)]
    got = spark.createDataFrame(rows, "n long, total long").select("n", "total", divergence.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // r["total"] for r in got)
