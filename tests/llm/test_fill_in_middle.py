"""Cut texts against plain slices, and the learned index against all boundaries."""

import hashlib

import numpy as np
import pytest

from jobvigil.llm import fill_in_middle as fim

TEXTS = [
    None, "", "a", "é", "日本語", "plain ascii " * 50, "<P> inside", "a<S>b", "<M>", "<P<S", "<", "P>x<", "x" * 200_000, "a😀" * 40_000, "日" * 70_000 + "b" * 70_000 + "é" * 70_000, "\x00\n\r", "é" * 30,
]


def plain(doc, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_forms(spark):
    rows = [(i * 31 + k, t) for k, t in enumerate(TEXTS) for i in range(-1, 6 if len(t or "") < 1000 else 1)] + [(None, "no key"), (7, "twice"), (7, "twice")]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n int, Fim string, whole_row string").repartition(4)
    made = fim.fill_in_middle(frame)
    assert made.columns == ["doc_id", "text", "n", "whole_row", "fim"]
    got = made.withColumn("back", fim.restored(made["fim.output"], made["fim.form"])).collect()
    assert len(got) == len(rows) and {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r["fim"]) == plain(r["doc_id"], r["text"]) and r["back"] == (r["text"] or "") and (r["n"], r["whole_row"]) == (1, "y")
    assert fim.fill_in_middle(frame.limit(0)).count() == 0


@pytest.mark.parametrize("letters", ["a", "aé", "a日", "日", "é日😀a", "ab\n"])
@pytest.mark.parametrize("n", [0, 1, 2, 300, 65_535, 65_536, 70_001])
def test_index_gives_all_boundaries(letters, n):
    rng = np.random.default_rng(n)
    runs = rng.integers(1, 400, max(1, n))
    text = "".join(letters[i % len(letters)] * int(r) for i, r in enumerate(runs[: max(1, n // 200)]))[:n] + "".join(rng.choice(list(letters), max(0, n - 200 * (n // 200))))
    text = text[:n]
    data = text.encode()
    index = fim.RankIndex(data)
    want = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
    assert index.n == len(text) and np.array_equal(index.offsets(np.arange(len(text) + 1)), want)
    assert np.abs(index.residuals.astype(int)).max() <= fim.ERROR + 1
    assert len(index.first) <= 1 + len(text) // (fim.ERROR // 3)


def test_one_line_is_enough_for_ascii():
    assert len(fim.RankIndex(b"abc " * 100_000).first) == 1
