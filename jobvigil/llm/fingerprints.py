"""Fingerprints of documents: a sum of wide vectors, one hashed from each paragraph.

A vector has lanes, each a number modulo a power of two. Sums of vectors do not depend
on the order of the paragraphs, and a paragraph is put in or taken out by adding or
subtracting its vector. The lanes are

    1   number of paragraphs                                            modulo 2^32
    8   four 64-bit hashes in halves: equal multisets and only those agree   modulo 2^32
    576 nine strata of 64 lanes; each paragraph adds to one lane of a stratum: every paragraph
        in the first, an eighth of them in the second, and so on to 8^-8 in the ninth   modulo 2^16

The last stratum tells apart some 5 * 64 * 8^8 paragraphs, more than two texts can have.

Lanes of the strata that agree in two fingerprints tell how many paragraphs differ.
A paragraph ends after a line break, or after a full stop, question or exclamation
mark with the blank after it; it keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobvigil.llm.arrays import let, place_of
from jobvigil.llm.common import ready

PARAGRAPH = r"(?<=\n)|(?<=[.!?]\x20)"
DENSE, STRATA, LANES = 9, tuple(8**i for i in range(9)), 64
_WIDE, _NARROW = 1 << 32, 1 << 16


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH, -1), lambda p: p != "")


def lanes_of(text: Column) -> Column:
    """The lanes of a text as array<bigint>; a null or empty text has zeros."""
    hashes = F.transform(paragraphs(F.coalesce(text, F.lit(""))), lambda p: F.struct(*(F.xxhash64(F.lit(j), p).alias(f"h{j}") for j in range(4))))

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, F.lit(0).cast("long"), lambda a, h: a + value(h))

    def dense(rows: Column) -> list[Column]:
        zeros = F.struct(*(F.lit(0).cast("long").alias(f"s{j}") for j in range(8)))
        halves = lambda h: [x for j in range(4) for x in (h[f"h{j}"].bitwiseAND(_WIDE - 1), F.shiftrightunsigned(h[f"h{j}"], 32))]
        sums = F.aggregate(rows, zeros, lambda a, h: F.struct(*((a[f"s{j}"] + x).alias(f"s{j}") for j, x in enumerate(halves(h)))))
        return F.concat(F.array(F.size(rows).cast("long")), let(sums, lambda s: F.array(*(s[f"s{j}"].bitwiseAND(_WIDE - 1) for j in range(8)))))

    def lane_of(h: Column, level: int) -> Column:
        return F.shiftrightunsigned(h["h3"] if level < 7 else h["h0"], 8 + 8 * (level % 7)).bitwiseAND(LANES - 1)

    def within(rows: Column, level: int) -> Column:
        # decided by other bits than lane and value; a level lies within the one before
        return F.filter(rows, lambda h: F.shiftrightunsigned(h["h2"], 8).bitwiseAND(STRATA[level] - 1) == 0) if level else rows

    def stratum(rows: Column, level: int) -> Column:
        none = F.array_repeat(F.lit(0).cast("long"), LANES)
        return let(within(rows, level), lambda c: F.when(F.size(c) == 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda lane: total(
            F.filter(c, lambda h: lane_of(h, level) == lane), lambda h: h["h1"].bitwiseAND(_NARROW - 1)).bitwiseAND(_NARROW - 1))))

    def strata(rows: Column, levels: range) -> Column:
        return F.concat(*(stratum(rows, level) for level in levels))

    # few texts have paragraphs in the sparse levels, so these are looked for once
    sparse = range(3, len(STRATA))
    return let(hashes, lambda rows: F.concat(dense(rows), strata(rows, range(sparse.start)), let(within(rows, sparse.start), lambda few: F.when(
        F.size(few) == 0, F.array_repeat(F.lit(0).cast("long"), LANES * len(sparse))).otherwise(strata(few, sparse)))))


def combine(one: Column, other: Column, sign: int = 1) -> Column:
    """Lanes of both multisets together; ``sign`` -1: of the first without the second."""
    both = F.zip_with(one, other, lambda a, b: a + sign * b)
    return F.transform(both, lambda x, i: F.when(i < DENSE, x.bitwiseAND(_WIDE - 1)).otherwise(x.bitwiseAND(_NARROW - 1)))


def to_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x, i: F.lpad(F.lower(F.hex(x)), F.when(i < DENSE, 8).otherwise(4), F.lit("0"))), "")


def likeness(one: Column, other: Column) -> Column:
    """Estimated share of paragraphs in common, from two fingerprints as text: 1 if they are equal, else 0 to below 1.

    If a share q of a stratum's lanes agrees, about -64 ln q of its paragraphs are in
    one text only. The first stratum with q of a fifth or more decides, else the last.
    """
    count = lambda f: F.conv(F.substring(f, 1, 8), 16, 10).cast("double")
    part = lambda f, level: F.substring(f, level * (4 * LANES) + (8 * DENSE + 1), F.lit(4 * LANES))
    lane = lambda f, i: F.substring(f, i * 4 + 1, F.lit(4))
    agree = lambda level: let(F.struct(part(one, level).alias("a"), part(other, level).alias("b")), lambda p: F.size(F.filter(
        F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: lane(p["a"], i) == lane(p["b"], i))) / LANES)
    differ = lambda q, level: -F.log(F.greatest(q, F.lit(0.5 / LANES))) * LANES * F.pow(F.lit(8.0), level)
    last = len(STRATA) - 1
    n = count(one) + count(other)
    estimate = F.aggregate(F.sequence(F.lit(0), F.lit(last)), F.lit(None).cast("double"), lambda found, level: F.when(found.isNotNull(), found).otherwise(
        let(agree(level), lambda q: F.when((q >= 0.2) | (level == last), differ(q, level)))))
    share = let(F.greatest(F.abs(count(one) - count(other)), F.least(estimate, n)), lambda d: (n - d) / F.greatest(n + d, F.lit(1.0)))
    return F.when(one == other, F.lit(1.0)).otherwise(F.round(F.least(share, F.lit(0.999999)), 6))


def fingerprint(documents: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of their whole text; equal texts have equal ones, a null text that of an empty one."""
    return documents.withColumn(into, to_text(lanes_of(F.col(f"`{text}`"))))


def beside_next(documents: DataFrame, key: str, carry: list[str], parts: int | None = None) -> DataFrame:
    """Each row's key and ``carry`` columns, and those of the row that follows by descending key as ``next_<name>``.

    The last is followed by the first. Rows are dealt to ranges of the key, one shuffle;
    the first row of each range is also sent to the end of the range before it, so no
    row looks beyond its range. Only range bounds and one key per range, ``parts`` of
    each, reach the driver. A null key comes last, ties by the carried columns.
    """
    parts = parts or ready(documents.sparkSession)
    rows = documents.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63))).alias("k"), F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`") for c in carry))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set((rows.agg(F.percentile_approx("k", shares, 10_000).alias("b")).first()["b"] if shares else None) or []))
    literal = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    dealt = rows.withColumn("range", place_of(F.col("k"), literal, len(bounds)))
    heads = {r["range"]: r["k"] for r in dealt.groupBy("range").agg(F.max("k").alias("k")).collect()}
    used = sorted(heads)
    # the range whose last row a range's first row follows: the next higher one, or for the highest the lowest
    above = {r: used[(i + 1) % len(used)] for i, r in enumerate(used)}
    at = lambda values: F.get(F.array(*(F.lit(values.get(i)) for i in range(len(bounds) + 1))).cast("array<bigint>"), F.col("range"))
    copies = F.when(F.col("k") == at(heads), F.array(
        F.struct(F.col("range").cast("long").alias("range"), F.lit(False).alias("ghost")), F.struct(at(above).alias("range"), F.lit(True).alias("ghost")),
    )).otherwise(F.array(F.struct(F.col("range").cast("long").alias("range"), F.lit(False).alias("ghost"))))
    order = Window.partitionBy("to.range").orderBy("to.ghost", F.desc("k"), *carry)
    following = F.lead(F.struct("key", *carry)).over(order)
    placed = dealt.withColumn("to", F.explode(copies)).drop("range").withColumn("following", following).where(~F.col("to.ghost"))
    return placed.select(F.col("key").alias(key), *carry, F.col("following.key").alias(f"next_{key}"), *(F.col("following")[c].alias(f"next_{c}") for c in carry))
