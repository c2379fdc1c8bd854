"""Mixing sources: shares of tokens to the power of an exponent, realised by passes over permuted blocks.

A source with the share p of all words gets the weight p^a, normalised. The exponent a
is bisected: the largest at which the weights have the entropy asked for, then raised
if needed until no source is read more often than the repetition limit. The largest
source is read once, so none is thinned; a source with the share p is read
(p_max / p)^(1 - a) times. Whole passes read every document. The rest of a source's
budget is filled by blocks of documents in an order drawn by hash, and the block in
which the budget ends is cut at a document, in an order drawn by hash as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobvigil.llm.common import SPACE, ready, small

#: Exponents tried in one job: four levels of the bisection.
LEVELS, JOBS = 4, 8


@dataclass(frozen=True)
class Mix:
    """``entropy``: of the weights, as a part of the most that so many sources can have. ``repeats``: passes at most."""

    entropy: float = 0.998
    repeats: float = 2.0
    block_words: int = 1 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def _bisect(sources: DataFrame, holds) -> float:
    """The largest exponent in [0, 1] at which ``holds`` (a test that an exponent fails from some point on) is true."""
    low, high = 0.0, 1.0
    if sources.agg(holds(1.0).alias("x")).first()["x"]:
        return 1.0
    for _ in range(JOBS):
        step = (high - low) / (1 << LEVELS)
        points = [low + step * i for i in range(1, 1 << LEVELS)]
        row = sources.agg(*(holds(p).alias(f"x{i}") for i, p in enumerate(points))).first()
        passed = 0
        while passed < len(points) and row[f"x{passed}"]:
            passed += 1
        low, high = low + step * passed, low + step * (passed + 1)
    return low


def exponent(sources: DataFrame, mix: Mix) -> float:
    """From the table of sources (source, words > 0), to six digits."""
    row = sources.agg(F.count("*").alias("n"), F.sum("words").alias("total"), F.min("words").alias("least"), F.max("words").alias("most")).first()
    if row["n"] < 2 or row["least"] == row["most"]:
        return 1.0
    share = F.col("words") / F.lit(float(row["total"]))

    def spread(a: float) -> Column:
        power = F.pow(share, F.lit(a))
        # with z the sum of powers, the entropy of p^a / z is ln z - a * sum(p^a ln p) / z
        return F.log(F.sum(power)) - F.lit(a) * F.sum(power * F.log(share)) / F.sum(power)

    wanted = F.lit(mix.entropy) * F.log(F.lit(float(row["n"])))
    by_entropy = _bisect(sources, lambda a: spread(a) >= wanted)
    # (most / least)^(1 - a) <= repeats fails below an exponent, which is the other way round
    ratio = F.max("words") / F.min("words")
    by_repeats = 1.0 - _bisect(sources, lambda a: F.pow(ratio, F.lit(a)) <= mix.repeats)
    return round(max(by_entropy, by_repeats), 6)


def plan_mix(documents: DataFrame, mix: Mix, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents by key, source and words; sources with passes; blocks with their place in each pass)."""
    ready(documents.sparkSession)
    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    narrow = documents.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), name.alias("s"), words(F.col(f"`{text}`")).alias("words")
    ).checkpoint()
    totals = narrow.groupBy("s").agg(F.sum("words").alias("words")).checkpoint()
    some = totals.where("words > 0")
    a = exponent(some, mix)
    most = some.agg(F.max("words").alias("m")).first()["m"] or 0
    passes = F.when(F.col("words") > 0, F.round(F.pow(F.lit(float(most)) / F.col("words"), F.lit(1.0 - a)), 6)).otherwise(1.0)
    sources = totals.select(
        "s", F.col("words").alias("source_words"), passes.alias("passes"),
        F.greatest(F.lit(1), F.ceil(F.col("words") / mix.block_words)).cast("long").alias("n_blocks"),
        F.floor(F.col("words") * passes).cast("long").alias("budget"),
    )
    sources = sources.withColumn("whole", F.when(F.col("source_words") > 0, F.floor(F.col("budget") / F.col("source_words"))).otherwise(1).cast("long"))
    placed = in_blocks(narrow, sources)
    sums = placed.groupBy("s", "block").agg(F.sum("words").alias("block_words"))
    each = sums.join(small(sources), "s").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    order = Window.partitionBy("s", "epoch").orderBy(_hash(F.col("s"), F.col("block").cast("string"), F.col("epoch").cast("string")), "block")
    each = each.withColumn("block_rank", F.row_number().over(order)).withColumn(
        "before", F.coalesce(F.sum("block_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("epoch") * F.col("source_words")
    )
    last = F.col("epoch") == F.col("whole")
    each = each.withColumn("room", F.when(last, F.col("budget") - F.col("before")).otherwise(F.col("block_words"))).where(~last | (F.col("room") > 0))
    # within the one block of a source where the budget ends: the documents up to it
    ends = each.where(F.col("room") < F.col("block_words")).select("s", "block", "epoch", "room")
    drawn = placed.join(small(ends), ["s", "block"]).groupBy("s", "block", "epoch", "room", _hash(F.col("k"), F.col("epoch").cast("string")).alias("draw")).agg(F.sum("words").alias("words"))
    up_to = F.sum("words").over(Window.partitionBy("s", "block", "epoch").orderBy("draw"))
    cuts = drawn.withColumn("sum", up_to).where("sum <= room").groupBy("s", "block", "epoch").agg(F.max("draw").alias("cut"))
    blocks = each.join(small(cuts), ["s", "block", "epoch"], "left").select(
        "s", "block", "epoch", "block_rank",
        F.when(F.col("budget") > 0, F.col("before") / F.col("budget")).otherwise(0.0).alias("slot"),
        # a cut before the first document takes none of them
        F.when(F.col("room") < F.col("block_words"), F.coalesce("cut", F.lit(""))).alias("cut"),
    )
    return narrow, sources, blocks.checkpoint()


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with k and s: also the block, drawn by hash from the blocks of their source."""
    drawn = F.conv(F.substring(F.md5(F.col("k")), 1, 8), 16, 10).cast("long")
    return rows.join(small(sources.select("s", "n_blocks")), "s").withColumn("block", drawn % F.col("n_blocks")).drop("n_blocks")


def mix_sources(documents: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as often as they are read: their columns, and a struct ``drawn`` of epoch, block, block_rank and slot.

    ``slot`` is where in its source's budget the document's block begins; a stream
    sorted by it draws from all sources by their weights at any time. Words are runs of
    characters other than ASCII white space. Documents with the same key are drawn
    together. Null sources are one source, named "", null keys one document, null and
    empty texts have no words; a source without words is read once. An empty table
    gives an empty one. A column named ``drawn`` is replaced.
    """
    _, sources, blocks = plan_mix(documents, mix, key, text, source)
    whole = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("s"),
    )
    taken = in_blocks(whole, sources).join(small(blocks), ["s", "block"]).where(
        F.col("cut").isNull() | (_hash(F.col("k"), F.col("epoch").cast("string")) <= F.col("cut"))
    )
    drawn = F.struct("epoch", "block", "block_rank", "slot").alias("drawn")
    return taken.select(*(F.col("row")[c].alias(c) for c in documents.columns if c.lower() != "drawn"), drawn)
