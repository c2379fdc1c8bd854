"""Audit of how far the sources of a language lie from the language and from each other.

Terms are counted per (language, source) within tasks, then kept term by term: an index
from each term to the sources that have it. Every share is a whole number of billionths,

    p = 1 + floor(10^9 * (count + 1) / (N + V)),    f(p, q) = floor((p - q)^2 / q),

and the distance of source s from source t is f summed over all V terms of the language.
Most counts are zero, and a term that s lacks has the same share in s wherever it is, so

    sum of f(p_s, p_t) = sum over s of f(p_s, zero_t)                    all terms, as if t had none
                       + sum over t of f(zero_s, p_t) - f(zero_s, zero_t)        terms of t, as if s had none
                       + sum over shared terms of f(p_s, p_t) - f(p_s, zero_t) - f(zero_s, p_t) + f(zero_s, zero_t)

The first two follow from how often each share occurs in a source. The third is a sparse
product of rows: each source scatters its terms through the index into a dense
accumulator with one place per other source, so no pair of postings is ever a row.
All of it is done in whole numbers.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobvigil.llm.common import ready, small
from jobvigil.session import ensure_checkpoint_dir

SCALE = 10**9
#: Entries of the counters that a task keeps before it sends them on.
HELD_TERMS = 300_000
#: Postings of the index that are accumulated at once; a term's postings are never cut.
BLOCK_POSTINGS = 1 << 19
#: Lower-cases A-Z and makes a blank of every ASCII character that is no letter, on the bytes of UTF-8.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 * (count + 1) / total)``, exact up to totals of 9 * 10^15, for 0 <= count < total."""
    first = (count + 1) * 1000
    rest = lambda a: a % total * 1000
    second = rest(first)
    third = rest(second)
    whole = lambda a: F.call_function("div", a, total)
    return 1 + whole(first) * 1_000_000 + whole(second) * 1000 + whole(third)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def count_terms(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often each task met a term, and in how many documents; keys may repeat.

    A text is counted whole; a task sends its counters on when they are large, so neither
    long texts nor many distinct terms pile up.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        said: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}

        def flush():
            for group, counted in said.items():
                terms, docs = list(counted), held[group]
                for at in range(0, len(terms), 1 << 16):
                    some = terms[at : at + (1 << 16)]
                    yield pa.record_batch([
                        pa.array([group[0]] * len(some), pa.string()), pa.array([group[1]] * len(some), pa.string()),
                        pa.array(some, pa.binary()).view(pa.string()), pa.array([counted[t] for t in some], pa.int64()),
                        pa.array([docs[t] for t in some], pa.int64()),
                    ], names=["lang", "source", "term", "n", "docs"])
            said.clear(), held.clear()

        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for group, text in zip(groups, batch.column(2).cast(pa.binary()), strict=True):
                terms = text.as_py().translate(_LETTERS).split()
                if not terms:
                    continue
                said.setdefault(group, Counter()).update(terms)
                held.setdefault(group, Counter()).update(set(terms))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from flush()
        yield from flush()

    return documents.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _spans(starts, lengths):
    """The numbers from each start on, ``lengths`` of them, in a row."""
    import numpy as np

    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _f(p, q):
    return (p - q) * (p - q) // q


def accumulate(term, source, p, zero):
    """(s, t, value) of the third sum, for postings sorted by term; ``zero`` is the share of a term that the source lacks."""
    import numpy as np

    begins = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    lengths = np.diff(np.append(begins, len(term)))
    owner = np.repeat(np.arange(len(begins)), lengths)  # the term's place in the index, of each posting
    peers, place = np.unique(source, return_inverse=True)
    rows = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[rows], np.arange(len(peers) + 1))
    for s in range(len(peers)):
        own = rows[edges[s] : edges[s + 1]]
        reached = _spans(begins[owner[own]], lengths[owner[own]])
        q, q0, to = p[reached], zero[reached], place[reached]
        mine, mine0 = np.repeat(p[own], lengths[owner[own]]), zero[own[0]]
        dense = np.zeros(len(peers), dtype=np.int64)
        np.add.at(dense, to, _f(mine, q) - _f(mine, q0) - _f(mine0, q) + _f(mine0, q0))
        dense[s] = 0
        there = np.flatnonzero(dense)
        yield np.full(len(there), peers[s]), peers[there], dense[there]


def _shared_terms(postings: DataFrame, parts: int) -> DataFrame:
    """lang, s, t, value: the third sum, from blocks of whole terms."""
    dealt = postings.select("lang", "term_id", "s", "p", "zero").repartition(parts, "term_id").sortWithinPartitions("term_id")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def block(rows):
            langs, *columns = rows.columns
            codes = langs.combine_chunks().dictionary_encode()
            codes, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            columns = [c.to_numpy() for c in columns]
            for code, name in enumerate(names):
                found = list(accumulate(*(c[codes == code] for c in columns)))
                s, t, value = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.record_batch([pa.array([name] * len(s), pa.string()), pa.array(s), pa.array(t), pa.array(value)], names=["lang", "s", "t", "value"])

        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= BLOCK_POSTINGS:
                rows = pa.Table.from_batches(waiting)
                terms = rows.column("term_id").to_numpy()
                cut = int(np.searchsorted(terms, terms[-1]))  # the last term may go on
                if cut:
                    yield from block(rows.slice(0, cut))
                waiting = rows.slice(cut).to_batches()
                size = rows.num_rows - cut
        if size:
            yield from block(pa.Table.from_batches(waiting))

    return dealt.mapInArrow(run, "lang string, s int, t int, value long")


def _from_zero(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, s, t, value: the first two sums, from how many terms of a source have each share; two rows for each two sources."""
    seen = postings.groupBy("lang", "s", "zero", "p").agg(F.count("*").alias("terms"))
    seen = seen.withColumn("there", F.lit(True)).unionByName(
        groups.select("lang", "s", "zero", F.col("zero").alias("p"), (F.col("v") - F.col("kept")).alias("terms"), F.lit(False).alias("there"))
    )
    # every source meets all of its language once, as it does in the result
    peers = groups.select("lang", F.explode(F.sequence(F.lit(1), "sources")).alias("s"), F.col("s").alias("t"), "zero").toDF("lang", "s", "t", "zero")

    def run(rows, others):
        import numpy as np
        import pyarrow as pa

        peer, zero = others["t"].to_numpy(), others["zero"].to_numpy()
        ahead, back = np.zeros(len(peer), np.int64), np.zeros(len(peer), np.int64)
        for r in rows.to_pylist():
            ahead += r["terms"] * _f(r["p"], zero)
            if r["there"]:
                back += r["terms"] * (_f(zero, r["p"]) - _f(zero, r["zero"]))
        own = rows["s"][0].as_py()
        other, same = peer != own, np.full(len(peer), own, dtype=np.int32)
        s, t = np.append(same[other], peer[other]), np.append(peer[other], same[other])
        name = [rows["lang"][0].as_py()] * len(s)
        return pa.table({"lang": pa.array(name, pa.string()), "s": pa.array(s), "t": pa.array(t), "value": pa.array(np.append(ahead[other], back[other]))})

    return seen.groupBy("lang", "s").cogroup(peers.groupBy("lang", "s")).applyInArrow(run, "lang string, s int, t int, value long")


def audit(
    documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_documents: int = 3, top: int = 200,
) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source apart.

    Part ``pair`` has the distance to every other source of the language, part ``term``
    the ``top`` terms that the source has more often than its language; ranks are from
    1 on, by falling value, ties by item. Terms are runs of letters (A-Z lower-cased)
    and of all characters beyond ASCII; a language keeps those in at least
    ``least_documents`` of its documents. Null columns are empty strings, repeated rows
    count each. A source without kept terms is still compared, with shares of nothing;
    a language without kept terms gives distances of 0, a language with one source no
    pairs, an empty table no rows. Other columns are ignored. The sources of one
    language are numbered in one task, and a term's sources are held together: both are
    as many as there are sources, as is a row of the result's pairs.
    """
    spark = documents.sparkSession
    parts = ready(spark)
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    narrow = documents.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    names = narrow.select("lang", "source").distinct()
    # one shuffle of counters, by term; the rest of the counting stays where that put them
    counted = count_terms(narrow).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("sources")
    ).where(F.col("in_docs") >= least_documents)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/divergence-{uuid.uuid4().hex}"
    # a term of a language has one number, given once and stored
    index.withColumn("term_id", F.monotonically_increasing_id()).write.parquet(path)
    index = spark.read.parquet(path)
    flat = index.select("lang", "term", "term_id", "lang_n", F.explode("sources").alias("one")).select("lang", "term", "term_id", "lang_n", "one.source", "one.n")

    of_lang = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    of_source = flat.groupBy("lang", "source").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = names.join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left").select(
        "lang", "source", *map(none, ("v", "lang_total", "kept", "total")), F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("s"),
        F.count("*").over(Window.partitionBy("lang")).cast("int").alias("sources"),
    ).withColumn("size", F.greatest(F.col("total") + F.col("v"), F.lit(1))).withColumn("zero", F.when(F.col("v") == 0, 1).otherwise(share(F.lit(0).cast("long"), F.col("size")))).checkpoint()

    postings = flat.join(small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size")))
    value = apart(F.col("p"), F.col("q"))
    terms = postings.withColumn("q", share(F.col("lang_n"), F.col("lang_total") + F.col("v"))).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    sums = _shared_terms(postings, parts).unionByName(_from_zero(postings, groups)).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    called = lambda number, name: small(groups.select("lang", F.col("s").alias(number), F.col("source").alias(name)))
    pairs = sums.join(called("s", "source"), ["lang", "s"]).join(called("t", "item"), ["lang", "t"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
