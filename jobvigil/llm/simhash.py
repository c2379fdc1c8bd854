"""Near-duplicates by SimHash: fingerprints that differ in few bits are linked.

A fingerprint is cut into segments, and each is mapped to the number of its set bits. These
counts are a point on a grid, and the Manhattan distance of two points is at most the
number of bits in which the fingerprints differ. So fingerprints that differ in up to two
bits are two points at most two steps apart, and halfway between them lies a cell that
is one step from both: each point goes to its own cell and to those one step away, and
what meets in a cell is compared exactly. One seldom meets what is unlike, since 16
counts of 4 bits have about 30 bits of information.

Very many distinct fingerprints may crowd into one cell. Those are not gathered: each of
them goes to its exact value and to the 64 that differ from it in one bit. Two that
differ in at most two bits meet at one of those values, and all that meet at one differ in
at most two bits, so nothing is compared; a value has at most 65 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobvigil.llm.common import ready, small
from jobvigil.llm.components import components

BITS, WORDS, SEED = 64, 3, 42
#: Bits of a segment.
SEGMENT = 4
#: Bits in which linked fingerprints may differ; the cells are made for this number.
APART = 2
#: Fingerprints of a cell up to which they are compared in one task.
CROWD = 1024
#: Shingles that are hashed and counted at once.
STEP = 1 << 16


def _bits(hashes, starts):
    """How many of the hashes from each start to the next have each bit, lowest first."""
    import numpy as np

    spread = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(spread, starts, axis=0, dtype=np.int64)


def _shingles(data: bytes, words: int) -> Iterator[bytes]:
    said = data.lower().split()  # bytes know A-Z and ASCII white space only
    line = b" ".join(said)
    if len(said) <= words:
        return iter([line] if said else [])
    begins, at = [0], 0
    for word in said:
        at += len(word) + 1
        begins.append(at)
    return (line[a : b - 1] for a, b in zip(begins, begins[words:], strict=False))


def prints_of(texts: list[bytes], words: int = WORDS):
    """The fingerprints of whole texts as unsigned 64-bit integers: a bit is set that over half the shingles' hashes have."""
    import numpy as np
    from xxhash import xxh64_intdigest

    ones, sizes = np.zeros((len(texts), BITS), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    held: list[int] = []
    owner: list[tuple[int, int]] = []  # text, and where its hashes begin

    def count():
        if held:
            ones_of = _bits(np.array(held, dtype=np.uint64), np.array([at for _, at in owner]))
            np.add.at(ones, [i for i, _ in owner], ones_of)
        held.clear(), owner.clear()

    for i, data in enumerate(texts):
        rest = _shingles(data, words)
        while True:
            at, room = len(held), STEP - len(held)
            held.extend(xxh64_intdigest(s, SEED) for _, s in zip(range(room), rest, strict=False))
            if len(held) > at:
                owner.append((i, at))
                sizes[i] += len(held) - at
            if len(held) < STEP:
                break
            count()
    count()
    chosen = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(chosen, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(texts: DataFrame) -> DataFrame:
    """id, fp: the signed 64-bit fingerprint of each text."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = prints_of([t.as_py() for t in some.column(1)])
                yield pa.record_batch([some.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return texts.mapInArrow(run, "id long, fp long")


def _steps():
    """A random number for a step along each axis; a cell's number is the sum of its steps."""
    import numpy as np

    return np.random.default_rng(11).integers(1, 1 << 63, BITS // SEGMENT, dtype=np.uint64) | np.uint64(1)


def cells(prints, segment: int = SEGMENT):
    """(place in ``prints``, cell): the own cell of each and the cells one step from it.

    Cells are named by 64-bit numbers, so unlike cells may have one name; that only adds
    comparisons. Steps below zero or above a segment's bits lead nowhere a point can
    be, and no two points need such a cell between them.
    """
    import numpy as np

    steps = _steps()
    mask = np.uint64((1 << segment) - 1)
    counts = np.stack([np.bitwise_count((prints >> np.uint64(segment * i)) & mask) for i in range(BITS // segment)], axis=1)
    own = (counts.astype(np.uint64) * steps).sum(axis=1, dtype=np.uint64)
    everyone = np.arange(len(prints))
    out = [(everyone, own)]
    for i, step in enumerate(steps):
        up, down = counts[:, i] < segment, counts[:, i] > 0
        out += [(everyone[up], own[up] + step), (everyone[down], own[down] - step)]
    places, numbers = zip(*out, strict=True)
    return np.concatenate(places), np.concatenate(numbers)


def _cell_table(nodes: DataFrame) -> DataFrame:
    """fp, cell for every fingerprint and each of its cells."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                prints = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
                places, numbers = cells(prints.view(np.uint64))
                yield pa.record_batch([pa.array(prints[places]), pa.array(numbers.view(np.int64))], names=["fp", "cell"])

    return nodes.select("fp").mapInArrow(run, "fp long, cell long")


def _joined(prints, lengths, apart: int = APART):
    """Links (fp, least fp it is connected with) within runs of ``prints``, each pair compared."""
    import numpy as np

    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 1]):
        begins, at_once = starts[lengths == length], max(1, (1 << 20) // int(length) ** 2)
        for at in range(0, len(begins), at_once):
            runs = np.sort(prints[begins[at : at + at_once, None] + np.arange(length)], axis=1)
            near = np.bitwise_count(runs[:, :, None] ^ runs[:, None, :]) <= apart
            label = np.broadcast_to(np.arange(length), runs.shape)
            while True:  # the least number each one reaches
                least = np.where(near, label[:, None, :], length).min(axis=2)
                if (least == label).all():
                    break
                label = least
            found = label != np.arange(length)
            rows = np.nonzero(found)[0]
            yield runs[found], runs[rows, label[found]]


def _met(dealt: DataFrame) -> DataFrame:
    """u, v: links between fingerprints that meet in a cell; rows are sorted by cell, cells are whole."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def link(prints, cell):
            begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            lengths = np.diff(np.append(begins, len(cell)))
            found = list(_joined(prints.view(np.uint64), lengths))
            if found:
                u, v = (np.concatenate(c).view(np.int64) for c in zip(*found, strict=True))
                pairs = np.unique(np.stack([u, v], axis=1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            prints, cell = (np.concatenate([w, batch.column(i).to_numpy(zero_copy_only=False)]) for i, w in enumerate(waiting))
            cut = int(np.argmax(cell == cell[-1])) if len(cell) else 0  # the last cell may go on
            yield from link(prints[:cut], cell[:cut]) if cut else ()
            waiting = (prints[cut:], cell[cut:])
        yield from link(*waiting) if len(waiting[0]) else ()

    return dealt.mapInArrow(run, "u long, v long")


def _balls(crowded: DataFrame) -> DataFrame:
    """u, v: links between crowded fingerprints, by the values at most one bit from them."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << BITS if i == BITS - 1 else 0)).cast("long") for i in range(BITS)))
    balls = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("value"))
    # at most 65 fingerprints a value
    met = balls.groupBy("value").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select("u", F.explode("all").alias("v")).where("u <> v").distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: key, fingerprint (16 hexadecimal digits), component_id.

    ``component_id`` is the smallest key reachable by links, the row's own included; rows
    link if their fingerprints differ in at most two bits. Shingles are three words
    (A-Z lower-cased), repeats included; a text of fewer words is one, a text without
    words has fingerprint zero and links like any other. Rows that repeat a key are one
    document as far as links go. A row with a null key links nothing but finds the
    component of an equal fingerprint; without one its component is null. An empty
    table gives an empty one, other columns are ignored.
    """
    parts = ready(documents.sparkSession)
    texts = documents.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    prints = fingerprints(texts).checkpoint()
    nodes = prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.max("id").alias("last")).checkpoint()
    placed = _cell_table(nodes)
    full = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("cell").checkpoint()
    full = small(full)
    dealt = placed.join(full, "cell", "left_anti").select("fp", "cell").repartition(parts, "cell").sortWithinPartitions("cell")
    crowded = placed.join(full, "cell", "left_semi").select("fp").distinct()
    # two versions of one document connect their fingerprints
    versions = prints.where("id is not null").groupBy("id").agg(F.min("fp").alias("u"), F.max("fp").alias("w")).where("u <> w").select("id", "u").checkpoint()
    several = prints.join(small(versions), "id").select("u", F.col("fp").alias("v")).where("u <> v")
    links = _met(dealt).unionByName(_balls(crowded)).unionByName(several)
    roots = components(links).toDF("fp", "root")
    least = roots.join(nodes, "fp").groupBy("root").agg(F.min("rep").alias("component"))
    linked = roots.join(least, "root").select("fp", "component")
    # only fingerprints that say more than a row's own key does
    nameless = prints.where("id is null").select("fp", F.lit(True).alias("asked")).distinct()
    told = nodes.join(linked, "fp", "left").join(nameless, "fp", "left").withColumn("component_id", F.coalesce("component", "rep")).where("asked or component_id <> last")
    out = prints.join(small(told.select("fp", "component_id").checkpoint()), "fp", "left")
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", F.col("id")).alias("component_id"))
