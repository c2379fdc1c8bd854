"""Jaccard join of documents as sets of word n-grams: size-aware, heavy and light.

Small sets: with sizes a and b, two sets are similar if and only if they share a subset
of c(a, b) elements, a number the sizes fix. Each small set lists its subsets of those
sizes, and sets meet in the lists without any comparison.

Large sets: their elements are dealt to a number of ranges of the hash that is one more than the
elements in which two similar sets of these sizes can differ, so similar sets agree in
a whole range. An inverted list per range and content gathers them. Lists only connect
candidates to a leader; sets that are connected that way form a cluster, and in a
cluster overlaps are counted by scanning the lists of its elements: short lists pair by
pair, long ones as columns of a matrix product.

Which sizes are small is decided by the number of entries either way makes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobvigil.llm.common import ready, release, small, trim
from jobvigil.llm.components import components

#: Elements and sets of a block, on average; two blocks at most are compared in one task.
BLOCK_ELEMENTS, BLOCK_SETS = 1 << 20, 1024
#: Texts of the sample that frequent elements are looked for in, on average; texts that make one frequent; elements at most.
SAMPLE, SEEN, FREQUENT = 8192, 3, 1 << 20
#: One spare range for so many ranges that are needed.
SPARE = 2
#: Lists longer than this are counted by a matrix product.
HEAVY = 48
#: Entries of lists that a task looks through for its own doubles before it sends them on.
LOCAL_ENTRIES = 1 << 19
#: Entries that are looked through for doubles of all tasks at once, on average, at most.
BUCKET_ENTRIES = 1 << 18
#: Bytes of a batch of lists, on average, at most.
BATCH_BYTES = 1 << 20
#: Bits of a list of candidates, and of a set's name in it, that are left out: sets that meet by chance are compared, no more.
LIST_CUT, NAME_CUT = 10, 24
#: Candidates up to which they are broadcast to the texts, each in 56 bytes.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Likeness:
    """Similar: ``of * common >= least * united`` elements, sets of ``words``-word n-grams."""

    words: int = 5
    least: int = 80
    of: int = 100

    def common(self, a: int, b: int) -> int:
        """Elements that sets of a and b elements have to share."""
        return -(-self.least * (a + b) // (self.least + self.of))

    def partners(self, n: int) -> range:
        """Sizes of sets that one of n elements can be similar to."""
        return range(-(-self.least * n // self.of), self.of * n // self.least + 1)

    def apart(self, largest: int) -> int:
        """Elements in which similar sets of up to ``largest`` elements differ at most."""
        return (self.of - self.least) * 2 * largest // (self.of + self.least)

    @property
    def small(self) -> int:
        return _boundary(self)

    @property
    def bands(self) -> tuple[tuple[int, int], ...]:
        return _bands(self)


@lru_cache
def _boundary(like: Likeness) -> int:
    """The largest size whose subsets are no more entries than its ranges, with its elements counted for the comparison."""
    n = 1
    while True:
        subsets = sum(comb(n + 1, like.common(n + 1, b)) for b in like.partners(n + 1))
        if subsets > 2 * (like.apart(n + 1) + 1) + 2 * (n + 1):
            return n
        n += 1


@lru_cache
def _bands(like: Likeness) -> tuple[tuple[int, int], ...]:
    """Sizes of large sets, and of small ones they can be similar to, in bands: similar sets are in one band or in neighbouring ones."""
    low, out = like.partners(like.small + 1)[0], []
    while low < 1 << 40:
        high = max(low, like.of * low // like.least)
        out.append((low, high))
        low = high + 1
    return tuple(out)


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int):
    """The set of a whole text as sorted 64-bit hashes: n-grams of words, A-Z lower-cased.

    Words are runs of anything but ASCII white space. Fewer words than an n-gram has
    are one element; no words are none.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know A-Z and ASCII white space only
    said = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not said:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.array(list(map(xxh64_intdigest, said)), dtype=np.uint64)
    n = len(said) - words + 1
    if n < 1:
        words, n = len(said), 1
    out = np.full(n, words, dtype=np.uint64)
    for j in range(words):
        out = _mix(out) + hashes[j : j + n]
    return np.unique(_mix(out))


@lru_cache(maxsize=4096)
def _edges(parts: int):
    """Where each of so many equal ranges of the hash begins, and its number hashed."""
    import numpy as np

    starts = np.array([-(-(i << 64) // parts) for i in range(parts)], dtype=np.uint64)
    return starts, _mix(np.arange(parts, dtype=np.uint64) + np.uint64(parts << 32))


def _range_entries(own, cold, band: int, apart: int):
    """One entry per range: a hash of band, range and the elements in it, for one range more than sets can be ``apart``.

    There are more ranges, and each set leaves as many of its lightest out: those with the
    fewest elements that are not frequent, then the fewest at all, then by place. Similar
    sets agree in at least one range more than are left out, and what a range weighs
    follows from its elements, so the heaviest of those is left out by neither. ``cold``
    counts the elements that are not frequent up to each of the sorted ``own``.
    """
    import numpy as np

    spare = -(-(apart + 1) // SPARE)
    starts, numbers = _edges(apart + 1 + spare)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(own), dtype=np.uint64)])
    at = np.append(np.searchsorted(own, starts), len(own))
    heavy = np.lexsort((np.diff(at), np.diff(cold[at])))[spare:]
    return _mix((sums[at[1:]] - sums[at[:-1]])[heavy] ^ numbers[heavy] ^ np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def entries(own, like: Likeness, frequent):
    """(lists of exact links, whether the set is of the smaller size there), lists of candidates; for one set."""
    import numpy as np

    n, exact, low = len(own), [], []
    if n <= like.small:
        mixed = _mix(own).tolist()
        for b in like.partners(n):
            if b > like.small or not b:
                continue
            pair, share = (min(n, b) << 20) | max(n, b), like.common(n, b)
            for left in combinations(mixed, share):
                exact.append((sum(left) ^ pair * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
                low.append(n <= b)
    lists = []
    if n >= like.bands[0][0]:
        band = next(i for i, (_, high) in enumerate(like.bands) if n <= high)
        at = np.minimum(np.searchsorted(frequent, own), max(0, len(frequent) - 1))
        cold = np.concatenate([[0], np.cumsum(frequent[at] != own) if len(frequent) else np.arange(1, n + 1)])
        # with its own band and the one below it; with the one above
        lists = [_range_entries(own, cold, i, like.apart(like.bands[i][1])) for i in (band, band + 1) if i == band or like.partners(n)[-1] >= like.bands[i][0]]
    return _mix(np.array(exact, dtype=np.uint64)), np.array(low, dtype=bool), np.concatenate(lists) if lists else np.zeros(0, np.uint64)


def _names(own) -> tuple[int, int]:
    """Two 64-bit names of a set; the first is even."""
    import numpy as np

    one, two = _mix(own ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64), _mix(own ^ np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64)
    return int((one & ~np.uint64(1)).astype(np.int64)), int(two.astype(np.int64))


def set_table(texts: DataFrame, like: Likeness) -> DataFrame:
    """id, n, one, two: the size and the names of the set of each text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(len(own), *_names(own)) for own in (shingles(t.as_py(), like.words) for t in batch.column(1))]
            n, one, two = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["id", "n", "one", "two"])
        trim()

    return texts.mapInArrow(run, "id long, n long, one long, two long")


def frequent_elements(texts: DataFrame, like: Likeness):
    """Elements that at least ``SEEN`` of a bounded sample of the texts have, sorted; the most frequent, if there are very many.

    They only decide which ranges a set leaves out, so links do not depend on them:
    passages that many documents share do not connect documents that are otherwise unlike.
    """
    import numpy as np

    n = texts.count()
    draw = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    sample = texts.where(draw < min(1.0, SAMPLE / max(1, n)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(1):
                yield pa.record_batch([pa.array(shingles(text.as_py(), like.words).view(np.int64))], names=["element"])

    counted = sample.mapInArrow(run, "element long").groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    found = counted.orderBy(F.desc("n"), "element").limit(FREQUENT).select("element").toArrow()["element"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def bucket_bits(elements: int, like: Likeness, parts: int) -> int:
    """Upper bits of a list that say which lists are gone through together; a bucket for each of the ``parts`` at least."""
    return max(1, (parts - 1).bit_length(), (2 * like.apart(elements) // BUCKET_ENTRIES).bit_length())


def packed(lists, entries, exact: bool, bits: int):
    """bucket, exact, width, body: one row per bucket of the lists, sorted; a list as its distance from the one before.

    All distances take ``width`` bytes, as many as the largest needs. Lists of candidates
    and the names in them are cut; exact ones, which nothing verifies, are kept whole.
    """
    import numpy as np
    import pyarrow as pa

    cut, name_cut = (0, 0) if exact else (LIST_CUT, NAME_CUT)
    order = np.argsort(lists, kind="stable")
    lists, names = lists[order] >> np.uint64(cut), entries[order].view(np.uint64) >> np.uint64(name_cut)
    inner = np.uint64(64 - cut - bits)
    bucket = lists >> inner
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    steps = np.diff(lists, prepend=np.uint64(0))
    steps[starts] = lists[starts] - (bucket[starts] << inner)
    width, name_bytes = max(1, -(-int(steps.max()).bit_length() // 8)), 8 - name_cut // 8
    body = np.empty((len(lists), width + name_bytes), dtype=np.uint8)
    body[:, :width] = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    body[:, width:] = names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :name_bytes]
    bounds = (np.append(starts, len(lists)) * (width + name_bytes)).astype(np.int32)
    bodies = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    return pa.record_batch([
        pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), exact)), pa.array(np.full(len(starts), width, dtype=np.int32)), bodies,
    ], names=["bucket", "exact", "width", "body"])


def unpacked(rows, exact: bool):
    """(lists, entries) of rows of one bucket; a list is its distance from where its bucket begins."""
    import numpy as np

    name_cut = 0 if exact else NAME_CUT
    widths, name_bytes = rows["width"].to_numpy(), 8 - name_cut // 8
    lists, entries = [], []
    for width in np.unique(widths):
        bodies = [b.as_buffer() for b, w in zip(rows["body"], widths, strict=True) if w == width]
        wide = int(width) + name_bytes
        counts = np.array([b.size // wide for b in bodies])
        body = np.frombuffer(b"".join(bodies), dtype=np.uint8).reshape(-1, wide)
        numbers = np.zeros((2, len(body), 8), dtype=np.uint8)
        numbers[0, :, :width], numbers[1, :, :name_bytes] = body[:, :width], body[:, width:]
        steps, names = numbers.reshape(2, -1).view("<u8").astype(np.uint64)
        sums, starts = np.cumsum(steps, dtype=np.uint64), np.cumsum(counts) - counts
        lists.append(sums - np.repeat(sums[starts] - steps[starts], counts))
        entries.append((names << np.uint64(name_cut)).view(np.int64))
    return np.concatenate(lists), np.concatenate(entries)


def led(lists, entries):
    """Distinct (one, leader): each set and the smallest name of its lists, of those in the smaller size there, if another."""
    import numpy as np

    order = np.lexsort((entries, entries & 1, lists))
    lists, entries = lists[order], entries[order]
    first = np.append(True, lists[1:] != lists[:-1])
    leader = entries[np.flatnonzero(first)[np.cumsum(first) - 1]]
    name = entries & ~np.int64(1)
    joined = (leader % 2 == 0) & (leader != name)
    return np.unique(np.stack([name[joined], leader[joined]], axis=1), axis=0)


def list_table(texts: DataFrame, like: Likeness, frequent, bits: int) -> DataFrame:
    """bucket, exact, width, body: the entries of all sets, see ``packed``.

    An entry is the set's name, plus one if it is not of the smaller size in a list of
    exact links.

    A task first looks for lists that its own sets share: of those only one leader's
    entry goes on, and each other set gets one list with its leader. So a list that very
    many sets share has an entry per task and not per set.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held, exact_held, size = [], [], 0
        met: set[tuple[int, int]] = set()  # sets that are held; copies have the same entries

        def flush():
            nonlocal size
            lists = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.uint64)
            owner = np.repeat(np.array([o for o, _ in held], dtype=np.int64), [len(x) for _, x in held])
            order = np.lexsort((owner, lists))
            lists, owner = lists[order], owner[order]
            first = np.append(True, lists[1:] != lists[:-1]) if len(lists) else np.zeros(0, bool)
            leader = owner[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(lists) else owner
            apart = owner != leader
            pairs = np.unique(np.stack([owner[apart], leader[apart]], axis=1), axis=0)
            joint = _mix(_mix(pairs[:, 0].astype(np.uint64)) + pairs[:, 1].astype(np.uint64))
            candidates = np.concatenate([lists[first], joint, joint]), np.concatenate([owner[first], pairs[:, 0], pairs[:, 1]])
            links = [np.concatenate(c) for c in zip(*((x, o + ~low) for o, x, low in exact_held), strict=True)] or [lists[:0], owner[:0]]
            held.clear(), exact_held.clear(), met.clear()
            size = 0
            for exact, (numbers, names) in ((False, candidates), (True, links)):
                for at in range(0, len(numbers), 2 * LOCAL_ENTRIES):
                    some = slice(at, at + 2 * LOCAL_ENTRIES)
                    made = packed(numbers[some], names[some], exact, bits)
                    step = max(1, made.num_rows * BATCH_BYTES // made.nbytes)
                    yield from (made.slice(row, step) for row in range(0, made.num_rows, step))

        for batch in batches:
            for text in batch.column(1):
                own = shingles(text.as_py(), like.words)
                if not len(own) or (names := _names(own)) in met:
                    continue
                met.add(names)
                exact, low, lists = entries(own, like, frequent)
                name = names[0]
                held.append((name, lists)), exact_held.append((name, exact, low))
                size += len(lists) + len(exact)
                if size > LOCAL_ENTRIES:
                    yield from flush()
        yield from flush()
        trim()

    return texts.mapInArrow(run, "bucket int, exact boolean, width int, body binary")


def joined_sets(lists: DataFrame) -> DataFrame:
    """one, leader, exact: the pairs of ``led`` from all buckets, each once."""

    def run(group):
        import numpy as np
        import pyarrow as pa

        exact = group["exact"][0].as_py()
        pairs = led(*unpacked(group, exact))
        trim()
        return pa.table({"one": pa.array(pairs[:, 0]), "leader": pa.array(pairs[:, 1]), "exact": pa.array(np.full(len(pairs), exact))})

    return lists.groupBy("bucket", "exact").applyInArrow(run, "one long, leader long, exact boolean").distinct()


def overlaps(sets: list):
    """How many elements each two sets have in common."""
    import numpy as np

    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    starts = np.flatnonzero(np.append(True, elements[1:] != elements[:-1])) if len(elements) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(elements)))
    common = np.zeros(count * count, dtype=np.int64)
    for length in np.unique(lengths[(lengths > 1) & (lengths <= HEAVY)]):
        members = owner[starts[lengths == length][:, None] + np.arange(length)]
        i, j = np.triu_indices(length, 1)
        for at in range(0, len(members), max(1, (1 << 20) // len(i))):
            some = members[at : at + max(1, (1 << 20) // len(i))]
            common += np.bincount((some[:, i] * count + some[:, j]).ravel(), minlength=count * count)
    common = common.reshape(count, count)
    heavy = np.flatnonzero(lengths > HEAVY)
    for at in range(0, len(heavy), 2048):
        some = heavy[at : at + 2048]
        there = np.zeros((count, len(some)), dtype=np.float32)
        for column, h in enumerate(some):
            there[owner[starts[h] : starts[h] + lengths[h]], column] = 1.0
        common += np.triu(there @ there.T, 1).astype(np.int64)
    return common


def links_within(ids: list[int], sets: list, like: Likeness) -> list[tuple[int, int]]:
    """Links that connect the sets which similar pairs connect; at most one less than there are sets."""
    import numpy as np

    common, n = overlaps(sets), np.array([len(s) for s in sets])
    i, j = np.nonzero(np.triu(like.of * common >= like.least * (n[:, None] + n[None, :] - common), 1))
    root, out = list(range(len(ids))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[a], ids[b]))
    return out


def _verified(texts: DataFrame, members: DataFrame, like: Likeness, parts: int) -> DataFrame:
    """Links (u, v) between the members (id, n, one, two, cluster) that are similar, each cluster compared in blocks."""
    bands = F.lit(-1)
    for i, (low, _) in enumerate(b for b in like.bands if b[0] < 1 << 31):
        bands = F.when(F.col("n") >= low, i).otherwise(bands)
    sized = members.withColumn("band", bands)
    # a cluster that fits is one block; a larger one is cut by size band and hash, and only bands that can hold similar sets meet
    total = members.groupBy("cluster").agg(F.sum("n").alias("elements"), F.count("*").alias("sets"))
    large = small(total.where((F.col("elements") > 2 * BLOCK_ELEMENTS) | (F.col("sets") > 2 * BLOCK_SETS)).select("cluster", F.lit(True).alias("large")).checkpoint())
    sized = sized.join(large, "cluster", "left").withColumn("band", F.when(F.col("large"), F.col("band")).otherwise(0))
    blocks = small(sized.where("large").groupBy("cluster", "band").agg(F.greatest(
        F.ceil(F.sum("n") / BLOCK_ELEMENTS), F.ceil(F.count("*") / BLOCK_SETS), F.lit(1)).cast("int").alias("blocks")).checkpoint())
    dealt = sized.join(blocks, ["cluster", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    # six numbers a row, 56 bytes, so that the number of rows bounds what is broadcast; which blocks meet is added to the sets afterwards
    placed = dealt.withColumn("own", own).select("id", "one", "two", "cluster", "band", F.col("own").alias("block")).checkpoint()
    # of the texts, only those of members move
    few = placed.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(placed) if few else placed, "id")

    def to_sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = [shingles(t.as_py(), like.words) for t in batch.column(1)]
            # an id may be repeated with another text
            same = [_names(s) == (a.as_py(), b.as_py()) for s, a, b in zip(own, batch.column(2), batch.column(3), strict=True)]
            made = pa.record_batch([batch.column(0), *(batch.column(i) for i in (4, 5, 6)), pa.array([s.tobytes() for s in own], pa.binary())], names=["id", "cluster", "band", "block", "own"])
            yield made.filter(pa.array(same))
        trim()

    sets = found.select("id", "text", "one", "two", "cluster", "band", "block").mapInArrow(to_sets, "id long, cluster long, band int, block int, own binary")
    # one row per cluster cut into blocks and its band; a block meets those of its band and of the bands beside it
    beside = lambda step, name: blocks.select("cluster", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))
    around = blocks
    for step, name in ((1, "below"), (-1, "above")):
        around = around.join(beside(step, name), ["cluster", "band"], "left")
    with_ = lambda n, make: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)).otherwise(F.array().cast("array<array<int>>"))
    meets = F.concat(
        with_("blocks", lambda q: F.array(F.col("band"), F.least(F.col("block"), q), F.col("band"), F.greatest(F.col("block"), q))),
        with_("below", lambda q: F.array(F.col("band") - 1, q, F.col("band"), F.col("block"))),
        with_("above", lambda q: F.array(F.col("band"), F.col("block"), F.col("band") + 1, q)),
    )
    met = sets.join(small(around.checkpoint()), ["cluster", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    grouped = met.select("id", "cluster", F.explode(meets).alias("meet"), "own").repartition(parts, "cluster", "meet")

    def compare(group):
        import numpy as np
        import pyarrow as pa

        ids = group["id"].to_pylist()
        # an id may have several sets
        once = dict.fromkeys(zip(ids, (b.as_py() for b in group["own"]), strict=True))
        found = links_within([i for i, _ in once], [np.frombuffer(b, dtype=np.uint64) for _, b in once], like) if len(once) > 1 else []
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    return grouped.groupBy("cluster", "meet").applyInArrow(compare, "u long, v long")


def similar_groups(documents: DataFrame, like: Likeness = Likeness(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: key, n_shingles, component_id.

    ``component_id`` is the smallest key reachable by links, the row's own included;
    two rows link when their sets are similar. A text without words has an empty set
    and links with nothing. Rows that repeat a key are one document as far as links go.
    A row with a null key takes part in no comparison but finds the component of an
    equal set; without one its component is null. An empty table gives an empty one,
    other columns are ignored. Sets are compared by 64-bit hashes of their elements.
    """
    parts = ready(documents.sparkSession)
    texts = documents.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sets = set_table(texts, like).checkpoint()
    equal = ["n", "one", "two"]
    classes = sets.where("n > 0").groupBy(*equal).agg(F.min("id").alias("rep")).where("rep is not null").checkpoint()
    named_texts = texts.where("id is not null")
    bits = bucket_bits(sets.agg(F.sum("n")).first()[0] or 0, like, parts)
    joined = joined_sets(list_table(named_texts, like, frequent_elements(named_texts, like), bits)).checkpoint()
    # names of sets to their representatives, for the links that need no comparison
    reps = classes.select("one", "rep")
    exact = joined.where("exact").join(reps, "one").select(F.col("rep").alias("u"), F.col("leader").alias("one")).join(reps, "one").select("u", F.col("rep").alias("v"))
    clusters = components(joined.where("not exact").select(F.col("one").alias("u"), F.col("leader").alias("v")))
    # candidates go by the upper bits of their names
    cut = F.col("one").bitwiseAND(F.lit(-1 << NAME_CUT).cast("long"))
    members = classes.withColumn("cut", cut).join(clusters.toDF("cut", "cluster"), "cut").select(F.col("rep").alias("id"), "n", "one", "two", "cluster").checkpoint()
    # the lists' shuffle, some queries after its last reader, before the sets' one
    release(documents.sparkSession)
    # rows that repeat a key with other words connect their sets
    said = F.struct(*equal)
    several = sets.where("id is not null").groupBy("id").agg(F.min(said).alias("a"), F.max(said).alias("b")).where("a <> b").select("id").checkpoint()
    versions = sets.join(small(several), "id").join(classes, equal).select(F.col("id").alias("u"), F.col("rep").alias("v"))
    found = exact.unionByName(versions).unionByName(_verified(texts, members, like, parts))
    roots = components(found).toDF("rep", "root").checkpoint()
    named = classes.join(roots, "rep", "left").select(*equal, F.coalesce("root", "rep").alias("component_id"))
    # many rows may have one set, so the sets' names are the side that is split if need be
    out = sets.join(named, equal, "left")
    # the row without words of a key that has words elsewhere
    of_key = several.join(roots, several.id == roots.rep).select("id", F.col("root").alias("by_key"))
    out = out.join(small(of_key), "id", "left").withColumn("component_id", F.coalesce("component_id", "by_key"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", F.col("id")).alias("component_id"),
    )
