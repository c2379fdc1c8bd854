"""Token ids in files: every id in the fewest bits that hold the vocabulary, in blocks that say where they start.

A file is one task's share of the documents in ascending order of their key, stored
as Parquet, since that is what Spark commits whole or not at all to any store. Each
row is a block of whole documents:

    part      number of the file, in the order of the documents
    block     number of the block in it
    start     ids before the block in its file
    n_ids     ids in the block
    bits      bits of each id
    keys      of its documents
    lengths   ids of each
    payload   the ids, ``bits`` each, lowest bit first

The place of id i in a payload is bit ``i * bits``, so a reader can open it anywhere
and numpy unpacks any run at once. ``<path>/index`` has one row per file with its number of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobvigil.llm.common import ready

#: A block is closed once it has so many ids; a document is never cut.
BLOCK_IDS = 1 << 17
_BLOCKS = (
    "part int, block int, start long, n_ids long, bits int, keys array<bigint>, lengths array<bigint>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids, bits: int) -> bytes:
    import numpy as np

    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits than the vocabulary has")
    out = [
        np.packbits(((ids[at : at + 65536, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little")
        for at in range(0, len(ids), 65536)  # 65536 ids of any width fill whole bytes
    ]
    return b"".join(part.tobytes() for part in out)


def unpack_bits(payload: bytes, bits: int, first: int, n: int):
    """Ids ``first`` to ``first + n`` of a payload as unsigned 32-bit integers."""
    import numpy as np

    data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8)
    place = np.arange(first, first + n, dtype=np.int64) * bits
    byte, shift = place >> 3, (place & 7).astype(np.uint64)
    word = np.zeros(n, dtype=np.uint64)
    for k in range((bits + 7 + 7) // 8):
        word |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype("<u4")


def write_token_files(
    documents: DataFrame, path: str, tokenizer_file: str, vocabulary: int, key: str = "doc_id", text: str = "text", end_id: int = 2,
) -> None:
    """Writes all documents' ids, each document followed by ``end_id``, under ``path``.

    Documents are in ascending order of their key, a null key first, ties by text. A
    null or empty text is ``end_id`` alone. Repeated rows are stored each. An empty
    table makes files without blocks. Other columns are ignored.
    """
    spark = documents.sparkSession
    parts = ready(spark)
    bits = bits_for(vocabulary)
    # the range boundaries need a look at the keys; texts are moved once and encoded after the move
    ordered = (
        documents.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        .repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from jobvigil.llm.tokens import encoder

        encode, end = encoder(tokenizer_file), np.asarray([end_id], dtype="<u4").tobytes()
        part, block, start = TaskContext.get().partitionId(), 0, 0
        keys, lengths, held = [], [], []
        schema = pa.schema([
            ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()),
            ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()),
        ])

        def close():
            nonlocal block, start
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            row = (part, block, start, len(ids), bits, list(keys), list(lengths), pack_bits(ids, bits))
            block, start = block + 1, start + len(ids)
            keys.clear(), lengths.clear(), held.clear()
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        waiting = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    keys.append(doc), lengths.append(len(ids) // 4 + 1), held.append(ids + end)
                    waiting += len(ids) // 4 + 1
                    if waiting >= BLOCK_IDS:
                        yield close()
                        waiting = 0
        if held:
            yield close()

    ordered.mapInArrow(run, _BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, with ``first``: ids of all files and blocks before each."""
    # one row per file, so a window over all of them is small; the sum of what is before each file
    before = spark.read.schema("part int, n_ids long").parquet(f"{path}/index").select(
        "part", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    return (
        spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").join(F.broadcast(before), "part")
        .withColumn("first", F.col("before") + F.col("start")).drop("before")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: key, start, n_tokens, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["payload"], row["bits"], 0, row["n_ids"])
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                yield pa.record_batch(
                    [
                        pa.array(row["keys"], pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(row["lengths"], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["key", "start", "n_tokens", "ids"],
                )

    ready(spark)
    return read_blocks(spark, path).select("first", "n_ids", "bits", "keys", "lengths", "payload").mapInArrow(
        run, "key long, start long, n_tokens long, ids binary"
    )


def blocks_of_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """The blocks that hold ids ``start`` to ``start + n`` of the whole store.

    The index tells the first and the last file. That goes to the scan as bounds of
    ``part``, so of the other files only the footers are read.
    """
    until = F.sum("n_ids").over(Window.orderBy("part"))
    files = spark.read.schema("part int, n_ids long").parquet(f"{path}/index").withColumn("until", until)
    held = files.where((F.col("until") > start) & (F.col("until") - F.col("n_ids") < start + n))
    low, high = held.agg(F.min("part"), F.max("part")).first()
    here = F.lit(False) if low is None else F.col("part").between(low, high)
    return read_blocks(spark, path).where(here & (F.col("first") < start + n) & (F.col("first") + F.col("n_ids") > start))


def read_range(spark: SparkSession, path: str, start: int, n: int) -> list[int]:
    """Ids ``start`` to ``start + n`` of the whole store, fewer where it ends before. ``n`` has to fit the driver."""
    rows = blocks_of_range(spark, path, start, n).select("first", "n_ids", "bits", "payload").orderBy("first").toLocalIterator()
    out: list[int] = []
    for r in rows:
        a, b = max(start, r["first"]), min(start + n, r["first"] + r["n_ids"])
        out.extend(unpack_bits(bytes(r["payload"]), r["bits"], a - r["first"], b - a).tolist())
    return out
