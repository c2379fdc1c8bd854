"""Packing by powers of two: a document's ids are cut at the binary digits of their number.

A document of n ids becomes one piece for each power of two in n (powers above the
longest length repeat that length). Each piece is a sequence by itself, so no sequence
crosses documents and none needs padding. Equal lengths share the upper bits of
``sequence_id``, which is how a reader takes batches of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobvigil.llm.common import ready, trim
from jobvigil.llm.tokens import KEPT_PIECES

#: Bits of ``sequence_id`` below the length's exponent: number of the task, and of the piece within it.
TASK_BITS, PIECE_BITS = 24, 34


def piece_lengths(n: int, longest: int) -> list[int]:
    """Long pieces first: ``longest`` as often as it goes, then the powers of two in the rest."""
    out = [longest] * (n // longest)
    rest, power = n % longest, longest >> 1
    while rest:
        if rest & power:
            out.append(power)
            rest -= power
        power >>= 1
    return out


def pack(
    documents: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", end_id: int = 2, longest: int = 4096,
    kept_pieces: int = KEPT_PIECES,
) -> DataFrame:
    """One row per piece: key, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers. A document is the ids of its
    whole text and then ``end_id``; a null or empty text is ``end_id`` alone. Each id is
    in exactly one piece, each piece is a sequence and so starts at offset 0. Repeated
    rows are packed each, a null key stays null, an empty table gives none, other
    columns are ignored. ``longest`` must be a power of two. A worker remembers the ids of
    ``kept_pieces`` pieces: fewer take less memory and more time. ``sequence_id`` is unique
    within one evaluation; store the result before reading it twice.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    ready(documents.sparkSession)
    narrow = documents.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from jobvigil.llm.tokens import encoder

        encode, end = encoder(tokenizer_file, kept_pieces), np.asarray([end_id], dtype="<u4").tobytes()
        task, made = TaskContext.get().partitionId(), 0
        schema = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
            ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
        ])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows: list[tuple] = []
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for size in piece_lengths(n, longest):
                        number = ((size.bit_length() - 1) << (TASK_BITS + PIECE_BITS)) | (task << PIECE_BITS) | made
                        rows.append((doc, start, size, ids[4 * start : 4 * (start + size)], n, number, 0))
                        start, made = start + size, made + 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        trim()

    return narrow.mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    ).withColumnRenamed("doc_id", key)
