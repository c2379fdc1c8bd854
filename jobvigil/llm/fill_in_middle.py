"""Fill-in-middle: a text cut at two places and put together so that its middle comes last.

A cut is a number of code points, a text is stored as UTF-8. From the number to the place
in the bytes leads a learned index: straight lines, each fitted to as many character
boundaries in a row as it can pass within ``ERROR`` bytes of, and what it is off by at every
boundary, in one byte. A cut's place is the line's value plus that residual, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobvigil.llm.common import ready, with_temporary

#: Fixed: what stands before each part. None of them can begin inside another or inside a text that is cut.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares, of a hundred, of texts that are cut, and of those with the suffix first.
CUT_OF_100, SUFFIX_FIRST_OF_100 = 90, 20
#: Bytes that a line may be off; residuals then fit one signed byte with room for rounding.
ERROR = 120
#: Boundaries that are fitted at a time.
STEP = 1 << 16


class RankIndex:
    """From the number of a code point to its place in the UTF-8 bytes of a text."""

    def __init__(self, data: bytes):
        import numpy as np

        raw = np.frombuffer(data, dtype=np.uint8)
        self.first, self.place, self.slope, residuals = [], [], [], []
        line, number = None, 0  # the open line: first boundary, its place, least and greatest slope
        for at in range(0, len(raw) + 1, STEP):
            part = np.flatnonzero((raw[at : at + STEP] & 0xC0) != 0x80).astype(np.int64) + at
            if at + STEP > len(raw):
                part = np.append(part, len(raw))  # the end is a boundary too
            done, reach = 0, 256  # as far as is looked ahead, farther while the line holds
            while done < len(part):
                if line is None:
                    line, done, reach = (number + done, int(part[done]), 0.0, float("inf")), done + 1, 256
                    continue
                first, place, least, most = line
                ahead = part[done : done + reach]
                run, rise = np.arange(number + done, number + done + len(ahead)) - first, ahead - place
                low = np.maximum(np.maximum.accumulate((rise - ERROR) / run), least)
                high = np.minimum(np.minimum.accumulate((rise + ERROR) / run), most)
                over = low > high
                fits = int(over.argmax()) if over.any() else len(run)
                if fits:
                    line = (first, place, float(low[fits - 1]), float(high[fits - 1]))
                done, reach = done + fits, 2 * reach
                if fits < len(ahead):
                    self._close(line)
                    line = None
            number += len(part)
        self._close(line)
        self.n = number - 1
        # one more pass, line by line: what each boundary is off by
        number = 0
        for at in range(0, len(raw) + 1, STEP):
            part = np.flatnonzero((raw[at : at + STEP] & 0xC0) != 0x80).astype(np.int64) + at
            if at + STEP > len(raw):
                part = np.append(part, len(raw))
            residuals.append((part - self.predict(np.arange(number, number + len(part)))).astype(np.int8))
            number += len(part)
        self.residuals = np.concatenate(residuals)

    def _close(self, line) -> None:
        first, place, least, most = line
        self.first.append(first), self.place.append(place)
        self.slope.append((least + most) / 2 if most != float("inf") else 1.0)

    def predict(self, numbers):
        import numpy as np

        line = np.searchsorted(self.first, numbers, side="right") - 1
        first, place, slope = (np.asarray(x)[line] for x in (self.first, self.place, self.slope))
        return place + np.rint(slope * (numbers - first)).astype(np.int64)

    def offsets(self, numbers):
        """Where the code points with these numbers (0 to n) begin."""
        import numpy as np

        numbers = np.asarray(numbers, dtype=np.int64)
        return self.predict(numbers) + self.residuals[numbers]


def draws(key: Column) -> list[Column]:
    """Four 32-bit numbers from a document's key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``fim``: n, form, prefix_chars, middle_chars, output.

    ``n`` counts the code points of the whole text, null being empty. The form is
    ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain``: the text as
    it is, if it is empty, holds one of the three marks, or is drawn so; the lengths are
    then null. Draws follow from the key, so a repeated row is cut alike; a null
    key counts as an empty one. All rows and other columns stay, a column ``fim`` is
    replaced; an empty table gives an empty one.
    """
    ready(documents.sparkSession)
    kept = [c for c in documents.columns if c.lower() != "fim"]
    whole = with_temporary(documents, "whole_row")
    narrow = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias(whole), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
        F.array(*draws(F.col(f"`{key}`"))).alias("h"),
    )
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])
        for batch in batches:
            rows = []
            for data, h in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = data.as_py()
                index = RankIndex(data)
                n = index.n
                if not n or h[2] % 100 >= CUT_OF_100 or any(m in data for m in marks):
                    rows.append({"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": data})
                    continue
                a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                x, y = index.offsets([a, b]).tolist()
                prefix, middle, suffix = marks[0] + data[:x], marks[2] + data[x:y], marks[1] + data[y:]
                form = "spm" if h[3] % 100 < SUFFIX_FIRST_OF_100 else "psm"
                output = (suffix + prefix if form == "spm" else prefix + suffix) + middle
                rows.append({"n": n, "form": form, "prefix_chars": a, "middle_chars": b - a, "output": output})
            yield pa.record_batch([batch.column(0), pa.array(rows, made)], names=[whole, "fim"])

    row = narrow.schema[whole].dataType.simpleString()
    out = narrow.mapInArrow(run, f"`{whole}` {row}, fim struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: binary>")
    fim = [F.col("fim")[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")]
    return out.select(*(F.col(whole)[c].alias(c) for c in kept), F.struct(*fim, F.col("fim.output").cast("string").alias("output")).alias("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from output and form alone."""
    body = F.substr(output, F.lit(1 + len(PREFIX)))
    before, after = lambda s, mark: F.substring_index(s, mark, 1), lambda s, mark: F.substring_index(s, mark, -1)
    middle = after(body, MIDDLE)
    psm = F.concat(before(body, SUFFIX), middle, before(after(body, SUFFIX), MIDDLE))
    spm = F.concat(before(after(body, PREFIX), MIDDLE), middle, before(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
