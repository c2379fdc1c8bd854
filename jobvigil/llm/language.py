"""Language of texts: sparse multinomial logistic regression on TF-IDF of character n-grams.

How many documents hold an n-gram is counted over all labelled documents. The weights
are fitted on a bounded sample of their distinct texts, drawn by hash, with the follow-the-regularised-
leader rule and an elastic-net penalty; a temperature, fitted on a part of the sample
kept aside, makes the probabilities honest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobvigil.llm.common import ready, with_temporary

#: What a text without letters is said to be in.
UNKNOWN = "und"
#: Characters that are worked on at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Training:
    """``sample``: distinct labelled texts per language that weights are fitted on, on average over draws."""

    sample: int = 1000
    longest: int = 3
    buckets: int = 1 << 13
    rounds: int = 4
    batch: int = 32
    rate: float = 0.5
    smooth: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    aside: float = 0.2


@dataclass(frozen=True)
class Model:
    languages: list[str]
    training: Training
    idf: object = None
    weights: object = None
    temperature: float = 1.0
    facts: dict = field(default_factory=dict)


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def counts(text: str, training: Training):
    """How often each bucket's n-grams (of one to ``longest`` characters) are in the whole text, lower-cased."""
    import numpy as np

    total = np.zeros(training.buckets, dtype=np.int64)
    lower, reach = text.lower(), training.longest - 1
    for at in range(0, len(lower), CHUNK):
        codes = np.frombuffer(lower[max(0, at - reach) : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        skip = min(at, reach)
        gram = np.zeros(len(codes), dtype=np.uint32)
        for size in range(1, training.longest + 1):
            # ``gram[i]`` ends up as a hash of the characters i to i + size
            gram = (gram[: len(codes) - size + 1] * np.uint32(0x9E3779B1) + codes[size - 1 :] + np.uint32(size)) if size <= len(codes) else gram[:0]
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            first = max(0, skip - size + 1)  # those that end before this chunk were counted
            total += np.bincount(mixed[first:] >> np.uint32(32 - (training.buckets.bit_length() - 1)), minlength=training.buckets)
    return total


def _vector(total, idf):
    """Places and values of the normalised TF-IDF, and a constant at the end."""
    import numpy as np

    at = np.flatnonzero(total)
    value = (1.0 + np.log(total[at])) * idf[at]
    norm = float(np.sqrt((value**2).sum())) or 1.0
    return np.append(at, len(idf)), np.append(value / norm, 0.1)


def _fit(vectors: list, labels, n_languages: int, t: Training):
    """Follow the regularised leader; each coordinate has its own rate, and stays 0 until its sum outgrows ``l1``."""
    import numpy as np

    shape = (t.buckets + 1, n_languages)
    z, n, w = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    order = np.random.default_rng(1)
    for _ in range(t.rounds):
        rows = order.permutation(len(vectors))
        for at in range(0, len(rows), t.batch):
            some = rows[at : at + t.batch]
            x = np.zeros((len(some), shape[0]))
            for i, r in enumerate(some):
                x[i, vectors[r][0]] = vectors[r][1]
            logits = x @ w
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1.0
            g = x.T @ p
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / t.rate
            z += g - sigma * w
            n += g * g
            w = np.where(np.abs(z) <= t.l1, 0.0, -(z - np.sign(z) * t.l1) / ((t.smooth + np.sqrt(n)) / t.rate + t.l2))
    return w


def _temperature(logits, labels) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    import numpy as np

    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        top = scaled.max(axis=1)
        return float((top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[np.arange(len(labels)), labels]).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(documents: DataFrame, text: str = "text", label: str = "lang", training: Training = Training()) -> Model:
    """A model from the rows with a label and a text; without any, one that knows no language."""
    import numpy as np

    ready(documents.sparkSession)
    known = documents.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("string").alias("label")).where(
        F.col("label").isNotNull() & F.col("text").isNotNull())
    # copies of a text are one text of the sample, however many there are; a task sends each on once
    known = known.withColumn("hash", F.xxhash64("text", "label"))
    texts = known.select("label", "hash").distinct()
    per_label = {r["label"]: (r["n"], r["least"]) for r in texts.groupBy("label").agg(F.count("*").alias("n"), F.min("hash").alias("least")).collect()}
    languages = sorted(per_label)
    if not languages:
        return Model([], training)

    def spread(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen, rows = np.zeros(training.buckets, dtype=np.int64), 0
        for batch in batches:
            for words in batch.column(0):
                seen += counts(words.as_py(), training) > 0
                rows += 1
        held = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(seen[held], rows), pa.int64())], names=["bucket", "n"])

    # one row per bucket and task, summed by bucket
    held = np.zeros(training.buckets)
    n_rows = 0
    for r in known.select("text").mapInArrow(spread, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["bucket"] < 0:
            n_rows = r["n"]
        else:
            held[r["bucket"]] = r["n"]
    idf = np.log((1.0 + n_rows) / (1.0 + held)) + 1.0

    def featured(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        met = set()
        for batch in batches:
            new = []
            for i, drawn in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if drawn not in met:
                    met.add(drawn), new.append(i)
            some = batch.take(pa.array(new, pa.int64()))
            totals = [counts(words.as_py(), training) for words in some.column(0)]
            at = [np.flatnonzero(t) for t in totals]
            yield pa.record_batch(
                [some.column(1), some.column(2), pa.array([a.astype("<u4").tobytes() for a in at], pa.binary()), pa.array([t[a].astype("<u4").tobytes() for t, a in zip(totals, at, strict=True)], pa.binary())],
                names=["label", "hash", "at", "n"],
            )

    share, least = F.lit(None).cast("double"), F.lit(None).cast("long")
    for name in languages:
        n, first = per_label[name]
        share = F.when(F.col("label") == name, float(min(1.0, training.sample / n))).otherwise(share)
        least = F.when(F.col("label") == name, F.lit(first)).otherwise(least)
    draw = F.pmod(F.col("hash"), F.lit(1 << 30)) / float(1 << 30)
    # the text with the smallest hash is always in, so no label is without one
    drawn = known.where((draw < share) | (F.col("hash") == least)).select("text", "label", "hash").mapInArrow(featured, "label string, hash long, at binary, n binary")
    sample = sorted((r["label"], bytes(r["at"]), bytes(r["n"])) for r in drawn.dropDuplicates(["label", "hash"]).toLocalIterator())
    vectors = []
    for _, at, n in sample:
        total = np.zeros(training.buckets, dtype=np.int64)
        total[np.frombuffer(at, "<u4")] = np.frombuffer(n, "<u4")
        vectors.append(_vector(total, idf))
    labels = np.array([languages.index(s[0]) for s in sample], dtype=np.int64)
    aside = np.random.default_rng(2).random(len(sample)) < training.aside
    aside[np.unique(labels, return_index=True)[1]] = False  # one of each label is fitted on
    inside = np.flatnonzero(~aside)
    weights = _fit([vectors[i] for i in inside], labels[inside], len(languages), training)
    temperature = 1.0
    if aside.sum() >= 20:
        logits = np.stack([v @ weights[at] for at, v in (vectors[i] for i in np.flatnonzero(aside))])
        temperature = _temperature(logits, labels[aside])
    facts = {"rows": int(n_rows), "sample": len(sample), "non_zero": float((weights != 0).mean())}
    return Model(languages, training, idf.astype(np.float32), weights.astype(np.float32), temperature, facts)


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, the probability of that language, from the whole text alone.

    A null text and one without a letter, and every text under a model without
    languages, are ``und`` with score 0. Repeated rows get the same answer each, an
    empty table gives an empty one, columns of those two names are replaced.
    """
    ready(documents.sparkSession)
    names = [c for c in documents.columns if c.lower() not in ("lang_pred", "score")]
    rest = with_temporary(documents, "rest")
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(rest), F.col(f"`{text}`").alias("text"))
    # a text that goes along with its row is read there, so that a worker holds it once
    at_text = [c.lower() for c in names].index(text.lower()) if text.lower() in (c.lower() for c in names) else None
    if at_text is not None:
        packed = packed.select(rest)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            said, scores = [], []
            for value in batch.column(1) if at_text is None else batch.column(0).field(at_text):
                words = value.as_py()
                if not model.languages or words is None or not has_letter(words):
                    said.append(UNKNOWN), scores.append(0.0)
                    continue
                at, v = _vector(counts(words, model.training), model.idf)
                logits = (v @ model.weights[at]) / model.temperature
                p = np.exp(logits - logits.max())
                best = int(p.argmax())
                said.append(model.languages[best]), scores.append(float(p[best] / p.sum()))
            yield pa.record_batch([batch.column(0), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[rest, "lang_pred", "score"])

    inner = packed.schema[rest].dataType.simpleString()
    done = packed.mapInArrow(run, f"`{rest}` {inner}, lang_pred string, score double")
    return done.select(*(F.col(rest)[c].alias(c) for c in names), "lang_pred", "score")
