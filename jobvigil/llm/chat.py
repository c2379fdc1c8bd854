"""Chat formatting with expressions only: sort the turns, merge neighbours of one role, write one text.

The template marks a block of turns by its role and a turn within a block:

    <|from|>user<|says|>first text<|next|>second text<|done|>

All marks start with ``<|``. In roles and texts each backslash is doubled and ``<|``
becomes ``<\\|``, so no text can hold a mark, and reading back undoes it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FROM, SAYS, NEXT, DONE = "<|from|>", "<|says|>", "<|next|>", "<|done|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    # after doubling, a single backslash between < and | can only come from <|
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id, ``formatted``, and ``segments``.

    ``segments`` cuts ``formatted`` into stretches (text, loss); those under the loss
    mask are the texts of ``loss_roles``, one stretch each. Turns come by ``turn``,
    ties by role and text; a null turn comes first. A null role or text counts as
    empty, a null id is one more conversation, repeated rows are turns of their own,
    other columns are ignored. No rows give no rows. A conversation is one value of
    the result, so it is the one thing that has to fit into a task.
    """
    turns = rows.select(
        F.col(f"`{conversation}`").alias("id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    sorted_turns = turns.groupBy("id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    # the first turn of each block of one role, and how many turns the block has
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"] != F.element_at("turns", i)["role"]),
    )
    blocks = F.transform("starts", lambda start, k: F.slice(
        "turns", start, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - start))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    written = F.transform("blocks", lambda block: F.concat(
        F.flatten(F.transform(block, lambda said, k: F.array(
            segment(F.when(k == 0, F.concat(F.lit(FROM), escape(said["role"]), F.lit(SAYS))).otherwise(F.lit(NEXT)), F.lit(False)),
            segment(escape(said["text"]), said["role"].isin(*loss_roles)),
        ))),
        F.array(segment(F.lit(DONE), F.lit(False))),
    ))
    return (
        sorted_turns.withColumn("starts", starts).withColumn("blocks", blocks)
        .withColumn("segments", F.flatten(written))
        .select(F.col("id").alias(conversation), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    split = F.split(formatted, r"<\|from\|>")
    blocks = F.slice(split, F.lit(2), F.size(split))
    turns = F.transform(blocks, lambda block: F.transform(
        F.split(F.regexp_replace(F.element_at(F.split(block, r"<\|says\|>"), 2), r"<\|done\|>$", ""), r"<\|next\|>"),
        lambda text: F.struct(unescape(F.element_at(F.split(block, r"<\|says\|>"), 1)).alias("role"), unescape(text).alias("text")),
    ))
    return F.flatten(turns)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
