"""Chat formatting with cumulative snapshots collapsed.

Logs often hold a conversation again after every turn. A rolling hash of the turns so far
identifies every prefix; conversations whose whole hash is a prefix of a longer one leave by an
anti-join, equal ones count once, and the maximal ones that stay are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import stored

# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: int) -> Column:
    parts = [F.col("k")]
    for c in ("role", "text"):
        parts += [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))]
    return F.xxhash64(F.lit(seed), *parts)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k, n and the 128-bit hash (p1, p2) of turns 1 to k of each conversation.

    ``turns`` has conv_id, turn, role and text; turns are ordered by turn, then role and text.
    The hash is the exclusive or of hashes of place and content, so it runs along a window
    without gathering the conversation.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        turns.select("conv_id", "turn", "role", "text", F.row_number().over(by_turn).alias("k"))
        .select("conv_id", "turn", "role", "text", "k", _turn_hash(1).alias("h1"), _turn_hash(2).alias("h2"))
        .select(
            "conv_id",
            "k",
            F.max("k").over(Window.partitionBy("conv_id")).alias("n"),
            F.bit_xor("h1").over(so_far).alias("p1"),
            F.bit_xor("h2").over(so_far).alias("p2"),
        )
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of conversations that begin no longer one. Equal
    conversations give one row with the smallest id and their number."""
    book = stored(prefixes(turns), "prefixes")
    whole = (
        book.filter("k = n")
        .groupBy("n", "p1", "p2")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    begun = book.filter("k < n").select("k", F.col("p1").alias("q1"), F.col("p2").alias("q2")).distinct()
    left = whole.join(begun, F.expr("n = k and p1 = q1 and p2 = q2"), "left_anti")
    return left.select("conv_id", F.col("n").cast("bigint").alias("n_turns"), "n_copies")


def _shown(role: Column, text: Column) -> Column:
    """One turn; a mark within a text is broken by a blank, so it cannot pose as one."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(CLOSE + "\n"))


def format_chats(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, ``rendered``.

    Rows with a null id are one conversation, which a like one with an id stands for. Null
    roles and texts differ from empty ones when conversations are compared and render as
    empty. Repeated rows are repeated turns; turns that share a number are ordered by role and
    text. Other columns are not carried; an empty table gives an empty one.
    """
    turns = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    chosen = maximal(turns).withColumnRenamed("conv_id", "id")
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return (
        turns.join(chosen, F.col("conv_id").eqNullSafe(F.col("id")))
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_join(F.transform(parts, lambda p: _shown(p["role"], p["text"])), "").alias("rendered"))
    )
