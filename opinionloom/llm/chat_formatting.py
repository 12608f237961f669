"""Chat formatting that collapses cumulative snapshots, in DataFrame functions only.

Logs often hold one conversation several times, each time with a few turns more. A rolling hash over the turns,
which adds a hash of place, role and text at each turn, names every prefix of every conversation. A
conversation whose whole name is the name of a proper prefix of another one is a snapshot and is dropped by an
anti-join; of equal conversations the smallest conv_id stays. Only what remains is rendered. Texts are hashed
before the first shuffle; the names move narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPENING, CLOSING = "<|{}|>\n", "<|end|>\n"


def turn_name() -> Column:
    return F.md5(F.concat_ws("\x1f", "role", "text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), n (turns of the conversation), a, b (rolling hashes up to the place)."""
    narrow = turns.select("conv_id", "turn", turn_name().alias("name")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "name")
    placed = narrow.select("conv_id", "turn", "name", F.row_number().over(order).alias("place"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = [F.xxhash64(F.lit(k), "place", "name").cast("decimal(20,0)") for k in (1, 2)]
    return placed.select(
        "conv_id", "place", F.count("*").over(Window.partitionBy("conv_id")).alias("n"),
        F.sum(step[0]).over(so_far).alias("a"), F.sum(step[1]).over(so_far).alias("b"),
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text (rendered) of every maximal conversation, ordered within by turn.

    Turns that repeat a whole row of a conversation count once; turns with one number are ordered by a hash of
    their content. A null role is `unknown`, a null text empty, a null turn first. Rows without conv_id belong
    to no conversation and are left out. An empty table gives an empty table; extra columns are ignored. A
    conversation becomes one row, so it must fit in a task.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    named = prefixes(turns)
    whole = named.where("place = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = named.where("place < n").select(F.col("place").alias("n"), "a", "b").distinct()
    kept = whole.join(proper, ["n", "a", "b"], "left_anti").select("conv_id", "n_copies")
    lines = turns.join(kept, "conv_id").groupBy("conv_id", "n_copies").agg(
        F.array_sort(F.collect_set(F.struct("turn", turn_name().alias("name"), "role", "text"))).alias("turns")
    )
    opening, closing = OPENING.split("{}"), F.lit(CLOSING)
    rendered = F.transform("turns", lambda t: F.concat(F.lit(opening[0]), t["role"], F.lit(opening[1]), t["text"], F.lit("\n"), closing))
    return lines.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(rendered, "").alias("text"))
