"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs often hold a conversation many times, each time a few turns longer. Every turn
is hashed with its place; the running xor of those hashes over a conversation names
each of its prefixes (128 bits and its length). A conversation whose whole is a
proper prefix of another is anti-joined away, of equal ones the smallest conv_id
stays, and what is maximal is rendered.

Turns are ordered by turn, then role and text. Repeated rows count once. Null role
or text is empty; rows without conv_id belong to no conversation and are left out;
a null turn comes first. An empty table has no conversations. Other columns are not
read, whatever their names. The running hash is a window that can spill, so a
conversation of any length, and of long texts, is no array before it is rendered,
and each gives one row of output by contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"


def _harmless(text: Column) -> Column:
    """Text in which no turn mark can be read."""
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _harmless(role), F.lit(CLOSE + "\n"), _harmless(text), F.lit(f"\n{OPEN}end{CLOSE}\n"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turns, role, text, h1, h2): a row for every prefix, its last turn and its hash."""
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far, whole = own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    placed = rows.distinct().withColumn("place", F.row_number().over(own))
    hashed = placed.select(
        "conv_id", "turn", "role", "text", "place", F.xxhash64("place", "role", "text").alias("x"), F.xxhash64(F.lit("second"), "text", "role", "place").alias("y")
    )
    return hashed.select(
        "conv_id",
        "place",
        F.count("*").over(whole).alias("turns"),
        "role",
        "text",
        F.expr("bit_xor(x)").over(so_far).alias("h1"),
        F.expr("bit_xor(y)").over(so_far).alias("h2"),
    )


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id of every conversation that is no proper prefix of another and the first of its equals."""
    key = ["place", "h1", "h2"]
    whole = rows.where("place = turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    return whole.join(rows.where("place < turns").select(*key).distinct(), key, "left_anti").select("conv_id")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of every maximal conversation."""
    rows = prefixes(conversations)
    kept = rows.join(maximal(rows), "conv_id", "left_semi")
    turns = F.sort_array(F.collect_list(F.struct("place", render_turn(F.col("role"), F.col("text")).alias("shown"))))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(turns, lambda t: t["shown"]), "").alias("rendered"))
