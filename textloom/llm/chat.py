"""Collapse of cumulative chat snapshots and rendering of the conversations that remain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one rendered row; longer conversations are rendered in several rows, so no row grows without bound.
SEGMENT_TURNS = 1024


def maximal_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(kept, ranked): the conversations that no longer one extends, and all turns with their rank.

    `kept` has conv_id and n_turns; `ranked` has conv_id, rank, role, text. A conversation is dropped
    when its whole sequence of (role, text) is a proper prefix of another's; of equal ones the smallest
    conv_id stays. The prefix hash after k turns is the running XOR of two 64-bit hashes of (rank, role,
    text), so it rolls along a window and its total is an aggregate that combines before the shuffle.
    Identical snapshots and identical prefixes collapse by aggregation before the anti-join, so a first
    turn or a conversation that a third of the logs share is one row there.

    Turns order by number, then role, then text (null first); null role or text counts as ''; rows
    without conv_id belong to no conversation and are left out; repeated rows are turns of their own."""
    t = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ranked = t.select("conv_id", F.row_number().over(w).cast("long").alias("rank"), "role", "text")
    hashed = t.select(
        "conv_id", "turn", "role", "text", F.row_number().over(w).cast("long").alias("rank"), F.lead(F.lit(1)).over(w).isNull().alias("last")
    ).select(
        "conv_id", "turn", "role", "text", "rank", "last",
        F.xxhash64("rank", "role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "rank", "role").alias("h2"),
    )
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("conv_id", "rank", "last", F.bit_xor("h1").over(running).alias("p1"), F.bit_xor("h2").over(running).alias("p2"))
    snapshots = rolled.where("last").groupBy("rank", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = rolled.where("not last").groupBy("rank", "p1", "p2").agg(F.count("*").alias("times")).drop("times")
    kept = snapshots.join(prefixes, ["rank", "p1", "p2"], "left_anti").select("conv_id", F.col("rank").alias("n_turns"))
    return kept, ranked


def format_chats(
    turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>", segment_turns: int = SEGMENT_TURNS, **columns: str
) -> DataFrame:
    """The maximal conversations as (conv_id, segment, n_turns, rendered).

    n_turns is the whole conversation's. Each turn renders as start, role, newline, text, end, newline;
    a row holds up to `segment_turns` turns in order. Nulls, ties and repeats: see
    `maximal_conversations`. An empty table gives no rows."""
    kept, ranked = maximal_conversations(turns, **columns)
    piece = F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(f"{end}\n"))
    return (
        ranked.join(kept, "conv_id")
        .groupBy("conv_id", F.floor((F.col("rank") - 1) / segment_turns).cast("long").alias("segment"), "n_turns")
        .agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece")))).alias("pieces"))
        .select("conv_id", "segment", "n_turns", F.array_join(F.col("pieces.piece"), "").alias("rendered"))
    )
