"""Chat formatting with cumulative-snapshot collapse. DataFrame functions only.

Logs often hold a conversation again each time it grew by a turn. The hash of a prefix is the running exclusive-or of
turn hashes that include the turn's place, so one window gives the hashes of all prefixes. A conversation whose whole
hash and length occur among the proper prefixes of another is a snapshot and leaves by an anti-join; of equal
conversations the smallest id stays. Both sides of the anti-join are distinct, so copies of one conversation weigh one
row. Hashes are 128 bits in two halves.

Order of turns: ``turn``, then role and text; exact repeats of a turn row are turns. Null role and text are rendered
as empty and compared as null. Rows with a null ``conv_id`` belong to no conversation and are left out. An empty table
gives an empty table. A rendered conversation is one value, so it is held by one task, as a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: int) -> Column:
    # a null and an empty string differ by the flags
    return F.xxhash64(F.lit(seed), F.col("__i"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def _plain(c: str) -> Column:
    """The text with turn marks defused, so content can't end a turn."""
    return F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place and the hash of the conversation up to it."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null").withColumn("__i", F.row_number().over(by))
    running = Window.partitionBy("conv_id").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    hashed = placed.withColumn("__a", _turn_hash(1)).withColumn("__b", _turn_hash(2))
    return hashed.withColumn("__a", F.bit_xor("__a").over(running)).withColumn("__b", F.bit_xor("__b").over(running))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id n_turns n_copies``: conversations that no other one extends, one for each set of equal ones."""
    p = prefixes(turns).select("conv_id", "__i", "__a", "__b").withColumn("__n", F.max("__i").over(Window.partitionBy("conv_id")))
    whole = p.filter("__i = __n").groupBy("__i", "__a", "__b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = p.filter("__i < __n").select("__i", "__a", "__b").distinct()
    kept = whole.join(proper, ["__i", "__a", "__b"], "left_anti")
    return kept.select("conv_id", F.col("__i").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """``conv_id n_turns n_copies rendered`` of the maximal conversations."""
    line = F.concat(F.lit(START), _plain("role"), F.lit("\n"), _plain("text"), F.lit(END + "\n"))
    kept = maximal(turns)
    rows = turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    return rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(F.transform(parts, lambda x: x.getField("line")), "").alias("rendered"))


def op6(turns: DataFrame) -> DataFrame:
    return render(turns)
