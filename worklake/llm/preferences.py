"""Preference formatting: one prompt, two masked completions.

Of a pair's chosen and rejected conversation the longest common prefix of turns (equal role and text)
is rendered once, as the prompt; what follows in each is its completion. A turn is rendered as
`<|role|>\\n` + text + `<|end|>\\n`. The mask gives runs `length:flag` over a completion, in
characters: 1 for what an assistant wrote with its end mark, 0 for headers and other roles.

`report` makes the pairs: a conversation as it is, and the same one whose last assistant turn is that of
the conversation with the next id. They share all turns before it, so these are the prompt. Where there
is no next conversation or no assistant turn, both are the same.

Turns are ordered by number (null first), then role, then text; repeated turns stay (ties). Null role is
`unknown`, null text empty. A missing side is an empty conversation. Equal conversations give empty
completions (`same` is true). A turn without pair_id or conv_id belongs to no conversation and is a pair
of its own, so such turns never meet in one task. Very long texts are rendered whole, an empty table
gives an empty one, and other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def _header(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(t["text"], F.lit("<|end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    def runs(t: Column) -> Column:
        flag = F.when(t["role"] == TRAINED, F.lit("1")).otherwise(F.lit("0"))
        sizes = [F.char_length(x).cast("string") for x in (_header(t), _body(t))]
        return F.concat(sizes[0], F.lit(":0,"), sizes[1], F.lit(":"), flag)

    return F.array_join(F.transform(turns, runs), ",")


def format_pairs(turns: DataFrame) -> DataFrame:
    """`turns`: pair_id, side ('rejected', else chosen), turn, role, text. One row a pair.

    Turns without pair_id are told apart by `lone`, if there is such a column.
    """
    if "lone" not in turns.columns:
        turns = turns.withColumn("lone", F.when(F.col("pair_id").isNull(), F.monotonically_increasing_id()))
    rejected = F.coalesce(F.col("side") == "rejected", F.lit(False))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    pairs = turns.groupBy("pair_id", "lone").agg(
        F.sort_array(F.collect_list(F.when(~rejected, turn))).alias("c"),
        F.sort_array(F.collect_list(F.when(rejected, turn))).alias("r"),
    )
    shorter = F.least(F.size("c"), F.size("r"))
    at = F.filter(
        F.sequence(F.lit(0), shorter - 1),
        lambda i: (F.get(F.col("c"), i)["role"] != F.get(F.col("r"), i)["role"])
        | (F.get(F.col("c"), i)["text"] != F.get(F.col("r"), i)["text"]),
    )
    k = F.when(shorter == 0, 0).otherwise(F.coalesce(F.get(at, F.lit(0)), shorter))
    return (
        pairs.withColumn("k", k)
        .withColumn("p", F.slice("c", F.lit(1), F.col("k")))
        .withColumn("c", F.slice("c", F.col("k") + 1, F.size("c")))
        .withColumn("r", F.slice("r", F.col("k") + 1, F.size("r")))
        .select(
            "pair_id",
            F.col("k").cast("long").alias("n_prompt_turns"),
            _render(F.col("p")).alias("prompt"),
            _render(F.col("c")).alias("chosen"),
            _render(F.col("r")).alias("rejected"),
            _mask(F.col("c")).alias("chosen_mask"),
            _mask(F.col("r")).alias("rejected_mask"),
            ((F.size("c") == 0) & (F.size("r") == 0)).alias("same"),
        )
    )


def swapped_endings(conversations: DataFrame) -> DataFrame:
    """Turns of pairs: each conversation, and the same one with the next conversation's last assistant turn."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("pair_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    named = turns.where("pair_id is not null")
    last = named.where(F.col("role") == TRAINED).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    ending = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.text").alias("other"))
    ends = F.coalesce((F.col("role") == TRAINED) & (F.struct("turn", "text") == F.col("last")), F.lit(False))
    both = named.join(last, "pair_id", "left").join(ending, "pair_id", "left").select(
        "pair_id", F.lit(None).cast("long").alias("lone"), "turn", "role", "text",
        F.when(ends, F.coalesce("other", "text")).otherwise(F.col("text")).alias("instead"),
    )
    loose = turns.where("pair_id is null").select(
        "pair_id", F.monotonically_increasing_id().alias("lone"), "turn", "role", "text", F.col("text").alias("instead")
    )
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
        F.struct(F.lit("rejected").alias("side"), F.col("instead").alias("text")),
    )
    return both.unionByName(loose).select("pair_id", "lone", "turn", "role", F.inline(sides))


def report(conversations: DataFrame) -> DataFrame:
    """One pair a conversation, see `swapped_endings`."""
    return format_pairs(swapped_endings(conversations))
