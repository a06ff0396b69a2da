"""Preference formatting: chosen and rejected conversations as one prompt and
two masked completions.

The longest common turn prefix of the two is rendered once as the prompt; what
follows is the completion of either side. Masks are character ranges of the
completion that a loss may see: the text and end mark of assistant turns, not
the headers and not later user turns.

Scale: conversations are assembled by one aggregation on ``conv_id`` (a
conversation is one record, so its turns meet in one row); pairs are joined by
key, nothing is compared with more than its partner, so a first turn or a
whole conversation that many share costs nothing extra.

Defined cases: very long texts are rendered whole; a null role reads ``unknown``, a null text is empty; turns with
equal numbers are ordered by role and text, repeated rows are kept as turns;
rows without ``conv_id`` belong to no conversation and give no row; when one
side is a prefix of the other (or equal) its completion is empty with no mask
and ``trainable`` is false; an empty table gives an empty result; other columns
are ignored. The opening mark ``<|`` inside roles and texts is written ``< |``, so a text
cannot forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tally.llm.common import stage

END = "<|end|>\n"


def _clean(c: Column, default: str) -> Column:
    return F.replace(F.coalesce(c, F.lit(default)), F.lit("<|"), F.lit("< |"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _clean(turn["role"], "unknown"), F.lit("|>\n"))


def _render(turn: Column) -> Column:
    return F.concat(_header(turn), _clean(turn["text"], ""), F.lit("\n" + END))


def render(turns: Column) -> Column:
    """Text of an array of ``struct<role, text>`` turns."""
    return F.array_join(F.transform(turns, _render), "")


def loss_ranges(turns: Column) -> Column:
    """``array<struct<start, end>>`` of the assistant parts of ``render(turns)``."""

    def step(state: Column, turn: Column) -> Column:
        whole, header = F.length(_render(turn)), F.length(_header(turn))
        one = F.array(F.struct((state["at"] + header).alias("start"), (state["at"] + whole - 1).alias("end")))
        return F.struct((state["at"] + whole).alias("at"),
                        F.when(turn["role"] == "assistant", F.concat(state["spans"], one))
                        .otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return F.aggregate(turns, start, step, lambda state: state["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that the two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.array_min(differ), n))


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns`` (``array<struct<role, text>>`` in turn order)."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return (rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(turns.alias("_t"))
            .select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
                    .alias("turns")))


def format_preferences(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pairs with array columns ``chosen`` and ``rejected`` (null: no turns) as
    ``keys``, ``n_prompt_turns``, ``prompt``, ``chosen``, ``rejected``,
    ``chosen_mask``, ``rejected_mask`` and ``trainable``."""
    empty = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    base = pairs.select(*keys, F.coalesce("chosen", empty).alias("_c"), F.coalesce("rejected", empty).alias("_r"))
    base = base.withColumn("n_prompt_turns", common_turns(F.col("_c"), F.col("_r")))

    def rest(c: str) -> Column:
        return F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.size(c))

    out = base.select(*keys, "n_prompt_turns",
                      F.when(F.col("n_prompt_turns") > 0, render(F.slice("_c", F.lit(1), F.col("n_prompt_turns"))))
                      .otherwise("").alias("prompt"),
                      F.when(F.size("_c") > F.col("n_prompt_turns"), rest("_c")).otherwise(empty).alias("_c"),
                      F.when(F.size("_r") > F.col("n_prompt_turns"), rest("_r")).otherwise(empty).alias("_r"))
    out = out.select(*keys, "n_prompt_turns", "prompt", render(F.col("_c")).alias("chosen"),
                     render(F.col("_r")).alias("rejected"), loss_ranges(F.col("_c")).alias("chosen_mask"),
                     loss_ranges(F.col("_r")).alias("rejected_mask"))
    return out.withColumn("trainable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def _digits(c: Column, at: int, n: int) -> Column:
    """``n`` hex digits of the MD5 of ``c`` from ``at`` on, as a number."""
    return F.conv(F.substring(F.md5(c.cast("string")), at, n), 16, 10).cast("long")


def swapped_replies(convs: DataFrame, block: int = 256, earlier: bool = False) -> DataFrame:
    """Preference pairs from plain conversations: chosen is a conversation up
    to its last assistant turn; rejected is the same with that reply replaced
    by the last reply of the next conversation. With ``earlier`` a digest of
    the id names the assistant turn at which rejected leaves and ends, so that
    chosen may go on for several turns.

    Conversations with a reply are dealt by a digest of their id to groups of
    ``block`` in the mean (one group below twice as many), whatever the ids;
    the next one is the next id of the group, for the last one the first. A
    group is never a single one but where a table has a single conversation
    with a reply; that one, and those without a reply, give no pair."""
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    told = stage(convs.withColumn("_replies", replies).filter(F.size("_replies") > 0), "told")
    groups = max(1, told.count() // block)
    told = (told.withColumn("_last", F.element_at("_replies", -1))
            .withColumn("_reply", F.get(F.col("turns"), F.col("_last")))
            .withColumn("_group", _digits(F.col("conv_id"), 1, 15) % groups))
    leaves = F.get("_replies", (_digits(F.col("conv_id"), 17, 8) % F.size("_replies")).cast("int"))
    told = told.withColumn("_at", leaves if earlier else F.col("_last"))
    w = Window.partitionBy("_group").orderBy("conv_id")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct(F.col("conv_id").alias("donor"), F.col("_reply").alias("reply"))
    told = (told.withColumn("_next", F.coalesce(F.lead(other).over(w), F.first(other).over(all_)))
            .filter(F.col("_next.donor") != F.col("conv_id")))
    before = F.when(F.col("_at") > 0, F.slice("turns", F.lit(1), F.col("_at"))).otherwise(F.slice("turns", 1, 0))
    return told.select("conv_id", F.col("_next.donor").alias("donor_id"),
                       F.slice("turns", F.lit(1), F.col("_last") + 1).alias("chosen"),
                       F.concat(before, F.array("_next.reply")).alias("rejected"))
