"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are the tokens. Each source has a target; the corpus is cut into blocks
of equally many words; sources get whole numbers of blocks by the highest
quotients ``target / (2 j + 1)``, every source hands its blocks to its shards
by the highest quotients of their sizes, and a shard takes its quota of blocks
by a seeded systematic draw. A shard whose quota exceeds its blocks takes the
whole shard once or twice first. Everything is DataFrame functions.

Scale: documents of a source are dealt to shards of about ``docs_per_shard``
by a seeded hash, so a source with a third of all rows is only more shards.
Sums are pre-aggregated; single-task windows run over the table of sources
only, and over the shards of one source (a few rows per ``docs_per_shard``
documents).

Defined cases: a null text has size 0 and takes 0; a null ``source`` is a
source of its own, ordered last; a null ``doc_id`` is kept (its rows order by
size); repeated rows are mixed independently; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tally.llm.common import small, stage, stage_as_is, word_count


def apportion(df: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë seats per row of ``df``: rows of a group share ``seats``
    (one value per group) in proportion to ``votes``.

    The divisor ``sum(votes) / seats`` gives a start that is off by at most
    half the number of rows; the seats that are missing go to the highest
    open quotients, seats in excess leave from the lowest held ones. Equal
    quotients go to the smaller ``key``. A group without votes gets 0.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, rows = F.sum(votes).over(g), F.count(F.lit(1)).over(g)
    start = F.when(total > 0, F.floor(F.col(votes) * F.col(seats) / total + F.lit(0.5))).otherwise(0).cast("long")
    base = (df.withColumn("_start", start)
            .withColumn("_open", F.when(total > 0, F.col(seats) - F.sum("_start").over(g)).otherwise(0))
            .withColumn("_reach", F.when(total > 0, F.ceil((F.abs("_open") + rows) * F.col(votes) / total) + 1)
                        .otherwise(0).cast("long")))
    # Quotients that may change hands: above the start when seats are open,
    # below it when there are too many.
    first = F.when(F.col("_open") > 0, F.col("_start")).otherwise(
        F.greatest(F.lit(0), F.col("_start") - F.col("_reach")))
    last = F.when(F.col("_open") > 0, F.col("_start") + F.col("_reach")).otherwise(F.col("_start") - 1)
    cand = (base.filter((F.col("_open") != 0) & (last >= first))
            .select(*group, key, votes, "_open", F.explode(F.sequence(first, last)).alias("_j"))
            .withColumn("_q", F.col(votes) / (2 * F.col("_j") + 1)))
    sign = F.signum("_open")
    by = [(-F.col("_q") * sign).asc(), (F.col(key) * sign).asc()]
    ranked = cand.withColumn("_r", F.row_number().over(
        (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(*by, F.col("_j") * sign)))
    moved = (ranked.filter(F.col("_r") <= F.abs("_open"))
             .groupBy(*group, key).agg(F.sum(sign).cast("long").alias("_moved")))
    return (base.join(moved, [*group, key], "left")
            .withColumn(out, F.col("_start") + F.coalesce("_moved", F.lit(0)))
            .drop("_start", "_open", "_reach", "_moved"))


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Targets of the sources (columns ``source``, ``source_size``): weights
    repeat along the sources by code point, null last; a target stops at
    ``max_repeats`` times its source's size and the excess is shared by weight
    among the others until none is above. Adds ``sid``, ``target``, ``total``.

    The fixed point needs no loop: by ascending ``cap / weight`` the sources
    that stop come first, and the first one whose share of what is then left
    does not reach its cap fixes the level.
    """
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = (sources.withColumn("sid", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
              .withColumn("_w", w)
              .withColumn("_cap", (max_repeats * F.col("source_size")).cast("double"))
              .withColumn("total", F.sum("source_size").over(every)))
    order = every.orderBy(F.col("_cap") / F.col("_w"), F.col("sid"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.col("total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    found = (ranked.withColumn("_level", level)
             .withColumn("_first", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"),
                                                F.struct(F.col("_cap") / F.col("_w"), F.col("sid"), F.col("_level"))))
                         .over(every)))
    return found.select("source", "source_size", "sid", "total", F.col("n_docs"),
                        F.least(F.col("_cap"), F.col("_first")["_level"] * F.col("_w")).alias("target"))


def _number(text: Column, start: int = 1) -> Column:
    """Eight hexadecimal digits of an MD5 string as a number."""
    return F.conv(F.substring(text, start, 8), 16, 10).cast("long")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 17,
                n_blocks: int = 20_000, docs_per_shard: int = 5_000, broadcast_rows: int = 10_000,
                shard_blocks: int = 400) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` has ``doc_id``, ``text`` and ``source``. The result has one row
    per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``,
    ``target`` and ``taken`` (a word taken twice counts twice; at most
    ``max_repeats`` times ``size``). ``n_blocks`` sets the block length, the
    total divided by it, or less where the mean shard of some source would have
    under ``shard_blocks`` blocks: the short last block of a shard counts as a
    whole one, and a source gets whole blocks.
    """
    sized = stage_as_is(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    shard = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("shards"))
    most = F.floor(F.min(shard).over(Window.partitionBy(F.lit(0))) / shard_blocks)
    targets = (source_targets(sources, weights, max_repeats)
               .withColumn("shards", F.ceil(F.col("n_docs") / docs_per_shard).cast("long"))
               .withColumn("block", F.greatest(F.lit(1), F.least(F.ceil(F.col("total") / n_blocks), most)).cast("long"))
               .withColumn("_all", F.round(F.col("total") / F.col("block")).cast("long")))
    # Whole words as votes: their sums do not depend on the order of addition.
    targets = targets.withColumn("votes", F.round("target"))
    plan = stage(apportion(targets, [], "sid", "votes", "_all", "seats"), "mix-targets")

    per_source = small(plan.select(F.col("source").alias("_source"), "sid", "shards"), broadcast_rows)
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    dealt = (sized.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
             .withColumn("_h", draw)
             .withColumn("shard", _number(F.col("_h")) % F.col("shards")))
    sizes = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = apportion(sizes.join(plan.select("sid", "seats", "block", "source_size", "target"), "sid"),
                       ["sid"], "shard", "shard_size", "seats", "quota")
    start = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("start"), F.col("sid").cast("string"),
                              F.col("shard").cast("string")))
    quotas = (quotas.withColumn("blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("long"))
              .withColumn("quota", F.least("quota", max_repeats * F.col("blocks")))
              .withColumn("whole", F.coalesce(F.expr("quota div nullif(blocks, 0)"), F.lit(0)))
              .withColumn("part", F.coalesce(F.expr("quota % nullif(blocks, 0)"), F.lit(0)))
              .withColumn("offset", F.coalesce(_number(start) % F.expr("nullif(blocks, 0)"), F.lit(0))))
    quotas = small(stage(quotas.select("sid", "shard", "source_size", "target", "block", "blocks", "whole", "part",
                                       "offset"), "mix-quotas"), broadcast_rows)

    along = Window.partitionBy("sid", "shard").orderBy("_h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_end", F.sum("size").over(along)).join(quotas, ["sid", "shard"])

    def drawn(k: str) -> str:
        """Blocks drawn before block ``k`` of the shard."""
        return f"(({k}) + offset) * part div blocks - offset * part div blocks"

    def words(c: str) -> str:
        """Words of drawn blocks before word ``c`` of the shard."""
        k = f"({c}) div block"
        return f"block * ({drawn(k)}) + (({drawn(k + ' + 1')}) - ({drawn(k)})) * (({c}) % block)"

    taken = F.when(F.col("size") > 0, F.col("whole") * F.col("size")
                   + F.expr(f"({words('_end')}) - ({words('_end - size')})")).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
