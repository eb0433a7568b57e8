"""Mixing sources to target shares with capped repetition.

Method: capped water-filling. Every source of a mix may give at most its tokens times max_repeats. Sources that can't
reach their share are clamped there and the weight they leave is handed to the others in proportion to their shares,
until no further source is clamped. Ordered by capacity per unit of share, the clamped sources are a prefix, so the
level is found with one running sum per mix instead of a loop. Sources that can't reach their own share are those that
the first round clamps. Whole repetitions are copied; the fractional one is
drawn in the order of a seeded hash of the documents, as far as its share of the tokens goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.checkpoints import cut
from ..operators.parallel import broadcast_small, spread
from .tokens import DEFAULT_DIR, VOCABULARY, count_tokens

#: Slices of a source's documents by hash, the finest that its fractional repetition is cut at.
SLICES = 4_096


def document_tokens(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", directory: str = DEFAULT_DIR, name: str = VOCABULARY) -> DataFrame:
    """(id, source, tokens) of every document, counted once and kept."""
    documents = spread(documents.select(id_col, source_col, text_col))
    return cut(documents.select(id_col, F.col(source_col).alias("source"), count_tokens(documents, text_col, directory, name).alias("tokens")))


def source_tokens(documents: DataFrame, source_col: str = "source", text_col: str = "text", directory: str = DEFAULT_DIR, name: str = VOCABULARY) -> DataFrame:
    """(source, docs, tokens) over all documents; partial sums are taken before the shuffle, so a source may be of any size.

    Null and empty texts count as documents of no tokens; a null source is a group of its own, which no target names.
    """
    documents = spread(documents.select(source_col, text_col))
    return source_sums(documents.select(F.col(source_col).alias("source"), count_tokens(documents, text_col, directory, name).alias("tokens")))


def source_sums(sized: DataFrame) -> DataFrame:
    """(source, docs, tokens) of documents whose tokens are counted."""
    return sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


def water_fill(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """The plan of every mix: targets (mix_id, source, target_share, max_repeats, size_ratio), sizes (source, tokens).

    One row per row of targets: tokens (0 for a source without documents), wanted = share x ratio x all tokens, capacity
    = tokens x max_repeats, unreachable (capacity < wanted), clamped (after redistribution), allocated tokens, epochs
    (allocated per token of the source, null without tokens), and planned_share of what the whole mix is to get; what
    it does get is measured by `drawn_shares`. Null numbers
    in targets count as 0; a source of share 0 is given nothing; targets is the small side, sizes has one row per source
    and is used twice, so what is costly to compute should be kept first.
    """
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("all_tokens"))
    t = targets.select("mix_id", "source", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("target_share", "max_repeats", "size_ratio")])
    x = t.join(sizes.select("source", "tokens"), "source", "left").crossJoin(total)  # total is one row
    x = x.withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    x = x.withColumn("wanted", F.col("target_share") * F.col("size_ratio") * F.col("all_tokens")).withColumn("capacity", F.col("tokens") * F.col("max_repeats"))
    x = x.withColumn("unreachable", F.col("capacity") < F.col("wanted"))
    some = F.col("target_share") > 0
    x = x.withColumn("level", F.when(some, F.col("capacity") / F.col("target_share")).otherwise(F.lit(float("inf"))))
    mix = Window.partitionBy("mix_id")
    order = mix.orderBy("level", "source")
    up = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("goal", F.sum("wanted").over(mix)).withColumn("cap_below", F.coalesce(F.sum("capacity").over(up), F.lit(0.0)))
    # the share from this source on is a sum of positive numbers, its own among them, so nothing cancels out
    x = x.withColumn("share_left", F.sum("target_share").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the level if exactly the sources before this one are clamped; this one is clamped too if it can't reach it
    x = x.withColumn("if_level", F.when(some, (F.col("goal") - F.col("cap_below")) / F.col("share_left")))
    x = x.withColumn("clamped", F.coalesce(F.col("level") < F.col("if_level"), F.lit(False)))
    # beyond the first source that isn't clamped the would-be level only falls
    x = x.withColumn("water", F.max(F.when(some & ~F.col("clamped"), F.col("if_level"))).over(mix))
    x = x.withColumn("allocated", F.when(F.col("clamped"), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("target_share") * F.coalesce("water", F.lit(0.0)))))
    x = x.withColumn("epochs", F.col("allocated") / F.nullif(F.col("tokens").cast("double"), F.lit(0.0)))
    x = x.withColumn("planned_share", F.col("allocated") / F.nullif(F.sum("allocated").over(mix), F.lit(0.0)))
    return x.select("mix_id", "source", "target_share", "max_repeats", "size_ratio", "tokens", "all_tokens", "wanted", "capacity", "unreachable", "clamped", "allocated", "epochs", "planned_share")


def short_sources(plan: DataFrame) -> DataFrame:
    """(mix_id, source) of a filled plan's sources that can't reach their target share.

    They are among the clamped ones: of these, those that the first round clamps, whose capacity is below their own
    share of the goal, checked exactly; the others were only overrun by what the first left to them.
    """
    return plan.filter("clamped").filter("unreachable").select("mix_id", "source")


def sample_mix(documents: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, tokens_col: str | None = None) -> DataFrame:
    """(mix_id, id, source, copies, tokens): how often each document goes into each mix; documents of no copies give no row.

    copies = the whole part of the source's epochs, plus one for the documents of the lowest seeded hashes of (mix, id)
    that together come nearest to the fraction of the source's tokens (of its documents without tokens_col, each then
    counting 1), to a slice of SLICES. So the draw is the same on every run and every partitioning. The plan has a row
    per mix and source, and SLICES times as many sums are looked at; tables of a row per mix and source are broadcast if
    they are counted to be small and joined otherwise.
    """
    p = plan.filter(F.col("epochs") > 0).select("mix_id", F.col("source").alias("_source"), "epochs")
    weight = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else F.lit(1).cast("long")
    d = documents.select(F.col(id_col), F.col(source_col).alias("source"), weight.alias("tokens"))
    x = d.join(broadcast_small(p), d["source"] == p["_source"])
    x = x.withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), F.col("mix_id"), F.col(id_col)), F.lit(SLICES)))
    part = F.col("epochs") - F.floor("epochs")
    of = Window.partitionBy("mix_id", "source")
    below = F.coalesce(F.sum("w").over(of.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = x.groupBy("mix_id", "source", "epochs", "slice").agg(F.sum("tokens").alias("w"))
    taken = sums.withColumn("goal", part * F.sum("w").over(of)).withColumn("below", below).filter((part > 0) & (F.col("below") + F.col("w") / 2 <= F.col("goal")))
    last = taken.groupBy("mix_id", "source").agg(F.max("slice").alias("last"))
    x = x.join(broadcast_small(last), ["mix_id", "source"], "left")
    x = x.withColumn("copies", (F.floor("epochs") + (F.col("slice") <= F.coalesce("last", F.lit(-1))).cast("int")).cast("int"))
    return x.filter(F.col("copies") > 0).select("mix_id", id_col, "source", "copies", "tokens")


def drawn_shares(plan: DataFrame, mix: DataFrame) -> DataFrame:
    """plan with drawn, the tokens x copies of each mix and source in the mix that was made, and actual_share of the mix's sum.

    Sources nothing is drawn from have 0; a mix of no tokens has null shares. mix is summed to a row per row of plan.
    """
    sums = mix.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("drawn"))
    x = plan.join(sums, ["mix_id", "source"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return x.withColumn("actual_share", F.col("drawn") / F.nullif(F.sum("drawn").over(Window.partitionBy("mix_id")).cast("double"), F.lit(0.0)))
