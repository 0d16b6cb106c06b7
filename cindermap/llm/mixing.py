"""Mixture of sources: token budgets down a tree of categories, then a prefix of seeded epochs for each leaf."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.llm.common import WORD, running_totals
from cindermap.session import materialize


def n_tokens(text: str = "text") -> Column:
    """Words of a text; what budgets are counted in."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(level: str, weights: Mapping[str, int], other: int = 1) -> Column:
    """Integer weight of a category among its siblings; what is not named weighs ``other``.

    A category of weight 0 takes nothing; its siblings share what it would have taken, and where all weigh 0 it stays unspent.
    """
    if min([other, *weights.values()]) < 0:
        raise ValueError("weights are 0 or more")
    named = F.lit(other)
    for name, weight in weights.items():
        named = F.when(F.col(level) == name, F.lit(weight)).otherwise(named)
    return F.when(F.col(level).isNull(), F.lit(other)).otherwise(named).cast("long")


def _share(nodes: DataFrame, parents: Sequence[str], level: str) -> DataFrame:
    """Split each parent's ``budget`` over its children by ``weight``, none above its ``capacity``.

    Children fill up in the order of capacity per weight. Those below the common level get
    all they have; what they leave short goes to their siblings, by weight. Whole tokens are
    dealt by rounding running sums, so that children add up to the parent exactly.
    """
    # a weight of 0 has no ratio and comes last
    ratio = F.try_divide(F.col("capacity").cast("decimal(24,0)"), F.col("weight").cast("decimal(10,0)"))
    filled = Window.partitionBy(*parents).orderBy(ratio.asc_nulls_last(), F.col(level).asc_nulls_first())
    less = F.coalesce(F.sum("capacity").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = nodes.withColumns({"__less": less, "__left": left}).withColumn(
        "__full",
        (F.col("weight") > 0)
        & (F.col("capacity").cast("decimal(24,0)") * F.col("__left") <= (F.col("budget") - F.col("__less")).cast("decimal(24,0)") * F.col("weight")),
    )
    # a child that is not full: siblings that are full have taken their capacities, the rest is dealt by weight
    side = Window.partitionBy(*parents)
    rest = F.col("budget") - F.sum(F.when(F.col("__full"), F.col("capacity")).otherwise(0)).over(side)
    open_weight = F.when(F.col("__full"), F.lit(0)).otherwise(F.col("weight"))
    named = Window.partitionBy(*parents).orderBy(F.col(level).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = marked.withColumns({"__rest": rest, "__open": F.sum(open_weight).over(side), "__upto": F.sum(open_weight).over(named), "__w": open_weight})

    def cut(upto: Column) -> Column:
        dealt = F.floor(F.try_divide(F.col("__rest").cast("decimal(24,0)") * upto.cast("decimal(10,0)"), F.col("__open").cast("decimal(10,0)")))
        return F.coalesce(dealt.cast("long"), F.lit(0).cast("long"))

    share = F.when(F.col("__full"), F.col("capacity")).otherwise(cut(F.col("__upto")) - cut(F.col("__upto") - F.col("__w")))
    return dealt.withColumn("budget", share).drop("__less", "__left", "__full", "__rest", "__open", "__upto", "__w")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], budget: Column) -> DataFrame:
    """Budget of every leaf from the root's, level by level.

    ``leaves``: the categories of each leaf, its ``capacity``, and ``weight_<level>`` for every level.
    A node can hold what its leaves hold. So a shortage in a leaf is made up by its
    siblings first; only what a whole branch cannot hold moves on to the branch's siblings.
    Null categories are a category.
    """
    spread = leaves.withColumn("budget", F.least(budget, F.sum("capacity").over(Window.partitionBy(F.lit(1)))).cast("long"))
    for depth, level in enumerate(levels):
        parents = [F.lit(1).alias("__root")] if depth == 0 else list(levels[:depth])
        path = list(levels[: depth + 1])
        nodes = spread.groupBy(*path).agg(
            F.sum("capacity").alias("capacity"), F.first("budget").alias("budget"), F.first(f"weight_{level}").alias("weight")
        )
        shared = _share(nodes, parents, level).select(*[F.col(p).alias(f"__{p}") for p in path], F.col("budget").alias("__budget"))
        match = F.lit(True)
        for p in path:
            match = match & F.col(p).eqNullSafe(F.col(f"__{p}"))
        spread = spread.join(shared, match).withColumn("budget", F.col("__budget")).drop("__budget", *[f"__{p}" for p in path])
    return spread


def mix(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Column],
    share_percent: int,
    max_epochs: int,
    seed: int,
    key: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often each document is taken to bring the tree of ``levels`` to its target weights.

    The root's budget is ``share_percent`` of all tokens; a leaf can give its tokens ``max_epochs``
    times. An epoch is the leaf in the order of md5(seed, epoch, key); the epochs of a leaf
    follow each other, and its documents are taken as long as they start before the leaf's
    budget is spent: all of them in whole epochs, a prefix in the last one. The last
    document taken may end past the budget, so a leaf is met to within one document.

    ``docs`` has the columns of ``levels``. Returns key, levels, tokens, leaf_budget, copies and the columns of ``carry``
    (documents taken at least once). Tree tables have one row per leaf; documents
    are ordered by leaf and hash across tasks, so a leaf may hold any part of the rows.
    Null texts and texts without words have no tokens and are never taken. Null
    categories are a category, a null key hashes as the word null, repeated rows are rows of
    their own (with one hash, so they follow each other). No rows give no rows.
    """
    counted = docs.select(F.col(key), *levels, *carry, n_tokens(text).alias("tokens")).filter(F.col("tokens") > 0)
    counted = materialize(counted, "tokens")
    leaves = counted.groupBy(*levels).agg(F.sum("tokens").alias("leaf_tokens"))
    leaves = leaves.withColumns({"capacity": F.col("leaf_tokens") * F.lit(max_epochs), **{f"weight_{lv}": weights[lv] for lv in levels}})
    goal = F.floor(F.sum("leaf_tokens").over(Window.partitionBy(F.lit(1))).cast("decimal(24,0)") * F.lit(share_percent) / F.lit(100))
    budgets = leaf_budgets(leaves.withColumn("__goal", goal.cast("long")), levels, F.col("__goal"))
    budgets = materialize(
        budgets.select(
            *[F.col(lv).alias(f"__{lv}") for lv in levels],
            F.col("budget").alias("leaf_budget"),
            F.expr("budget div leaf_tokens").alias("__whole"),
            F.expr("budget % leaf_tokens").alias("__rest"),
        ),
        "budgets",
    )
    match = F.lit(True)
    for lv in levels:
        match = match & F.col(lv).eqNullSafe(F.col(f"__{lv}"))
    named = counted.join(budgets, match).drop(*[f"__{lv}" for lv in levels])
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    ordered = running_totals(named.withColumn("__place", place), "tokens", ["__place", key], levels)
    copies = F.col("__whole") + F.when(F.col("before") < F.col("__rest"), F.lit(1)).otherwise(F.lit(0))
    return (
        ordered.withColumn("copies", copies).filter(F.col("copies") > 0).select(key, *levels, "tokens", "leaf_budget", "copies", *carry)
    )
