"""Samples that match target category proportions (problem 1).

Quotas travel down a category tree.  Every node hands its quota to its children; a child
whose subtree holds too few rows keeps what it has, and the rest goes to its siblings that
have rows to spare.  Since a node is only given less than it asked for when its whole
subtree is exhausted, unmet quota reaches siblings first, then cousins, then the rest of
the tree.  Rows are drawn at the leaves by a permuted dense rank; a plan also draws a reserve
for each class up to its target, so the draw itself shows where a target cannot be met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Rows of a category that are ranked in one task, about.
BUCKET_ROWS = 100_000

#: Ancestors of each class from the root's children down: broadleaf or other, then genus group.
CLASS_TREE = {1: ("a", "a1"), 2: ("a", "a1"), 3: ("a", "a2"), 4: ("a", "a2"), 5: ("b", "b1"), 6: ("b", "b1"), 7: ("b", "b2"), 8: ("b", "b2")}


def tree_columns(category: Column, tree: dict[int, tuple[str, ...]]) -> list[Column]:
    """One column for each level above the leaves; categories outside the tree get null."""
    depth = len(next(iter(tree.values())))
    out = []
    for level in range(depth):
        pairs = [x for k, path in tree.items() for x in (F.lit(k), F.lit(path[level]))]
        out.append(F.element_at(F.create_map(*pairs), category))
    return out


def _spread(df: DataFrame, plan: WindowSpec, amount: str, weight: str, out: str, tie: list[Column]) -> DataFrame:
    """``out``: whole parts of ``amount`` (one value a plan) in proportion to ``weight``, largest remainders first."""
    all_, part, rest = F.sum(weight).over(plan), F.col("_part"), F.col("_rest")
    return (
        df.withColumn("_all", all_)
        .withColumn("_part", F.when(F.col("_all") > 0, F.expr(f"({amount} * {weight}) div _all")).otherwise(0))
        .withColumn("_rest", F.when(F.col("_all") > 0, F.col(amount) * F.col(weight) - part * F.col("_all")).otherwise(0))
        .withColumn("_odd", F.col(amount) - F.sum("_part").over(plan))
        .withColumn("_rr", F.row_number().over(plan.orderBy(rest.desc(), *tie)))
        .withColumn(out, part + F.when((F.col("_rr") <= F.col("_odd")) & (rest > 0), 1).otherwise(0))
        .drop("_all", "_part", "_rest", "_odd", "_rr")
    )


def allocate(targets: DataFrame, available: DataFrame, tree: dict[int, tuple[str, ...]] = CLASS_TREE) -> DataFrame:
    """How many rows each plan takes of each category.

    ``targets``: plan_id, site_id, sample_size, feature_class, target_pct, min_rows.
    ``available``: site_id, feature_class, available.  Result: one row for each distinct row
    of ``targets``, its number ``line`` in the plan, ``available``, ``wanted`` (the larger of
    ``sample_size * target_pct / 100``, rounded up, and ``min_rows``), ``quota`` (whole rows asked
    for), ``take`` (rows granted after passing unmet quota on), ``achieved_pct`` of the plan's
    rows, and ``short``: fewer than ``wanted`` rows exist.

    Quotas of a plan add up to its sample size: what a small category's minimum (as far as it
    has rows) adds to its share is taken from the categories above their own minimum, in
    proportion to the excess.  Only minima that exceed the sample size together make a sample
    larger.  A null sample size, percentage or minimum counts as 0.  Categories outside the tree
    are siblings of each other below an own node.  An empty input gives an empty result.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    base = (
        targets.select("plan_id", "site_id", "sample_size", "feature_class", "target_pct", "min_rows").distinct()
        .join(available.select("site_id", "feature_class", "available"), ["site_id", "feature_class"], "left")
        .withColumn("available", zero("available"))
        .repartition("plan_id")
    )
    plan = Window.partitionBy("plan_id")
    tie = [F.col("feature_class"), F.col("site_id"), F.col("min_rows"), F.col("sample_size"), F.col("target_pct")]
    # Whole quotas of a plan add up to its sample size: largest remainders first.
    rows = (
        base.withColumn("_share", zero("sample_size") * zero("target_pct"))
        .withColumn("line", F.row_number().over(plan.orderBy(*tie)))
        .withColumn("wanted", F.greatest(F.expr("(_share + 99) div 100"), zero("min_rows")))
        .withColumn("_size", F.expr("sum(_share) over (partition by plan_id) div 100"))
    )
    rows = _spread(rows, plan, "_size", "_share", "_quota", tie).withColumn("_kept", F.least(zero("min_rows"), F.col("available")))
    rows = rows.withColumn("_gain", F.greatest(F.col("_kept") - F.col("_quota"), F.lit(0))).withColumn("_excess", F.greatest(F.col("_quota") - F.col("_kept"), F.lit(0)))
    rows = rows.withColumn("_given", F.least(F.sum("_gain").over(plan), F.sum("_excess").over(plan)))
    rows = (
        _spread(rows, plan, "_given", "_excess", "_cut", tie)
        .withColumn("quota", F.col("_quota") + F.col("_gain") - F.col("_cut"))
        .withColumn("short", F.col("available") < F.col("wanted"))
        .drop("_share", "_size", "_quota", "_kept", "_gain", "_excess", "_given", "_cut")
    )
    path = []
    for i, c in enumerate(tree_columns(F.col("feature_class"), tree)):
        rows = rows.withColumn(f"_t{i}", c)
        path.append(f"_t{i}")
    rows = rows.withColumn("_leaf", F.struct(*tie)).withColumn("_grant", F.least(F.sum("quota").over(plan), F.sum("available").over(plan)))
    for level in range(len(path) + 1):
        parent = Window.partitionBy("plan_id", *path[:level])
        own = ["plan_id", *path[: level + 1], *(["_leaf"] if level == len(path) else [])]
        child = Window.partitionBy(*own)
        rows = (
            rows.withColumn("_first", F.row_number().over(child.orderBy("_leaf")) == 1)
            .withColumn("_cap", F.sum("available").over(child))
            .withColumn("_base", F.least(F.sum("quota").over(child), F.col("_cap")))
            .withColumn("_spare", F.when(F.col("_first"), F.col("_cap") - F.col("_base")).otherwise(0))
            .withColumn("_over", F.col("_grant") - F.sum(F.when(F.col("_first"), F.col("_base")).otherwise(0)).over(parent))
            .withColumn("_spares", F.sum("_spare").over(parent))
            .withColumn("_part", F.when(F.col("_spares") > 0, F.expr("(_over * _spare) div _spares")).otherwise(0))
            .withColumn("_rem", F.when(F.col("_spares") > 0, F.col("_over") * F.col("_spare") - F.col("_part") * F.col("_spares")).otherwise(0))
            .withColumn("_rank", F.row_number().over(parent.orderBy(F.col("_rem").desc(), "_leaf")))
            .withColumn("_odd", F.col("_over") - F.sum("_part").over(parent))
            .withColumn("_add", F.col("_part") + F.when((F.col("_rank") <= F.col("_odd")) & (F.col("_rem") > 0), 1).otherwise(0))
            .withColumn("_grant", F.col("_base") + F.sum("_add").over(child))
        )
    achieved = F.try_divide(F.col("_grant") * 100, F.sum("_grant").over(plan))
    return rows.select("plan_id", "line", "site_id", "sample_size", "feature_class", "target_pct", "min_rows", "available", "wanted", "quota", F.col("_grant").alias("take"), achieved.alias("achieved_pct"), "short")


def draw(population: DataFrame, allocation: DataFrame, seed: int = 17) -> DataFrame:
    """The rows drawn for ``allocation``: plan_id, line, site_id, feature_class, segment_id, rank, reserve.

    Within each (site, category) rows get a dense rank in a seeded random permutation; a plan
    takes the ranks from its own starting point on, wrapping around, so that plans of one site
    differ and no row is drawn twice for one line.  Exactly ``take`` rows are the sample; where the
    target ``wanted`` is higher, the rows up to it follow as a reserve (``reserve`` true), as far as
    there are any.  ``rank`` counts a line's rows from 1.  Rows without site or category are never
    drawn; repeated rows count as rows of their own.

    The permutation is cut into buckets of about ``BUCKET_ROWS`` by its leading bits.  Bucket sizes
    tell which buckets a plan reaches, and only those are ranked and joined, each by itself: a
    category of any size is spread over many tasks, and a small sample leaves most of it unsorted.
    """
    keys = ["site_id", "feature_class", "_b"]
    wanted = allocation.withColumn("_need", F.least(F.greatest("take", "wanted"), "available")).where("_need > 0")
    wanted = wanted.select("plan_id", "line", "site_id", "feature_class", "take", "available", "_need", F.pmod(F.xxhash64("plan_id", "feature_class", F.lit(seed)), F.col("available")).alias("_from"))
    bits = F.greatest(F.ceil(F.log2(F.col("available") / BUCKET_ROWS)), F.lit(0)).cast("int")
    asked = wanted.select("site_id", "feature_class", bits.alias("_bits")).distinct()
    rows = population.select("site_id", "feature_class", "segment_id", F.xxhash64("segment_id", F.lit(seed)).alias("_h")).join(asked, ["site_id", "feature_class"])
    rows = rows.withColumn("_b", F.expr("if(_bits = 0, 0L, shiftright(_h, 64 - _bits))")).drop("_bits")
    before = Window.partitionBy("site_id", "feature_class").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = F.col("_from") + F.col("_need")
    reached = ((F.col("_before") < last) & (F.col("_before") + F.col("_n") > F.col("_from"))) | (F.col("_before") < last - F.col("available"))
    needed = wanted.join(sizes, ["site_id", "feature_class"]).where(reached)
    inside = Window.partitionBy(*keys).orderBy("_h", "segment_id")
    ranks = rows.join(needed.select(*keys).distinct(), keys, "left_semi").withColumn("_rank", F.row_number().over(inside))
    rank = F.pmod(F.col("_before") + F.col("_rank") - 1 - F.col("_from"), F.col("available")) + 1
    drawn = needed.join(ranks, keys).withColumn("rank", rank).where(F.col("rank") <= F.col("_need"))
    return drawn.select("plan_id", "line", "site_id", "feature_class", "segment_id", "rank", (F.col("rank") > F.col("take")).alias("reserve"))


def population_counts(population: DataFrame) -> DataFrame:
    """Rows of each (site, category) as ``available``."""
    return population.groupBy("site_id", "feature_class").agg(F.count(F.lit(1)).alias("available"))
