"""Fair selection of paths from several queues under budgets of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import keep, running


def rounds(paths: DataFrame) -> DataFrame:
    """``paths`` (seed, place, ...) with ``round``: the place among those of its seed, from 1. No task sees a whole queue."""
    placed = running(paths, F.struct("seed", "place"), _n=F.lit(1))
    first = placed.groupBy("seed").agg((F.min("_n") - 1).alias("_before"))
    return placed.join(first, "seed").withColumn("round", F.col("_n") - F.col("_before")).drop("_n", "_before")


def round_robin(paths: DataFrame, budgets: dict[str, int], given: list[tuple[str, str]] = ()) -> DataFrame:
    """(seed, place, round) of the paths that are taken when the queues are asked in turn.

    ``paths``: seed, place (unique within it), items (array of struct kind, id). In every round each seed offers its next
    path. It is taken whole if what it adds keeps to the budget of every kind, else passed over for good; items that
    are there already cost nothing, and ``given`` ones are there from the start.

    Whoever is too large now stays too large: whatever is added later to its items uses up as much of the budget. So a
    turn of the loop drops all that are too large by themselves, and of the others takes those ahead of
    the first that the running sum of new items does not let in. Only items within the budgets reach the driver.
    """
    spark = paths.sparkSession
    dealt = keep(rounds(paths.select("seed", "place", "items")))
    items = keep(dealt.select("round", "seed", F.explode(F.array_distinct("items")).alias("i")).select("round", "seed", "i.kind", "i.id").where(F.col("kind").isin(*budgets)))
    taken = set(given)
    while True:
        left = {k: n - sum(kind == k for kind, _ in taken) for k, n in budgets.items()}
        have = spark.createDataFrame(sorted(taken) or [(None, None)], "kind string, id string")
        new = items.join(F.broadcast(have), ["kind", "id"], "left_anti")  # no more than the budgets
        size = {k: F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in budgets}
        fits = new.groupBy("round", "seed").agg(*size.values())
        for k, n in left.items():
            fits = fits.where(F.col(f"n_{k}") <= n)
        first = new.join(fits.select("round", "seed"), ["round", "seed"]).groupBy("kind", "id").agg(F.min(F.struct("round", "seed")).alias("at"))
        # Each of these paths adds an item, so that one more than is left of all budgets decides.
        ahead = first.groupBy("at").agg(F.collect_list(F.struct("kind", "id")).alias("adds")).orderBy("at").limit(max(sum(left.values()), 0) + 1).collect()
        for row in ahead:
            adds = [(x["kind"], x["id"]) for x in row["adds"]]
            if any(sum(kind == k for kind, _ in adds) > n for k, n in left.items()):
                break
            taken.update(adds)
            for kind, _ in adds:
                left[kind] -= 1
        if not ahead:
            break
    missing = new.select("round", "seed").distinct()
    return dealt.join(missing, ["round", "seed"], "left_anti").select("seed", "place", "round")
