"""Restoration planning units: masks, rewards and renderings.

Units: unit_id, candidate, cost, gain, selected. Edges: src, dst in both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mask(units: DataFrame, budget: float) -> DataFrame:
    """unit_id of candidates that are not selected and that the rest of the budget still pays."""
    used = units.agg(F.coalesce(F.sum(F.when(F.col("selected"), F.col("cost"))), F.lit(0.0)).alias("used"))
    free = (F.col("candidate") == 1) & ~F.col("selected") & (F.col("cost") <= budget - F.col("used") + 1e-9) & (F.col("used") < budget - 1e-9)
    return units.crossJoin(F.broadcast(used)).where(free).select("unit_id")  # one row


def reward_default(units: DataFrame, edges: DataFrame, budget: float, w_gain: float = 1.0, w_cost: float = 0.1, w_link: float = 0.2) -> DataFrame:
    """unit_id, reward of selecting each unit next: gain, share of selected neighbours, cost."""
    near = edges.join(units.select(F.col("unit_id").alias("dst"), F.col("selected").alias("sel")), "dst").groupBy(F.col("src").alias("unit_id")).agg(F.avg(F.col("sel").cast("double")).alias("share"))
    return units.join(near, "unit_id", "left").select("unit_id", (w_gain * F.col("gain") + w_link * F.coalesce("share", F.lit(0.0)) - w_cost * F.col("cost") / max(budget, 1e-6)).alias("reward"))


def delayed_reward(steps: DataFrame, edges: DataFrame, horizon: int = 5, now: float = 0.3) -> DataFrame:
    """episode, step, paid: a share at once, the rest at step + horizon if a neighbour is selected by then."""
    s = steps.select("episode", "step", "unit_id", "value")
    support = s.alias("a").join(edges.alias("e"), F.col("a.unit_id") == F.col("e.src")).join(s.alias("b"), (F.col("b.unit_id") == F.col("e.dst")) & (F.col("b.episode") == F.col("a.episode")) & (F.col("b.step") <= F.col("a.step") + horizon))
    kept = support.select("a.episode", "a.step").distinct().withColumn("due", F.col("step") + horizon)
    late = s.join(kept, ["episode", "step"]).select("episode", F.col("due").alias("step"), ((1 - now) * F.col("value")).alias("paid"))
    return s.select("episode", "step", (now * F.col("value")).alias("paid")).unionByName(late).groupBy("episode", "step").agg(F.sum("paid").alias("paid"))


def cumulative(steps: DataFrame) -> DataFrame:
    """Running value and number of selections of each episode."""
    w = Window.partitionBy("episode").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("episode", "step", F.sum("value").over(w).alias("total"), F.count("*").over(w).alias("n_selected"))
