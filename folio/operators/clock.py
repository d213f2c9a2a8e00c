"""The virtual clock: timers fire in order of due time without waiting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["admitted_requests", "fire_order"]


def fire_order(timers: DataFrame, cancelled: DataFrame | None = None, horizon_ms: int = 10_000, max_fired: int | None = 10_000, keys: list[str] | None = None) -> DataFrame:
    """(keys, timer_id, due_ms, nth, rank): every firing up to the horizon, in order.

    ``timers``: (keys, timer_id, delay_ms, repeat, kind). Delays below zero are zero, a repeating timer has a period of at least 1 ms;
    timers due past the horizon never run; idle callbacks come after all others. ``cancelled``: (keys, timer_id).
    Each firing's position follows from its delay alone, so a repeating timer is a sequence and the budget a rank; None is no budget.
    """
    keys = keys or []
    delay = F.greatest(F.col("delay_ms"), F.lit(0)).cast("bigint")
    live = timers.withColumn("delay", delay).where(F.col("delay") <= horizon_ms)
    if cancelled is not None:
        live = live.join(cancelled, [*keys, "timer_id"], "left_anti")
    period = F.greatest(F.col("delay"), F.lit(1))
    runs = F.when(F.col("repeat"), F.sequence(F.col("delay"), F.greatest(F.lit(horizon_ms).cast("bigint"), F.col("delay")), period)).otherwise(F.array("delay"))
    fired = live.select(*keys, "timer_id", "kind", F.posexplode(runs).alias("nth", "due_ms"))
    order = Window.partitionBy(*keys).orderBy((F.col("kind") == "idle").cast("int"), "due_ms", "nth", "timer_id")
    ranked = fired.withColumn("rank", F.row_number().over(order))
    if max_fired is not None:
        ranked = ranked.where(F.col("rank") <= max_fired)
    return ranked.select(*keys, "timer_id", "due_ms", "nth", "rank")


def admitted_requests(requests: DataFrame, keys: list[str], order: list[str], budget: int = 384) -> DataFrame:
    """Requests within a page's budget, first come first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return requests.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget).drop("_n")
