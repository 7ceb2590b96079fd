"""Figures of a fact table that are gathered while it is written, so that no check reads it again.

Rows come to a write by series and day; windows over that order tell repeats, gaps and silent series row by row, and the
write's own tasks add them up. A task that runs again counts once, as figures are taken from finished tasks of the last stage.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

KEYS = ["store_id", "item_id"]
_HELPERS = ["__place", "__last", "__before", "__before2", "__units", "__from", "__to"]


def watch(facts: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, dealt by series and sorted by day, and what is to be read once they are written.

    Nulls: a row without store, item or day counts in `nulls` and `repeated_rows`; rows without a store or item form one
    series; a series without any day has no gap. An empty table has zeros everywhere and no first or last day.
    """
    own = Window.partitionBy(*KEYS).orderBy("date")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    dealt = facts.repartition(*KEYS).withColumns({
        "__place": F.row_number().over(own), "__last": F.lead(F.lit(1)).over(own).isNull(), "__before": F.lag("date").over(own), "__before2": F.lag("date", 2).over(own),
        "__units": F.sum("sales").over(so_far), "__from": F.min("date").over(so_far), "__to": F.max("date").over(so_far),
    })
    no_key = F.col("store_id").isNull() | F.col("item_id").isNull() | F.col("date").isNull()
    again = (F.col("__place") > 1) & F.col("date").eqNullSafe(F.col("__before"))
    once = (F.col("__place") == 2) | ~F.col("date").eqNullSafe(F.col("__before2"))
    active, zero = F.col("is_active"), F.lit(0)
    seen = Observation()
    out = dealt.observe(
        seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("sales"), zero).alias("units"), F.coalesce(F.sum(F.col("sales") * F.col("cents")), zero).alias("revenue_cents"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.count_if("__last").alias("series"), F.count_if(no_key | again).alias("repeated_rows"), F.count_if(again & once).alias("repeated_keys"), F.count_if(no_key | F.col("sales").isNull()).alias("nulls"),
        F.count_if(F.col("sales") < 0).alias("negative"), F.count_if(F.col("sell_price") <= 0).alias("priceless"), F.count_if(active).alias("active"), F.count_if(~active).alias("inactive"),
        F.count_if(active & F.col("sell_price").isNull()).alias("unpriced_active"), F.count_if(F.col("__last") & (F.datediff("__to", "__from") + 1 != F.col("__place"))).alias("gaps"),
        F.count_if(F.col("__last") & (F.col("__units") == 0)).alias("silent"),
    )
    return out.drop(*_HELPERS), seen


def figures(seen: Observation) -> dict[str, Any]:
    """What was observed; waits for the write."""
    got = dict(seen.get)
    return got | {"unpriced": got["unpriced_active"] / got["active"] if got["active"] else 0.0}
