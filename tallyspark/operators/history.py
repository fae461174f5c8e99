"""The row before, by key and order, with hot keys split.

A plain ``lag`` brings all rows of a key into one task.  Here the order is cut
into chunks, so a window holds one key's rows of one chunk.  What a chunk's first
row lacks is the value of the last row of the key's chunk before it: one row for
each key and chunk, aggregated before its shuffle and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_last(rows: DataFrame, keys: dict[str, Column], order: list[str], value: str, chunk: Column, name: str) -> DataFrame:
    """Adds ``name``: ``value`` of the row before; ``chunk`` never falls as ``order`` rises. Null keys are a key.

    Key and chunk are one struct, whose equality takes nulls as equal: so the window and the join share the only
    shuffle of whole rows. The aggregated side reads no more than key, order and value.
    """
    group, before_group = f"{name}_group", f"{name}_before"
    out = rows.withColumn(group, F.struct(*(c.alias(k) for k, c in keys.items()), chunk.alias("chunk")))
    window = Window.partitionBy(group).orderBy(*order)
    inside = out.withColumns({f"{name}_place": F.row_number().over(window), f"{name}_inside": F.lag(value).over(window)})
    # ``order`` in nulls-first order, as the window has it
    last = out.groupBy(group).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("v"))
    before = last.withColumn("v", F.lag("v.v").over(Window.partitionBy(*(f"{group}.{k}" for k in keys)).orderBy(f"{group}.chunk")))
    before = before.where("v is not null").select(F.col(group).alias(before_group), F.col("v").alias(f"{name}_carried"))
    joined = inside.join(before, F.col(group) == F.col(before_group), "left")
    found = F.when(F.col(f"{name}_place") == 1, F.col(f"{name}_carried")).otherwise(F.col(f"{name}_inside"))
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), found.alias(name))
