"""Names attached to the nodes of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(tree: DataFrame, keys: list[str], labels: dict[int, DataFrame]) -> DataFrame:
    """Adds ``label`` of each node's own key (level d: frame (key, name)); missing names are "Unknown", the root has none."""
    out = tree.withColumn("label", F.lit(None).cast("string"))
    for d, key in enumerate(keys):
        if d not in labels:
            continue
        names = labels[d].select(F.col("key").alias("__key"), F.col("name").alias("__name"))
        own = F.col("depth") == d + 1
        out = out.join(names, own & (F.col(key) == F.col("__key")), "left")
        out = out.withColumn("label", F.when(own, F.coalesce("__name", F.lit("Unknown"))).otherwise(F.col("label"))).drop("__key", "__name")
    return out


def external_ids(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Dense ids back to external keys (key, id); null where there is none."""
    return rows.join(ids.select(F.col("id").alias("__id"), F.col("key").alias(f"{col}_key")), F.col(col) == F.col("__id"), "left").drop("__id")
