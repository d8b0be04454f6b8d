"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common


def signed(edges: DataFrame) -> tuple:
    """Count and sum of hashes, by which two states of the edges are told apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge: ``root`` is the smallest node that it reaches.

    ``edges`` has the columns u and v, of one ordered type. Each round hangs
    every node's larger neighbours, then its smaller ones, below the least of
    them; the edges end as one star a component after about log(n) rounds. Each
    round's edges are written to the shared folder, so lineage stays short. No
    rows give no rows; nulls and loops are left out. If ``rounds`` don't suffice,
    which no graph of this world should need, it raises.
    """
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType
    now = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = common.stage(now, "edges")
    seen = signed(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(mins.select("u", F.col("m").alias("v"))).distinct()
        after, to = common.stage(small, "edges")
        common.unstage(spark, path)
        now, path = after, to
        before, seen = seen, signed(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"the components of the graph aren't found after {rounds} rounds")
    assert now.schema["u"].dataType == kind
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
