"""Connected components over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import runtime


def linked(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``, distributed: (node, root) with the smallest node as root.

    Least labels with pointer jumping; each round is a written table, so that lost executors cost a task only. An error
    if ``most`` rounds are not enough.
    """
    spark = edges.sparkSession
    both, both_at = runtime.stage(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    state, state_at = runtime.stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("r")).select("node", F.least("node", "r").alias("root")), f"{name}-0")
    for step in range(most):
        heard = both.join(state, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = state.join(heard, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = state.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        new = low.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("upper", "root")).alias("root"))
        new, new_at = runtime.stage(new, f"{name}-{step + 1}")
        done = new.filter(F.col("root") != F.col("was")).isEmpty()
        runtime.delete_path(spark, state_at)
        state, state_at = new.select("node", "root"), new_at
        if done:
            runtime.delete_path(spark, both_at)
            return state
    raise RuntimeError(f"components of {name} are not complete after {most} rounds")
