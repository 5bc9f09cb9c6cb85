"""Connected components of a link table: smallest labels spread along links, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import Workspace


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id that can be reached.

    Every round takes the smallest label among the neighbours, hooks the old label's node under it as well, and then
    replaces a label by its label's label, so that the number of rounds grows with the logarithm of a chain. Rounds are
    written tables, labels never leave the executors. An id linked with itself alone is its own component.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = work.write(both, f"{name}-links")
    labels = work.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both["b"] == labels["id"]).select(both["a"].alias("id"), labels["component"].alias("near"))
        near = near.groupBy("id").agg(F.min("near").alias("near"))
        found = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        # an old label's node may take the smaller label that one of its nodes has found
        hooks = found.filter("label < was").select(F.col("was").alias("id"), "label").groupBy("id").agg(F.min("label").alias("hook"))
        found = found.join(hooks, "id", "left").select("id", "was", F.least("label", F.coalesce("hook", "label")).alias("label"))
        found = work.write(found, f"{name}-s{step}")
        up = found.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = found.join(up, "label", "left").select("id", "was", F.least("label", F.coalesce("up", "label")).alias("component"))
        jumped = work.write(jumped, f"{name}-{step}")
        work.drop(f"{name}-s{step}")
        labels = jumped.select("id", "component")
        if jumped.filter("component <> was").isEmpty():
            work.drop(f"{name}-links")
            return labels
        work.drop(f"{name}-{step - 1}")
