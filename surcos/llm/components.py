"""Connected components: of a link table by label passing, and of a few links in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surcos.sources.scratch import materialise, release


class Forest:
    """Union-find over ids met in one task; ``joins`` tells whether a pair is news."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = b
        return a

    def joins(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the least reachable node) for every linked node.

    A round gives each node the least label among itself and its neighbours, and then the
    label of that label, so long chains shrink fast. Labels are written each round, which
    keeps plans short and survives lost executors. Minima are merged before the shuffle, and
    joins start from written tables, whose swollen partitions adaptive execution can split.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(seen, F.col("node") == F.col("a")).select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        target = labels.select(F.col("node").alias("n"), F.col("component").alias("next"))
        jumped = materialise(
            hooked.join(target, F.col("component") == F.col("n"), "left").select(
                "node", F.least("component", "next").alias("component"), "old"),
            "labels",
        )
        changed = jumped.where("component <> old").limit(1).count()
        release(labels)
        labels = jumped.select("node", "component")
        if not changed:
            release(both)
            return labels
