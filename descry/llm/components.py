"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import stored


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label) for every end of ``links`` (src, dst long): the smallest reachable node.

    Each round a node takes the least label among its neighbours, hands it to its present
    root, and then follows its label once. All sums are minima, so a node of many links is
    added up before it moves; rounds grow with the logarithm of the longest chain in practice.
    A link with a null end is no link, a link to itself makes a component of one; an empty
    table gives an empty table. ``rows``, if known, bounds the links.
    """
    links = links.filter("src is not null and dst is not null")
    both = links.select("src", "dst").unionAll(links.select(F.col("dst").alias("src"),
                                                            F.col("src").alias("dst")))
    edges = stored(both.distinct(), "links", rows)
    n = edges.count()
    labels = stored(edges.groupBy("src").agg(F.min("dst").alias("low"))
                    .select(F.col("src").alias("node"), F.least("src", "low").alias("label")),
                    "labels", n)
    before = None
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        near = (edges.join(labels.withColumnRenamed("node", "dst"), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("label").alias("low")))
        met = labels.join(near, "node")
        hooked = (met.select(F.explode(F.array(
            F.struct("node", F.least("label", "low").alias("label")),
            F.struct(F.col("label").alias("node"), F.least("label", "low").alias("label"))))
            .alias("x")).select("x.*").groupBy("node").agg(F.min("label").alias("label")))
        root = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(hooked.join(root, "label").select("node", F.col("next").alias("label")),
                        "labels", n)
