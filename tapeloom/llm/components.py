"""Connected components by alternating large and small stars, with every round staged in the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.frames import staged

MOST_ROUNDS = 60


def _loose(links: DataFrame) -> DataFrame:
    """Nodes with several lower ends, or with a lower and an upper one: u, least (the least lower end), upper. None in a forest of stars."""
    lower = F.struct("u", F.col("v").alias("least"), F.lit(False).alias("upper"))
    upper = F.struct(F.col("v").alias("u"), F.lit(None).cast(links.schema["v"].dataType).alias("least"), F.lit(True).alias("upper"))
    ends = links.select(F.explode(F.array(lower, upper)).alias("e")).select("e.*")
    nodes = ends.groupBy("u").agg(F.min("least").alias("least"), F.max("least").alias("most"), F.max("upper").alias("upper"))
    return nodes.filter("least < most OR (upper AND least IS NOT NULL)").select("u", "least", "upper")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, component): the smallest node reachable. Only nodes of some link are listed.

    Links point from the larger to the smaller end. A round sends every link on to the least lower end of its own lower end
    (large star), then all lower ends of a node to the least of them (small star), and makes no row more. The centre of a star
    has no lower end: its links meet a table of the loose nodes alone, which is small as soon as stars form. A forest of
    stars, as links may come, takes no round. Self links and repeated links don't matter; no links give an empty result.
    """
    given = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    links = given.filter("u > v")
    for _ in range(MOST_ROUNDS):
        loose = staged(_loose(links))
        if loose.isEmpty():
            break
        onward = loose.filter("upper AND least IS NOT NULL").select(F.col("u").alias("v"), "least")
        large = links.join(onward, "v", "left").select("u", F.coalesce("least", "v").alias("v")).distinct()
        small = large.withColumn("least", F.min("v").over(Window.partitionBy("u")))
        links = staged(small.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")))
    else:
        raise RuntimeError("components did not settle")
    nodes = links.unionByName(links.select(F.col("v").alias("u"), "v")).unionByName(given.filter("u = v"))
    return nodes.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
