"""Connected components of an edge table, by contraction to randomly ordered neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmnet.storage import materialize


def contract(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (columns a, b; 64-bit): ids of a component share one root.

    In each round every id takes the name of the neighbour, or itself, that comes first in an order hashed anew for the
    round; edges between equal names vanish. About half of the names go in a round whatever the shape of the component,
    so paths and stars of any length end after a logarithmic number of rounds. A round sums at the map side and is
    stored, which cuts lineage; no neighbour list is ever gathered.
    """
    names = []
    left = materialize(edges.where("a != b").select("a", "b").distinct(), "edges")
    while not left.isEmpty():
        order = F.xxhash64(F.lit(len(names) + 1), F.col("b"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.unionByName(both.select("a", F.col("a").alias("b")))
        name = materialize(both.groupBy("a").agg(F.min(F.struct(order.alias("o"), "b")).alias("m")).select("a", F.col("m.b").alias("to")), "names")
        names.append(name)
        moved = left.join(name, "a").select("b", F.col("to").alias("a")).join(name.withColumnRenamed("a", "b"), "b")
        left = materialize(moved.select("a", F.col("to").alias("b")).where("a != b").distinct(), "edges")
    if not names:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = names[0].withColumnRenamed("a", "id").withColumnRenamed("to", "root")
    for name in names[1:]:
        moved = roots.join(name, roots["root"] == name["a"], "left")
        roots = moved.select("id", F.coalesce("to", "root").alias("root"))
    return roots
