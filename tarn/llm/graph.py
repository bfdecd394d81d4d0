"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, label) of every node of ``edges`` (src, dst): the label is the smallest node of its component.

    Each round sends every node to its smallest neighbour, and once more to that one's, and carries on with the edges
    between the nodes that are left, so that tables shrink from round to round. What a round leaves is written to
    the shared folder; the rounds' moves are put together at the end. Loops and repeated edges do no harm, edges with a null end are ignored, no edges give no rows.
    """
    left = materialise(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), f"{tag}-edges")
    rounds = []
    while not rounds or not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("node"), F.col("src").alias("to")))).alias("e"))
        near = ends.select("e.*").groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        above = near.select(F.col("node").alias("to"), F.col("to").alias("top"))
        rounds.append(materialise(near.join(above, "to").select("node", F.col("top").alias("to")), f"{tag}-moved"))
        src, dst = (rounds[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("src", "dst"))
        joined = left.join(src, "src").join(dst, "dst").where("src_to <> dst_to")
        left = materialise(joined.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).distinct(), f"{tag}-edges")
    labels = rounds[0].select("node", F.col("to").alias("label"))
    for moved in rounds[1:]:
        labels = labels.join(moved.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialise(labels, f"{tag}-labels") if len(rounds) > 1 else labels
