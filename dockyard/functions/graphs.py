"""Graph encoders with fixed weights as joins and aggregates over node and edge tables.

Nodes have ``id`` and a state ``h``; edges ``i``, ``j`` and a weight or bond value ``w``, in both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_passing(nodes: DataFrame, edges: DataFrame, own: float, other: float, bias: float = 0.0, bond: float = 0.0) -> DataFrame:
    """relu(own * h_i + sum over neighbours of (other * h_j + bond * w_ij + bias)), scalar weights: one join and one sum a step."""
    sent = edges.join(nodes.select(F.col("id").alias("j"), F.col("h").alias("hj")), "j")
    got = sent.groupBy("i").agg(F.sum(F.col("hj") * other + F.col("w") * bond + bias).alias("m"))
    met = nodes.join(got, nodes["id"] == got["i"], "left")
    return met.select("id", F.greatest(F.lit(0.0), F.col("h") * own + F.coalesce("m", F.lit(0.0))).alias("h"))


def attention(nodes: DataFrame, edges: DataFrame, weight: float, a_own: float, a_other: float) -> DataFrame:
    """Graph attention: softmax over the neighbours and the node itself of LeakyReLU(0.2) logits, then the weighted sum."""
    loops = edges.select("i", "j").distinct().unionByName(nodes.select(F.col("id").alias("i"), F.col("id").alias("j")))
    v = nodes.select("id", (F.col("h") * weight).alias("v"))
    met = loops.join(v.toDF("i", "vi"), "i").join(v.toDF("j", "vj"), "j")
    raw = F.col("vi") * a_own + F.col("vj") * a_other
    logits = met.withColumn("e", F.when(raw >= 0, raw).otherwise(raw * 0.2))
    top = logits.groupBy("i").agg(F.max("e").alias("t"))
    x = F.exp(F.col("e") - F.col("t"))
    out = logits.join(top, "i").groupBy("i").agg((F.sum(x * F.col("vj")) / F.sum(x)).alias("h"))
    return out.select(F.col("i").alias("id"), "h")


def readout(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """Sum and maximum of the states of each graph: ``graph`` has ``id`` and ``g``."""
    return nodes.join(graph, "id").groupBy("g").agg(F.sum("h").alias("sum_h"), F.max("h").alias("max_h"))
