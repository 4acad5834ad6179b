"""Graph encoders with vector states: message passing, attention with heads, soft pooling, readouts, combination.

Nodes have ``g`` (the graph), ``id`` and a state ``h`` (array<double>); edges ``g``, ``i``, ``j``, a weight ``a`` (1 in a plain graph) and,
where bonds count, attributes ``w`` (array<double>), in both directions. Weight matrices are numpy arrays of a model's size, written into
the plan; states are multiplied where they are, so a step is one join of edges with states and one sum by node, element by element,
which is combined before the shuffle. No graph is collected into a row. Joins are merges: Spark's guess of a state's size can be far
below it, and a table of nodes must not be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(v: np.ndarray) -> Column:
    """A vector or a matrix (its rows) as arrays."""
    return F.array(*[F.lit(float(x)) if np.ndim(x) == 0 else literal(x) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times(h: Column, matrix: np.ndarray) -> Column:
    """The row vector ``h`` times a matrix."""
    return F.transform(literal(np.asarray(matrix).T), lambda column: dot(h, column))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def softmax(v: Column) -> Column:
    """Of a row; ``v`` is computed once."""
    raised = F.get(F.transform(F.array(v), lambda u: F.transform(u, lambda x: F.exp(x - F.array_max(u)))), F.lit(0))
    return F.get(F.transform(F.array(raised), lambda u: F.transform(u, lambda x: x / F.aggregate(u, F.lit(0.0), lambda s, y: s + y))), F.lit(0))


def summed(df: DataFrame, by: Sequence[str], v: Column, width: int, how=F.sum) -> DataFrame:
    """Element-wise sums (or maxima) ``v`` of an array of known width by groups."""
    rows = df.select(*by, v.alias("_v"))
    each = rows.groupBy(*by).agg(*[how(F.col("_v")[k]).alias(f"_{k}") for k in range(width)])
    return each.select(*by, F.array(*[F.col(f"_{k}") for k in range(width)]).alias("v"))


def neighbours(nodes: DataFrame, edges: DataFrame, state: Column) -> DataFrame:
    """Edges with ``state`` of the node they come from as ``hj``."""
    return edges.join(nodes.select("g", F.col("id").alias("j"), state.alias("hj")).hint("merge"), ["g", "j"])


def message_passing(nodes: DataFrame, edges: DataFrame, own: np.ndarray, other: np.ndarray, bias: np.ndarray | None = None, bond: np.ndarray | None = None, activate: bool = True) -> DataFrame:
    """relu(h_i ``own`` + sum over neighbours of a_ij (h_j ``other`` + w_ij ``bond`` + ``bias``)); without ``activate``, no relu."""
    width = np.shape(other)[1]
    sent = neighbours(nodes, edges, times(F.col("h"), other))
    value = F.col("hj")
    if bond is not None:
        value = plus(value, times(F.col("w"), bond))
    if bias is not None:
        value = plus(value, literal(bias))
    got = summed(sent, ["g", "i"], F.transform(value, lambda x: x * F.col("a")), width).withColumnRenamed("i", "id")
    zero = literal(np.zeros(width))
    total = plus(times(F.col("h"), own), F.coalesce(F.col("v"), zero))
    return nodes.join(got.hint("merge"), ["g", "id"], "left").select("g", "id", (relu(total) if activate else total).alias("h"))


def attention(nodes: DataFrame, edges: DataFrame, heads: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], bias: Sequence[np.ndarray] | None = None, reduction: str = "concat", slope: float = 0.2) -> DataFrame:
    """Attention over the neighbours and the node itself, with one (matrix, own vector, neighbour's vector) a head.

    A head's logits are LeakyReLU(own . v_i + neighbour's . v_j) with v = h matrix; their softmax weighs the v_j. Heads are joined
    (``concat``) or averaged, then relu. All heads go through the same joins.
    """
    if reduction not in ("concat", "average"):
        raise ValueError(f"no reduction {reduction}")
    size = np.shape(heads[0][0])[1]
    v = F.array(*[times(F.col("h"), w) for w, _, _ in heads])
    told = nodes.select("g", "id", v.alias("v"))
    told = told.select("g", "id", "v", F.array(*[dot(F.col("v")[n], literal(a)) for n, (_, a, _) in enumerate(heads)]).alias("s"), F.array(*[dot(F.col("v")[n], literal(b)) for n, (_, _, b) in enumerate(heads)]).alias("t"))
    loops = nodes.select("g", F.col("id").alias("i"), F.col("id").alias("j"))
    near = edges.select("g", "i", "j").where("i <> j").distinct().unionByName(loops)
    met = near.join(told.select("g", F.col("id").alias("i"), "s").hint("merge"), ["g", "i"]).join(told.select("g", F.col("id").alias("j"), "t", "v").hint("merge"), ["g", "j"])
    raw = F.zip_with("s", "t", lambda x, y: F.when(x + y >= 0, x + y).otherwise((x + y) * slope))
    logits = met.select("g", "i", "v", raw.alias("e"))
    count = range(len(heads))
    top = logits.groupBy("g", "i").agg(*[F.max(F.col("e")[n]).alias(f"m{n}") for n in count])
    share = logits.join(top.hint("merge"), ["g", "i"]).select("g", "i", "v", *[F.exp(F.col("e")[n] - F.col(f"m{n}")).alias(f"x{n}") for n in count])
    sums = [F.sum(f"x{n}").alias(f"d{n}") for n in count] + [F.sum(F.col(f"x{n}") * F.col("v")[n][k]).alias(f"y{n}_{k}") for n in count for k in range(size)]
    each = share.groupBy("g", F.col("i").alias("id")).agg(*sums)
    out = [[F.col(f"y{n}_{k}") / F.col(f"d{n}") + float(bias[n][k] if bias is not None else 0.0) for k in range(size)] for n in count]
    flat = sum(out, []) if reduction == "concat" else [sum((out[n][k] for n in count), F.lit(0.0)) / len(heads) for k in range(size)]
    return each.select("g", "id", F.array(*[F.greatest(x, F.lit(0.0)) for x in flat]).alias("h"))


def assignment(nodes: DataFrame, edges: DataFrame, own: np.ndarray, other: np.ndarray) -> DataFrame:
    """Each node's shares ``s`` in the clusters: the softmax of one step of relu message passing to as many columns as clusters."""
    raw = message_passing(nodes, edges, own, other)
    return raw.select("g", "id", softmax(F.col("h")).alias("s"))


def pooled(nodes: DataFrame, edges: DataFrame, shares: DataFrame, width: int, clusters: int) -> tuple[DataFrame, DataFrame]:
    """The smaller graph of the clusters: states S'H and weights S'AS between clusters, each node and edge spread over its clusters."""
    met = nodes.join(shares.hint("merge"), ["g", "id"]).select("g", "h", F.posexplode("s").alias("id", "p"))
    own = summed(met, ["g", "id"], F.transform("h", lambda x: x * F.col("p")), width).withColumnRenamed("v", "h")
    ends = edges.join(shares.select("g", F.col("id").alias("i"), F.col("s").alias("si")).hint("merge"), ["g", "i"]).join(shares.select("g", F.col("id").alias("j"), F.col("s").alias("sj")).hint("merge"), ["g", "j"])
    rows = ends.select("g", "a", "sj", F.posexplode("si").alias("i", "p")).select("g", "i", F.transform("sj", lambda q: q * F.col("p") * F.col("a")).alias("row"))
    cells = summed(rows, ["g", "i"], F.col("row"), clusters)
    return own, cells.select("g", "i", F.posexplode("v").alias("j", "a"))


def link_loss(edges: DataFrame, shares: DataFrame, clusters: int) -> DataFrame:
    """Per graph the Frobenius norm ``loss`` of A - SS', from the edges and the clusters' products alone, never from all pairs.

    The squares of all s_i . s_j add up to the squares of S'S; only edges change their cells.
    """
    products = shares.select("g", "s", F.posexplode("s").alias("c", "p")).select("g", "c", F.transform("s", lambda x: x * F.col("p")).alias("row"))
    gram = summed(products, ["g", "c"], F.col("row"), clusters)
    whole = gram.groupBy("g").agg(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("q"))
    ends = edges.join(shares.select("g", F.col("id").alias("i"), F.col("s").alias("si")).hint("merge"), ["g", "i"]).join(shares.select("g", F.col("id").alias("j"), F.col("s").alias("sj")).hint("merge"), ["g", "j"])
    k = dot(F.col("si"), F.col("sj"))
    moved = ends.select("g", "a", k.alias("k")).groupBy("g").agg(F.sum(F.col("a") * F.col("a") - 2 * F.col("a") * F.col("k")).alias("d"))
    return whole.join(moved.hint("merge"), "g", "left").select("g", F.sqrt(F.greatest(F.lit(0.0), F.col("q") + F.coalesce("d", F.lit(0.0)))).alias("loss"))


def readout(nodes: DataFrame, width: int, how: str = "sum") -> DataFrame:
    """One vector a graph: element-wise ``sum`` or ``max``."""
    return summed(nodes, ["g"], F.col("h"), width, {"sum": F.sum, "max": F.max}[how]).withColumnRenamed("v", "h")


def combined(steps: Sequence[DataFrame], widths: Sequence[int], how: str = "concat") -> DataFrame:
    """Readouts of several steps as one vector a graph: their ``sum``, one behind the other (``concat``), or the ``last``."""
    if how == "last":
        return steps[-1].select("g", "h")
    met = steps[0].select("g", F.col("h").alias("h0"))
    for n, s in enumerate(steps[1:], 1):
        met = met.join(s.select("g", F.col("h").alias(f"h{n}")).hint("merge"), "g", "full")
    parts = [F.coalesce(F.col(f"h{n}"), literal(np.zeros(w))) for n, w in enumerate(widths)]
    if how == "concat":
        return met.select("g", F.concat(*parts).alias("h"))
    if how == "sum":
        total = parts[0]
        for p in parts[1:]:
            total = plus(total, p)
        return met.select("g", total.alias("h"))
    raise ValueError(f"no combination {how}")
