"""Evaluation metrics as aggregates. Predictions have ``y`` (0 or 1, null for missing) and ``score``.

Curves group equal scores first, so what passes through the ordered window is one row a distinct score; null labels
are dropped. AUPR, ROC AUC, F1, recall and precision are percentages with two decimals, accuracy and MCC fractions
with four, squared errors have five. Undefined values are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockyard.operators.ranking import global_rank


#: Ranges of scores that running sums are made in, about equal in rows.
RANGES = 256


def range_of(df: DataFrame, column: str) -> Column:
    """The range of a number: borders are quantiles of the whole column (one pass; a fixed number of them reaches the
    driver), so numbers that crowd in a small interval are spread as well."""
    share = [i / RANGES for i in range(1, RANGES)]
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), share, 10_000)).first()[0]
    borders = sorted({float(b) for b in found or [] if math.isfinite(b)})

    def below(low: int, high: int) -> str:
        """A binary search among the borders."""
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN `{column}` >= {borders[mid]!r}D THEN {below(mid + 1, high)} ELSE {below(low, mid)} END"

    return F.expr(below(0, len(borders)))


def ranges(pred: DataFrame) -> DataFrame:
    """Rows with a label and a score, and ``_b``, the range of the score."""
    known = pred.where("y is not null and score is not null")
    return known.withColumn("_b", range_of(known, "score"))


def quantiles(df: DataFrame, by: list[str], column: str, shares: list[float]) -> DataFrame:
    """Exact quantiles ``q0``, ``q1`` .. of a number by groups, interpolated between neighbours; nulls are left out.

    Numbers are ranked in ranges, so no task holds all of a group's.
    """
    known = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v is not null")
    ranked = global_rank(known, ["_v"], range_of(known, "_v"), "_r", by).withColumn("_g", F.struct(*by, F.lit(0)))
    count = ranked.groupBy("_g").agg(F.count("*").alias("_n"))
    asked = [F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("at")) for i, q in enumerate(shares)]
    places = count.withColumn("_q", F.explode(F.array(*asked))).select("_g", "_q.i", F.floor("_q.at").alias("_low"), (F.col("_q.at") - F.floor("_q.at")).alias("_part"))
    ends = places.withColumn("_r", F.explode(F.array("_low", F.col("_low") + 1)))
    met = ranked.select("_g", "_r", "_v").join(ends, ["_g", "_r"])  # two rows a group and share
    low = F.max(F.when(F.col("_r") == F.col("_low"), F.col("_v")))
    high = F.coalesce(F.max(F.when(F.col("_r") > F.col("_low"), F.col("_v"))), low)
    each = met.groupBy("_g", "i").agg((low + (high - low) * F.max("_part")).alias("v"))
    found = each.groupBy("_g").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{i}") for i in range(len(shares))])
    return found.select(*[F.col("_g")[c].alias(c) for c in by], *[f"q{i}" for i in range(len(shares))])


def curve(pred: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct score, falling: positives ``tp`` and rows ``n`` at it, running sums ``ctp`` and ``cn``, totals ``p`` and ``t``.

    Running sums are made within ranges of scores, and what lies above a range is added; only the sums of the ranges, at
    most ``RANGES`` rows a group, pass through one window. Rows without a label or without a score are left out.
    """
    at = ranges(pred).groupBy(*by, "_b", "score").agg(F.sum("y").cast("double").alias("tp"), F.count("*").cast("double").alias("n"))
    at = at.withColumn("_g", F.struct(*by, "_b")).drop("_b")  # never null itself, so groups with a null key keep their rows
    whole = Window.partitionBy(*[F.col("_g")[c] for c in by]) if by else Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.desc(F.col("_g")["_b"]))
    sums = at.groupBy("_g").agg(F.sum("tp").alias("_tp"), F.sum("n").alias("_n"))
    above = sums.select(
        "_g",
        (F.sum("_tp").over(order) - F.col("_tp")).alias("_atp"),
        (F.sum("_n").over(order) - F.col("_n")).alias("_an"),
        F.sum("_tp").over(whole).alias("p"),
        F.sum("_n").over(whole).alias("t"),
    )
    own = Window.partitionBy("_g").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = at.withColumn("ctp", F.sum("tp").over(own)).withColumn("cn", F.sum("n").over(own))
    met = summed.join(above, "_g")
    return met.withColumn("ctp", F.col("ctp") + F.col("_atp")).withColumn("cn", F.col("cn") + F.col("_an")).drop("_g", "_atp", "_an")


def percent(x: Column) -> Column:
    return F.round(F.coalesce(x, F.lit(0.0)) * 100, 2)


def areas() -> dict[str, Column]:
    """Aggregates of a curve: ``aupr``, recall steps times precision, equal scores together; ``rocauc``, the share of ordered
    pairs of a positive and a negative, ties for a half; ``pr_area``, under straight lines between the points of the
    precision-recall curve, from recall 0 and precision 1."""
    tp, n, ctp, cn, p = (F.col(c) for c in ("tp", "n", "ctp", "cn", "p"))
    below = (F.col("t") - p) - (cn - ctp)
    wins = F.sum(tp * below + 0.5 * tp * (n - tp))
    before = F.coalesce(F.try_divide(ctp - tp, cn - n), F.lit(1.0))
    return {
        "aupr": percent(F.sum(F.try_divide(tp, p) * ctp / cn)),
        "rocauc": percent(F.try_divide(wins, F.max(p * (F.col("t") - p)))),
        "pr_area": F.round(F.sum(F.try_divide(tp, p) * (ctp / cn + before) / 2), 4),
    }


def areas_of(pred: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """The named areas, from one curve."""
    return curve(pred, by).groupBy(*by).agg(*[areas()[n].alias(n) for n in names])


def average_precision(pred: DataFrame, by: list[str]) -> DataFrame:
    return areas_of(pred, by, ["aupr"])


def roc_auc(pred: DataFrame, by: list[str]) -> DataFrame:
    return areas_of(pred, by, ["rocauc"])


def pr_trapezoid(pred: DataFrame, by: list[str]) -> DataFrame:
    return areas_of(pred, by, ["pr_area"])


def confusion(pred: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the four cells; a score counts as positive by rounding half to even."""
    hit = F.rint("score").cast("int")
    cell = lambda y, h: F.count_if((F.col("y") == y) & (hit == h)).cast("double")
    kept = pred.where("y is not null")
    return kept.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def rates() -> dict[str, Column]:
    """Metrics of a confusion table."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "f1": percent(F.try_divide(2 * tp, 2 * tp + fp + fn)),
        "recall": percent(F.try_divide(tp, tp + fn)),
        "precision": percent(F.try_divide(tp, tp + fp)),
        "acc": F.round(F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), F.lit(0.0)), 4),
        "mcc": F.round(F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0)), 4),
    }


def mse(pred: DataFrame, by: list[str]) -> DataFrame:
    return pred.where("y is not null").groupBy(*by).agg(F.round(F.avg(F.pow(F.col("y") - F.col("score"), 2)), 5).alias("mse"))


def report(pred: DataFrame, by: list[str]) -> DataFrame:
    """All classification metrics in long form: ``score_name`` and ``value``."""
    counts = confusion(pred, by)
    wide = counts.select(*by, *[c.alias(n) for n, c in rates().items() if n != "mcc"])
    joined = wide.join(areas_of(pred, by, ["aupr", "rocauc"]), by)
    return joined.unpivot(by, ["aupr", "rocauc", "f1", "recall", "precision", "acc"], "score_name", "value")


def masked_bce(pred: DataFrame) -> DataFrame:
    """Mean binary cross entropy over all cells, of which those without a label count as 0."""
    p = F.greatest(F.least("score", F.lit(1 - 1e-7)), F.lit(1e-7))
    loss = F.when(F.col("y").isNull(), 0.0).when(F.col("y") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return pred.groupBy("task").agg(F.round(F.avg(loss), 6).alias("loss"))
