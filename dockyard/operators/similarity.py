"""Similarity joins of bags by prefixes, with hot items cut into blocks that meet pairwise.

A bag with an item n times is the set of its tokens (item, 1) to (item, n); the count-Tanimoto of two bags, the sum of minima
over the sum of maxima, is the Jaccard coefficient of their tokens. Tokens are put in one order for all, the rarest first. Two
sets of sizes s and t with a coefficient of at least c share a token among the first s - ceil(c s) + 1 of the one and the first
t - ceil(c t) + 1 of the other, so only these meet, and only where the sizes allow the coefficient. What meets is verified on
all tokens.

Where few tokens make all the sets, none is rare and nearly all pairs meet, several times. Then the kernel's tiles are made and cells below
the bound dropped where they are made: the same result, at some nanoseconds a cell.

A token that many sets have is cut into blocks of about ``BLOCK`` sets; each pair of blocks is a key of its own, so no task sees
more than two blocks of one token, and no two sets meet twice by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockyard.functions.kernels import overlap_pairs
from dockyard.operators.lineage import kept

BLOCK, SALT = 2048, 16
#: Where sets would meet more often than this, and once for ``CELLS`` cells of the whole kernel, its tiles are made instead.
MEETINGS, CELLS = 20_000_000, 20


def token_sets(bag: DataFrame) -> DataFrame:
    """``id``, ``s`` (how many tokens) and ``tokens``, rarest first, of a bag (``id``, ``item``, ``n``).

    Rows that repeat an item of an id add up; null ids and items and counts below 1 are left out. The number of sets that have a
    token is counted with a map-side combine and joined back in ``SALT`` parts, so a hot token does not meet in one task.
    """
    summed = bag.where("id is not null and item is not null and n >= 1").groupBy("id", "item").agg(F.sum("n").cast("int").alias("n"))
    each = summed.select("id", "item", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    df = each.groupBy("item", "nth").agg(F.count("*").alias("df"))
    dealt = df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    token = F.struct("df", "item", "nth")
    return each.join(dealt, ["item", "nth", "salt"]).groupBy("id").agg(F.sort_array(F.collect_list(token)).alias("tokens")).withColumn("s", F.size("tokens"))


def _prefix(least: float) -> Column:
    return F.col("s") - F.ceil(F.col("s") * least - 1e-9).cast("int") + 1


def _hot(sets: DataFrame, least: float) -> bool:
    """Whether prefixes would meet so often that tiles of all pairs are less work."""
    df = sets.select(F.explode(F.slice("tokens", F.lit(1), _prefix(least))).alias("t")).groupBy("t").agg(F.count("*").cast("double").alias("n"))
    meetings = df.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    return meetings > MEETINGS and meetings * CELLS > sets.count() ** 2 / 2


def _met(sets: DataFrame, least: float, block: int) -> DataFrame:
    """Pairs ``i`` < ``j`` (with ``u``, ``v``, their tokens as text) beside each token ``t`` of both prefixes, where the sizes allow ``least``."""
    size = _prefix(least)
    text = lambda t: F.concat_ws(":", t["nth"].cast("string"), t["item"].cast("string"))
    names = sets.select("id", "s", "tokens", F.transform("tokens", text).alias("names"))
    first = names.select("id", "s", "names", F.explode(F.slice("tokens", F.lit(1), size)).alias("t"))
    parts = F.ceil(F.col("t.df") / block).cast("int")  # sets that have the token bound those that have it in front
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    met = first.select("id", "s", "names", text(F.col("t")).alias("t"), own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    key = met.select("id", "s", "names", "t", "own", F.least("own", "other").alias("b"), F.greatest("own", "other").alias("c"))
    a = key.select("t", "b", "c", F.col("id").alias("i"), F.col("s").alias("p"), F.col("own").alias("x"), F.col("names").alias("u"))
    b = key.select("t", "b", "c", F.col("id").alias("j"), F.col("s").alias("q"), F.col("own").alias("y"), F.col("names").alias("v"))
    fits = (F.col("i") < F.col("j")) & (F.least("p", "q") >= least * F.greatest("p", "q") - 1e-9) & ((F.col("b") == F.col("c")) | (F.col("x") != F.col("y")))
    return a.join(b.hint("merge"), ["t", "b", "c"]).where(fits)


def candidates(sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs ``i`` < ``j`` of sets that share a token of their prefixes and whose sizes allow ``least``; each pair once."""
    return _met(sets, least, block).select("i", "j").distinct()


def similarity_join(bag: DataFrame, least: float = 0.5, block: int = BLOCK, diagonal: bool = True) -> DataFrame:
    """Count-Tanimoto kernel (``i`` <= ``j``, ``k``) of a bag's pairs with at least ``least`` (over 0): the cells of
    ``kernels.overlap_pairs`` at that bound, without meeting by common items alone.

    Sets carry all their tokens to where they meet and are verified there. A pair that shares several tokens of its prefixes counts
    where it meets by the first one, so no pair that meets is shuffled.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    own = kept(bag.where("id is not null and item is not null and n >= 1").groupBy("id", "item").agg(F.sum("n").cast("int").alias("n")))
    sets = kept(token_sets(own))
    if _hot(sets, least):
        cells = overlap_pairs(own, least)
        return cells if diagonal else cells.where("i <> j")
    shared = _met(sets, least, block).select("i", "j", "p", "q", "t", F.array_intersect("u", "v").alias("both")).where(F.get("both", F.lit(0)) == F.col("t"))
    m = F.size("both")
    found = shared.select("i", "j", (m / (F.col("p") + F.col("q") - m)).alias("k")).where(F.col("k") >= least)
    return found.unionByName(sets.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("k"))) if diagonal else found
