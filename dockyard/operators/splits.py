"""Cross-validation splits with nested, deterministic negative samples.

Pairs fall into groups: one in setting 1, the folds of an entity in settings 2 and 3, the cells of a grid of folds in
setting 4. Each group gets negatives in proportion to its own positives, however few entities it has, so draws are made for
each group: draw t of a group is the pair of a protein and a molecule of the group that a hash of t numbers, and
draws that repeat or that interact are dropped. What is left, in the order of the draws, is a uniform sample without
replacement from the group's complement, which is never formed; a sample for a smaller ratio is the beginning of the one
for a larger ratio. Only where a group wants over half of its complement, that complement is listed, in a hash order.

Entities are numbered in a hash order, so ids may be of any type. Draws are numbers; they get names once they are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockyard.operators.lineage import cut, kept
from dockyard.operators.ranking import global_rank, kfold, numbered

RATIOS = (10, 5, 2, 1)
FOLDS = 5
#: Draws that one row stands for before they are dealt to tasks, and that are ranked together.
CHUNK = 1 << 14
#: Parts of the proteins, each of which is sent every lot of molecules.
PARTS = 16


def n_draws(need: int, cells: int, free: int) -> tuple[int, bool]:
    """How many draws give ``need`` different free cells of ``cells`` (six standard deviations are added), or all cells and
    True where more than half of the ``free`` ones are wanted.

    With x the share of the free cells that is wanted, -ln(1 - x) draws a cell leave that share; it is at most x + x^2.
    """
    wanted = need + 6 * math.isqrt(need) + 10
    if 2 * wanted > free:
        return cells, True
    return wanted * cells * (free + wanted) // free // free + 1, False


def negatives(pairs: DataFrame, groups: dict[int, tuple[int, int]], top: int) -> tuple[DataFrame, dict[int, int]]:
    """``top`` negatives for each positive of a group: ``g``, ``pi``, ``mi`` and ``position``, and how many each group has.

    ``pairs``: the numbered positives (``g``, ``pi``, ``mi``); ``groups``: how many proteins and molecules a group has. A
    group has fewer negatives than asked for only if its complement is that small.
    """
    spark = pairs.sparkSession
    known = {r.g: r["count"] for r in pairs.groupBy("g").count().collect()}  # one row a group
    more = 1
    while True:
        told = []
        for g, n in sorted(known.items()):
            n_p, n_m = groups[g]
            count, listed = n_draws(top * n * more, n_p * n_m, n_p * n_m - n)
            told.append((g, n_p, n_m, top * n, count, listed))
        table = spark.createDataFrame(told, "g int, n_p long, n_m long, want long, draws long, listed boolean")
        starts = table.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1, F.lit(CHUNK).cast("long"))))
        dealt = starts.repartition(F.col("g"), F.col("start"))
        t = dealt.withColumn("t", F.explode(F.expr(f"sequence(start, least(start + {CHUNK}, draws) - 1)")))
        h = F.md5(F.concat(F.col("g").cast("string"), F.lit("-"), F.col("t").cast("string")))
        number = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long")
        drawn = t.withColumn("h", h).select(
            "g",
            F.when(F.col("listed"), F.floor(F.col("t") / F.col("n_m"))).otherwise(number(1) % F.col("n_p")).alias("pi"),
            F.when(F.col("listed"), F.col("t") % F.col("n_m")).otherwise(number(17) % F.col("n_m")).alias("mi"),
            F.when(F.col("listed"), number(1)).otherwise(F.col("t")).alias("o"),
        )
        first = drawn.groupBy("g", "pi", "mi").agg(F.min("o").alias("o"))
        free = cut(first.join(pairs.select("g", "pi", "mi"), ["g", "pi", "mi"], "left_anti"))
        have = {g: 0 for g in known} | {r.g: r["count"] for r in free.groupBy("g").count().collect()}
        if all(listed or have[g] >= want for g, _, _, want, _, listed in told):
            break
        more *= 2  # about once in 10^9 groups
    last = F.broadcast(table.select("g", "want", F.when(F.col("listed"), (1 << 60) / F.ceil(F.col("draws") / CHUNK)).otherwise(float(CHUNK)).alias("wide")))
    keyed = free.join(last, "g")
    ranked = global_rank(keyed, ["o", "pi", "mi"], F.floor(F.col("o") / F.col("wide")), "position", ["g"])
    return ranked.where(F.col("position") < F.col("want")).select("g", "pi", "mi", "position"), {g: min(n, top * known[g]) for g, n in have.items()}


def sizes(n: int, ratios=RATIOS) -> dict[int, int]:
    """How many negatives ``n`` positives get at each ratio: each ratio's count is rounded from the one before."""
    last, out = max(ratios), {max(ratios): max(ratios) * n}
    for ratio in sorted(ratios, reverse=True)[1:]:
        out[ratio] = round(ratio / last * out[last])
        last = ratio
    return out


class Grid:
    """A relation by numbers: its pairs with the group, the protein's and the molecule's number in it, and the names.

    ``kp`` and ``km`` folds of proteins and molecules make kp * km groups; an entity's number gives its fold (the
    remainder) and its number there. Ids that are null take no part; repeated rows are one.
    """

    def __init__(self, inter: DataFrame, prots: DataFrame, mols: DataFrame, kp: int, km: int):
        self.kp, self.km = kp, km
        self.inter = cut(inter.select("prot_id", "mol_id").where("prot_id is not null and mol_id is not null").distinct())
        own = [df.select(c).where(F.col(c).isNotNull()).distinct() for df, c in ((prots, "prot_id"), (mols, "mol_id"))]
        p, m = (cut(numbered(df, df.columns[0])) for df in own)
        self.n_p, self.n_m = p.count(), m.count()
        self.p = p.select("prot_id", (F.col("number") % kp).cast("int").alias("pf"), F.floor(F.col("number") / kp).alias("pi"))
        self.m = m.select("mol_id", (F.col("number") % km).cast("int").alias("mf"), F.floor(F.col("number") / km).alias("mi"))
        group = (F.col("pf") * km + F.col("mf")).cast("int")
        self.pairs = self.inter.join(self.p, "prot_id").join(self.m, "mol_id").withColumn("g", group)

    def negatives(self, top: int) -> tuple[DataFrame, dict[int, int]]:
        """Named negatives: ``prot_id``, ``mol_id``, ``pf``, ``mf``, ``g``, ``position``; how many each group has."""
        size = lambda n, k, f: (n - f + k - 1) // k
        groups = {f * self.km + e: (size(self.n_p, self.kp, f), size(self.n_m, self.km, e)) for f in range(self.kp) for e in range(self.km)}
        found, have = negatives(self.pairs, groups, top)
        split = found.withColumn("pf", F.floor(F.col("g") / self.km).cast("int")).withColumn("mf", F.col("g") % self.km)
        return split.join(self.p, ["pf", "pi"]).join(self.m, ["mf", "mi"]).select("prot_id", "mol_id", "pf", "mf", "g", "position"), have


def setting1(inter: DataFrame, prots: DataFrame, mols: DataFrame, ratios=RATIOS, k: int = FOLDS, only: int | None = None) -> DataFrame:
    """Raw pairs: ``prot_id``, ``mol_id``, ``y``, ``ratio``, ``fold``, ``missing``. Positives are the same for every ratio.

    Of the ``n_pos * max(ratios)`` negatives, dealt to folds by their position, a fold keeps for a ratio the first
    round(round(ratio / previous ratio * previous count) / k), ratios falling. Pairs are drawn and ranked once, and each
    row goes to the ratios it is in. Where the complement is too small for a ratio all of it is taken, and ``missing``
    says how many negatives the ratio lacks. ``only`` gives a single ratio's rows.
    """
    grid = Grid(inter, prots, mols, 1, 1)
    pairs = grid.inter.withColumn("_key", F.concat_ws("-", "prot_id", "mol_id"))
    positive = kfold(pairs, "_key", k).select("prot_id", "mol_id", F.lit(1).alias("y"), "fold", F.lit(0).cast("long").alias("r"))
    n, top = grid.inter.count(), max(ratios)
    found, have = grid.negatives(top)
    fold, place = (F.col("position") % k).cast("int").alias("fold"), F.floor(F.col("position") / k).alias("r")
    negative = found.select("prot_id", "mol_id", F.lit(0).alias("y"), fold, place)
    some = {r: c for r, c in sizes(n, ratios).items() if only in (None, r)}
    told = [
        F.struct(F.lit(r).alias("ratio"), F.lit((1 << 62) if r == top else round(c / k)).alias("most"), F.lit(max(0, c - have.get(0, 0))).alias("missing"))
        for r, c in some.items()
    ]
    fits = F.filter(F.array(*told), lambda s: (F.col("y") == 1) | (F.col("r") < s["most"]))
    return positive.unionByName(negative).select("prot_id", "mol_id", "y", "fold", F.explode(fits).alias("s")).select(
        "prot_id", "mol_id", "y", "s.ratio", "fold", F.col("s.missing").cast("long").alias("missing")
    )


def _grouped(grid: Grid, ratios) -> DataFrame:
    """Positives and nested negatives of each group: ``prot_id``, ``mol_id``, ``y``, ``pf``, ``mf``, ``ratio``, ``missing``."""
    found, have = grid.negatives(max(ratios))
    counts = grid.pairs.groupBy("g").agg(F.count("*").alias("n_pos"))
    told = grid.inter.sparkSession.createDataFrame(sorted(have.items()), "g int, have long")
    ratio = F.explode(F.array(*[F.lit(r) for r in ratios])).alias("ratio")
    groups = F.broadcast(counts.join(told, "g").select("*", ratio).withColumn("missing", F.greatest(F.lit(0), F.col("ratio") * F.col("n_pos") - F.col("have"))))
    positive = grid.pairs.select("prot_id", "mol_id", F.lit(1).alias("y"), "pf", "mf", "g", F.lit(-1).cast("long").alias("position"))
    negative = found.select("prot_id", "mol_id", F.lit(0).alias("y"), "pf", "mf", "g", "position")
    met = positive.unionByName(negative).join(groups, "g").where(F.col("position") < F.col("ratio") * F.col("n_pos"))
    return met.select("prot_id", "mol_id", "y", "pf", "mf", "ratio", "missing")


def by_entity(inter: DataFrame, prots: DataFrame, mols: DataFrame, entity: str, ratios=RATIOS, k: int = FOLDS) -> DataFrame:
    """Settings 2 and 3: folds over proteins or molecules (``entity``); pairs inherit the fold; negatives nested in it.

    ``missing`` says how many negatives of a ratio the fold's complement lacks.
    """
    kp, km, fold = (k, 1, "pf") if entity == "protein" else (1, k, "mf")
    found = _grouped(Grid(inter, prots, mols, kp, km), ratios)
    return found.select("prot_id", "mol_id", "y", F.col(fold).alias("fold"), "ratio", "missing")


def double_orphan(inter: DataFrame, prots: DataFrame, mols: DataFrame, ratios=RATIOS, k: int = FOLDS) -> DataFrame:
    """Setting 4: ``prot_id``, ``mol_id``, ``y``, ``pf``, ``mf``, ``ratio``, ``missing``: pairs in a k x k grid of folds.

    Each cell holds its positives and, nested by ratio, its first negatives, ``ratio`` times its positives. A split is a
    filter on the two folds (``block``), so the pairs of the k^2 (k - 1)^2 splits are stored once.
    """
    return _grouped(Grid(inter, prots, mols, k, k), ratios)


def part(tp, tm, vp, vm) -> Column:
    """The part of a pair of setting 4 if (tp, tm) is the test block and (vp, vm) the validation block: train pairs lie
    outside both blocks in both keys, and what is left has no part."""
    tp, tm, vp, vm = (F.lit(x) if isinstance(x, int) else x for x in (tp, tm, vp, vm))
    return (
        F.when((F.col("pf") == tp) & (F.col("mf") == tm), "test")
        .when((F.col("pf") == vp) & (F.col("mf") == vm), "val")
        .when(~F.col("pf").isin(tp, vp) & ~F.col("mf").isin(tm, vm), "train")
    )


def block(grid: DataFrame, tp: int, tm: int, vp: int, vm: int) -> DataFrame:
    """One split of setting 4: the pairs of ``double_orphan`` with their ``part``."""
    return grid.withColumn("part", part(tp, tm, vp, vm)).where("part is not null")


def block_counts(grid: DataFrame, k: int = FOLDS) -> DataFrame:
    """Pairs in ``test``, ``val`` and ``train`` of every split: each pair of blocks that differ in both coordinates.

    The pairs of a cell are counted once; the splits combine k * k counts, so nothing is repeated 400 times.
    """
    cells = grid.groupBy("pf", "mf", "y", "ratio").agg(F.count("*").alias("n"))
    blocks = grid.sparkSession.range(1)
    for name in ("tp", "tm", "vp", "vm"):
        blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name))
    blocks = blocks.drop("id").where("tp <> vp and tm <> vm")
    met = blocks.join(F.broadcast(cells))  # at most two rows a cell and ratio
    told = met.withColumn("part", part(*(F.col(c) for c in ("tp", "tm", "vp", "vm")))).where("part is not null")
    return told.groupBy("tp", "tm", "vp", "vm", "part", "y", "ratio").agg(F.sum("n").alias("n"))


def make_split(setting: int, inter: DataFrame, prots: DataFrame, mols: DataFrame, ratios=RATIOS, k: int = FOLDS) -> DataFrame:
    """Pairs of any setting with their folds: 1 raw pairs, 2 orphan proteins, 3 orphan molecules, 4 both."""
    if setting == 1:
        return setting1(inter, prots, mols, ratios, k)
    if setting in (2, 3):
        return by_entity(inter, prots, mols, "protein" if setting == 2 else "molecule", ratios, k)
    if setting == 4:
        return double_orphan(inter, prots, mols, ratios, k)
    raise ValueError(f"settings are 1 to 4, not {setting}")


def assign_folds(df: DataFrame, key: str, k: int, strategy: str = "random", by: list[str] | None = None, features: str | None = None, seed: int = 324) -> DataFrame:
    """``key`` and ``fold`` of a table of examples, by name of the strategy: ``random`` (in a hash order), ``stratified``
    (the same within the classes ``by``), or ``kmeans`` (clusters of the array column ``features`` as folds)."""
    if strategy == "random":
        return kfold(df, key, k, seed).select(key, "fold")
    if strategy == "stratified":
        return kfold(df, key, k, seed, by=by).select(key, "fold")
    if strategy == "kmeans":
        from dockyard.operators.learners import kmeans_folds

        return kmeans_folds(df, key, features, k, seed)
    raise ValueError(f"no strategy {strategy}")


def downsample(labels: DataFrame, cap: int = 10, seed: int = 92) -> DataFrame:
    """Per task, negatives beyond ``cap`` times the positives get a null label; no row is dropped."""
    h = labels.withColumn("_h", F.md5(F.concat_ws("-", F.col("id").cast("string"), "task", F.lit(str(seed)))))
    known, rest = h.where("y = 0"), h.where("y is null or y <> 0")
    n_pos = labels.where("y = 1").groupBy("task").agg(F.count("*").alias("_p"))
    ranked = global_rank(known, ["_h", "id"], F.substring("_h", 1, 2), "_rank", ["task"]).join(n_pos, "task", "left")
    over = F.col("_rank") >= cap * F.coalesce("_p", F.lit(0))
    capped = ranked.withColumn("y", F.when(~over, F.col("y")))
    return capped.select(labels.columns).unionByName(rest.select(labels.columns))


def overlap(split: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of disjointness: keys in more than one fold, as one row."""
    seen = split.groupBy(*keys).agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
    return seen.agg(F.count_if(F.col("a") != F.col("b")).alias("n_violations")).select(F.lit("fold_leak").alias("check_name"), "n_violations")


def batches(df: DataFrame, key: str, size: int, epoch: int = 0) -> DataFrame:
    """Shuffled order of an epoch cut into batches: ``position`` and ``batch``."""
    h = df.withColumn("_h", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(epoch)))))
    ranked = global_rank(h, ["_h", key], F.substring("_h", 1, 3), "position").drop("_h")
    return ranked.withColumn("batch", F.floor(F.col("position") / size))


def top_by(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def complement(inter: DataFrame, prot: DataFrame, mol: DataFrame, lot: int = 4096) -> DataFrame:
    """All pairs of a protein and a molecule that ``inter`` does not have; the pairs are never shuffled.

    Molecules are dealt to lots of about ``lot``; for each lot, a protein has the array of its molecules there, and its pairs with the rest of
    the lot are exploded where both meet. What is shuffled is a row for each protein and lot, and the lots for each part of the proteins.
    """
    own = kept(mol.groupBy("mol_id").agg(F.count("*").alias("times")))  # rows that repeat stay
    lots = max(1, -(-own.count() // lot))
    at = F.pmod(F.xxhash64("mol_id"), F.lit(lots)).cast("int").alias("lot")
    packed = own.select(at, "mol_id", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).groupBy("lot").agg(F.collect_list(F.struct("mol_id")).alias("m")).select("lot", F.col("m.mol_id").alias("mols"))
    met = inter.where("prot_id is not null").select("prot_id", at, "mol_id").groupBy("prot_id", "lot").agg(F.collect_set("mol_id").alias("known"))
    parts = F.pmod(F.xxhash64("prot_id"), F.lit(PARTS)).cast("int").alias("part")
    asked = prot.select("prot_id", parts, F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    each = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    beside = asked.join(met.hint("merge"), ["prot_id", "lot"], "left").join(each.hint("merge"), ["lot", "part"])
    rest = F.when(F.col("known").isNull(), F.col("mols")).otherwise(F.filter("mols", lambda m: ~F.coalesce(F.array_contains("known", m), F.lit(False))))
    return beside.select("prot_id", F.explode(rest).alias("mol_id"))
