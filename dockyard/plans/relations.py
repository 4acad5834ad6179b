"""Joins, complements, set operations and splits of the protein-molecule relation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from dockyard.operators import splits as S
from dockyard.operators.ranking import kfold
from dockyard.plans.registry import query
from dockyard.sources import tables as T

INTER, PROT = T.INTER, T.PROT


def _trio(spark, d):
    return T.interaction(spark, d), T.protein(spark, d).select("prot_id"), T.molecule(spark, d).select("mol_id")


@query("interaction_inner", f"WITH {INTER}, {PROT} SELECT prot_id, mol_id, species, p_name AS structure FROM inter JOIN prot USING (prot_id) JOIN part ON mol_id = p_partkey")
def interaction_inner(spark, d):
    return T.interaction(spark, d).join(T.protein(spark, d), "prot_id").join(T.molecule(spark, d), "mol_id").select("prot_id", "mol_id", "species", "structure")


@query("entity_semi", f"WITH {INTER} SELECT p_partkey AS mol_id FROM part WHERE p_partkey IN (SELECT mol_id FROM inter)")
def entity_semi(spark, d):
    return T.molecule(spark, d).join(T.interaction(spark, d), "mol_id", "left_semi").select("mol_id")


@query("variant_join", "SELECT e.event_id, c.c_mktsegment AS segment FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def variant_join(spark, d):
    e, c = T.table(spark, d, "events"), T.table(spark, d, "customer")
    return e.join(c, e["user_id"] == c["c_custkey"]).select("event_id", F.col("c_mktsegment").alias("segment"))


@query("pair_features", f"WITH {INTER} SELECT prot_id, mol_id, s_acctbal AS prot_fea, p_retailprice AS mol_fea FROM inter LEFT JOIN supplier ON prot_id = s_suppkey LEFT JOIN part ON mol_id = p_partkey")
def pair_features(spark, d):
    prot = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("prot_id"), F.col("s_acctbal").alias("prot_fea"))
    mol = T.table(spark, d, "part").select(F.col("p_partkey").alias("mol_id"), F.col("p_retailprice").alias("mol_fea"))
    return T.interaction(spark, d).join(prot, "prot_id", "left").join(mol, "mol_id", "left").select("prot_id", "mol_id", "prot_fea", "mol_fea")


@query(
    "design_matrix",
    f"WITH {INTER} SELECT prot_id, mol_id, array_to_string([p_size::DOUBLE, p_retailprice, s_acctbal], ',') AS fea FROM inter JOIN part ON mol_id = p_partkey JOIN supplier ON prot_id = s_suppkey",
)
def design_matrix(spark, d):
    """Features of the molecule, then of the protein, in one row a pair."""
    mol = T.table(spark, d, "part").select(F.col("p_partkey").alias("mol_id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("mf"))
    prot = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("prot_id"), F.array("s_acctbal").alias("pf"))
    both = T.interaction(spark, d).join(mol, "mol_id").join(prot, "prot_id")
    return both.select("prot_id", "mol_id", F.array_join(F.concat("mf", "pf").cast("array<string>"), ",").alias("fea"))


@query("negatives_complement", f"WITH {INTER} SELECT s_suppkey AS prot_id, p_partkey AS mol_id FROM supplier CROSS JOIN part ANTI JOIN inter ON prot_id = s_suppkey AND mol_id = p_partkey")
def negatives_complement(spark, d):
    """All pairs that don't interact: the result itself has a row for nearly every pair, so a cross join is its size.

    Molecules come in lots; a protein meets a lot beside the molecules of that lot that it interacts with, so the pairs are
    made where they are written and never shuffled. Sampling never goes this way; see ``splits.draws``.
    """
    inter, prot, mol = _trio(spark, d)
    return S.complement(inter, prot, mol)


@query("negatives_degree", f"WITH {INTER} SELECT s_suppkey AS prot_id, (SELECT count(*) FROM part) - count(mol_id) AS n_negatives FROM supplier LEFT JOIN inter ON prot_id = s_suppkey GROUP BY s_suppkey")
def negatives_degree(spark, d):
    """How many molecules each protein doesn't interact with, without forming the pairs."""
    inter, prot, mol = _trio(spark, d)
    n = mol.agg(F.count("*").alias("n_mol"))
    return prot.join(inter.groupBy("prot_id").agg(F.count("*").alias("k")), "prot_id", "left").join(F.broadcast(n)).select(
        "prot_id", (F.col("n_mol") - F.coalesce("k", F.lit(0))).alias("n_negatives")
    )


KF = "(row_number() OVER (ORDER BY md5(concat_ws('-', {k}, '324')), {k}) - 1) % 5"


@query("kfold", f"SELECT s_suppkey AS prot_id, ({KF.format(k='s_suppkey')})::INT AS fold FROM supplier")
def kfold_query(spark, d):
    return kfold(T.protein(spark, d).select("prot_id"), "prot_id", 5)


@query("kfold_stratified", "SELECT vec_id, ((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('-', vec_id, '324')), vec_id) - 1) % 5)::INT AS fold FROM embeddings")
def kfold_stratified(spark, d):
    return kfold(T.table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 5, by=["label"]).select("vec_id", "fold")


@query(
    "fold_relabel",
    f"WITH k AS (SELECT s_suppkey AS prot_id, {KF.format(k='s_suppkey')} AS fold FROM supplier), m AS (SELECT fold, dense_rank() OVER (ORDER BY min(prot_id)) - 1 AS new_fold FROM k GROUP BY fold) SELECT prot_id, new_fold::INT AS fold FROM k JOIN m USING (fold)",
)
def fold_relabel(spark, d):
    folds = kfold(T.protein(spark, d).select("prot_id"), "prot_id", 5)
    first = folds.groupBy("fold").agg(F.min("prot_id").alias("at"))  # one row a fold
    names = first.withColumn("new_fold", (F.dense_rank().over(Window.orderBy("at")) - 1).cast("int")).drop("at")
    return folds.join(F.broadcast(names), "fold").select("prot_id", F.col("new_fold").alias("fold"))


PFOLD = f"pf AS (SELECT s_suppkey AS prot_id, ({KF.format(k='s_suppkey')})::INT AS fold FROM supplier)"
MFOLD = f"mf AS (SELECT p_partkey AS mol_id, ({KF.format(k='p_partkey')})::INT AS fold FROM part)"


@query("fold_semi", f"WITH {INTER}, {PFOLD} SELECT prot_id, mol_id FROM inter SEMI JOIN (SELECT prot_id FROM pf WHERE fold = 2) USING (prot_id)")
def fold_semi(spark, d):
    inter, prot, _ = _trio(spark, d)
    return inter.join(kfold(prot, "prot_id", 5).where("fold = 2"), "prot_id", "left_semi").select("prot_id", "mol_id")


@query("double_orphan_train", f"WITH {INTER}, {PFOLD}, {MFOLD} SELECT prot_id, mol_id FROM inter JOIN pf USING (prot_id) JOIN mf USING (mol_id) WHERE pf.fold NOT IN (0, 1) AND mf.fold NOT IN (0, 1)")
def double_orphan_train(spark, d):
    inter, prot, mol = _trio(spark, d)
    out_p, out_m = kfold(prot, "prot_id", 5).where("fold in (0, 1)"), kfold(mol, "mol_id", 5).where("fold in (0, 1)")
    return inter.join(out_p, "prot_id", "left_anti").join(out_m, "mol_id", "left_anti").select("prot_id", "mol_id")


@query(
    "fold_pairs_theta",
    f"WITH {INTER}, {PFOLD}, {MFOLD}, g AS (SELECT pf.fold AS p, mf.fold AS m, count(*) AS n FROM inter JOIN pf USING (prot_id) JOIN mf USING (mol_id) GROUP BY ALL) SELECT t.p AS tp, t.m AS tm, v.p AS vp, v.m AS vm, t.n AS n_test, v.n AS n_val FROM g t JOIN g v ON t.p <> v.p AND t.m <> v.m",
)
def fold_pairs_theta(spark, d):
    """Of the cells of the relation's grid of folds: each test cell with the validation cells that differ in both, and their pairs."""
    inter, prot, mol = _trio(spark, d)
    p, m = kfold(prot, "prot_id", 5).withColumnRenamed("fold", "p"), kfold(mol, "mol_id", 5).withColumnRenamed("fold", "m")
    cell = inter.join(p, "prot_id").join(m, "mol_id").groupBy("p", "m").agg(F.count("*").alias("n"))  # 25 rows at most
    t, v = cell.toDF("tp", "tm", "n_test"), cell.toDF("vp", "vm", "n_val")
    return t.join(v, (F.col("tp") != F.col("vp")) & (F.col("tm") != F.col("vm")))


@query("merge_override", "SELECT coalesce(b.c_custkey, a.s_suppkey) AS id, coalesce(b.c_acctbal, a.s_acctbal) AS balance FROM supplier a FULL JOIN customer b ON a.s_suppkey = b.c_custkey")
def merge_override(spark, d):
    """Right wins where both have the key."""
    a = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("l"))
    b = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("r"))
    return a.join(b, "id", "full").select("id", F.coalesce("r", "l").alias("balance"))


@query(
    "transfer_split",
    f"WITH {INTER}, {PFOLD}, b AS (SELECT DISTINCT l_suppkey AS prot_id, l_partkey AS mol_id FROM lineitem WHERE l_quantity <= 1) SELECT 'train' AS part, 'a' AS corpus, prot_id, mol_id FROM inter UNION ALL SELECT CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END, 'b', prot_id, mol_id FROM b JOIN pf USING (prot_id)",
)
def transfer_split(spark, d):
    """Train on all of corpus a and the train folds of b; validate and test on folds of b."""
    inter, prot, _ = _trio(spark, d)
    b = T.table(spark, d, "lineitem").where("l_quantity <= 1").select(F.col("l_suppkey").alias("prot_id"), F.col("l_partkey").alias("mol_id")).distinct()
    part = F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train")
    own = b.join(kfold(prot, "prot_id", 5), "prot_id").select(part.alias("part"), F.lit("b").alias("corpus"), "prot_id", "mol_id")
    return inter.select(F.lit("train").alias("part"), F.lit("a").alias("corpus"), "prot_id", "mol_id").unionByName(own)


@query("labelled_pairs", f"WITH {INTER}, n AS (SELECT DISTINCT l_suppkey AS prot_id, l_partkey AS mol_id FROM lineitem WHERE l_quantity <= 1) SELECT prot_id, mol_id, 1 AS y FROM inter UNION ALL SELECT prot_id, mol_id, 0 FROM n ANTI JOIN inter USING (prot_id, mol_id)")
def labelled_pairs(spark, d):
    inter = T.interaction(spark, d)
    n = T.table(spark, d, "lineitem").where("l_quantity <= 1").select(F.col("l_suppkey").alias("prot_id"), F.col("l_partkey").alias("mol_id")).distinct()
    return inter.withColumn("y", F.lit(1)).unionByName(n.join(inter, ["prot_id", "mol_id"], "left_anti").withColumn("y", F.lit(0)))


@query(
    "block_diagonal",
    f"WITH {INTER}, b AS (SELECT DISTINCT l_suppkey AS prot_id, l_partkey AS mol_id FROM lineitem WHERE l_quantity <= 1) SELECT prot_id AS i, mol_id AS j FROM inter UNION ALL SELECT prot_id + (SELECT max(s_suppkey) + 1 FROM supplier), mol_id + (SELECT max(p_partkey) + 1 FROM part) FROM b",
)
def block_diagonal(spark, d):
    """Two relations side by side: the second one's indices come after the first one's."""
    b = T.table(spark, d, "lineitem").where("l_quantity <= 1").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).distinct()
    top = T.table(spark, d, "supplier").agg((F.max("s_suppkey") + 1).alias("pi")).join(T.table(spark, d, "part").agg((F.max("p_partkey") + 1).alias("pj")))
    moved = b.join(F.broadcast(top)).select((F.col("i") + F.col("pi")).alias("i"), (F.col("j") + F.col("pj")).alias("j"))
    return T.interaction(spark, d).toDF("i", "j").unionByName(moved)


@query("fold_intersect", f"WITH {INTER}, {PFOLD} SELECT mol_id FROM inter JOIN pf USING (prot_id) WHERE fold = 0 INTERSECT SELECT mol_id FROM inter JOIN pf USING (prot_id) WHERE fold = 1")
def fold_intersect(spark, d):
    inter, prot, _ = _trio(spark, d)
    met = inter.join(kfold(prot, "prot_id", 5), "prot_id")
    return met.where("fold = 0").select("mol_id").intersect(met.where("fold = 1").select("mol_id"))


# Negatives by hashed draws, stated in SQL: draw t of a group names a protein and a molecule of the group.
NUMBERS = """pn AS (SELECT s_suppkey AS prot_id, row_number() OVER (ORDER BY md5(concat_ws('-', s_suppkey, '324')), s_suppkey) - 1 AS rp FROM supplier),
mn AS (SELECT p_partkey AS mol_id, row_number() OVER (ORDER BY md5(concat_ws('-', p_partkey, '324')), p_partkey) - 1 AS rm FROM part)"""


def _draws(kp: int, km: int) -> str:
    """``ip``: numbered pairs of the relation; ``gs``: groups; ``ng``: negatives of each group by position; ``hv``: how many."""
    return f"""{INTER}, {NUMBERS}, pf AS (SELECT prot_id, (rp % {kp})::INT AS pf, rp // {kp} AS pi FROM pn), mf AS (SELECT mol_id, (rm % {km})::INT AS mf, rm // {km} AS mi FROM mn),
ip AS (SELECT prot_id, mol_id, pf, mf, pf * {km} + mf AS g, pi, mi FROM inter JOIN pf USING (prot_id) JOIN mf USING (mol_id)),
sz_p AS (SELECT pf, count(*) AS n_p FROM pf GROUP BY pf), sz_m AS (SELECT mf, count(*) AS n_m FROM mf GROUP BY mf),
gs AS (SELECT g, pf, mf, count(*) AS n, any_value(n_p) AS n_p, any_value(n_m) AS n_m, any_value(n_p * n_m) AS cells FROM ip JOIN sz_p USING (pf) JOIN sz_m USING (mf) GROUP BY g, pf, mf),
gw AS (SELECT *, 10 * n + 6 * floor(sqrt(10 * n))::BIGINT + 10 AS w, cells - n AS free FROM gs),
gd AS (SELECT *, 2 * w > free AS listed, CASE WHEN 2 * w > free THEN cells ELSE (w::HUGEINT * cells * (free + w) // free // free + 1)::BIGINT END AS d FROM gw),
t AS (SELECT g, n_p, n_m, listed, t, md5(g || '-' || t) AS h FROM (SELECT *, unnest(range(d)) AS t FROM gd)),
x AS (SELECT *, ('0x' || substr(h, 1, 15))::BIGINT AS a, ('0x' || substr(h, 17, 15))::BIGINT AS b FROM t),
dr AS (SELECT g, CASE WHEN listed THEN t // n_m ELSE a % n_p END AS pi, CASE WHEN listed THEN t % n_m ELSE b % n_m END AS mi, min(CASE WHEN listed THEN a ELSE t END) AS o FROM x GROUP BY ALL),
fr AS (SELECT * FROM dr ANTI JOIN ip USING (g, pi, mi)), rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o, pi, mi) - 1 AS pos FROM fr),
ng AS (SELECT p.prot_id, m.mol_id, gs.pf, gs.mf, g, pos, n FROM rk JOIN gs USING (g) JOIN pf p ON p.pf = gs.pf AND p.pi = rk.pi JOIN mf m ON m.mf = gs.mf AND m.mi = rk.mi WHERE pos < 10 * n),
hv AS (SELECT g, n, coalesce(least(have, 10 * n), 0) AS have FROM gs LEFT JOIN (SELECT g, count(*) AS have FROM fr GROUP BY g) USING (g))"""


DRAW = f"""{_draws(1, 1)}, np AS (SELECT count(*) AS n FROM inter),
ps AS (SELECT prot_id, mol_id, ((row_number() OVER (ORDER BY md5(concat_ws('-', prot_id, mol_id, '324')), concat_ws('-', prot_id, mol_id)) - 1) % 5)::INT AS fold FROM inter)"""
#: Counts per ratio: 10 n, round(5 / 10 * that), and so on, half to even.
SIZES = """sz(ratio, size) AS (SELECT 10, 10 * n FROM np UNION ALL SELECT 5, round_even(0.5 * 10 * n, 0)::BIGINT FROM np
  UNION ALL SELECT 2, round_even(0.4 * round_even(0.5 * 10 * n, 0), 0)::BIGINT FROM np
  UNION ALL SELECT 1, round_even(0.5 * round_even(0.4 * round_even(0.5 * 10 * n, 0), 0), 0)::BIGINT FROM np)"""
CV1 = f"""{DRAW}, {SIZES}, cv AS (SELECT prot_id, mol_id, 1 AS y, ratio, fold FROM ps, sz UNION ALL
  SELECT prot_id, mol_id, 0, ratio, (pos % 5)::INT FROM ng, sz WHERE (ratio = 10 OR pos // 5 < round_even(size / 5.0, 0)))"""


@query("cv_setting1", f"WITH {CV1} SELECT * FROM cv")
def cv_setting1(spark, d):
    return S.setting1(*_trio(spark, d)).select("prot_id", "mol_id", "y", "ratio", "fold")


@query("cv_fold_counts", f"WITH {CV1} SELECT ratio, fold, y, count(*) AS n FROM cv GROUP BY ALL")
def cv_fold_counts(spark, d):
    """The flagship: relation, complement, folds with nested negatives, and their balance."""
    return S.setting1(*_trio(spark, d)).groupBy("ratio", "fold", "y").agg(F.count("*").alias("n"))


@query("negative_sample", f"WITH {CV1} SELECT prot_id, mol_id, fold FROM cv WHERE y = 0 AND ratio = 1")
def negative_sample(spark, d):
    return S.setting1(*_trio(spark, d), only=1).where("y = 0").select("prot_id", "mol_id", "fold")


def _grouped(kp: int, km: int) -> str:
    return f"""{_draws(kp, km)}, rt(ratio) AS (VALUES (10), (5), (2), (1)),
  cv AS (SELECT prot_id, mol_id, y, pf, mf, ratio, greatest(0, ratio * n - have)::BIGINT AS missing
    FROM (SELECT prot_id, mol_id, 1 AS y, pf, mf, g, -1 AS pos FROM ip UNION ALL SELECT prot_id, mol_id, 0, pf, mf, g, pos FROM ng) JOIN hv USING (g), rt WHERE pos < ratio * n)"""


@query("cv_setting2", f"WITH {_grouped(5, 1)} SELECT prot_id, mol_id, y, pf AS fold, ratio, missing FROM cv")
def cv_setting2(spark, d):
    return S.by_entity(*_trio(spark, d), "protein")


@query("cv_setting3", f"WITH {_grouped(1, 5)} SELECT prot_id, mol_id, y, mf AS fold, ratio, missing FROM cv")
def cv_setting3(spark, d):
    return S.by_entity(*_trio(spark, d), "molecule")


CV4 = f"{_grouped(5, 5)}, g4 AS (SELECT * FROM cv)"


@query("cv_setting4", f"WITH {CV4} SELECT * FROM g4")
def cv_setting4(spark, d):
    return S.make_split(4, *_trio(spark, d))


@query(
    "cv_setting4_block",
    f"WITH {CV4} SELECT prot_id, mol_id, y, ratio, CASE WHEN pf = 1 AND mf = 2 THEN 'test' WHEN pf = 3 AND mf = 0 THEN 'val' ELSE 'train' END AS part FROM g4 WHERE (pf = 1 AND mf = 2) OR (pf = 3 AND mf = 0) OR (pf NOT IN (1, 3) AND mf NOT IN (2, 0))",
)
def cv_setting4_block(spark, d):
    """One of the 400 splits: test block (1, 2), validation block (3, 0)."""
    return S.block(S.double_orphan(*_trio(spark, d)), 1, 2, 3, 0).select("prot_id", "mol_id", "y", "ratio", "part")


@query(
    "cv_setting4_counts",
    f"""WITH {CV4}, g AS (SELECT p, m FROM range(5) a(p), range(5) b(m)),
  s AS (SELECT t.p AS tp, t.m AS tm, v.p AS vp, v.m AS vm FROM g t JOIN g v ON t.p <> v.p AND t.m <> v.m),
  z AS (SELECT tp, tm, vp, vm, y, ratio, CASE WHEN pf = tp AND mf = tm THEN 'test' WHEN pf = vp AND mf = vm THEN 'val'
    WHEN pf NOT IN (tp, vp) AND mf NOT IN (tm, vm) THEN 'train' END AS part FROM s, g4)
  SELECT tp::INT AS tp, tm::INT AS tm, vp::INT AS vp, vm::INT AS vm, part, y, ratio, count(*) AS n FROM z WHERE part IS NOT NULL GROUP BY ALL""",
)
def cv_setting4_counts(spark, d):
    return S.block_counts(S.double_orphan(*_trio(spark, d)))


@query("fold_summary", f"WITH {T.LABEL}, f AS (SELECT doc_id AS id, ({KF.format(k='doc_id')})::INT AS fold FROM documents) SELECT fold, task, y, count(*) AS n FROM lab JOIN f USING (id) GROUP BY ALL")
def fold_summary(spark, d):
    folds = kfold(T.table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", 5)
    return T.label(spark, d).join(folds, "id").groupBy("fold", "task", "y").agg(F.count("*").alias("n"))


@query("fold_loader", f"WITH {CV1} SELECT CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS part, prot_id, mol_id, y FROM cv WHERE ratio = 5")
def fold_loader(spark, d):
    """Train on every fold but the test and validation ones; on partitioned tables this prunes partitions."""
    part = F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train")
    return S.setting1(*_trio(spark, d), only=5).select(part.alias("part"), "prot_id", "mol_id", "y")


@query("dq_fold_leak", f"WITH {CV1} SELECT 'fold_leak' AS check_name, count(*) AS n_violations FROM (SELECT 1 FROM cv GROUP BY prot_id, mol_id, ratio HAVING count(DISTINCT fold) > 1)")
def dq_fold_leak(spark, d):
    return S.overlap(S.setting1(*_trio(spark, d)), ["prot_id", "mol_id", "ratio"])


@query("dq_negatives_clean", f"WITH {CV1} SELECT 'negative_is_positive' AS check_name, count(*) AS n_violations FROM cv SEMI JOIN inter USING (prot_id, mol_id) WHERE y = 0")
def dq_negatives_clean(spark, d):
    inter, prot, mol = _trio(spark, d)
    bad = S.setting1(inter, prot, mol).where("y = 0").join(inter, ["prot_id", "mol_id"], "left_semi")
    return bad.agg(F.count("*").alias("n_violations")).select(F.lit("negative_is_positive").alias("check_name"), "n_violations")


@query(
    "downsample_labels",
    f"""WITH {T.LABEL}, r AS (SELECT id, task, y, row_number() OVER (PARTITION BY task, y ORDER BY md5(concat_ws('-', id, task, '92')), id) - 1 AS r FROM lab),
    p AS (SELECT task, count(*) AS p FROM lab WHERE y = 1 GROUP BY task) SELECT id, task, CASE WHEN y = 0 AND r >= 1 * coalesce(p, 0) THEN NULL ELSE y END AS y FROM r LEFT JOIN p USING (task)""",
)
def downsample_labels(spark, d):
    return S.downsample(T.label(spark, d).select("id", "task", "y"), cap=1)


EPOCH = "row_number() OVER (ORDER BY md5(concat_ws('-', prot_id, mol_id, '3')), concat_ws('-', prot_id, mol_id)) - 1"


@query("epoch_shuffle", f"WITH {INTER} SELECT prot_id, mol_id, {EPOCH} AS position FROM inter")
def epoch_shuffle(spark, d):
    pairs = T.interaction(spark, d).withColumn("key", F.concat_ws("-", "prot_id", "mol_id"))
    return S.batches(pairs, "key", 50, epoch=3).select("prot_id", "mol_id", "position")


@query("batch_index", f"WITH {INTER}, e AS (SELECT {EPOCH} AS position FROM inter) SELECT (position // 50)::BIGINT AS batch, count(*) AS n FROM e GROUP BY 1")
def batch_index(spark, d):
    pairs = T.interaction(spark, d).withColumn("key", F.concat_ws("-", "prot_id", "mol_id"))
    return S.batches(pairs, "key", 50, epoch=3).groupBy("batch").agg(F.count("*").alias("n"))
