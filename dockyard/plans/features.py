"""Features, kernels and encoders with fixed weights."""

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from dockyard.functions import descriptors as D
from dockyard.functions import encoders
from dockyard.functions import graphs as G
from dockyard.functions import kernels as K
from dockyard.operators import alignment
from dockyard.operators.lineage import shared_folder
from dockyard.operators.similarity import similarity_join
from dockyard.plans.registry import query
from dockyard.sources import tables as T

# Proteins as bags of molecule brands; nations as bags of customer segments: whole tables, small enough to square.
BAG = f"{T.INTER}, bag AS (SELECT prot_id AS id, p_brand AS item, count(*) AS n FROM inter JOIN part ON mol_id = p_partkey GROUP BY ALL)"
KP = f"""{BAG}, z AS (SELECT id, sum(n)::BIGINT AS s FROM bag GROUP BY id), o AS (SELECT a.id AS i, b.id AS j, sum(least(a.n, b.n))::BIGINT AS m FROM bag a JOIN bag b USING (item) WHERE a.id <= b.id GROUP BY ALL),
  kp AS (SELECT i, j, m / (p.s + q.s - m)::DOUBLE AS k FROM o JOIN z p ON p.id = i JOIN z q ON q.id = j)"""
NAT = """nb AS (SELECT c_nationkey AS id, c_mktsegment AS item, count(*) AS n FROM customer GROUP BY ALL), nz AS (SELECT id, sum(n)::BIGINT AS s FROM nb GROUP BY id),
  no AS (SELECT a.id AS i, b.id AS j, sum(least(a.n, b.n))::BIGINT AS m FROM nb a JOIN nb b USING (item) WHERE a.id <= b.id GROUP BY ALL),
  nh AS (SELECT i, j, m / (p.s + q.s - m)::DOUBLE AS k FROM no JOIN nz p ON p.id = i JOIN nz q ON q.id = j), nk AS (SELECT i, j, k FROM nh UNION ALL SELECT j, i, k FROM nh WHERE i <> j)"""


def _bag(spark, d):
    part = T.table(spark, d, "part").select(F.col("p_partkey").alias("mol_id"), F.col("p_brand").alias("item"))
    return T.interaction(spark, d).join(part, "mol_id").groupBy(F.col("prot_id").alias("id"), "item").agg(F.count("*").alias("n"))


def _nations(spark, d):
    bag = T.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("item")).agg(F.count("*").alias("n"))
    return K.mirrored(K.overlap_pairs(bag))


def _r(c="k", n=6):
    x = F.round(c, n) + 0.0
    return x.alias(c) if isinstance(c, str) else x


@query("tanimoto_counts", f"WITH {KP} SELECT i, j, round(k, 6) AS k FROM kp")
def tanimoto_counts(spark, d):
    return K.overlap_pairs(_bag(spark, d)).select("i", "j", _r())


@query("tanimoto_join", f"WITH {KP} SELECT i, j, round(k, 6) AS k FROM kp WHERE k >= 0.5")
def tanimoto_join(spark, d):
    """The cells of the same kernel from a half on, by prefixes of rare items."""
    return similarity_join(_bag(spark, d), 0.5).select("i", "j", _r())


@query("alignment_kernel")
def alignment_kernel(spark, d):
    """Local alignment scores of all pairs of benchmark texts, by blocks of rows of a table."""
    texts = T.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("seq"))
    return alignment.kernel_table(texts, f"{shared_folder(spark)}/{uuid.uuid4()}").select("i", "j", "k")


GRAMS = "gr AS (SELECT DISTINCT s, substr(s, i, 3) AS item FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM (SELECT DISTINCT p_name AS s FROM part)))"


def _grams(spark, d):
    names = T.molecule(spark, d).select(F.col("structure").alias("s")).distinct()
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("s") - 2, F.lit(1))))
    return names.select("s", at.alias("i")).select("s", F.col("s").substr(F.col("i"), F.lit(3)).alias("item")).where(F.length("item") == 3).distinct()


@query("tanimoto_pairs", f"WITH {GRAMS}, z AS (SELECT s, count(*) AS n FROM gr GROUP BY s), o AS (SELECT a.s AS i, b.s AS j, count(*) AS m FROM gr a JOIN gr b USING (item) WHERE a.s <= b.s GROUP BY ALL) SELECT i, j, round(m / (p.n + q.n - m)::DOUBLE, 6) AS k FROM o JOIN z p ON p.s = i JOIN z q ON q.s = j")
def tanimoto_pairs(spark, d):
    """Tanimoto kernel of the trigram sets of all different structures."""
    return K.overlap_pairs(_grams(spark, d).select(F.col("s").alias("id"), "item", F.lit(1).alias("n"))).select("i", "j", _r())


@query("fingerprint_bits", f"WITH {GRAMS} SELECT DISTINCT s, (('0x' || substr(md5(item), 1, 8))::BIGINT % 1024)::INT AS bit FROM gr")
def fingerprint_bits(spark, d):
    """1024 bits of hashed trigrams, as the set bits."""
    bit = (F.conv(F.substring(F.md5("item"), 1, 8), 16, 10).cast("long") % 1024).cast("int")
    return _grams(spark, d).select("s", bit.alias("bit")).distinct()


@query(
    "spectrum_kernel",
    """WITH b AS (SELECT item_id AS id, substr(text, i, 3) AS item, count(*) AS n FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM benchmark) GROUP BY ALL),
    z AS (SELECT id, sqrt(sum(n * n)) AS s FROM b GROUP BY id) SELECT x.id AS i, y.id AS j, round(sum(x.n * y.n) / any_value(p.s) / any_value(q.s), 6) AS k
    FROM b x JOIN b y USING (item) JOIN z p ON p.id = x.id JOIN z q ON q.id = y.id WHERE x.id <= y.id GROUP BY ALL""",
)
def spectrum_kernel(spark, d):
    """Cosine of the counts of 3-mers."""
    t = T.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - 2, F.lit(1)))).alias("at"))
    bag = t.select("id", F.col("text").substr(F.col("at"), F.lit(3)).alias("item")).where(F.length("item") == 3).groupBy("id", "item").agg(F.count("*").alias("n"))
    size = bag.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("s"))
    sized = bag.join(size, "id")
    a, b = sized.toDF("i", "item", "x", "p"), sized.toDF("j", "item", "y", "q")
    both = a.join(b, "item").where("i <= j").groupBy("i", "j", "p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("m"))
    return both.select("i", "j", F.round(F.col("m") / F.col("p") / F.col("q"), 6).alias("k"))


@query("kernel_center", f"WITH {NAT}, c AS (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k FROM nk) SELECT i, j, round(k, 6) + 0.0::DOUBLE AS k FROM c")
def kernel_center(spark, d):
    return K.centred(_nations(spark, d)).select("i", "j", _r())


@query(
    "kernel_normalise",
    f"WITH {NAT}, c AS (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k FROM nk) SELECT c.i, c.j, round(c.k / sqrt(a.k * b.k), 6) + 0.0::DOUBLE AS k FROM c JOIN c a ON a.i = c.i AND a.j = c.i JOIN c b ON b.i = c.j AND b.j = c.j",
)
def kernel_normalise(spark, d):
    return K.normalised(K.centred(_nations(spark, d))).select("i", "j", _r())


@query("kernel_slice", f"WITH {KP} SELECT i, j, round(k, 6) AS k FROM kp WHERE i % 2 = 0 AND j % 2 = 1")
def kernel_slice(spark, d):
    """Rows of one set of entities, columns of another (here: even against odd ids)."""
    bag = _bag(spark, d)  # the two sides are cut out before they meet
    return K.overlap_between(bag.where("id % 2 = 0"), bag.where("id % 2 = 1")).where("i < j").select("i", "j", _r())


PAIRS = "pr AS (SELECT DISTINCT c_nationkey AS p, n_regionkey AS m FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("pair_kernel", f"WITH {NAT}, {PAIRS} SELECT a.p * 10 + a.m AS i, b.p * 10 + b.m AS j, round(x.k * CASE WHEN a.m = b.m THEN 1.0 ELSE 0.5 END, 6)::DOUBLE AS k FROM pr a JOIN pr b ON a.p * 10 + a.m <= b.p * 10 + b.m JOIN nk x ON x.i = a.p AND x.j = b.p")
def pair_kernel(spark, d):
    """Product of a nation kernel and a region kernel (1 for equal regions, else a half)."""
    nation = T.table(spark, d, "nation")
    own = T.table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct().join(nation, "n_nationkey")
    pairs = own.select((F.col("n_nationkey") * 10 + F.col("n_regionkey")).alias("pair"), F.col("n_nationkey").alias("p"), F.col("n_regionkey").alias("m"))
    five = T.table(spark, d, "region").select(F.col("r_regionkey").alias("i"))
    region = five.crossJoin(five.toDF("j")).withColumn("k", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.5))  # 5 x 5
    return K.pair_kernel(pairs, _nations(spark, d), region).select("i", "j", _r())


TOP = f"{NAT}, nn AS (SELECT i, j, k, row_number() OVER (PARTITION BY i ORDER BY k DESC, j)::INT AS rank FROM nk WHERE i <> j), tp AS (SELECT * FROM nn WHERE rank <= 3)"


@query("knn_topk", f"WITH {TOP} SELECT i, j, rank, round(k, 6) AS k FROM tp")
def knn_topk(spark, d):
    return K.nearest(_nations(spark, d), 3).select("i", "j", "rank", _r())


@query("knn_impute", f"WITH {TOP}, b AS (SELECT c_nationkey AS j, avg(c_acctbal) AS v FROM customer GROUP BY 1) SELECT i, round(coalesce(sum(k * v) / sum(k), 0.5), 4) AS v FROM tp JOIN b USING (j) GROUP BY i")
def knn_impute(spark, d):
    """An unknown entity's value is the similarity-weighted mean over its nearest known ones; 0.5 where there is none."""
    known = T.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("j")).agg(F.avg("c_acctbal").alias("v"))
    mean = F.sum(F.col("k") * F.col("v")) / F.sum("k")
    return K.nearest(_nations(spark, d), 3).join(known, "j").groupBy("i").agg(F.round(F.coalesce(mean, F.lit(0.5)), 4).alias("v"))


@query(
    "graph_laplacian",
    f"WITH {TOP}, b AS (SELECT i, j, k FROM tp UNION ALL SELECT j, i, k FROM tp) SELECT i, j, round(-sum(k) / 2, 6) AS l FROM b GROUP BY i, j UNION ALL SELECT i, i, round(sum(k) / 2, 6) FROM b GROUP BY i",
)
def graph_laplacian(spark, d):
    return K.laplacian(K.nearest(_nations(spark, d), 3)).select("i", "j", _r("l"))


@query("aa_composition", "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS code FROM documents) , g AS (SELECT doc_id, code, count(*) AS n FROM c WHERE code BETWEEN 'a' AND 'z' GROUP BY ALL) SELECT doc_id, code, round(n / (sum(n) OVER (PARTITION BY doc_id))::DOUBLE, 8) AS share FROM g")
def aa_composition(spark, d):
    codes = T.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("code")).where(F.col("code").between("a", "z"))
    counts = codes.groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    return counts.select("doc_id", "code", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")), 8).alias("share"))


@query("dipeptide_composition", "WITH c AS (SELECT item_id, substr(text, unnest(range(1, greatest(length(text), 2)))::INT, 2) AS code FROM benchmark) , g AS (SELECT item_id, code, count(*) AS n FROM c GROUP BY ALL) SELECT item_id, code, round(n / (sum(n) OVER (PARTITION BY item_id))::DOUBLE, 8) AS share FROM g")
def dipeptide_composition(spark, d):
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))))
    codes = T.table(spark, d, "benchmark").select("item_id", "text", at.alias("i")).select("item_id", F.col("text").substr(F.col("i"), F.lit(2)).alias("code"))
    counts = codes.groupBy("item_id", "code").agg(F.count("*").alias("n"))
    return counts.select("item_id", "code", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("item_id")), 8).alias("share"))


# Residues by the classes of conjoint triads, and by hydrophobicity (polar, neutral, hydrophobic).
TRIADS = ("AGVILFPYMTSHNQWRKDEC", "11122223333444455667")
HYDRO = ("RKEDQNGASTPHYCLVIMFW", "11111122222223333333")


def _classes(spark, d, classes):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return T.table(spark, d, "benchmark").select("item_id", F.regexp_replace(F.translate(letters, *classes), "[A-Z]", "").alias("s"))


def _class_sql(classes) -> str:
    return f"c AS (SELECT item_id, regexp_replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{classes[0]}', '{classes[1]}'), '[A-Z]', '', 'g') AS s FROM benchmark)"


def _shares(spark, d, classes, width):
    """Shares of the runs of ``width`` classes in a sequence."""
    long = _classes(spark, d, classes).where(F.length("s") >= width)
    codes = long.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - (width - 1)), lambda i: F.col("s").substr(i, F.lit(width)))).alias("code"))
    return codes.groupBy("item_id", "code").agg(F.count("*").alias("n"))


def _run_sql(classes, width) -> str:
    return f"WITH {_class_sql(classes)}, r AS (SELECT item_id, substr(s, unnest(range(1, length(s) - {width - 2}))::INT, {width}) AS code FROM c WHERE length(s) >= {width}), g AS (SELECT item_id, code, count(*) AS n FROM r GROUP BY ALL)"


@query("conjoint_triad", _run_sql(TRIADS, 3) + " SELECT item_id, code, n, round((n - CASE WHEN count(*) OVER w < 343 THEN 0 ELSE min(n) OVER w END) / (max(n) OVER w)::DOUBLE, 8) AS scaled FROM g WINDOW w AS (PARTITION BY item_id)")
def conjoint_triad(spark, d):
    """Counts of the 343 triads of residue classes, scaled by the least (0 where one is absent) and the largest one of the sequence."""
    own = Window.partitionBy("item_id")  # at most 343 rows
    least = F.when(F.count("*").over(own) < 343, 0).otherwise(F.min("n").over(own))
    return _shares(spark, d, TRIADS, 3).select("item_id", "code", "n", F.round((F.col("n") - least) / F.max("n").over(own), 8).alias("scaled"))


@query("ctd_composition", _run_sql(HYDRO, 1) + " SELECT item_id, code, round(n / (sum(n) OVER (PARTITION BY item_id))::DOUBLE, 8) AS share FROM g")
def ctd_composition(spark, d):
    return _shares(spark, d, HYDRO, 1).select("item_id", "code", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("item_id")), 8).alias("share"))


@query(
    "ctd_transition",
    _run_sql(HYDRO, 2)
    + ", t AS (SELECT item_id, least(code[1], code[2]) || greatest(code[1], code[2]) AS pair, n, sum(n) OVER (PARTITION BY item_id) AS total FROM g) SELECT item_id, pair, round(sum(n) / (any_value(total))::DOUBLE, 8) AS share FROM t WHERE pair[1] <> pair[2] GROUP BY item_id, pair",
)
def ctd_transition(spark, d):
    """Shares of neighbours of unlike classes, whichever comes first."""
    n = _shares(spark, d, HYDRO, 2).withColumn("total", F.sum("n").over(Window.partitionBy("item_id")))
    a, b = F.substring("code", 1, 1), F.substring("code", 2, 1)
    unlike = n.where(a != b).withColumn("pair", F.concat(F.least(a, b), F.greatest(a, b)))
    return unlike.groupBy("item_id", "pair").agg(F.round(F.sum("n") / F.first("total"), 8).alias("share"))


@query(
    "ctd_distribution",
    f"""WITH {_class_sql(HYDRO)}, p AS (SELECT item_id, length(s) AS size, unnest(range(1, length(s) + 1)) AS pos, s FROM c WHERE length(s) > 0), r AS (SELECT item_id, size, s[pos] AS code, pos, row_number() OVER (PARTITION BY item_id, s[pos] ORDER BY pos) AS k, count(*) OVER (PARTITION BY item_id, s[pos]) AS n FROM p)
    SELECT item_id, code, q, round(100 * min(pos) / (any_value(size))::DOUBLE, 6) AS at FROM r, (VALUES (0), (25), (50), (75), (100)) t(q) WHERE k >= greatest(1, ceil(n * q / 100.0)) GROUP BY item_id, code, q""",
)
def ctd_distribution(spark, d):
    """Where in a sequence, in per cent, the first, the 25th, 50th, 75th and 100th per cent of a class's residues lie."""
    own = Window.partitionBy("item_id", "code")
    s = _classes(spark, d, HYDRO).where(F.length("s") > 0)
    p = s.select("item_id", F.length("s").alias("size"), F.posexplode(F.split("s", "")).alias("pos", "code")).withColumn("pos", F.col("pos") + 1)
    r = p.withColumn("k", F.row_number().over(own.orderBy("pos"))).withColumn("n", F.count("*").over(own))
    met = r.withColumn("q", F.explode(F.array(*map(F.lit, (0, 25, 50, 75, 100))))).where(F.col("k") >= F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("q") / 100)))
    return met.groupBy("item_id", "code", "q").agg(F.round(100 * F.min("pos") / F.first("size"), 6).alias("at"))


def _listed(v) -> str:
    return "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]"


SEQUENCES = f"""s AS (SELECT item_id, list_filter(string_split(translate(text, '{D.RESIDUES.lower()}', '{D.RESIDUES}'), ''), lambda c: c <> '' AND contains('{D.RESIDUES}', c)) AS r FROM benchmark),
  v AS (SELECT item_id, r, len(r) AS n, {', '.join(f"list_transform(r, lambda c: {_listed(t)}[instr('{D.RESIDUES}', c)]) AS p{k}" for k, t in enumerate(D.PROPERTIES.values()))} FROM s),
  l AS (SELECT *, unnest(range(1, 31)) AS d FROM v)"""


def _lag_sql(f: str, a: str = "p0", n: str = "n - d") -> str:
    return f"list_sum(list_transform(range(1, {n} + 1), lambda i: {f.replace('A', f'{a}[i]').replace('B', f'{a}[i + d]')}))"


@query(
    "autocorrelations",
    f"""WITH {SEQUENCES}, m AS (SELECT *, list_sum(p0) / n AS m FROM l WHERE n > d), q AS (SELECT *, list_transform(p0, lambda x: x - m) AS c FROM m),
    w AS (SELECT *, list_sum(list_transform(c, lambda x: x * x)) AS v FROM q)
    SELECT item_id, d::INT AS lag, round({_lag_sql('A * B')} / (n - d), 6) + 0.0::DOUBLE AS moreau_broto, round({_lag_sql('A * B', 'c')} / (n - d) / (v / n), 6) + 0.0::DOUBLE AS moran,
      round({_lag_sql('(A - B) * (A - B)')} / (2 * (n - d)) / (v / (n - 1)), 6) + 0.0::DOUBLE AS geary FROM w""",
)
def autocorrelations(spark, d):
    """Three autocorrelations of hydropathy at lags 1 to 30."""
    found = D.autocorrelations(T.table(spark, d, "benchmark"), "item_id", "text")
    return found.select("item_id", "lag", *[_r(c) for c in ("moreau_broto", "moran", "geary")])


@query(
    "pseudo_composition",
    f"""WITH {SEQUENCES}, t AS (SELECT item_id, d, ({' + '.join(_lag_sql('(A - B) * (A - B)', f'p{k}') for k in range(3))}) / 3 / (n - d) AS theta FROM l WHERE n > 10 AND d <= 10),
    z AS (SELECT item_id, list(theta ORDER BY d) AS th, 1 + 0.05::DOUBLE * sum(theta) AS s FROM t GROUP BY item_id),
    f AS (SELECT item_id, list_transform(string_split('{D.RESIDUES}', ''), lambda x: len(list_filter(r, lambda c: c = x)) / n::DOUBLE) AS f FROM v),
    x AS (SELECT item_id, list_transform(f, lambda v: v / s) || list_transform(th, lambda v: v * 0.05::DOUBLE / s) AS x FROM z JOIN f USING (item_id))
    SELECT item_id, unnest(range(len(x)))::INT AS at, round(unnest(x), 6) + 0.0::DOUBLE AS share FROM x""",
)
def pseudo_composition(spark, d):
    """Shares of the residues and of ten order numbers."""
    found = D.pseudo_composition(T.table(spark, d, "benchmark"), "item_id", "text")
    return found.select("item_id", F.posexplode("x").alias("at", "share")).select("item_id", "at", _r("share"))


@query(
    "order_coupling",
    f"""WITH {SEQUENCES} SELECT item_id, d::INT AS lag, round({' + '.join(_lag_sql('(A - B) * (A - B)', f'p{k}') for k in range(3))}, 4) AS coupling,
    round({_lag_sql('A * B', 'p0')} / (n - d), 6) + 0.0::DOUBLE AS hydropathy, round({_lag_sql('A * B', 'p1')} / (n - d), 6) + 0.0::DOUBLE AS hydrophilicity FROM l WHERE n > d""",
)
def order_coupling(spark, d):
    found = D.order_numbers(T.table(spark, d, "benchmark"), "item_id", "text")
    return found.select("item_id", "lag", _r("coupling", 4), _r("hydropathy"), _r("hydrophilicity"))


@query(
    "sequence_conv",
    """WITH s AS (SELECT conv_id, turn, length(text)::DOUBLE AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
    c AS (SELECT conv_id, pos, greatest(0, 0.25 * coalesce(lag(x) OVER w, 0) + 0.5 * x - 0.125 * coalesce(lead(x) OVER w, 0)) AS y FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
    SELECT conv_id, round(sum(y), 6) AS embedding FROM c WHERE pos % 2 = 0 GROUP BY conv_id""",
)
def sequence_conv(spark, d):
    """Width 3, stride 2, same padding, relu, then the sum over positions."""
    own = Window.partitionBy("conv_id")
    s = T.table(spark, d, "conversations").select("conv_id", F.length("text").cast("double").alias("x"), (F.row_number().over(own.orderBy("turn")) - 1).alias("pos"))
    order = own.orderBy("pos")
    y = 0.25 * F.lag("x", 1, 0.0).over(order) + 0.5 * F.col("x") - 0.125 * F.lead("x", 1, 0.0).over(order)
    c = s.withColumn("y", F.greatest(F.lit(0.0), y)).where("pos % 2 = 0")
    return c.groupBy("conv_id").agg(F.round(F.sum("y"), 6).alias("embedding"))


@query(
    "explained_variance_k",
    """WITH v AS (SELECT i, var_pop(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i),
    c AS (SELECT row_number() OVER w AS k, sum(v) OVER w / (SELECT sum(v) FROM v) AS r FROM v WINDOW w AS (ORDER BY v DESC, i)) SELECT min(k)::INT AS k FROM c WHERE r > 0.9""",
)
def explained_variance_k(spark, d):
    """How many axes, by falling variance, hold over 90 % of it. The window sees one row an axis."""
    axes = T.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    v = axes.groupBy("i").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    order = Window.orderBy(F.desc("v"), "i")
    running = v.select(F.row_number().over(order).alias("k"), F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.sum("v").over(Window.partitionBy()).alias("t"))
    return running.where(F.col("c") / F.col("t") > 0.9).agg(F.min("k").alias("k"))


# Nations as a graph: edges between nations of one region; the state is the mean balance in thousands.
GRAPH = """h AS (SELECT c_nationkey AS id, avg(c_acctbal) / 1000 AS h FROM customer GROUP BY 1),
  e AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, abs(a.n_nationkey - b.n_nationkey) / 10.0::DOUBLE AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)"""


def _graph(spark, d):
    nodes = T.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg((F.avg("c_acctbal") / 1000).alias("h"))
    n = T.table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), "n_regionkey"), n.select(F.col("n_nationkey").alias("j"), "n_regionkey")
    edges = a.join(b, "n_regionkey").where("i <> j").select("i", "j", (F.abs(F.col("i") - F.col("j")) / 10).alias("w"))
    return nodes, edges


def _step(source: str, own: float, other: float, bias: float, bond: float) -> str:
    return f"(SELECT id, greatest(0, h * {own} + coalesce(m, 0)) AS h FROM {source} LEFT JOIN (SELECT e.i, sum(x.h * {other} + e.w * {bond} + {bias}) AS m FROM e JOIN {source} x ON x.id = e.j GROUP BY e.i) ON i = id)"


@query("message_passing", f"WITH {GRAPH}, s1 AS {_step('h', 0.5, 0.25, -0.5, 0.0)}, s2 AS {_step('s1', 0.5, 0.25, -0.5, 0.0)} SELECT id, round(h, 6) AS h FROM s2")
def message_passing(spark, d):
    nodes, edges = _graph(spark, d)
    once = G.message_passing(nodes, edges, 0.5, 0.25, -0.5)
    return G.message_passing(once, edges, 0.5, 0.25, -0.5).select("id", _r("h"))


@query("message_passing_bond", f"WITH {GRAPH}, s1 AS {_step('h', 0.5, 0.25, 0.0, -0.3)} SELECT id, round(h, 6) AS h FROM s1")
def message_passing_bond(spark, d):
    nodes, edges = _graph(spark, d)
    return G.message_passing(nodes, edges, 0.5, 0.25, 0.0, -0.3).select("id", _r("h"))


@query(
    "graph_attention",
    f"""WITH {GRAPH}, v AS (SELECT id, h * 0.8 AS v FROM h), p AS (SELECT i, j FROM e UNION ALL SELECT id, id FROM h),
    l AS (SELECT i, b.v, CASE WHEN a.v * 0.3 - b.v * 0.6 >= 0 THEN a.v * 0.3 - b.v * 0.6 ELSE 0.2 * (a.v * 0.3 - b.v * 0.6) END AS x FROM p JOIN v a ON a.id = i JOIN v b ON b.id = j)
    SELECT i AS id, round(sum(exp(x) * v) / sum(exp(x)), 6) AS h FROM l GROUP BY i""",
)
def graph_attention(spark, d):
    nodes, edges = _graph(spark, d)
    return G.attention(nodes, edges, 0.8, 0.3, -0.6).select("id", _r("h"))


@query("graph_readout", f"WITH {GRAPH} SELECT n_regionkey AS g, round(sum(h), 6) AS sum_h, round(max(h), 6) AS max_h FROM h JOIN nation ON id = n_nationkey GROUP BY 1")
def graph_readout(spark, d):
    nodes, _ = _graph(spark, d)
    graph = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("g"))
    return G.readout(nodes, graph).select("g", _r("sum_h"), _r("max_h"))


@query("graph_combine", f"WITH {GRAPH}, s1 AS {_step('h', 0.5, 0.25, -0.5, 0.0)}, u AS (SELECT * FROM h UNION ALL SELECT * FROM s1) SELECT n_regionkey AS g, round(sum(h), 6) AS h FROM u JOIN nation ON id = n_nationkey GROUP BY 1")
def graph_combine(spark, d):
    """Readouts after every step, summed over the steps."""
    nodes, edges = _graph(spark, d)
    graph = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("g"))
    steps = G.readout(nodes, graph).unionByName(G.readout(G.message_passing(nodes, edges, 0.5, 0.25, -0.5), graph))
    return steps.groupBy("g").agg(F.sum("sum_h").alias("h")).select("g", _r("h"))


# Proteins and molecules as one graph of their interactions, with two numbers each; ids of molecules are negative.
BIPARTITE = f"""{T.INTER}, h AS (SELECT s_suppkey AS id, s_acctbal / 10000::DOUBLE AS x, 1.0::DOUBLE AS y FROM supplier UNION ALL SELECT -1 - p_partkey, p_size / 50::DOUBLE, p_retailprice / 2000::DOUBLE FROM part),
  e AS (SELECT prot_id AS i, -1 - mol_id AS j FROM inter UNION ALL SELECT -1 - mol_id, prot_id FROM inter)"""
#: Per head a 2 x 2 matrix, the vector for the node itself and that for its neighbours.
HEADS = ((((0.8, -0.3), (0.4, 0.6)), (0.5, -0.7), (0.2, 0.9)), (((-0.2, 0.7), (1.1, 0.1)), (-0.6, 0.3), (0.8, -0.4)))
OWN, OTHER = ((0.5137, -0.2219), (0.1043, 0.7171)), ((0.0513, 0.0229), (-0.0317, 0.0443))


def _bipartite(spark, d):
    one = F.lit(0).alias("g")
    prot = T.table(spark, d, "supplier").select(one, F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 10000, F.lit(1.0)).alias("h"))
    mol = T.table(spark, d, "part").select(one, (-1 - F.col("p_partkey")).alias("id"), F.array(F.col("p_size") / 50, F.col("p_retailprice") / 2000).alias("h"))
    inter = T.interaction(spark, d).select(one, F.col("prot_id").alias("i"), (-1 - F.col("mol_id")).alias("j"), F.lit(1.0).alias("a"))
    return prot.unionByName(mol), inter.unionByName(inter.select("g", F.col("j").alias("i"), F.col("i").alias("j"), "a"))


def _heads_sql() -> str:
    v = ", ".join(f"x * {w[0][k]} + y * {w[1][k]} AS v{n}{k}" for n, (w, _, _) in enumerate(HEADS) for k in (0, 1))
    e = ", ".join(f"a.v{n}0 * {s[0]} + a.v{n}1 * {s[1]} + b.v{n}0 * {t[0]} + b.v{n}1 * {t[1]} AS r{n}" for n, (_, s, t) in enumerate(HEADS))
    x = ", ".join(f"exp(CASE WHEN r{n} >= 0 THEN r{n} ELSE 0.2 * r{n} END) AS x{n}" for n in (0, 1))
    out = ", ".join(f"round(greatest(0, sum(x{n} * v{n}{k}) / sum(x{n})), 6) AS h{n}{k}" for n in (0, 1) for k in (0, 1))
    return f"""WITH {BIPARTITE}, v AS (SELECT id, {v} FROM h), p AS (SELECT i, j FROM e UNION ALL SELECT id, id FROM h),
  r AS (SELECT i, b.v00, b.v01, b.v10, b.v11, {e} FROM p JOIN v a ON a.id = i JOIN v b ON b.id = j), l AS (SELECT *, {x} FROM r) SELECT i AS id, {out} FROM l GROUP BY i"""


@query("attention_heads", _heads_sql())
def attention_heads(spark, d):
    """Two heads of graph attention on the relation's graph, one behind the other."""
    nodes, edges = _bipartite(spark, d)
    found = encoders.attention(nodes, edges, [tuple(map(np.array, head)) for head in HEADS])
    return found.select("id", *[_r(F.col("h")[2 * n + k]).alias(f"h{n}{k}") for n in (0, 1) for k in (0, 1)])


def _vectors_sql() -> str:
    own = [f"x * {OWN[0][k]} + y * {OWN[1][k]}" for k in (0, 1)]
    other = [f"sum(b.x * {OTHER[0][k]} + b.y * {OTHER[1][k]})" for k in (0, 1)]
    return f"""WITH {BIPARTITE}, m AS (SELECT i, {other[0]} AS m0, {other[1]} AS m1 FROM e JOIN h b ON b.id = j GROUP BY i)
  SELECT id, round(greatest(0, {own[0]} + coalesce(m0, 0)), 6) AS h0, round(greatest(0, {own[1]} + coalesce(m1, 0)), 6) AS h1 FROM h LEFT JOIN m ON i = id"""


@query("message_passing_vectors", _vectors_sql())
def message_passing_vectors(spark, d):
    nodes, edges = _bipartite(spark, d)
    found = encoders.message_passing(nodes, edges, np.array(OWN), np.array(OTHER))
    return found.select("id", *[_r(F.col("h")[k]).alias(f"h{k}") for k in (0, 1)])


@query("node_degree", f"WITH {T.INTER} SELECT mol_id, count(*) AS degree FROM inter GROUP BY mol_id")
def node_degree(spark, d):
    return T.interaction(spark, d).groupBy("mol_id").agg(F.count("*").alias("degree"))


@query("pair_concat", f"WITH {T.INTER} SELECT prot_id, mol_id, concat(s_name, '|', p_name) AS joined FROM inter JOIN supplier ON s_suppkey = prot_id JOIN part ON p_partkey = mol_id")
def pair_concat(spark, d):
    both = T.interaction(spark, d).join(T.protein(spark, d), "prot_id").join(T.molecule(spark, d), "mol_id")
    return both.select("prot_id", "mol_id", F.concat_ws("|", "name", "structure").alias("joined"))


@query(
    "pair_attention",
    f"WITH {T.INTER}, x AS (SELECT mol_id, s_acctbal / 5000 AS r, p_size / 25.0 AS m FROM inter JOIN supplier ON s_suppkey = prot_id JOIN part ON p_partkey = mol_id) SELECT mol_id, round(sum(r / (1 + exp(-r * m))), 6) AS e FROM x GROUP BY mol_id",
)
def pair_attention(spark, d):
    """Weights sigmoid(g(r) g(m)) over the proteins of a molecule, then the weighted sum."""
    prot = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("prot_id"), (F.col("s_acctbal") / 5000).alias("r"))
    mol = T.table(spark, d, "part").select(F.col("p_partkey").alias("mol_id"), (F.col("p_size") / 25.0).alias("m"))
    x = T.interaction(spark, d).join(prot, "prot_id").join(mol, "mol_id")
    return x.groupBy("mol_id").agg(F.round(F.sum(F.col("r") / (1 + F.exp(-F.col("r") * F.col("m")))), 6).alias("e"))


# Latent factors as fixed functions of the ids, for one evaluation of the factorisation's likelihood and of its scores.
FACT = f"""{T.INTER}, u AS (SELECT s_suppkey AS prot_id, (s_suppkey % 7 - 3) / 10.0::DOUBLE AS u1, (s_suppkey % 5 - 2) / 10.0::DOUBLE AS u2 FROM supplier),
  v AS (SELECT p_partkey AS mol_id, (p_partkey % 11 - 5) / 10.0::DOUBLE AS v1, (p_partkey % 3 - 1) / 10.0::DOUBLE AS v2 FROM part)"""


def _factors(spark, d):
    u = T.protein(spark, d).select("prot_id", ((F.col("prot_id") % 7 - 3) / 10).alias("u1"), ((F.col("prot_id") % 5 - 2) / 10).alias("u2"))
    v = T.molecule(spark, d).select("mol_id", ((F.col("mol_id") % 11 - 5) / 10).alias("v1"), ((F.col("mol_id") % 3 - 1) / 10).alias("v2"))
    return u, v


@query(
    "nrlmf_loglik",
    f"""WITH {FACT}, a AS (SELECT u1, u2, count(*) AS n FROM u GROUP BY ALL), b AS (SELECT v1, v2, count(*) AS n FROM v GROUP BY ALL),
    z AS (SELECT sum(a.n * b.n * ln(1 + exp(u1 * v1 + u2 * v2))) AS s FROM a, b), p AS (SELECT sum(5 * (u1 * v1 + u2 * v2) - 4 * ln(1 + exp(u1 * v1 + u2 * v2))) AS s FROM inter JOIN u USING (prot_id) JOIN v USING (mol_id)),
    r AS (SELECT (SELECT sum(u1 * u1 + u2 * u2) FROM u) + (SELECT sum(v1 * v1 + v2 * v2) FROM v) AS q) SELECT round(p.s - z.s - 0.0625 * q, 4) AS loglik FROM p, z, r""",
)
def nrlmf_loglik(spark, d):
    """Weighted log-likelihood (positives count 5 times) with the ridge of 0.125; unknown cells are negatives.

    The sum over all cells runs over distinct latent vectors with their numbers, the one over positives over edges.
    """
    u, v = _factors(spark, d)
    dot = F.col("u1") * F.col("v1") + F.col("u2") * F.col("v2")
    soft = F.log(1 + F.exp(dot))
    a, b = u.groupBy("u1", "u2").agg(F.count("*").alias("na")), v.groupBy("v1", "v2").agg(F.count("*").alias("nb"))
    z = a.join(F.broadcast(b)).agg(F.sum(F.col("na") * F.col("nb") * soft).alias("z"))  # 35 x 33 distinct vectors
    p = T.interaction(spark, d).join(u, "prot_id").join(v, "mol_id").agg(F.sum(5 * dot - 4 * soft).alias("p"))
    ru = u.agg(F.sum(F.col("u1") ** 2 + F.col("u2") ** 2).alias("ru"))
    rv = v.agg(F.sum(F.col("v1") ** 2 + F.col("v2") ** 2).alias("rv"))
    one = z.join(p).join(ru).join(rv)
    return one.select(F.round(F.col("p") - F.col("z") - 0.0625 * (F.col("ru") + F.col("rv")), 4).alias("loglik"))


@query("kmedoid_assign", "WITH m AS (SELECT label, min(vec_id) AS m FROM embeddings GROUP BY label), x AS (SELECT e.vec_id, v.vec_id AS medoid, round(list_distance(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS dist FROM embeddings e, embeddings v JOIN m ON v.vec_id = m.m) SELECT vec_id, arg_min(medoid, (dist, medoid)) AS medoid FROM x GROUP BY vec_id")
def kmedoid_assign(spark, d):
    """Each vector goes to the nearest medoid; the medoids, one a label, are broadcast (their number is fixed)."""
    e = T.table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    first = e.groupBy("label").agg(F.min("vec_id").alias("medoid"))
    m = first.join(e, F.col("medoid") == F.col("vec_id")).select("medoid", F.col("embedding").alias("c"))
    gap = F.aggregate(F.zip_with("embedding", "c", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    near = e.join(F.broadcast(m)).select("vec_id", "medoid", F.round(F.sqrt(gap), 9).alias("dist"))
    return near.groupBy("vec_id").agg(F.min_by("medoid", F.struct("dist", "medoid")).alias("medoid"))


@query("kmedoid_update", f"WITH {NAT}, c AS (SELECT n_nationkey AS id, n_regionkey AS g FROM nation), x AS (SELECT a.g, nk.i, round(sum(1 - k), 9) AS cost FROM nk JOIN c a ON a.id = i JOIN c b ON b.id = j AND a.g = b.g GROUP BY ALL) SELECT g, arg_min(i, (cost, i)) AS medoid FROM x GROUP BY g")
def kmedoid_update(spark, d):
    """The member with the least total distance, 1 - k, to its cluster becomes the medoid."""
    c = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("g"))
    met = _nations(spark, d).join(c, "i").join(c.toDF("j", "h"), "j").where("g = h")
    cost = met.groupBy("g", "i").agg(F.round(F.sum(1 - F.col("k")), 9).alias("cost"))
    return cost.groupBy("g").agg(F.min_by("i", F.struct("cost", "i")).alias("medoid"))
