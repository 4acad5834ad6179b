"""Metrics, reports and the analysis of experiment results."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from dockyard.functions import metrics as M
from dockyard.plans.registry import query
from dockyard.sources import tables as T

PRED, RES = T.PRED, T.RES
CURVE = """g AS (SELECT task, score, sum(y)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM pred WHERE y IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER v AS p, sum(n) OVER v AS t FROM g
  WINDOW w AS (PARTITION BY task ORDER BY score DESC), v AS (PARTITION BY task))"""
CONF = """m AS (SELECT task, y, round_even(score, 0) AS h FROM pred WHERE y IS NOT NULL), k AS (SELECT task, count(*) FILTER (y = 1 AND h = 1)::DOUBLE AS tp,
  count(*) FILTER (y = 0 AND h = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND h = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND h = 0)::DOUBLE AS tn FROM m GROUP BY task)"""
AP = "round(coalesce(sum(tp / nullif(p, 0) * ctp / cn), 0) * 100, 2)"
AUC = "round(coalesce(sum(tp * ((t - p) - (cn - ctp)) + 0.5 * tp * (n - tp)) / nullif(max(p * (t - p)), 0), 0) * 100, 2)"
FORMS = {
    "f1_score": ("f1", "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * 100, 2)"),
    "recall_score": ("recall", "round(coalesce(tp / nullif(tp + fn, 0), 0) * 100, 2)"),
    "precision_score": ("precision", "round(coalesce(tp / nullif(tp + fp, 0), 0) * 100, 2)"),
    "accuracy_score": ("acc", "round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 4)"),
    "mcc_score": ("mcc", "round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 4)"),
}


@query("average_precision", f"WITH {PRED}, {CURVE} SELECT task, {AP} AS aupr FROM c GROUP BY task")
def average_precision(spark, d):
    return M.average_precision(T.prediction(spark, d), ["task"])


@query("roc_auc", f"WITH {PRED}, {CURVE} SELECT task, {AUC} AS rocauc FROM c GROUP BY task")
def roc_auc(spark, d):
    return M.roc_auc(T.prediction(spark, d), ["task"])


@query(
    "pr_trapezoid",
    f"""WITH {PRED}, {CURVE}, q AS (SELECT task, score, ctp / p AS r, ctp / cn AS q FROM c),
    l AS (SELECT task, r, q, coalesce(lag(r) OVER w, 0) AS r0, coalesce(lag(q) OVER w, 1) AS q0 FROM q WINDOW w AS (PARTITION BY task ORDER BY score DESC))
    SELECT task, round(sum((r - r0) * (q + q0) / 2), 4) AS pr_area FROM l GROUP BY task""",
)
def pr_trapezoid(spark, d):
    return M.pr_trapezoid(T.prediction(spark, d), ["task"])


def _from_counts(name: str, column: str, form: str) -> None:
    @query(name, f"WITH {PRED}, {CONF} SELECT task, {form} AS {column} FROM k")
    def score(spark, d):
        return M.confusion(T.prediction(spark, d), ["task"]).select("task", M.rates()[column].alias(column))


for _name, (_column, _form) in FORMS.items():
    _from_counts(_name, _column, _form)


@query("mse_score", f"WITH {PRED} SELECT task, round(avg((y - score) ** 2), 5) AS mse FROM pred WHERE y IS NOT NULL GROUP BY task")
def mse_score(spark, d):
    return M.mse(T.prediction(spark, d), ["task"])


LONG = f"""lg AS (SELECT task, 'aupr' AS score_name, {AP} AS value FROM c GROUP BY task UNION ALL SELECT task, 'rocauc', {AUC} FROM c GROUP BY task
  {' '.join(f"UNION ALL SELECT task, '{c}', {f} FROM k" for c, f in FORMS.values() if c != 'mcc')})"""


@query("clf_report", f"WITH {PRED}, {CURVE}, {CONF}, {LONG} SELECT * FROM lg")
def clf_report(spark, d):
    return M.report(T.prediction(spark, d), ["task"])


@query(
    "multitask_report",
    f"WITH {PRED}, {CURVE}, {CONF}, {LONG}, w AS (SELECT task, tp + fp + fn + tn AS n FROM k) SELECT score_name, round(sum(value * n) / sum(n), 4) AS weighted FROM lg JOIN w USING (task) GROUP BY 1",
)
def multitask_report(spark, d):
    """Each task drops its missing labels; tasks are averaged by their valid rows."""
    pred = T.prediction(spark, d)
    sizes = pred.where("y is not null").groupBy("task").agg(F.count("*").alias("n"))
    total = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    return M.report(pred, ["task"]).join(sizes, "task").groupBy("score_name").agg(F.round(total, 4).alias("weighted"))


@query(
    "weighted_score",
    f"WITH {PRED}, a AS (SELECT task, avg(y) AS s, count(y) AS n FROM pred GROUP BY task) SELECT round(sum(s * n) / sum(n), 6) AS weighted FROM a",
)
def weighted_score(spark, d):
    a = T.prediction(spark, d).groupBy("task").agg(F.avg("y").alias("s"), F.count("y").alias("n"))
    return a.agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


@query(
    "masked_bce",
    f"""WITH {PRED}, b AS (SELECT task, y, greatest(least(score, 1 - 1e-7), 1e-7) AS p FROM pred)
    SELECT task, round(avg(CASE WHEN y IS NULL THEN 0 WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS loss FROM b GROUP BY task""",
)
def masked_bce(spark, d):
    return M.masked_bce(T.prediction(spark, d))


@query("score_stats", f"WITH {RES} SELECT algo, setting, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM res GROUP BY ALL")
def score_stats(spark, d):
    return T.result(spark, d).groupBy("algo", "setting").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"))


@query("distinct_dims", f"WITH {RES} SELECT DISTINCT algo, setting, ratio_tr, ratio_te FROM res")
def distinct_dims(spark, d):
    return T.result(spark, d).select("algo", "setting", "ratio_tr", "ratio_te").distinct()


@query(
    "missing_runs",
    f"WITH {RES}, g AS (SELECT a.algo, s.setting, i.ite, v.ival FROM (SELECT DISTINCT algo FROM res) a, (SELECT DISTINCT setting FROM res) s, (SELECT unnest(range(5))::INT AS ite) i, (SELECT unnest(range(5))::INT AS ival) v) SELECT * FROM g ANTI JOIN res USING (algo, setting, ite, ival)",
)
def missing_runs(spark, d):
    """The grid of expected runs, of known size, without those found."""
    res = T.result(spark, d)
    five = F.sequence(F.lit(0), F.lit(4))
    grid = res.select("algo").distinct().select("algo", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("setting"))
    grid = grid.select("*", F.explode(five).alias("ite")).select("*", F.explode(five).alias("ival"))
    return grid.join(res, ["algo", "setting", "ite", "ival"], "left_anti")


@query("results_filter", f"WITH {RES} SELECT event_id, algo, score FROM res WHERE setting = 1 AND algo IN ('view', 'click') AND contains(params, '7')")
def results_filter(spark, d):
    return T.result(spark, d).where((F.col("setting") == 1) & F.col("algo").isin("view", "click") & F.col("params").contains("7")).select("event_id", "algo", "score")


@query("rotation_filter", f"WITH {RES} SELECT event_id FROM res WHERE ival = (ite + 1) % 5")
def rotation_filter(spark, d):
    return T.result(spark, d).where("ival = (ite + 1) % 5").select("event_id")


@query("parse_result_path", f"WITH {RES} SELECT event_id, algo AS dataset, ite, ival, setting FROM res")
def parse_result_path(spark, d):
    """Parameters are read back from names like ``purchase_3,4_2_1_5``."""
    named = T.result(spark, d).select("event_id", F.concat_ws("_", "algo", F.concat_ws(",", "ite", "ival"), "setting", "ratio_tr", "ratio_te").alias("path"))
    part = lambda i: F.regexp_extract("path", r"^(.+)_(\d+),(\d+)_(\d+)_(\d+)_(\d+)$", i)
    return named.select("event_id", part(1).alias("dataset"), *[part(i).cast("int").alias(n) for i, n in ((2, "ite"), (3, "ival"), (4, "setting"))])


@query("results_semi", f"WITH {RES}, k AS (SELECT DISTINCT setting, ratio_tr, ratio_te, ite, ival FROM res WHERE algo = 'purchase') SELECT event_id FROM res SEMI JOIN k USING (setting, ratio_tr, ratio_te, ite, ival)")
def results_semi(spark, d):
    res, keys = T.result(spark, d), ["setting", "ratio_tr", "ratio_te", "ite", "ival"]
    return res.join(res.where("algo = 'purchase'").select(keys).distinct(), keys, "left_semi").select("event_id")


@query("results_union", f"WITH {RES} SELECT event_id, algo, params, NULL::INT AS layers FROM res WHERE algo = 'view' UNION ALL SELECT event_id, replace(algo, 'click', 'tap'), NULL, setting FROM res WHERE algo = 'click'")
def results_union(spark, d):
    res = T.result(spark, d)
    a = res.where("algo = 'view'").select("event_id", "algo", "params")
    b = res.where("algo = 'click'").select("event_id", F.replace("algo", F.lit("click"), F.lit("tap")).alias("algo"), F.col("setting").alias("layers"))
    return a.unionByName(b, allowMissingColumns=True)


@query("results_unpivot", "SELECT l_orderkey, l_linenumber, n AS score_name, CASE n WHEN 'disc' THEN l_discount ELSE l_tax END AS score FROM lineitem, (VALUES ('disc'), ('tax')) t(n)")
def results_unpivot(spark, d):
    wide = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"))
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["disc", "tax"], "score_name", "score")


@query("param_families", "SELECT c_custkey, concat('nation:', c_nationkey) AS encoder, concat('segment:', c_mktsegment) AS predictor FROM customer")
def param_families(spark, d):
    made = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    family = lambda names: F.array_join(F.transform(F.map_entries(F.map_filter(made, lambda k, v: k.isin(names))), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
    return T.table(spark, d, "customer").select("c_custkey", family(["nation"]).alias("encoder"), family(["segment"]).alias("predictor"))


@query("combo_inventory", f"WITH {RES}, x AS (SELECT DISTINCT setting, ratio_tr, ratio_te, ite, ival FROM res) SELECT setting, ratio_tr, ratio_te, string_agg(concat(ite, '/', ival), ' ' ORDER BY ite, ival) AS combos FROM x GROUP BY ALL")
def combo_inventory(spark, d):
    combo = F.concat_ws("/", "ite", "ival")
    return T.result(spark, d).groupBy("setting", "ratio_tr", "ratio_te").agg(F.array_join(F.array_sort(F.collect_set(combo)), " ").alias("combos"))


STATS = "st AS (SELECT algo, setting, ratio_te, avg(score) AS mean, stddev_pop(score) AS std FROM res GROUP BY ALL)"


def _stats(spark, d):
    return T.result(spark, d).groupBy("algo", "setting", "ratio_te").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


@query(
    "report_pivot",
    f"WITH {RES} SELECT algo, {', '.join(f'round(avg(score) FILTER (setting = {s}), 4) AS mean_{s}, round(stddev_pop(score) FILTER (setting = {s}), 4) AS std_{s}' for s in (1, 2, 3, 4))} FROM res GROUP BY algo",
)
def report_pivot(spark, d):
    pivot = T.result(spark, d).groupBy("algo").pivot("setting", [1, 2, 3, 4]).agg(F.round(F.avg("score"), 4).alias("mean"), F.round(F.stddev_pop("score"), 4).alias("std"))
    return pivot.select("algo", *[F.col(f"{s}_{x}").alias(f"{x}_{s}") for s in (1, 2, 3, 4) for x in ("mean", "std")])


@query(
    "report_bold",
    f"WITH {RES}, {STATS}, b AS (SELECT setting, ratio_te, max(mean) AS bm, arg_max(std, (round(mean, 9), round(std, 9))) AS bs FROM st GROUP BY ALL) SELECT algo, setting, ratio_te, round(mean, 4) AS mean, round(std, 4) AS std, mean > bm - bs AS bold FROM st JOIN b USING (setting, ratio_te)",
)
def report_bold(spark, d):
    """Bold are the means above the best mean less its deviation; of equal means the largest deviation counts."""
    st = _stats(spark, d)
    best = st.groupBy("setting", "ratio_te").agg(F.max("mean").alias("bm"), F.max_by("std", F.struct(F.round("mean", 9), F.round("std", 9))).alias("bs"))
    bold = (F.col("mean") > F.col("bm") - F.col("bs")).alias("bold")
    return st.join(best, ["setting", "ratio_te"]).select("algo", "setting", "ratio_te", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), bold)


@query("report_latex", f"""WITH {RES}, {STATS} SELECT algo, string_agg(printf('%.2f', round(mean, 2)) || ' $\\pm$ ' || printf('%.2f', round(std, 2)), ' & ' ORDER BY setting, ratio_te) AS line FROM st GROUP BY algo""")
def report_latex(spark, d):
    """One LaTeX table line for each algorithm."""
    cell = F.concat(F.format_string("%.2f", F.round("mean", 2)), F.lit(" $\\pm$ "), F.format_string("%.2f", F.round("std", 2)))
    cells = _stats(spark, d).groupBy("algo").agg(F.array_sort(F.collect_list(F.struct("setting", "ratio_te", cell.alias("c")))).alias("x"))
    return cells.select("algo", F.array_join(F.col("x")["c"], " & ").alias("line"))


@query("box_stats", f"WITH {RES} SELECT algo, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS q2, round(quantile_cont(score, 0.75), 6) AS q3 FROM res GROUP BY algo")
def box_stats(spark, d):
    q = M.quantiles(T.result(spark, d), ["algo"], "score", [0.25, 0.5, 0.75])
    return q.select("algo", *[F.round(F.col(f"q{i}"), 6).alias(f"q{i + 1}") for i in range(3)])


@query("best_param", f"WITH {RES}, a AS (SELECT algo, params, avg(score) AS m FROM res GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY algo ORDER BY round(m, 9) DESC, params) AS k FROM a) SELECT algo, params, round(m, 6) AS mean FROM r WHERE k = 1")
def best_param(spark, d):
    a = T.result(spark, d).groupBy("algo", "params").agg(F.avg("score").alias("m"))
    order = Window.partitionBy("algo").orderBy(F.desc(F.round("m", 9)), "params")
    return a.withColumn("k", F.row_number().over(order)).where("k = 1").select("algo", "params", F.round("m", 6).alias("mean"))


@query("best_ratio", f"WITH {RES}, a AS (SELECT algo, setting, ratio_tr, avg(score) AS m FROM res GROUP BY ALL), b AS (SELECT algo, setting, arg_max(ratio_tr, (round(m, 9), -ratio_tr)) AS ratio_tr FROM a GROUP BY ALL) SELECT event_id, algo, setting, ratio_tr FROM res SEMI JOIN b USING (algo, setting, ratio_tr)")
def best_ratio(spark, d):
    res = T.result(spark, d)
    a = res.groupBy("algo", "setting", "ratio_tr").agg(F.avg("score").alias("m"))
    best = a.groupBy("algo", "setting").agg(F.max_by("ratio_tr", F.struct(F.round("m", 9), -F.col("ratio_tr"))).alias("ratio_tr"))  # ties: the smaller
    return res.join(best, ["algo", "setting", "ratio_tr"], "left_semi").select("event_id", "algo", "setting", "ratio_tr")


@query("best_try", f"WITH {RES} SELECT algo, ite, ival, arg_max(event_id, (score, -event_id)) AS event_id, max(score) AS score FROM res GROUP BY ALL")
def best_try(spark, d):
    return T.result(spark, d).groupBy("algo", "ite", "ival").agg(F.max_by("event_id", F.struct("score", -F.col("event_id"))).alias("event_id"), F.max("score").alias("score"))


@query(
    "early_stopping",
    """WITH h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch FROM events),
    b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
    g AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS best_epoch FROM b),
    s AS (SELECT user_id, min(epoch) AS stop FROM g WHERE epoch - best_epoch >= 3 GROUP BY user_id)
    SELECT g.user_id, max(g.epoch) AS last_epoch, arg_max(g.best_epoch, g.epoch) AS best_epoch, any_value(stop) IS NOT NULL AS stopped
    FROM g LEFT JOIN s USING (user_id) WHERE stop IS NULL OR epoch <= stop GROUP BY g.user_id""",
)
def early_stopping(spark, d):
    """Per history: training ends after 3 epochs in a row that don't beat the best score so far."""
    own = Window.partitionBy("user_id")
    h = T.table(spark, d, "events").select("user_id", "value", (F.row_number().over(own.orderBy("ts", "event_id")) - 1).cast("long").alias("epoch"))
    before = F.max("value").over(own.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    beats = h.withColumn("b", before).withColumn("e", F.when(F.col("b").isNull() | (F.col("value") > F.col("b")), F.col("epoch")))
    best = beats.withColumn("best_epoch", F.max("e").over(own.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)))
    stop = best.withColumn("stop", F.min(F.when(F.col("epoch") - F.col("best_epoch") >= 3, F.col("epoch"))).over(own))
    run = stop.where("stop is null or epoch <= stop")
    return run.groupBy("user_id").agg(F.max("epoch").alias("last_epoch"), F.max_by("best_epoch", "epoch").alias("best_epoch"), F.max("stop").isNotNull().alias("stopped"))


@query("topk_scores", f"WITH {RES} SELECT event_id, score FROM res ORDER BY score DESC, event_id LIMIT 10")
def topk_scores(spark, d):
    return T.result(spark, d).select("event_id", "score").orderBy(F.desc("score"), "event_id").limit(10)
