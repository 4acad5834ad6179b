"""Scans, filters, projections and sinks of the assay and sequence tables."""

from pyspark.sql import functions as F

from dockyard.functions import columns as C
from dockyard.operators.ranking import global_rank
from dockyard.plans.registry import query
from dockyard.sources import tables as T


@query("scan_rowid", "SELECT * FROM (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part) WHERE p_size > 25")
def scan_rowid(spark, d):
    """Row numbers are given before the filter, so they have gaps."""
    part = T.table(spark, d, "part").select("p_partkey", "p_size")
    return global_rank(part, ["p_partkey"], F.floor(F.col("p_partkey") / 10_000), "row_id").where("p_size > 25")


@query("scan_column_subset", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_column_subset(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("label_from_source", "SELECT doc_id, regexp_extract(source, '(\\d+)$', 1)::INT AS y FROM documents")
def label_from_source(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("y"))


@query("parse_tokens", "SELECT c_custkey, split_part(c_name, '#', 1) AS word, regexp_extract(c_name, '#0*(\\d+)$', 1)::BIGINT AS number FROM customer")
def parse_tokens(spark, d):
    return T.table(spark, d, "customer").select(
        "c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("word"), F.regexp_extract("c_name", r"#0*(\d+)$", 1).cast("long").alias("number")
    )


@query(
    "align_by_ordinal",
    """WITH a AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
    b AS (SELECT quality, row_number() OVER (ORDER BY doc_id) AS n FROM labels) SELECT doc_id, quality FROM a JOIN b USING (n) WHERE lang = 'en'""",
)
def align_by_ordinal(spark, d):
    """Two files aligned by position: ordinals are made explicit and joined, then one filter holds for both."""
    bucket = F.floor(F.col("doc_id") / 10_000)
    a = global_rank(T.table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], bucket, "n")
    b = global_rank(T.table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], bucket, "n").drop("doc_id")
    return a.join(b, "n").where("lang = 'en'").select("doc_id", "quality")


@query("filter_species", f"WITH {T.PROT} SELECT prot_id, species FROM prot WHERE species = 'NATION_7'")
def filter_species(spark, d):
    return T.protein(spark, d).where("species = 'NATION_7'").select("prot_id", "species")


@query("vectorise_columns", "SELECT p_partkey, array_to_string([p_size, p_retailprice], ',') AS fea FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part)")
def vectorise_columns(spark, d):
    fea = F.array(F.col("p_size").cast("double"), "p_retailprice")
    return T.table(spark, d, "part").select("p_partkey", F.array_join(fea.cast("array<string>"), ",").alias("fea"))


@query(
    "union_by_name_fill",
    """SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS size, 0.0::DOUBLE AS balance FROM part
    UNION ALL SELECT s_suppkey, 0.0, 0.0, s_acctbal FROM supplier""",
)
def union_by_name_fill(spark, d):
    part = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    supplier = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return part.unionByName(supplier, allowMissingColumns=True).na.fill(0.0)


@query("sink_tsv", "SELECT doc_id, concat(doc_id, chr(9), source, chr(9), lang) AS line FROM documents")
def sink_tsv(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.concat_ws("\t", F.col("doc_id").cast("string"), "source", "lang").alias("line"))


@query("format_fasta", "SELECT item_id, concat('>', item_id, chr(10), text) AS record FROM benchmark")
def format_fasta(spark, d):
    return T.table(spark, d, "benchmark").select("item_id", F.concat(F.lit(">"), F.col("item_id").cast("string"), F.lit("\n"), "text").alias("record"))


@query("filter_valid", "SELECT doc_id FROM documents WHERE text <> '' AND regexp_matches(text, '[A-Za-z]')")
def filter_valid(spark, d):
    return T.table(spark, d, "documents").where((F.col("text") != "") & F.col("text").rlike("[A-Za-z]")).select("doc_id")


@query("filter_alphabet", "SELECT doc_id, length(text) AS n FROM documents WHERE regexp_full_match(text, '[A-Za-z .,\\n]*')")
def filter_alphabet(spark, d):
    return T.table(spark, d, "documents").where(F.col("text").rlike(r"^[A-Za-z .,\n]*\z")).select("doc_id", F.length("text").cast("long").alias("n"))


@query("filter_length", "SELECT doc_id FROM documents WHERE length(text) <= 1000")
def filter_length(spark, d):
    return T.table(spark, d, "documents").where(F.length("text") <= 1000).select("doc_id")


@query("unpivot_tasks", f"WITH {T.LABEL} SELECT id, task, y FROM lab WHERE y IS NOT NULL")
def unpivot_tasks(spark, d):
    return T.label(spark, d).where("y is not null").select("id", "task", "y")


@query("missing_counts", f"WITH {T.LABEL} SELECT task, count(y) AS present, count(*) - count(y) AS missing FROM lab GROUP BY task")
def missing_counts(spark, d):
    return T.label(spark, d).groupBy("task").agg(F.count("y").alias("present"), F.count_if(F.col("y").isNull()).alias("missing"))


@query("mask_missing", f"WITH {T.LABEL} SELECT id, task, coalesce(y, -1)::INT AS y FROM lab")
def mask_missing(spark, d):
    return T.label(spark, d).select("id", "task", F.coalesce("y", F.lit(C.MISSING)).alias("y"))


@query("label_encode", "SELECT event_id, (list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) - 1)::INT AS code FROM events")
def label_encode(spark, d):
    names = F.array(*map(F.lit, ["view", "click", "purchase", "signup", "error"]))
    return T.table(spark, d, "events").select("event_id", (F.array_position(names, F.col("event_type")) - 1).cast("int").alias("code"))


@query("residue_labels", "SELECT item_id, replace(text, 't', 'T') AS marked FROM benchmark")
def residue_labels(spark, d):
    return T.table(spark, d, "benchmark").select("item_id", F.replace("text", F.lit("t"), F.lit("T")).alias("marked"))


@query(
    "mutate_sequence",
    """SELECT item_id, CASE WHEN substr(text, 2, 1) = 'h' THEN substr(text, 1, 1) || 'H' || substr(text, 3) END AS changed,
    substr(text, 2, 1) <> 'h' AS rejected FROM benchmark""",
)
def mutate_sequence(spark, d):
    """The residue at the place must be the one named; else the row is rejected."""
    at = F.substring("text", 2, 1)
    changed = F.when(at == "h", F.overlay("text", F.lit("H"), F.lit(2), F.lit(1)))
    return T.table(spark, d, "benchmark").select("item_id", changed.alias("changed"), (at != "h").alias("rejected"))


@query("dq_length_mismatch", "SELECT 'length_mismatch' AS check_name, count(*) FILTER (length(text) <> n_chars) AS n_violations FROM documents")
def dq_length_mismatch(spark, d):
    bad = F.count_if(F.length("text") != F.col("n_chars"))
    return T.table(spark, d, "documents").agg(bad.alias("n_violations")).select(F.lit("length_mismatch").alias("check_name"), "n_violations")


@query("remap_values", "SELECT event_id, replace(event_type, 'signup', 'join') AS algo FROM events")
def remap_values(spark, d):
    return T.table(spark, d, "events").select("event_id", F.replace("event_type", F.lit("signup"), F.lit("join")).alias("algo"))


@query(
    "aa_map",
    f"""WITH r(code, letter) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in C.RESIDUES.items())}),
    w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{3}}')) AS w FROM documents), c AS (SELECT upper(w[1]) || lower(w[2:3]) AS code FROM w)
    SELECT code, letter, count(*) AS n FROM c JOIN r USING (code) GROUP BY ALL""",
)
def aa_map(spark, d):
    """Runs of three letters of all texts, as three-letter codes, with their one-letter ones."""
    runs = T.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3}"), F.lit(0))).alias("w"))
    codes = runs.groupBy(F.concat(F.upper(F.substring("w", 1, 1)), F.lower(F.substring("w", 2, 2))).alias("code")).agg(F.count("*").alias("n"))
    return codes.where(F.col("code").isin(*C.RESIDUES)).select("code", C.one_letter(F.col("code")).alias("letter"), "n")


@query("onehot_fallback", "SELECT p_partkey, (p_size = 5)::INT AS is_5, (p_size = 10)::INT AS is_10, (p_size NOT IN (5, 10))::INT AS is_other FROM part")
def onehot_fallback(spark, d):
    hot = C.one_hot(F.col("p_size"), [5, 10, 999])
    return T.table(spark, d, "part").select("p_partkey", hot[0].alias("is_5"), hot[1].alias("is_10"), hot[2].alias("is_other"))


@query("sequence_explode", "SELECT item_id, (i - 1)::INT AS pos, substr(text, i, 1) AS code FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)")
def sequence_explode(spark, d):
    return T.table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("pos", "code")).where("code <> ''")


@query(
    "pad_array",
    """WITH s AS (SELECT item_id, item_id // 16 AS batch, string_split(text, ' ') AS w FROM benchmark), m AS (SELECT batch, max(len(w)) AS m FROM s GROUP BY batch)
    SELECT item_id, batch, len(w) AS n, array_to_string(list_transform(w, lambda x: length(x)) || list_transform(range(m - len(w)), lambda x: 0), ',') AS padded FROM s JOIN m USING (batch)""",
)
def pad_array(spark, d):
    """Zeros up to the longest row of a batch of 16: one long row widens its own batch alone."""
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w))
    words = T.table(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 16).alias("batch"), lengths.alias("v"))
    both = words.join(words.groupBy("batch").agg(F.max(F.size("v")).alias("m")), "batch")
    return both.select("item_id", "batch", F.size("v").cast("long").alias("n"), F.array_join(C.padded(F.col("v"), F.col("m"), 0).cast("array<string>"), ",").alias("padded"))


@query("label_onehot", "SELECT vec_id, array_to_string(list_transform(range(10), lambda i: (i = label)::INT), '') AS hot FROM embeddings")
def label_onehot(spark, d):
    hot = C.one_hot(F.col("label"), list(range(10)), fallback=False)
    return T.table(spark, d, "embeddings").select("vec_id", F.array_join(hot.cast("array<string>"), "").alias("hot"))


@query("threshold_pred", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0)::INT AS hit FROM lineitem")
def threshold_pred(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.rint(F.col("l_quantity") / 4).cast("int").alias("hit"))


@query(
    "argmax_onehot",
    """SELECT vec_id, array_to_string(list_transform(e, lambda x: (x = list_max(e))::INT), '') AS hot
    FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(4 * x::DOUBLE)) AS e FROM embeddings)""",
)
def argmax_onehot(spark, d):
    rough = F.transform("embedding", lambda x: F.floor(4 * x.cast("double")))
    rows = T.table(spark, d, "embeddings").select("vec_id", rough.alias("e"))
    return rows.select("vec_id", F.array_join(C.argmax_one_hot(F.col("e")).cast("array<string>"), "").alias("hot"))


@query(
    "standardise",
    """SELECT p_partkey, round(CASE WHEN s = 0 THEN 0 ELSE (p_retailprice - a) / s END, 6) + 0.0::DOUBLE AS z FROM
    (SELECT p_partkey, p_retailprice, avg(p_retailprice) OVER (PARTITION BY p_brand) AS a, stddev_pop(p_retailprice) OVER (PARTITION BY p_brand) AS s FROM part)""",
)
def standardise(spark, d):
    """Per explicit batch (here the brand), population deviation; a constant column becomes 0."""
    stats = T.table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"), F.stddev_pop("p_retailprice").alias("s"))
    z = F.when(F.col("s") == 0, 0.0).otherwise((F.col("p_retailprice") - F.col("a")) / F.col("s"))
    return T.table(spark, d, "part").join(stats, "p_brand").select("p_partkey", (F.round(z, 6) + 0.0).alias("z"))


@query("sigmoid_score", "SELECT event_id, round(1 / (1 + exp(-(value - 20) / 10)), 8) AS p FROM events")
def sigmoid_score(spark, d):
    return T.table(spark, d, "events").select("event_id", F.round(C.sigmoid((F.col("value") - 20) / 10), 8).alias("p"))


@query("lr_schedule", "SELECT n_nationkey AS epoch, round(0.001 * power(0.9, floor(n_nationkey / 2)), 10)::DOUBLE AS lr FROM nation")
def lr_schedule(spark, d):
    return T.table(spark, d, "nation").select(F.col("n_nationkey").alias("epoch"), F.round(C.learning_rate(F.col("n_nationkey")), 10).alias("lr"))


@query("canonical_params", "SELECT c_custkey, concat('nation:', c_nationkey, ';segment:', c_mktsegment) AS params FROM customer")
def canonical_params(spark, d):
    made = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return T.table(spark, d, "customer").select("c_custkey", C.canonical_params(made).alias("params"))


@query(
    "parse_params",
    "SELECT o_orderkey, (o_orderkey % 4)::VARCHAR AS repeat, o_orderstatus AS bs, concat('{''name'':''', o_orderpriority, '''}') AS lrs FROM orders",
)
def parse_params(spark, d):
    """Names like ``3_bs:20;lrs:{'name':'X'}`` are made and parsed again."""
    orders = T.table(spark, d, "orders")
    name = F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit("_bs:"), "o_orderstatus", F.lit(";lrs:{'name':'"), "o_orderpriority", F.lit("'}"))
    got = orders.select("o_orderkey", C.parsed_params(name).alias("m"))
    return got.select("o_orderkey", F.col("m")["repeat"].alias("repeat"), F.col("m")["bs"].alias("bs"), F.col("m")["lrs"].alias("lrs"))


@query("json_param", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_param(spark, d):
    return T.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("label_counts", "SELECT label AS y, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark, d):
    return T.table(spark, d, "embeddings").groupBy(F.col("label").alias("y")).agg(F.count("*").alias("n"))


@query("residue_counts", "SELECT code, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS code FROM documents) WHERE code <> '' GROUP BY code")
def residue_counts(spark, d):
    return T.table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("code")).where("code <> ''").groupBy("code").agg(F.count("*").alias("n"))


@query("max_length", "SELECT lang, max(length(text)) AS longest FROM documents GROUP BY lang")
def max_length(spark, d):
    return T.table(spark, d, "documents").groupBy("lang").agg(F.max(F.length("text")).cast("long").alias("longest"))


@query(
    "balanced_counts",
    "SELECT source, count(*) FILTER (toxic = 1) AS a, count(*) FILTER (toxic = 0) AS b, least(count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0)) AS both_sides FROM documents JOIN labels USING (doc_id) GROUP BY source",
)
def balanced_counts(spark, d):
    met = T.table(spark, d, "documents").select("doc_id", "source").join(T.table(spark, d, "labels"), "doc_id")
    counts = met.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    return counts.withColumn("both_sides", F.least("a", "b"))


@query(
    "collect_variants",
    "SELECT c_nationkey, c_mktsegment, string_agg(c_custkey, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY ALL",
)
def collect_variants(spark, d):
    grouped = T.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list("c_custkey")).alias("m"))
    return grouped.select("c_nationkey", "c_mktsegment", F.array_join(F.col("m").cast("array<string>"), ",").alias("members"))


@query("class_weights", "SELECT label, round(max(count(*)) OVER () / count(*)::DOUBLE, 8) AS w FROM embeddings GROUP BY label")
def class_weights(spark, d):
    counts = T.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("m"))
    return counts.join(F.broadcast(top)).select("label", F.round(F.col("m") / F.col("n"), 8).alias("w"))  # one row a class


@query("is_multiclass", f"WITH {T.LABEL} SELECT task, count(DISTINCT CASE WHEN y <> -1 THEN y END) > 2 AS many FROM lab GROUP BY task")
def is_multiclass(spark, d):
    return T.label(spark, d).groupBy("task").agg((F.count_distinct(F.when(F.col("y") != -1, F.col("y"))) > 2).alias("many"))


@query("surrogate_index", "SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS idx FROM events GROUP BY user_id")
def surrogate_index(spark, d):
    seen = T.table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("at"))
    return global_rank(seen, ["at"], F.floor(F.col("at") / 100_000), "idx").select("user_id", "idx")


@query(
    "decode_onehot",
    "SELECT vec_id, list_position(list_transform(embedding, lambda x: x = list_max(embedding)), true)::INT - 1 AS code FROM embeddings",
)
def decode_onehot(spark, d):
    return T.table(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("code"))


@query(
    "sample_weight",
    "SELECT doc_id, CASE WHEN greatest(quality, toxic) = 1 THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL",
)
def sample_weight(spark, d):
    most = F.greatest("quality", "toxic")
    return T.table(spark, d, "labels").where(most.isNotNull()).select("doc_id", F.when(most == 1, 3.0).otherwise(1.0).alias("w"))


@query("first_last_turn", "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def first_last_turn(spark, d):
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))
