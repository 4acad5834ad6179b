"""Readers and writers, end to end: files in each layout are written from the tables and read back by the library's readers."""

import uuid

from pyspark.sql import functions as F

from dockyard.functions import columns as C
from dockyard.functions.kernels import overlap_pairs
from dockyard.operators.lineage import shared_folder
from dockyard.operators.splits import setting1
from dockyard.plans.features import KP, _bag
from dockyard.plans.registry import query
from dockyard.plans.relations import CV1, _trio
from dockyard.sources import files
from dockyard.sources import tables as T


def _new(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def _put(df, value) -> str:
    """Write records, a line or more each, as text files."""
    path = _new(df.sparkSession)
    df.select(value.alias("value")).write.text(path)
    return path


def _letters(name: str):
    return F.upper(F.regexp_replace(name, "[^a-z]", ""))


LETTERS = "upper(regexp_replace(p_name, '[^a-z]', '', 'g'))"


# --- assay tables: tasks first, then the id and the structure ------------------------------------------------------------


def _assay(name: str, tasks: int) -> None:
    y = [f"CASE WHEN (p_size + {j}) % 3 <> 2 THEN ((p_size + {j}) % 2)::VARCHAR END AS y{j}" for j in range(tasks)]

    @query(name, f"SELECT {', '.join(y)}, 'M' || p_partkey AS id, p_name AS smiles FROM part WHERE p_size <> 7")
    def scan(spark, d):
        """Columns by position, header skipped, empty labels null; rows without a structure are left out."""
        label = lambda j: F.when((F.col("p_size") + j) % 3 != 2, ((F.col("p_size") + j) % 2).cast("string")).alias(f"c{j}")
        smiles = F.when(F.col("p_size") != 7, F.col("p_name")).alias("s")
        path = _new(spark)
        T.table(spark, d, "part").select(*[label(j) for j in range(tasks)], F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("i"), smiles).write.csv(path, header=True)
        fields = {j: f"y{j}" for j in range(tasks)} | {tasks: "id", tasks + 1: "smiles"}
        return files.csv_by_position(spark, path, fields, tasks + 2).where("smiles is not null and smiles <> ''")


_assay("scan_tox21", 12)
_assay("scan_muv", 17)


def _measured(name: str, column: str) -> None:
    @query(name, f"SELECT 'M' || p_partkey AS id, {column}::DOUBLE AS y, p_name AS smiles FROM part")
    def scan(spark, d):
        """One measured number a row; the columns that are not wanted are skipped by position."""
        path = _new(spark)
        part = T.table(spark, d, "part")
        part.select(F.lit("x").alias("skip"), F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("i"), column, "p_name").write.csv(path, header=True)
        found = files.csv_by_position(spark, path, {1: "id", 2: "y", 3: "smiles"}, 4)
        return found.select("id", F.col("y").cast("double").alias("y"), "smiles")


_measured("scan_membrane_permeability", "p_size")
_measured("scan_atomization_energy", "p_retailprice")


# --- records -------------------------------------------------------------------------------------------------------------


@query("scan_sdf", "SELECT 'DB' || p_partkey AS id, p_name AS smiles, p_retailprice::DOUBLE AS weight FROM part")
def scan_sdf(spark, d):
    text = F.concat(
        F.lit("mol\n  x\n> <DATABASE_ID>\nDB"), F.col("p_partkey").cast("string"), F.lit("\n\n> <SMILES>\n"), "p_name",
        F.lit("\n\n> <MOLECULAR_WEIGHT>\n"), F.col("p_retailprice").cast("string"), F.lit("\n\n$$$$"),
    )
    return files.sdf(spark, _put(T.table(spark, d, "part"), text))


def _targets(spark, d) -> str:
    """Proteins with their ligands in the header and the sequence on two lines."""
    inter = T.interaction(spark, d).groupBy("prot_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("DB"), F.col("mol_id").cast("string")))).alias("m"))
    name = F.concat(F.lit("MKV"), F.translate(F.col("prot_id").cast("string"), "0123456789", "ACDEFGHIKL"))
    text = F.concat(F.lit(">sp|P"), F.col("prot_id").cast("string"), F.lit("|NAME one ("), F.array_join("m", "; "), F.lit(")\n"), name, F.lit("\nlla"))
    return _put(inter, text)


@query("scan_fasta_ligands", f"WITH {T.INTER} SELECT 'P' || prot_id AS prot_id, 'DB' || mol_id AS mol_id FROM inter")
def scan_fasta_ligands(spark, d):
    return files.target_fasta(spark, _targets(spark, d))[1]


@query("scan_fasta", f"WITH {T.INTER} SELECT DISTINCT 'P' || prot_id AS prot_id, 'MKV' || translate(prot_id::VARCHAR, '0123456789', 'ACDEFGHIKL') || 'LLA' AS seq FROM inter")
def scan_fasta(spark, d):
    """Sequences over several lines, the last record too."""
    return files.target_fasta(spark, _targets(spark, d))[0]


@query("scan_class_fasta", f"SELECT 'd' || p_partkey AS id, {LETTERS} AS seq, (p_size % 7)::INT AS y FROM part WHERE regexp_matches({LETTERS}, '^[{C.ALPHABET}]+$')")
def scan_class_fasta(spark, d):
    """The class is the first letter of the header's second token; sequences with other letters are left out."""
    letter = F.chr(F.lit(97) + F.col("p_size") % 7)
    text = F.concat(F.lit(">d"), F.col("p_partkey").cast("string"), F.lit(" "), letter, F.lit(".1.1.1 x\n"), F.lower(_letters("p_name")))
    return files.class_fasta(spark, _put(T.table(spark, d, "part"), text))


@query(
    "scan_variants",
    "SELECT 'VAR_' || lpad(p_partkey::VARCHAR, 6, '0') AS var_id, 'P' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS gene, 'p.Lys' || (p_size + 1) || 'Glu' AS change, CASE WHEN p_size % 2 = 0 THEN 'Disease' ELSE 'Polymorphism' END AS label, (p_size + 1)::INT AS pos FROM part WHERE p_size % 5 <> 0",
)
def scan_variants(spark, d):
    """Fixed text lines among others; tokens are found by their forms."""
    key = lambda v, n: F.lpad(v.cast("string"), n, "0")
    label = F.when(F.col("p_size") % 2 == 0, "Disease").otherwise("Polymorphism")
    text = F.concat(F.lit("GENE  P"), key(F.col("p_partkey") % 100000, 5), F.lit("  VAR_"), key(F.col("p_partkey"), 6), F.lit("  p.Lys"), (F.col("p_size") + 1).cast("string"), F.lit("Glu  "), label, F.lit("  -  x"))
    return files.variants(spark, _put(T.table(spark, d, "part"), F.when(F.col("p_size") % 5 != 0, text).otherwise("a line without a variant")))


@query("scan_annotated", f"SELECT 'P' || p_partkey AS id, {LETTERS} AS seq, translate({LETTERS}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', repeat('S', 13) || repeat('T', 13)) AS labels FROM part WHERE {LETTERS} <> ''")
def scan_annotated(spark, d):
    """Header line with a blank first, sequence, annotation of the same length; ``t`` counts as ``T``."""
    seq = _letters("p_name")
    marks = F.translate(seq, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "S" * 13 + "t" * 13)
    text = F.concat(F.lit("   "), F.length(seq).cast("string"), F.lit(" P"), F.col("p_partkey").cast("string"), F.lit("\n"), seq, F.lit("\n"), marks)
    return files.annotated(spark, _put(T.table(spark, d, "part"), text))


# --- data sets and sinks -------------------------------------------------------------------------------------------------


@query(
    "dataset_artefacts",
    f"""WITH {T.INTER}, p AS (SELECT s_suppkey AS prot_id, s_name AS seq, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier),
    m AS (SELECT p_partkey AS mol_id, p_name AS structure, row_number() OVER (ORDER BY p_partkey) - 1 AS j FROM part)
    SELECT i, j, prot_id, mol_id, seq, structure FROM inter JOIN p USING (prot_id) JOIN m USING (mol_id)""",
)
def dataset_artefacts(spark, d):
    """A data set's tables stored together and loaded by name: the relation by numbers, with what the numbers stand for."""
    path = _new(spark)
    prot, mol = T.protein(spark, d).select("prot_id", F.col("name").alias("seq")), T.molecule(spark, d)
    files.save_dataset(mol, prot, T.interaction(spark, d), path)
    found = files.load_dataset(spark, path)
    named = found["relation"].join(found["prot_index"], "i").join(found["mol_index"], "j")
    return named.join(found["protein"], "prot_id").join(found["molecule"], "mol_id").select("i", "j", "prot_id", "mol_id", "seq", "structure")


@query("sink_folds", f"WITH {CV1} SELECT 1 AS setting, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS part, prot_id, mol_id, y FROM cv WHERE ratio = 5")
def sink_folds(spark, d):
    """Folds written by setting, ratio and fold; a split reads its own folders alone."""
    path = _new(spark)
    split = setting1(*_trio(spark, d)).withColumn("setting", F.lit(1))
    files.write_folds(split.repartition("ratio", "fold"), path)
    own = files.read_folds(spark, path, 5, 0, 1)
    rows = [df.select("setting", F.lit(part).alias("part"), "prot_id", "mol_id", "y") for part, df in own.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("sink_results", f"WITH {T.RES} SELECT algo, setting, ite, ival, ratio_tr, ratio_te, count(*) AS n, round(sum(score), 4) AS total FROM res GROUP BY ALL")
def sink_results(spark, d):
    """Runs' scores written twice: a run that is written again replaces its rows."""
    path = _new(spark)
    res = T.result(spark, d).drop("params").withColumn("dataset", F.lit("d"))
    keys = ["dataset", "setting", "ratio_tr", "ratio_te", "ite", "ival"]
    files.replace_results(res.repartition(*keys), path)
    files.replace_results(res.where("ite = 0").repartition(*keys), path)
    own = ["algo", *keys[1:]]
    return spark.read.parquet(path).groupBy(*own).agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("sink_matrix", f"WITH {KP} SELECT i, j, round(k, 6) AS k FROM kp WHERE k <> 0")
def sink_matrix(spark, d):
    path = _new(spark)
    files.write_matrix(overlap_pairs(_bag(spark, d)), path, ranged=True)
    return spark.read.parquet(path).select("i", "j", F.round("k", 6).alias("k"))


@query("sink_weights", "SELECT p_brand AS layer, count(*)::INT AS n, round(CASE WHEN p_brand LIKE '%1' THEN sum(p_size) ELSE 0 END, 2)::DOUBLE AS total, p_brand LIKE '%1' AS loaded FROM part GROUP BY p_brand")
def sink_weights(spark, d):
    """Layers stored by a pattern of their names and loaded into a model that has zeros: the others keep their own."""
    path = _new(spark)
    part = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("layer")).agg(F.array(F.count("*").cast("int")).alias("shape"), F.collect_list(F.col("p_size").cast("float")).alias("values"))
    files.write_weights(part, path, "1$")
    fresh = part.withColumn("values", F.transform("values", lambda v: v * 0))
    found = files.load_weights(fresh, spark.read.parquet(path))
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return found.select("layer", F.col("shape")[0].alias("n"), F.round(total, 2).alias("total"), "loaded")


@query("filter_weight", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1500")
def filter_weight(spark, d):
    return files.within(T.table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 950, 1500)


@query("slice_padded", "SELECT item_id, len(string_split(text, ' ')) AS n, array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)), ',') AS v FROM benchmark")
def slice_padded(spark, d):
    """Rows padded to the longest of their batch and cut back to their own length."""
    words = T.table(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 16).alias("batch"), F.transform(F.split("text", " "), lambda w: F.length(w)).alias("v"))
    both = words.join(words.groupBy("batch").agg(F.max(F.size("v")).alias("m")), "batch").withColumn("n", F.size("v"))
    padded = both.select("item_id", "n", C.padded(F.col("v"), F.col("m"), 0).alias("p"))
    return padded.select("item_id", F.col("n").cast("long").alias("n"), F.array_join(F.slice("p", F.lit(1), F.col("n")).cast("array<string>"), ",").alias("v"))
