"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models for what no pattern knows.

Two models of first order, of random strings and of ordinary identifiers, give each character a probability after the one
before it. A candidate (a run of at least ``LEAST`` characters of ``ALPHABET`` that holds a letter) is a secret where the
log-likelihood ratio of the two reaches ``ODDS``. Both are trained on labelled samples. By default these come from the
documents: values that the fixed patterns match are random, and as the same bytes may be spelled otherwise, each hexadecimal
one is also learned in capitals and in base 64; other runs of 8 characters and more are identifiers, learned as they are, in
small letters and in capitals. The samples are those of about ``MAX_DOCS`` documents, drawn by a hash of the text.

The tables of log ratios have a fixed size and are literals of the plan, in whole thousandths, so sums are exact. A text is
split by each pattern; positions are running sums of the lengths of what lies between and of what matches. No row is moved
and none is joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.llm.shared import table

#: The patterns of the base kinds, the group whose length counts and its least length.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", r"([0-9a-f]{32,})", 1, 32),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE, IDENTIFIER = r"([A-Za-z0-9+/_=-]{%d,})", r"([A-Za-z0-9+/_=-]{8,})"
#: Characters of a candidate, thousandths of the log-likelihood ratio asked for, documents of the samples, and the weight of
#: what is known without a transition: a uniform choice for random strings, the character's own share for identifiers.
LEAST, ODDS, MAX_DOCS, PRIOR = 16, 10_000, 5_000, 20.0
K = len(ALPHABET)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def running(lengths: Column, block: int = 512) -> Column:
    """Running sums of an array of longs, in two levels, so that long arrays take about n * block steps."""
    add = lambda s, x: s + x
    part = lambda b: F.slice(lengths, b * block + 1, F.lit(block))
    blocks = F.sequence(F.lit(0), F.ceil(F.size(lengths) / F.lit(block)).cast("int") - 1)
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0).cast("long"), add))

    def inner(b: Column, before: Column) -> Column:
        grow = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))
        return let(F.aggregate(part(b), F.array(before), grow), lambda s: F.slice(s, F.lit(2), F.size(s)))

    made = let(sums, lambda t: F.flatten(F.transform(blocks, lambda b: inner(b, F.aggregate(F.slice(t, F.lit(1), b), F.lit(0).cast("long"), add)))))
    return F.when(F.size(lengths) > 0, made).otherwise(F.array().cast("array<long>"))


SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def spans(text: Column, pattern: str, kind: int, group: int, passes: Callable[[Column], Column]) -> Column:
    """Matches, leftmost first and not overlapping, whose group ``passes``: where they start and end in characters."""
    none = F.array().cast(SPAN)
    found = F.struct(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def placed(s: Column) -> Column:
        size = lambda x: F.length(x).cast("long")
        steps = F.zip_with(F.slice(s["between"], F.lit(1), F.size(s["all"])), s["all"], lambda g, m: size(g) + size(m))
        ends = let(steps, running)
        made = F.transform(
            F.arrays_zip(ends.alias("end"), s["all"].alias("all"), s["value"].alias("value")),
            lambda x: F.struct((x["end"] - size(x["all"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")),
        )
        return F.filter(made, lambda x: passes(x["value"]))

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind."""
    own = [spans(text, p, i, g, lambda v, n=n: F.length(v) >= n) for i, (_, p, g, n) in enumerate(BASE)]
    return F.array_sort(F.concat(*own))


def blanked(text: Column) -> Column:
    """The text with the characters of matches of the fixed patterns, one pattern after the other, as blanks."""
    for _, pattern, group, least in BASE:
        found = F.struct(
            F.split(text, pattern, -1).alias("between"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        )

        def joined(s: Column, least: int = least) -> Column:
            blank = lambda m, v: F.when(F.length(v) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m)
            matches = F.concat(F.zip_with(s["all"], s["value"], blank), F.array(F.lit("")))
            return F.array_join(F.zip_with(s["between"], matches, lambda g, m: F.concat(g, m)), "")

        text = F.when(text.rlike(pattern), let(found, joined)).otherwise(text)
    return text


def samples_of(docs: DataFrame, text: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """Labelled samples of about ``max_docs`` documents: ``value`` and ``random`` (1, 0), each value once."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    share = max_docs / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") < int(share * 2**32))
    known = rows.select(base_spans(F.col("t")).alias("s"), blanked(F.col("t")).alias("t"))
    value = F.col("v")
    pairs = F.col("v").rlike("^([0-9a-f]{2})+$")
    spelled = F.when(pairs, F.array(value, F.upper(value), F.rtrim(F.base64(F.unhex(value)), F.lit("=")))).otherwise(F.array(value))
    secret = known.select(F.explode(F.transform("s", lambda x: x["value"])).alias("v")).distinct().select(F.explode(spelled).alias("value"), F.lit(1).alias("random"))
    found = F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(1))))
    usual = known.select(found.alias("v")).distinct().select(F.explode(F.array(value, F.lower(value), F.upper(value))).alias("value"), F.lit(0).alias("random"))
    return secret.unionByName(usual).distinct()


class Model:
    """Thousandths of log-likelihood ratios: ``first`` by character, ``then`` by pairs of characters."""

    def __init__(self, pairs: dict[tuple[int, str], int], prior: float = PRIOR):
        """``pairs``: how often two characters follow each other, by label (1 random, 0 ordinary)."""
        place = {c: i for i, c in enumerate(ALPHABET)}
        counts = [[[0] * K for _ in range(K)] for _ in (0, 1)]
        for (y, p), n in pairs.items():
            counts[y][place[p[0]]][place[p[1]]] += n
        alone = [[sum(row[b] for row in counts[y]) for b in range(K)] for y in (0, 1)]
        share = [[(c + 1) / (sum(own) + K) for c in own] for own in alone]
        base = [share[0], [1 / K] * K]

        def after(y: int, a: int, b: int) -> float:
            return (counts[y][a][b] + prior * base[y][b]) / (sum_[y][a] + prior)

        sum_ = [[sum(row) for row in counts[y]] for y in (0, 1)]
        self.first = [math.floor(1000 * math.log(share[1][b] / share[0][b])) for b in range(K)]
        self.then = [math.floor(1000 * math.log(after(1, a, b) / after(0, a, b))) for a in range(K) for b in range(K)]

    def ratio(self, value: Column) -> Column:
        """The log-likelihood ratio of a string of characters of ``ALPHABET``, in thousandths."""
        literal = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
        first, then = literal(self.first), literal(self.then)
        codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

        def total(c: Column) -> Column:
            steps = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(then, a * K + b))
            return F.aggregate(steps, F.get(first, F.get(c, F.lit(0))), lambda s, x: s + x)

        return let(codes, total)


def fit(samples: DataFrame, prior: float = PRIOR) -> Model:
    """Count the pairs of characters of the labelled samples (``value``, ``random``).

    Pairs with a character outside the alphabet, null values and null labels count nothing. Without samples of a class its
    model is the smoothing alone. At most 2 * K^2 counts reach the driver.
    """
    pairs = let(F.split("value", ""), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.concat(a, b)))
    own = samples.where("random is not null and length(value) > 1").select((F.col("random") > 0).cast("int").alias("y"), F.explode(pairs).alias("p"))
    inside = own.where(F.col("p").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    return Model({(r.y, r.p): r["count"] for r in inside.groupBy("y", "p").count().collect()}, prior)


def scan_secrets(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, odds: int = ODDS) -> DataFrame:
    """Columns ``keep``, then ``base`` and ``random``: arrays of spans (``start``, ``kind``, ``end``, ``value``) by start.

    ``kind`` is the place among ``BASE``, and one more than the last for spans of the models, which are looked for in what
    the base spans leave. A null or empty text has none. Texts of any length are scanned whole; repeated rows are scanned
    each; an empty table gives an empty result; other columns are not read, so their names can't clash.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("base", base_spans(F.col("_t")))
    secret = lambda v: v.rlike("[A-Za-z]") & (model.ratio(v) >= odds)
    left = rows.withColumn("_left", blanked(F.col("_t")))
    return left.select(*keep, "base", spans(F.col("_left"), CANDIDATE % least, len(BASE), 1, secret).alias("random"))


def named(places: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("random"))
    return F.array_join(F.transform(places, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, fit(samples_of(docs)))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.array_sort(F.concat("base", "random"))).alias("spans")
    )


def _sql() -> str:
    base = ", ".join(f"({i}, '{k}', {n})" for i, (k, _, _, n) in enumerate(BASE))

    def split(t: str, pattern: str, group: int) -> str:
        p = pattern.replace("'", "''")
        return f"string_split_regex({t}, '{p}') AS g, regexp_extract_all({t}, '{p}', 0) AS a, regexp_extract_all({t}, '{p}', {group}) AS v"

    found = " UNION ALL ".join(f"SELECT id, {i} AS kind, {split('t', p, g)} FROM d" for i, (_, p, g, _) in enumerate(BASE))
    left = "".join(
        f"s{i} AS (SELECT id, {split('t', p, g)} FROM {f'l{i - 1}' if i else 'd'}), l{i} AS (SELECT id, array_to_string(list_transform("
        f"range(1, len(a) + 1), lambda i: g[i] || CASE WHEN len(v[i]) >= {n} THEN repeat(' ', len(a[i])) ELSE a[i] END), '') || g[-1] AS t FROM s{i}),\n"
        for i, (_, p, g, n) in enumerate(BASE)
    )
    last = f"l{len(BASE) - 1}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
base(kind, name, least) AS (VALUES {base}),
{left}found AS ({found}
  UNION ALL SELECT id, {len(BASE)} AS kind, {split('t', CANDIDATE % LEAST, 1)} FROM {last}),
steps AS (SELECT id, kind, unnest(range(1, len(a) + 1)) AS i, g, a, v FROM found),
placed AS (SELECT id, kind, v[i] AS v, len(a[i]) AS size, sum(len(g[i]) + len(a[i])) OVER (PARTITION BY id, kind ORDER BY i) AS e FROM steps),
fixed AS (SELECT id, kind, name, e - size AS s, e, v FROM placed JOIN base USING (kind) WHERE len(v) >= least),
total AS (SELECT greatest(1, count(*)) AS n FROM d),
sample AS (SELECT id FROM d, total WHERE n <= {MAX_DOCS} OR substr(md5(t), 1, 8) < format('{{:08x}}', ({MAX_DOCS} / n * 4294967296)::BIGINT)),
secret AS (SELECT DISTINCT v FROM fixed JOIN sample USING (id)),
usual AS (SELECT DISTINCT unnest(regexp_extract_all(t, '{IDENTIFIER}', 1)) AS v FROM {last} JOIN sample USING (id)),
samples AS (
  SELECT DISTINCT 1 AS y, unnest(CASE WHEN regexp_full_match(v, '([0-9a-f]{{2}})+') THEN [v, upper(v), rtrim(base64(unhex(v)), '=')] ELSE [v] END) AS v FROM secret
  UNION ALL SELECT DISTINCT 0 AS y, unnest([v, lower(v), upper(v)]) AS v FROM usual),
pairs AS (SELECT y, substr(v, i, 1) AS a, substr(v, i + 1, 1) AS b, count(*) AS c FROM (SELECT y, v, unnest(range(1, len(v))) AS i FROM samples)
          WHERE contains('{ALPHABET}', substr(v, i, 1)) AND contains('{ALPHABET}', substr(v, i + 1, 1)) GROUP BY ALL),
chars AS (SELECT unnest(string_split('{ALPHABET}', '')) AS x),
grid AS (SELECT y, l.x AS a, r.x AS b FROM chars l, chars r, (VALUES (0), (1)) AS ys(y)),
counted AS (SELECT y, a, b, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY y, a) AS n,
                   sum(coalesce(c, 0)) OVER (PARTITION BY y, b) AS nb, sum(coalesce(c, 0)) OVER (PARTITION BY y) AS nn
            FROM grid LEFT JOIN pairs USING (y, a, b)),
shares AS (SELECT *, (nb + 1)::DOUBLE / (nn + {K}) AS share FROM counted),
after AS (SELECT *, (c + {PRIOR}::DOUBLE * CASE y WHEN 1 THEN 1::DOUBLE / {K} ELSE share END) / (n + {PRIOR}::DOUBLE) AS p FROM shares),
step AS (SELECT a, b, floor(1000 * ln(max(p) FILTER (y = 1) / max(p) FILTER (y = 0)))::BIGINT AS g FROM after GROUP BY ALL),
begin AS (SELECT b, floor(1000 * ln(max(share) FILTER (y = 1) / max(share) FILTER (y = 0)))::BIGINT AS g FROM shares GROUP BY ALL),
cand AS (SELECT * FROM placed WHERE kind = {len(BASE)} AND regexp_matches(v, '[A-Za-z]')),
sums AS (SELECT id, e, sum(g) AS g FROM (SELECT id, e, substr(v, i, 1) AS a, substr(v, i + 1, 1) AS b FROM (SELECT *, unnest(range(1, len(v))) AS i FROM cand))
         JOIN step USING (a, b) GROUP BY ALL),
random AS (SELECT id, {len(BASE)} AS kind, 'random' AS name, e - size AS s, e FROM cand JOIN sums USING (id, e) JOIN begin ON begin.b = substr(v, 1, 1)
           WHERE sums.g + begin.g >= {ODDS}),
every AS (SELECT id, kind, name, s, e FROM fixed UNION ALL SELECT * FROM random),
told AS (SELECT id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex,
                string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)}) AS base,
                string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM every GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (id)
"""


OP11_SQL = _sql()
