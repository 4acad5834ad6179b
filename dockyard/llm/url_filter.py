"""URL filters by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and the start of a path. The keys of a url are its host and each parent domain, each joined
with the starts of its path of the lengths that occur among the rules; so a rule fits a url if and only if
the rule is one of the url's keys. Level 0 of a cascade encodes the listed keys. Level 1 encodes the keys of
the corpus that pass level 0 without being listed, level 2 the listed keys that pass level 1, and so on,
until a level lets nothing wrong through. A key of the corpus then belongs to the list if the first level
that rejects it is an odd one (or none does and the number of levels is odd): exact, without a join.

The filters are sized by the lists alone: the false positives that later levels encode are kept near the size of
the list by giving level 0 about log2(universe / list) bits a key. Their bits are literals of the plan, some three
bytes a listed key, so a list of millions of hosts still travels with the tasks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.llm.shared import table
from dockyard.operators.lineage import cut

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Hosts that are blocked with their subdomains where no rule fits.
BLOCKED_HOSTS = ("adult-x.example.com", "ads-track.example.com", "spam-farm.example.org")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(_after(url), "#", 1)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "/", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(rest, upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after(url), "#", 1), "?", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, rest.substr(at, F.length(rest))).otherwise(F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def keys_of(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys of a url: host and parent domains, with path starts of the given lengths."""
    labels = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda n: F.concat(h, path.substr(F.lit(1), n)))))


class Level:
    """One Bloom filter: ``words`` of 64 bits and ``probes`` positions a key."""

    def __init__(self, words: list[int], probes: int, seed: int):
        self.words, self.probes, self.seed = words, probes, seed

    @staticmethod
    def position(key: Column, k: Column, bits: int, seed: int) -> Column:
        """Double hashing: a start and ``k`` steps, both below ``bits``."""
        start = F.pmod(F.xxhash64(F.lit(2 * seed), key), F.lit(bits))
        step = F.pmod(F.xxhash64(F.lit(2 * seed + 1), key), F.lit(bits))
        return F.pmod(start + step * k, F.lit(bits))

    def passes(self, key: Column) -> Column:
        """The words are one literal, whatever their number: a string that the optimizer folds into an array once."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")

        def is_set(k: Column) -> Column:
            at = self.position(key, k, 64 * len(self.words), self.seed)
            return F.getbit(F.element_at(words, F.shiftright(at, 6).cast("int") + 1), at.bitwiseAND(F.lit(63)).cast("int")) == 1

        return F.forall(F.sequence(F.lit(0), F.lit(self.probes - 1)), is_set)


def _level(keys: DataFrame, count: int, share: float, seed: int) -> Level:
    """A filter over the column ``key`` with false positives of about ``share``."""
    probes = min(20, max(1, round(-math.log2(share))))
    bits = 64 * max(1, math.ceil(count * probes / math.log(2) / 64))
    at = keys.select(F.explode(F.array(*[Level.position(F.col("key"), F.lit(k), bits, seed) for k in range(probes)])).alias("at"))
    rows = (
        at.groupBy(F.shiftright("at", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        .collect()  # at most bits / 64 rows: half a row a listed key
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.bits
    return Level(words, probes, seed)


class Cascade:
    """Levels over a list and the universe of keys it is asked about."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: decided by the first level that rejects it."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(~level.passes(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Build the cascade of ``listed`` (column ``key``, not null) over ``universe`` (column ``key``, repeats are fine).

    Each level has hashes of its own and lets about half of what it is asked pass, so the cascade ends after about
    2 log2(list) levels, of which all together hold a few bits for each listed key.
    """
    listed = listed.select("key").where("key is not null").distinct()
    n = listed.count()
    if not n:
        return Cascade([])
    wide = universe.agg(F.approx_count_distinct("key")).first()[0]
    encode, wrong, count = listed, universe.select("key").where("key is not null"), n
    levels: list[Level] = []
    while count:
        seed = len(levels)
        share = 0.5 if seed else min(0.5, max(1e-9, n * math.sqrt(0.5) / max(wide, 1)))
        levels.append(_level(encode, count, share, seed))
        passed = wrong.where(levels[-1].passes(F.col("key")))
        if seed == 0:  # only here the list and the rest must be told apart; few keys are left of the rest
            passed = passed.distinct().join(listed, "key", "left_anti")
        # What passes is of the list's size; cut, so that no level asks all levels before it again.
        passed = cut(passed)
        encode, wrong, count = passed, encode, passed.count()
    return Cascade(levels)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked_hosts: Sequence[str] = BLOCKED_HOSTS,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Judge every url: columns ``keep``, then ``host``, ``path``, ``rule`` and ``verdict``.

    ``rule`` is the longest rule (host and path joined) that fits; of equally long ones that with the longer
    host. Where none fits it is null and the verdict is ``block`` if the host or a parent domain is in
    ``blocked_hosts``, else ``allow``. A null url, or one without ``://``, has an empty host and path and
    no rule. A repeated row is judged each time; an empty table gives an empty result. Other columns are
    not read, so their names can't clash. A rule given twice, with allow and with block, blocks.
    """
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    split = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = split.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    hosts = keys_of(F.col("host"), F.lit(""), [0])
    blocks = {h + p for h, p, v in rules if v == "block"}
    allows = {h + p for h, p, v in rules if v == "allow"} - blocks
    # One cascade for the three lists: a key is asked for with the letter of its list before it.
    lists = {"A": allows, "B": blocks, "H": set(blocked_hosts)}
    keys = json.dumps([k + x for k, own in lists.items() for x in sorted(own)])
    listed = spark.range(1).select(F.explode(F.from_json(F.lit(keys), "array<string>")).alias("key"))
    asked = F.concat(
        F.flatten(F.transform("keys", lambda k: F.array(F.concat(F.lit("A"), k), F.concat(F.lit("B"), k)))),
        F.transform(hosts, lambda h: F.concat(F.lit("H"), h)),
    )
    found = cascade(listed, keyed.select(F.explode(asked).alias("key")))

    passed = keyed.withColumn("passed", F.filter(asked, found.holds))
    fits = F.transform(F.filter("passed", lambda k: ~k.startswith("H")), lambda k: k.substr(F.lit(2), F.length(k)))
    # The keys come with the longest host first, so the first of the longest is the one wanted.
    at = F.array_position(F.transform("fits", lambda k: F.length(k)), F.array_max(F.transform("fits", lambda k: F.length(k))))
    return (
        passed.withColumn("fits", fits)
        .withColumn("rule", F.when(F.size("fits") > 0, F.try_element_at("fits", at.cast("int"))))
        .withColumn("by_rule", F.array_contains("passed", F.concat(F.lit("B"), F.col("rule"))))
        .withColumn("by_host", F.exists("passed", lambda k: k.startswith("H")))
        .withColumn("verdict", F.when(F.coalesce("by_rule", "by_host"), F.lit("block")).otherwise(F.lit("allow")))
        .select(*keep, "host", "path", "rule", "verdict")
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_HOST = r"""translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
OP9_SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT page_id, row_number() OVER () AS n, coalesce({_HOST}, '') AS host,
             coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
      FROM u JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p))
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN v
            WHEN {" OR ".join(f"host = '{h}' OR suffix(host, '.{h}')" for h in BLOCKED_HOSTS)} THEN 'block'
            ELSE 'allow' END AS verdict
FROM u LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (n)
"""
